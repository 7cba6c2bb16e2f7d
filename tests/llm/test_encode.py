import array
import random

import pytest

from pulsegrid.llm import encode as N

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(N.TOKENIZERS), reason="no vocabulary files here")
DOC = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def oracle():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{N.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ours():
    e = N.encoder(f"{N.TOKENIZERS}/{N.VOCABULARY}")

    def run(s):
        a = array.array("i")
        e.encode(s, a)
        return list(a)

    return run


TEXTS = [
    "", " ", "\n", "a", "Hello world", "  two  spaces \n\n\t x ", "it's we'll I'VE 's 'sfoo ''s \n's", "x y　z w", "<|endoftext|> <|startoftext|>", "ﬁ ǆ İ ß é é", "日本語の文章、そして漢字。", "中文字符 与 标点，",
    "12345 1.5e10 ½ ² Ⅳ", "\x00\x1c\x85​", "😀👩‍👩‍👧 flags 🇩🇪", "a" * 3000, " " * 700, "ab" * 900, "-" * 1000, "漢" * 900, "é" * 800, "\r\n\r\n  x", "﻿bom", "����",
]


def test_equals_the_public_library(oracle, ours):
    for s in TEXTS:
        assert ours(s) == oracle(s), s[:40]


def test_random_texts(oracle, ours):
    rng = random.Random(1)
    parts = [*"abcXYZ019 '\n\t.,;-_=", "'s", " the", "ing", "é", "漢", "ば", "😀", " ", "　", "  ", "\r\n", "Ⅳ", "́"]
    for n in (3, 10, 40, 300):
        for _ in range(60):
            s = "".join(rng.choice(parts) for _ in range(n))
            assert ours(s) == oracle(s), repr(s)


def parts_of(rng, n):
    return "".join(rng.choice(["un", "believ", "able", "ing", "x", "zq", "the", "a", "aa", "--", "é"]) for _ in range(n)).encode()


def test_the_transducer_needs_little_memory_and_emits_early():
    m = N.encoder(f"{N.TOKENIZERS}/{N.VOCABULARY}").merges
    rng = random.Random(2)
    data = parts_of(rng, 12_000)
    t, out, most, late = N.Transducer(m), [], 0, 0
    at = 0
    while at < len(data):
        n = rng.choice([1, 5, 100, 700, 5000])
        out += t.feed(data[at : at + n])
        at += n
        most, late = max(most, len(t.last)), max(late, min(at, len(data)) - sum(m.lengths[i] for i in out))
    assert len(out) > 0 and most <= 3 * m.lookahead and late <= 3 * m.lookahead
    out += t.finish()
    assert b"".join(m.tokens[i] for i in out) == data
    assert out == [m.ranks[p] for p in m.merge(data[:6000])][:-500] + out[len(m.merge(data[:6000])) - 500 :]


def test_what_lies_a_lookahead_back_is_final():
    m = N.encoder(f"{N.TOKENIZERS}/{N.VOCABULARY}").merges
    assert m.longest < m.lookahead < 2000
    rng = random.Random(4)
    for _ in range(6):
        data = parts_of(rng, 900)
        n = len(data) // 2
        ends = []
        for stop in [n, len(data), *rng.sample(range(n, len(data)), 3)]:
            at, e = 0, set()
            for p in m.merge(data[:stop]):
                at += len(p)
                e.add(at)
            ends.append({x for x in e if x <= n - m.lookahead})
        assert all(e == ends[0] for e in ends) and ends[0]


def test_fits_is_what_merging_both_gives():
    m = N.encoder(f"{N.TOKENIZERS}/{N.VOCABULARY}").merges
    rng = random.Random(5)
    for text in ("aaaaaaaa", "abababab", "-=-=-=-=", "thetheir", "    \n\n  "):
        pairs = [(text[:i].encode(), text[i:j].encode()) for j in range(2, len(text) + 1) for i in range(1, j)]
        for a, b in [p for p in pairs if p[0] in m.ranks and p[1] in m.ranks]:
            assert m.fits(m.ranks[a], m.ranks[b]) == (m.merge(a + b) == [a, b]), (a, b)
    short = [i for i, b in m.tokens.items() if len(b) < 12]
    for _ in range(3000):
        a, b = rng.choice(short), rng.choice(short)
        assert m.fits(a, b) == (m.merge(m.tokens[a] + m.tokens[b]) == [m.tokens[a], m.tokens[b]])


def test_every_byte_goes_through_the_transducer(monkeypatch, ours, oracle):
    took = 0
    step = N.Transducer._step

    def counted(self, data):
        nonlocal took
        took += len(data)
        step(self, data)

    monkeypatch.setattr(N.Transducer, "_step", counted)
    monkeypatch.setattr(N, "SHORT", 0)  # nothing is remembered
    N.encoder(f"{N.TOKENIZERS}/{N.VOCABULARY}").clear()
    text = " ".join(TEXTS)
    assert ours(text) == oracle(text) and took == len(text.encode())


def test_the_text_machine():
    data = "aé漢😀".encode() + b"\xf0\x9f" + "x".encode() + b"\xe6\xbc"
    for cuts in (1, 2, 3, 5):
        t = N.TextMachine()
        got = [t.feed(data[k : k + cuts]) for k in range(0, len(data), cuts)]
        assert "".join(got) + t.finish() == data.decode("utf-8", "replace")
        assert all(len(g.encode()) <= cuts + 3 for g in got)


def test_slices_change_nothing(monkeypatch, ours):
    s = "".join(random.Random(3).choice(["word ", "it's ", "\n", "  ", "12, ", "漢字", "x"]) for _ in range(3000))
    whole = ours(s)
    monkeypatch.setattr(N, "SLICE", 50)
    assert ours(s) == whole


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hi", "x"), (3, "Hi", "x"), (None, "Hi", "x")], DOC)
    got = sorted(((r.doc_id, r.ids) for r in N.encode_texts(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [17250]), (3, [17250]), (None, [17250])], key=str)
    assert N.encode_texts(df.where("false")).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame([(i, s, "") for i, s in enumerate(TEXTS)], DOC)
    back = {r.doc_id: r.text for r in N.decode_ids(N.encode_texts(df)).collect()}
    assert back == dict(enumerate(TEXTS))
    bad = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.text for r in N.decode_ids(bad).collect()} == {""}
