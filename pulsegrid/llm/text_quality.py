"""Per-document text statistics, and the share of prose, lists, tables and junk."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that sentences need and lists, tables and headings can do without. Articles are left out, as names in lists
#: have them too. Fixed values.
FUNCTION_WORDS = {
    "en": "of to in is for through then upon and or that which by with on at from as be are was were may can has have had not than if when whereby wherein this these those it its between into least only so such even also other both before after there no should would could however moreover thereby each any does do been but where while whose during without until about",
    "de": "und oder in im ist sind mit bei nach von vom zu zum zur für auf an am aus dass wobei wird werden wurde nicht als auch durch über unter sich dem den kann können so wie um vor bis zwischen einem einer eines ein eine dadurch umfassend hierdurch sobald dabei es aus blieb innerhalb",
    "fr": "et ou de du des dans est sont avec par pour sur en que qui selon une un ce cette ces peut être au aux à pas ne se son sa ses entre lequel laquelle comprenant caractérisé ainsi lors après avant plus même",
    "es": "y o de del en es son con por para que se según una un este esta su sus al no puede entre cual como más cuando comprende donde porque está antes después durante lo mediante",
}
#: Chinese characters and Japanese kana of the same kind. Fixed values.
FUNCTION_SIGNS = "的是在了和与可以从至为其所之时当后先中有由此使对及被将该于不如"
SENTENCE_SIGNS = ".,;:!?。、，；：！？"
STOPS = ".!?:。！？："
INNER_SIGNS = "()[]'\"’‘“”„«»（）【】「」-‐‑%°§&/µ²³"
BULLET_SIGNS = "•·*–—▪◦‣"
LANGUAGES = [*FUNCTION_WORDS, "ja", "zh"]
CATEGORIES = ["function", "content", "kana", "han", "digit", "sentence", "inner", "bullet", "mark", "junk"]
BLANK, NEWLINE, LETTER, KANA, HAN, HAN_FUNCTION, DIGIT, SENTENCE, INNER, BULLET, MARK, JUNK, TAB = range(13)
#: Shares of the categories among the non-blank characters of a segment, by structural profile. "function" are words of the
#: segment's own language. Prose of each language has the median share of function words that its documents in the test
#: data have (1,717 English, 136 German, 99 French, 110 Spanish ones with prose).
PROFILES = {
    "prose_en": [0.20, 0.72, 0.0, 0.0, 0.02, 0.03, 0.02, 0.0, 0.01, 0.0],
    "prose_de": [0.23, 0.69, 0.0, 0.0, 0.02, 0.03, 0.02, 0.0, 0.01, 0.0],
    "prose_fr": [0.21, 0.70, 0.0, 0.0, 0.03, 0.03, 0.02, 0.0, 0.01, 0.0],
    "prose_es": [0.21, 0.69, 0.0, 0.0, 0.04, 0.03, 0.02, 0.0, 0.01, 0.0],
    "prose_wordy": [0.40, 0.53, 0.0, 0.0, 0.02, 0.03, 0.02, 0.0, 0.0, 0.0],
    "prose_numeric": [0.20, 0.58, 0.0, 0.0, 0.13, 0.05, 0.04, 0.0, 0.0, 0.0],
    "prose_ja": [0.0, 0.02, 0.50, 0.35, 0.05, 0.06, 0.02, 0.0, 0.0, 0.0],
    "prose_zh": [0.25, 0.02, 0.0, 0.57, 0.05, 0.09, 0.02, 0.0, 0.0, 0.0],
    "label": [0.0, 0.96, 0.0, 0.0, 0.01, 0.01, 0.02, 0.0, 0.0, 0.0],
    "label_cjk": [0.0, 0.0, 0.12, 0.78, 0.0, 0.0, 0.10, 0.0, 0.0, 0.0],
    "list": [0.0, 0.86, 0.0, 0.0, 0.02, 0.05, 0.01, 0.06, 0.0, 0.0],
    "list_cjk": [0.0, 0.0, 0.10, 0.66, 0.08, 0.06, 0.02, 0.08, 0.0, 0.0],
    "list_numbered": [0.0, 0.70, 0.0, 0.0, 0.18, 0.06, 0.06, 0.0, 0.0, 0.0],
    "table": [0.0, 0.22, 0.0, 0.0, 0.58, 0.12, 0.02, 0.0, 0.06, 0.0],
    "table_marks": [0.0, 0.12, 0.0, 0.0, 0.45, 0.12, 0.03, 0.0, 0.28, 0.0],
    "table_text": [0.0, 0.58, 0.0, 0.0, 0.22, 0.08, 0.04, 0.0, 0.08, 0.0],
    "junk_signs": [0.0, 0.25, 0.0, 0.0, 0.03, 0.16, 0.16, 0.06, 0.30, 0.04],
    "junk_boxes": [0.0, 0.20, 0.0, 0.0, 0.0, 0.12, 0.0, 0.0, 0.08, 0.60],
    "junk_page": [0.10, 0.66, 0.0, 0.0, 0.17, 0.0, 0.0, 0.06, 0.0, 0.0],
    "junk_dots": [0.0, 0.20, 0.0, 0.0, 0.05, 0.72, 0.0, 0.03, 0.0, 0.0],
}
STRUCTURES = ["prose", "list", "table", "junk"]
#: A line longer than LONG is judged in pieces of some PIECE characters.
LONG, PIECE_CHARS = 200, 120
#: So many label-like segments in a row are a list; fewer are headings.
LABEL_RUN = 3
#: So many lines in a row shorter than SHORT_LINE, none ending as sentences do, are a list whatever words they have.
SHORT_RUN, SHORT_LINE = 5, 36
#: A label-like segment of so many signs that has a function word and ends as sentences do is a sentence.
SENTENCE_CHARS = 40
#: A segment with a number and a sign such as = or -> between blanks for every so many characters is a table row.
CHARS_PER_PAIR = 45
#: Characters worked on at a time.
SLAB = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of each code point of the basic plane, weights of the word hash, hashes of function words and the
    languages that have them, as bits."""
    kind = np.full(0x10000, JUNK, np.uint8)
    low = np.arange(0x10000, dtype=np.uint16)
    for c in range(0x10000):
        s = chr(c)
        cat = unicodedata.category(s)
        if cat[0] == "L" or cat[0] == "M":
            kind[c] = LETTER
            if len(s.lower()) == 1 and ord(s.lower()) < 0x10000:
                low[c] = ord(s.lower())
        elif cat[0] == "N":
            kind[c] = DIGIT
        elif cat in ("Zs", "Zl", "Zp", "Cc", "Cf"):
            kind[c] = BLANK
        elif cat[0] in "PS":
            kind[c] = MARK
    kind[0x3040:0x3100] = KANA
    kind[0x3400:0xA000] = HAN
    kind[0x2500:0x2700] = JUNK
    for signs, k in ((FUNCTION_SIGNS, HAN_FUNCTION), (SENTENCE_SIGNS, SENTENCE), (INNER_SIGNS, INNER), (BULLET_SIGNS, BULLET), ("¤�", JUNK), ("\n\r  \x0b\x0c\x85", NEWLINE), ("\t", TAB)):
        kind[[ord(c) for c in signs]] = k
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    hashes = np.array([(np.array([ord(c) for c in w], np.uint64) * power[: len(w)]).sum() for w in words], np.uint64)
    bits = np.array([sum(1 << i for i, ws in enumerate(FUNCTION_WORDS.values()) if w in ws.split()) for w in words], np.uint8)
    return kind, low, power, np.sort(hashes), bits[np.argsort(hashes)]


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


def nearest_profile(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the profile with the smallest Jensen-Shannon divergence from each row of shares, and that divergence."""
    own = _entropy(shares)
    best, near = np.full(len(shares), np.inf), np.zeros(len(shares), np.int8)
    for i, q in enumerate(np.array(list(PROFILES.values()))):
        q = q / q.sum()
        d = _entropy((shares + q) / 2) - (own + _entropy(q)) / 2
        closer = d < best
        best[closer], near[closer] = d[closer], i
    return near, best


def describe(texts: list[str]) -> dict[str, np.ndarray]:
    """Statistics of each text, worked out for all of them at once."""
    kind_of, lower, power, known, spoken = _tables()
    n_docs = len(texts)
    cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), [len(t) + 1 for t in texts])
    c16 = np.minimum(cp, 0xFFFF).astype(np.uint16)
    kind = kind_of[c16]
    kind[(cp >= 0x20000) & (cp < 0x40000)] = HAN
    n = len(cp)
    solid = (kind != BLANK) & (kind != NEWLINE) & (kind != TAB)

    # segments: lines, long ones cut at sentence ends and at blanks some PIECE_CHARS apart
    line = np.zeros(n, np.int32)
    line[1:] = np.cumsum(kind[:-1] == NEWLINE)
    line_at = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    width = np.diff(np.append(line_at, n))
    cut = np.zeros(n, bool)
    cut[line_at] = True
    long = width[line] > LONG
    before = np.append(0, c16[:-1])
    before2 = np.append(0, before[:-1])
    ended = long & (((kind == BLANK) & np.isin(before, [46, 33, 63]) & (kind_of[before2] != DIGIT)) | np.isin(before, [0x3002, 0xFF01, 0xFF1F]))
    step = (np.arange(n) - line_at[line]) // PIECE_CHARS
    gap = np.flatnonzero(long & (kind == BLANK))
    if len(gap):
        cut[gap[np.append(True, (step[gap[1:]] != step[gap[:-1]]) | (line[gap[1:]] != line[gap[:-1]]))]] = True
    cut |= ended
    seg = np.cumsum(cut) - 1
    n_seg = int(seg[-1]) + 1

    # words: runs of letters; a word's hash is compared with those of the function words
    letter = kind == LETTER
    starts = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    ends = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
    size = ends - starts
    short = size <= 14
    tongues = np.zeros(len(starts), np.uint8)  # languages of which a word is a function word
    if short.any():
        s, k = starts[short], size[short]
        h = np.zeros(len(s), np.uint64)
        for j in range(14):
            more = k > j
            h[more] += lower[c16[s[more] + j]].astype(np.uint64) * power[j]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        tongues[short] = np.where(known[at] == h, spoken[at], 0)
    by_tongue = [np.bincount(seg[starts], size * (tongues >> i & 1), n_seg) for i in range(len(FUNCTION_WORDS))]
    function_chars = np.max(by_tongue, axis=0)  # a segment is in the language that most of its function words are of
    function = tongues > 0

    counts = np.bincount(seg[solid] * 13 + kind[solid], minlength=n_seg * 13).reshape(n_seg, 13).astype(float)
    total = counts.sum(axis=1)
    shares = np.stack([
        function_chars + counts[:, HAN_FUNCTION], counts[:, LETTER] - function_chars, counts[:, KANA], counts[:, HAN], counts[:, DIGIT], counts[:, SENTENCE],
        counts[:, INNER], counts[:, BULLET], counts[:, MARK], counts[:, JUNK],
    ], axis=1) / np.maximum(total, 1)[:, None]
    near, _ = nearest_profile(shares)
    names = [p.split("_")[0] for p in PROFILES]
    structure = np.array([STRUCTURES.index(p) if p in STRUCTURES else 4 for p in names])[near]  # 4: a label

    # what the first sign and the blanks of a segment say
    seg_at = np.flatnonzero(cut)
    seg_doc = doc[seg_at]
    first = np.full(n_seg, -1)
    inked = np.flatnonzero(solid)
    first[seg[inked[::-1]]] = inked[::-1]
    lead = np.where(first >= 0, kind[first], BLANK)
    after_lead = kind[np.minimum(first + 1, n - 1)]
    bulleted = (first >= 0) & ((lead == BULLET) | (c16[first] == 45)) & (after_lead == BLANK)
    tabs = np.bincount(seg[kind == TAB], minlength=n_seg)
    wide = (kind == BLANK) & np.append(False, kind[:-1] == BLANK)
    gaps = np.bincount(seg[wide & (np.append(False, ~wide[:-1]))], minlength=n_seg)
    bars = np.bincount(seg[c16 == 124], minlength=n_seg)
    sentence = shares[:, 0] + shares[:, 2]
    blank = ~solid
    pair = np.isin(c16, (58, 61, 62, 0xFF1A)) & np.append(blank[1:], False) & (np.append(False, blank[:-1]) | (before == 45))
    pairs = np.bincount(seg[pair], minlength=n_seg)
    structure[(structure != 3) & bulleted] = 1
    structure[(structure != 3) & (tabs >= 2) | (bars >= 2) | ((gaps >= 2) & (shares[:, 4] > 0.2))] = 2
    structure[(structure == 0) & (sentence == 0) & (shares[:, 4] > 0.25)] = 2
    structure[(pairs * CHARS_PER_PAIR >= total) & (pairs > 0) & (shares[:, 4] > 0.05)] = 2

    end_sign = np.zeros(n_seg, np.uint16)
    end_sign[seg[inked]] = c16[inked]
    full_stop = np.isin(end_sign, [ord(c) for c in STOPS])
    structure[(structure == 4) & full_stop & (shares[:, 0] > 0) & (total >= SENTENCE_CHARS)] = 0

    # a few labels in a row are headings, more are a list; blank segments do not count
    real = np.flatnonzero(total > 0)
    label = structure[real] == 4
    other = np.append(True, (label[1:] != label[:-1]) | (seg_doc[real][1:] != seg_doc[real][:-1])) if len(real) else np.zeros(0, bool)
    run = np.cumsum(other) - 1
    length = np.bincount(run)[run] if len(real) else run
    between = np.zeros(len(real), bool)
    if len(real):
        nb = np.append([9], structure[real][:-1]), np.append(structure[real][1:], [9])
        between = np.isin(nb[0], (1, 2)) & np.isin(nb[1], (1, 2))
    stub = (total[real] < SHORT_LINE) & ~full_stop[real]
    stub_run = np.cumsum(np.append(True, (stub[1:] != stub[:-1]) | (seg_doc[real][1:] != seg_doc[real][:-1]))) - 1 if len(real) else run
    many = stub & (np.bincount(stub_run)[stub_run] >= SHORT_RUN) if len(real) else stub
    structure[real[label]] = np.where((length[label] >= LABEL_RUN) | between[label], 1, 0)
    structure[real[many & (structure[real] == 0)]] = 1

    per = {s: np.bincount(seg_doc, total * (structure == i), n_docs) for i, s in enumerate(STRUCTURES)}
    chars = np.bincount(doc[solid], minlength=n_docs)
    words = np.bincount(doc[starts], minlength=n_docs)
    common = np.bincount(doc[starts], function, n_docs)
    signs = solid & np.isin(kind, (MARK, BULLET, JUNK))
    last = np.full(int(line[-1]) + 1, -1)
    last[line[inked]] = inked
    inked_line = last >= 0
    line_doc = doc[line_at]
    lines = np.bincount(line_doc[inked_line], minlength=n_docs)
    stopped = np.bincount(line_doc[inked_line], (kind[last] == SENTENCE)[inked_line], n_docs)
    shares_doc = np.stack([np.bincount(seg_doc, shares[:, i] * total, n_docs) for i in range(len(CATEGORIES))], axis=1) / np.maximum(chars, 1)[:, None]
    doc_near, divergence = nearest_profile(shares_doc)
    heard = np.stack([*[np.bincount(seg_doc, x, n_docs) for x in by_tongue], np.bincount(seg_doc, counts[:, KANA], n_docs), np.bincount(seg_doc, counts[:, HAN_FUNCTION], n_docs)])
    heard[-1] *= heard[-2] < heard[-1]  # Japanese has Chinese signs too
    language = np.where(heard.max(axis=0) > 0, heard.argmax(axis=0), len(heard))
    some = np.maximum(chars, 1)
    return {
        "chars": chars, "words": words, "word_length": np.bincount(doc[starts], size, n_docs) / np.maximum(words, 1), "symbol_ratio": np.bincount(doc[signs], minlength=n_docs) / some,
        "lines": lines, "line_end_share": stopped / np.maximum(lines, 1), "common_word_share": common / np.maximum(words, 1),
        **{f"{s}_share": v / some for s, v in per.items()}, "profile": np.array(list(PROFILES))[doc_near], "divergence": divergence, "language": np.array([*LANGUAGES, ""])[language],
    }


SCHEMA = "chars bigint, words bigint, word_length double, symbol_ratio double, lines bigint, line_end_share double, common_word_share double, prose_share double, list_share double, table_share double, junk_share double, profile string, divergence double, language string"


def _describe(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        while at < b.num_rows:  # so many texts as fill a slab, one at least
            texts, size, start = [], 0, at
            while at < b.num_rows and (not texts or size < SLAB):
                texts.append(b[text][at].as_py() or "")
                size += len(texts[-1])
                at += 1
            d = describe(texts)
            blank = d["chars"] == 0
            profile = [None if z else p.split("_")[0] for p, z in zip(d["profile"].tolist(), blank)]
            d["language"] = [x or None for x in d["language"].tolist()]
            cols = [pa.array(profile if k == "profile" else v, pa.string()) if k in ("profile", "language") else pa.array(v.astype(np.int64) if v.dtype.kind == "i" else v) for k, v in d.items()]
            yield pa.RecordBatch.from_arrays([b[key].slice(start, at - start), *cols], [key, *d])


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of each text: (key, chars = non-blank characters, words = runs of letters, word_length,
    symbol_ratio, lines = lines with anything on them, line_end_share = those that end in punctuation,
    common_word_share, prose_share, list_share, table_share, junk_share of the non-blank characters, profile and
    divergence = the structural profile nearest to the whole text, language = that of most of its function words or
    signs, null without any).

    Every segment (a line, or a piece of a long line) is in the language that most of its function words are of, and gets
    the profile whose distribution of that language's function words and of character classes has the smallest
    Jensen-Shannon divergence from the segment's own; leading bullets, tabs and bars settle lists and tables, and
    segments like headings are prose unless many follow one another.

    Null, empty and blank texts get zeros and a null profile. Whole texts are read, of any length and language, each
    where it lies: there is no shuffle. Repeated rows are described each; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(partial(_describe, key=key, text=text), f"`{key}` {kind}, {SCHEMA}")


def without_prose(stats: DataFrame, least: float = 0.5) -> DataFrame:
    """Texts of which more than `least` of the non-blank characters are list entries, table cells or junk."""
    return stats.where((F.col("chars") > 0) & (1 - F.col("prose_share") > least))
