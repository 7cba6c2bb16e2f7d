"""Encoding of a corpus with a byte-level BPE vocabulary, and decoding it again."""

from __future__ import annotations

import array
import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie on every machine.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: What a piece is, as the vocabulary was trained with. Fixed value.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Here a text can be cut without a piece changing: a run of white space begins a piece whatever stands before it.
CUT = regex.compile(r"(?<=\S)(?=\s)")
SLICE = 1 << 18  # characters of a text worked on at a time
IDS = 4096  # ids whose bytes the decoder takes at a time
MEMO = 400_000  # pieces remembered per worker
SHORT = 64  # bytes of a piece whose ids are remembered, at most
FLUSH = 1 << 20  # ids after which the rows done so far are given on
NEVER = 1 << 40  # rank of a pair that is not in the list


class Merges:
    """A merge list as byte strings with ranks.

    `longest` is the length of its longest token: of the boundaries of any text's encoding one lies among any `longest`
    successive positions. `lookahead` is how many bytes must follow a token to make it final: see _reach.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.lengths = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.lookahead = self.longest + self._reach()
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)  # which tokens end at a byte, the longest first
        for b, i in ranks.items():
            self.found.add_word(b.decode("latin-1"), i)
        self.found.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}

    def _reach(self) -> int:
        """How many bytes before two prefixes part their encodings can differ at most.

        Merges go by rank, so the first place where two encodings differ moves to the left by at most one merge (u, v) a
        rank: v stands at that place in one of them, or a token that begins with it, and u, which both have before it,
        is merged in one only. Behind it stands then the new token in one and u, or a token that begins with u, in the
        other. So the bytes passed are the longest path through merges of rising rank in which each right part begins
        with the merged token or the left part of the merge before. Ranks are gone through from the highest down.
        """
        ranks, gain = self.ranks, {}
        for b, _ in sorted(ranks.items(), key=lambda x: -x[1]):
            here = gain.get(b, 0)
            parts = [(b[:i], b[i:]) for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
            for v, g in [(v, len(u) + max(here, gain.get(u, 0))) for u, v in parts]:
                for j in range(1, len(v) + 1):
                    if v[:j] in ranks and gain.get(v[:j], 0) < g:
                        gain[v[:j]] = g
        return max(gain.values(), default=0)

    def merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """Merges the pair of lowest rank, the leftmost first, until no pair is in the list or `least` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token was merged from; None for a single byte."""
        if token not in self._halves:
            parts = self.merge(self.tokens[token], 2)
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether token a can stand before token b in an encoding.

        The merges of both are undone, the latest first; a can stand there if none of the pairs that meet at their
        border on the way would have been merged before the merge undone last."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            known, limit = True, NEVER
            while known:
                known = self.ranks.get(self.tokens[a] + self.tokens[b], NEVER) >= limit
                left, right = self.halves(a), self.halves(b)
                if left is None and right is None:
                    break
                if right is None or (left is not None and a > b):
                    limit, a = a, left[1]
                else:  # of two of one rank the left one was merged first, and of equal pairs the left one
                    limit, b = b + 1, right[0]
            if len(self._fits) >= MEMO:
                self._fits.clear()
            self._fits[key] = known
        return known


class Transducer:
    """Encodes one piece of any length from a stream of bytes, with memory for a few lookaheads only.

    For each position it keeps the last token of the encoding of the prefix that ends there: the one token that fits
    the encoding of the prefix before it. A token with `lookahead` bytes behind it is in the encoding of every text
    that goes on from here, so it is final and is emitted.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        self.last: list[int] = []  # last[k]: last token of the prefix that ends after byte base + k
        self.base = 0
        self.done = 0  # bytes whose tokens were emitted
        self._ends = None

    def _step(self, data: bytes) -> None:
        last, base, fits, lengths = self.last, self.base, self.m.fits, self.m.lengths
        end = base + len(last)
        if self._ends is None:
            self._ends = self.m.found.iter(data.decode("latin-1"))
        else:
            self._ends.set(data.decode("latin-1"), False)  # goes on where it stopped
        for at, token in self._ends:
            if at == end:
                start = at + 1 - lengths[token]
                if start == 0 or (start > base and fits(last[start - base - 1], token)):
                    last.append(token)
                    end += 1

    def _emit(self, upto: int) -> list[int]:
        """Ids of the tokens not emitted yet that end at `upto` or before."""
        path, end = [], self.base + len(self.last)
        while end > self.done:
            token = self.last[end - self.base - 1]
            if end <= upto:
                if not path:
                    final = end
                path.append(token)
            end -= self.m.lengths[token]
        if path:
            self.done = final
        keep = max(0, self.done - 1 - self.base)  # the last token emitted decides what fits behind it
        del self.last[:keep]
        self.base += keep
        return path[::-1]

    def feed(self, data: bytes) -> Iterator[int]:
        """Takes more bytes and gives the ids that became final."""
        for k in range(0, len(data), self.m.lookahead):
            self._step(data[k : k + self.m.lookahead])
            if len(self.last) > 2 * self.m.lookahead:
                yield from self._emit(self.base + len(self.last) - self.m.lookahead)

    def finish(self) -> list[int]:
        return self._emit(self.base + len(self.last))

    def run(self, data: bytes) -> Iterator[int]:
        yield from self.feed(data)
        yield from self.finish()


class Encoder(dict):
    """Piece -> ids. Every piece goes through the transducer; what it gave for short ones is remembered, as words repeat."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> Iterable[int]:
        b = piece.encode()
        ids = Transducer(self.merges).run(b)
        if len(b) > SHORT:
            return ids  # they go on to the result as they become final
        ids = tuple(ids)
        if len(self) >= MEMO:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str, into: array.array) -> None:
        """Appends the ids of a text; a long text is worked on in slices that end where a piece begins."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE and (cut := CUT.search(text, at + SLICE)):
                end = cut.start()
            into.extend(chain.from_iterable(map(self.__getitem__, PIECE.findall(text, at, end) if end == len(text) else PIECE.findall(text[at:end]))))
            at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The vocabulary of a file, loaded once per worker."""
    with open(path, "rb") as f:
        return Encoder(Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}))


def _lists(keys: pa.Array, name: str, ids: array.array, offsets: array.array) -> pa.RecordBatch:
    values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
    lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), values)
    return pa.RecordBatch.from_arrays([keys, lists], [name, "ids"])


def _encode(batches: Iterator[pa.RecordBatch], path: str, key: str, text: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for b in batches:
        ids, offsets, first = array.array("i"), array.array("i", [0]), 0
        for i, t in enumerate(b[text], 1):
            if (s := t.as_py()) is not None:
                e.encode(s, ids)
            offsets.append(len(ids))
            if len(ids) >= FLUSH or i == b.num_rows:
                yield _lists(b[key].slice(first, i - first), key, ids, offsets)
                ids, offsets, first = array.array("i"), array.array("i", [0]), i


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every text, without special tokens.

    A null and an empty text give an empty list; blanks are text. What looks like a special token is ordinary text.
    Whole texts are encoded, of any length, every piece by the Transducer. Repeated keys are encoded each; other columns
    are ignored; an empty table gives an empty result. Rows are encoded where they are read: there is no shuffle.
    """
    run = partial(_encode, path=f"{tokenizers}/{vocabulary}", key=key, text=text)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


#: How many bytes a character has that begins with a byte; 0 where a character cannot begin.
BEGINS = [1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 0x05 + [0] * 0x0B


class TextMachine:
    """Bytes to text piece by piece. Its state is the bytes of a character that is not complete yet, three at most."""

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, data: bytes) -> str:
        """Takes more bytes and gives the characters that are complete; bytes that are no text give the replacement mark."""
        data = self.begun + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            if size := BEGINS[data[-back]]:
                cut -= back if size > back else 0
                break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


def _decode(batches: Iterator[pa.RecordBatch], path: str, key: str) -> Iterator[pa.RecordBatch]:
    token = encoder(path).merges.tokens.__getitem__
    for b in batches:
        texts = []
        for row in b["ids"]:
            state = TextMachine()
            ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else ()
            parts = [state.feed(b"".join(map(token, ids[k : k + IDS].tolist()))) for k in range(0, len(ids), IDS)]
            texts.append("".join(parts) + state.finish())
        yield pa.RecordBatch.from_arrays([b[key], pa.array(texts, pa.string())], [key, "text"])


def decode_ids(encoded: DataFrame, key: str = "doc_id", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of ids; a null or empty list gives an empty text, bytes that are no text the replacement mark."""
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(partial(_decode, path=f"{tokenizers}/{vocabulary}", key=key), f"`{key}` {kind}, text string")
