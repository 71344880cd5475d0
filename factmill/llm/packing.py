"""Packs documents, in order, into training sequences of bounded length.

Tokens come from a public word-BPE vocabulary. Texts are cut into its pre-tokens by array operations; each distinct
pre-token is encoded once by the tokenizers library and then looked up. A pre-token's ids don't depend on its
neighbours, and white space always ends one, so this gives the ids of the whole text.

Window cuts are chosen by dynamic programming over document ends and sentence ends: with f(j) the least cost of all
up to j, f(j) = penalty(j) + min over i in [j - L, j) of f(i) + L - (j - i). The minimum of f(i) + i over a sliding
window comes from a monotone queue, in time linear in the number of cuts. Order is kept: a sequence holds consecutive
tokens of the input stream.

Defined results: a null or empty text is one end-of-document id. Equal rows are separate documents. An empty table
gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from factmill.llm import textarrays as ta
from factmill.llm.scratch import arrow_rows

#: Costs of a cut, in tokens of padding: after a document, after a sentence, elsewhere.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE = 0, 4, 48
#: Distinct pre-tokens whose ids a worker keeps.
CACHE_WORDS = 1_500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, _ODD, np.uint8)
    for a, b, kind in ((0x21, 0x7E, _MARK), (0x30, 0x39, _DIGIT), (0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER)):
        out[a : b + 1] = kind
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[[ord("'"), ord("|")]] = _ODD  # contractions and control strings: left to the library
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class WordTokens:
    """Ids of texts under a word-BPE vocabulary file, as one flat array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = spec["model"]["end_of_word_suffix"]
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.sentence = np.zeros(len(self.ends), bool)
        for token, k in vocab.items():
            self.ends[k] = token.endswith(suffix)
            self.sentence[k] = bool(token.removesuffix(suffix)) and not token.removesuffix(suffix).strip(".!?")
        self._forget()

    def _forget(self, room: int = CACHE_WORDS) -> None:
        """An empty table with open addressing: a key's slot is its low bits, or the next free one."""
        self.room = max(room, CACHE_WORDS)
        self.size = 1 << (2 * self.room).bit_length()
        self.keys, self.word = np.zeros(self.size, ta.U64), np.full(self.size, -1, np.int32)
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The word number of each key, -1 where it is new."""
        mask = ta.U64(self.size - 1)
        slot = (h & mask).astype(np.int64)
        word = self.word[slot]
        at = np.flatnonzero((word >= 0) & (self.keys[slot] != h))
        while len(at):
            slot[at] = (slot[at] + 1) & (self.size - 1)
            word[at] = self.word[slot[at]]
            at = at[(word[at] >= 0) & (self.keys[slot[at]] != h[at])]
        return word

    def _learn(self, keys: np.ndarray, fast: list[str], slow: list[str], is_fast: np.ndarray) -> None:
        """Adds distinct new keys; fast and slow hold the strings of the keys where is_fast is True and False."""
        n = np.zeros(len(keys), np.int64)
        parts: list[np.ndarray] = []
        if fast:
            ids = np.array(self.bare.encode(" ".join(fast), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(fast):
                raise ValueError("the vocabulary doesn't end each word with its suffix")
            n[is_fast] = np.diff(last, prepend=-1)
            parts.append(ids)
        if slow:
            found = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch(slow, add_special_tokens=False)]
            n[~is_fast] = [len(x) for x in found]
            parts += found
        at = np.zeros(len(keys), np.int64)
        base = len(self.ids)
        for which in (is_fast, ~is_fast):
            ends = np.cumsum(n[which])
            at[which] = base + ends - n[which]
            base += int(ends[-1]) if len(ends) else 0
        left = np.arange(len(self.n), len(self.n) + len(keys), dtype=np.int32)
        slot = (keys & ta.U64(self.size - 1)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):  # each free slot goes to the last key that asks for it; the others move on
            free = todo[self.word[slot[todo]] < 0]
            self.word[slot[free]] = left[free]
            self.keys[slot[free]] = keys[free]
            todo = todo[self.word[slot[todo]] != left[todo]]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
        self.ids = np.concatenate([self.ids, *parts])
        self.at, self.n = np.concatenate((self.at, at)), np.concatenate((self.n, n))

    def _words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case, where each pre-token begins and ends, and whether it is left to the library whole."""
        low, kind = _LOWER[raw], _CLASS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        if len(lead):  # letters of Latin-1
            then = raw[lead + 1]
            lead = lead[(then >= 0x80) & (then <= 0xBF) & (then != 0x97) & (then != 0xB7)]
            kind[lead] = kind[lead + 1] = _LETTER
            low[lead + 1] |= 0x20 * (raw[lead + 1] < 0x9F).astype(np.uint8)
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        space = np.concatenate((kind == _SPACE, [True]))
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):  # a chunk that holds anything unusual is one unit, in its own letters
            limit = np.flatnonzero(space | edge)  # a chunk lies between two of these
            after = np.unique(np.searchsorted(limit, odd, "right"))
            begin = np.where(after > 0, limit[after - 1], 0)
            begin += space[begin]
            size = limit[after] - begin
            where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            kind[where] = _ODD
            low[where] = raw[where]
        start = kind == _DIGIT
        start |= edge[:-1]
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        stop = np.append(start[1:], True)
        solid = ~space[:-1]
        begin = np.flatnonzero(start & solid)
        return low, begin, np.flatnonzero((stop | space[1:]) & solid) + 1, kind[begin] == _ODD

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids, joined, and how many each row has."""
        rows = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        low, begin, end, odd = self._words(raw, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        h = ta.stretch_hash(ta.prefix_hash(low), begin, end)
        h ^= odd
        word = self._find(h)
        if (word < 0).any():
            new = np.flatnonzero(word < 0)
            keys, first = np.unique(h[new], return_index=True)
            if len(self.n) + len(keys) > self.room:
                new = np.arange(len(h))
                keys, first = np.unique(h, return_index=True)
                self._forget(len(keys))
            which = new[first]
            data, plain = low.tobytes(), ~odd[which]
            text = [data[a:b].decode("utf-8", "replace") for a, b in zip(begin[which].tolist(), end[which].tolist(), strict=True)]
            self._learn(keys, [t for t, p in zip(text, plain.tolist(), strict=True) if p], [t for t, p in zip(text, plain.tolist(), strict=True) if not p], plain)
            word = self._find(h)
        n = self.n[word]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.at[word] - ends[:-1], n) + np.arange(int(ends[-1]))]
        return ids, np.diff(ends[np.searchsorted(begin, offsets)])


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The vocabulary at `path`, loaded once in a process."""
    if path not in _TOKENS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def choose_cuts(at: np.ndarray, penalty: np.ndarray, most: int) -> list[int]:
    """Which of the sorted positions `at` (the first one the stream's start, the last its end) to cut at.

    A window from i to j costs most - (j - i), and each cut its penalty. Neighbouring positions are at most `most` apart.
    Ties go to the longer window. (Only what ends a stream may be cut into powers of two: see in_powers.)
    """
    where, price = at.tolist(), penalty.tolist()
    n = len(where)
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0.0] * n
    key[0] = where[0]
    for j in range(1, n):
        p = where[j]
        while where[queue[0]] < p - most:
            queue.popleft()
        i = queue[0]
        c = key[i] + most - p + price[j]
        cost[j], back[j] = c, i
        k = key[j] = c + p
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def in_powers(length: int, most: int) -> list[int]:
    """Lengths that add up to `length`, for the least padding plus the price of cutting anywhere."""
    if length == most or length & (length - 1) == 0 or (bin(length).count("1") - 1) * ELSEWHERE >= most - length:
        return [length]
    return [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]


def _positions(ends: np.ndarray, sentence: np.ndarray, total: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and at what price. Stretches without a boundary can be cut at every 64th token,
    and in shorter steps if windows are short."""
    price = np.full(total + 1, 0, np.float64)
    may = np.zeros(total + 1, bool)
    may[sentence] = True
    price[sentence] = AT_SENTENCE
    may[ends] = True
    price[ends] = AT_DOCUMENT
    may[[0, total]] = True
    price[[0, total]] = 0
    at = np.flatnonzero(may)
    wide, step = np.flatnonzero(np.diff(at) > most // 4), max(1, min(64, most // 4))
    for a, b in zip(at[wide].tolist(), at[wide + 1].tolist(), strict=True):
        extra = np.arange(a + step, b, step)
        may[extra] = True
        price[extra] = ELSEWHERE
    at = np.flatnonzero(may)
    return at, price[at]


class Packer:
    """Packs a stream that comes in parts. The last window of a part stays open and begins the next."""

    def __init__(self, tokens: WordTokens, most: int, eod: int, base: int):
        self.tokens, self.most, self.eod, self.next = tokens, most, eod, base
        self.ids, self.doc, self.start, self.n, self.total = np.zeros(0, np.uint32), [], [], np.zeros(0, np.int64), []

    def add(self, doc_ids: list, raw: np.ndarray, offsets: np.ndarray, last: bool) -> Iterator[tuple]:
        ids, n = self.tokens.encode(raw, offsets)
        sums = np.cumsum(n)
        ids = np.insert(ids, sums, self.eod) if len(n) else ids
        n = n + 1
        ids = np.concatenate((self.ids, ids))
        doc, start, total = self.doc + doc_ids, self.start + [0] * len(doc_ids), self.total + n.tolist()
        n = np.concatenate((self.n, n))
        ends = np.cumsum(n)
        size = len(ids)
        if not size:
            return
        sentence = np.flatnonzero(self.tokens.sentence[np.minimum(ids, len(self.tokens.sentence) - 1)]) + 1
        at, price = _positions(ends, sentence, size, self.most)
        chosen = at[choose_cuts(at, price, self.most)].tolist()
        keep = size if last else chosen[-2]
        bounds = chosen if last else chosen[:-1]
        if last and len(bounds) > 1:
            a, b = bounds[-2:]
            bounds = [*bounds[:-1], *(a + np.cumsum(in_powers(b - a, self.most))).tolist()]
        begins = (ends - n).tolist()
        stops, k = ends.tolist(), 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            p = a
            while p < b:
                while stops[k] <= p:
                    k += 1
                q = min(b, stops[k])
                yield doc[k], start[k] + p - begins[k], q - p, zlib.crc32(np.ascontiguousarray(ids[p:q], "<u4").tobytes()), total[k], self.next, p - a
                p = q
            self.next += 1
        k = int(np.searchsorted(ends, keep, "right"))
        self.ids, self.doc, self.total, self.n = ids[keep:], doc[k:], total[k:], n[k:].copy()
        self.start = start[k:]
        if self.doc:
            cut = keep - begins[k]
            self.start[0] += cut
            self.n[0] -= cut


def pack_documents(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, eod: int = 2) -> DataFrame:
    """One row per piece: the document, the piece's place in it and in its sequence, and a checksum of its ids.

    Each partition is a stream of its own and its tail the only part that may need much padding, so no row moves
    between tasks: a hot source or a long document costs what its bytes cost. Sequence ids hold the partition in their
    high bits.
    """
    if not 1 <= most < 1 << 20:
        raise ValueError("most must lie in [1, 2**20)")
    arrow_rows(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(word_tokens(vocabulary), most, eod, TaskContext.get().partitionId() << 40)

        def parts() -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
            for batch in batches:
                raw, offsets = ta.flat(batch.column(1))
                ids = batch.column(0).to_pylist()
                for a, b in ta.blocks(offsets):
                    yield ids[a:b], raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]

        held = None
        for part in parts():
            if held is not None:
                yield from _rows(packer.add(*held, False))
            held = part
        if held is not None:
            yield from _rows(packer.add(*held, True))

    return documents.select(id_col, text_col).withColumnRenamed(id_col, "doc_id").mapInArrow(run, PIECES)


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows = list(found)
    if rows:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
