"""Finds benchmark passages in training documents with suffix arrays, and removes the documents they touch.

A block of documents is a shard: its words become vocabulary numbers, its suffixes a sorted array, and every benchmark
suffix a binary search in it. Suffixes that don't begin as any benchmark window does can't hold a match and are left
out of the array; suffixes equal for as many words as the longest item has stand in text order. Where a suffix's first
window is found, neighbouring finds join to verbatim matches of full length, and a document's longest one is told with its
places. No document leaves its task, so neither a passage that a third of all documents hold nor a hot source moves or gathers rows.

Words: after A-Z become a-z, maximal runs of a-z, 0-9 and characters beyond ASCII. They are compared by 64-bit hashes.

Defined results: a null or empty text has no words and no hits; repeated rows are judged one by one; items without an
id or without words are left out, and equal item ids count once. Without items nothing is hit. Other columns are
ignored, or kept as they are by remove_contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm import textarrays as ta
from factmill.llm.scratch import arrow_rows, discard, written

#: Bytes of benchmark texts sent to every executor at once; a larger benchmark is searched in several passes.
ITEM_BYTES = 16 << 20

_LOWER = np.full(256, 32, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, joined, and how many words each row has."""
    if not len(raw):
        return np.zeros(0, ta.U64), np.zeros(len(offsets) - 1, np.int64)
    low = _LOWER[raw]
    begin, end, _ = ta.runs(low != 32, offsets)
    return ta.stretch_hash(ta.prefix_hash(low), begin, end), np.diff(np.searchsorted(begin, offsets))


class Benchmark:
    """The windows of a set of items, ready to be searched for."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        raw, offsets = ta.flat(pa.array(texts, pa.large_string()))
        h, n = words(raw, offsets)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        number = number.astype(np.int64) + 1
        ends = np.cumsum(n)
        self.items, self.window = ids, window
        self.rank = np.argsort(np.argsort(np.array(ids, object), kind="stable"), kind="stable") if ids else np.zeros(0, np.int64)
        self.owner, self.start_of = np.repeat(np.arange(len(n)), n), ends - n
        found: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        self.suffixes: list[tuple[int, int, np.ndarray]] = []
        for k, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
            size = min(window, b - a)
            for i in range(a, b - size + 1) if size else ():
                found.setdefault(size, []).append((number[i : i + size], k, i))
                self.suffixes.append((k, i - a, number[i:b]))
        self.longest = int(n.max(initial=0))
        self.groups = []
        for size, pairs in sorted(found.items()):
            distinct, which = np.unique(np.array([p for p, _, _ in pairs]), axis=0, return_inverse=True)
            which = which.reshape(-1)
            owner = np.unique(np.stack((which, [k for _, k, _ in pairs]), 1), axis=0)
            rows = np.arange(len(distinct) + 1)
            place = np.array([i for _, _, i in pairs], np.int64)[np.argsort(which, kind="stable")]
            self.groups.append((size, distinct, np.searchsorted(owner[:, 0], rows), owner[:, 1], np.searchsorted(np.sort(which), rows), place))
        self.begin = min([4, *(g[0] for g in self.groups)])
        bits = max(16, (16 * len(self.suffixes)).bit_length())
        self.mask = ta.U64((1 << bits) - 1)
        self.starts = np.zeros(1 << bits, bool)
        for _, distinct, *_ in self.groups:
            self.starts[self._start_hash(distinct.reshape(-1))[:: distinct.shape[1]]] = True
        self.known = np.zeros(1 << 20, bool)
        self.known[self.vocabulary & ta.U64((1 << 20) - 1)] = True

    def _start_hash(self, numbers: np.ndarray) -> np.ndarray:
        padded = np.concatenate((numbers, np.zeros(self.begin, numbers.dtype))).astype(ta.U64)
        return ta.sequence_hash(padded, self.begin)[: len(numbers)] & self.mask

    def shard(self, h: np.ndarray, n: np.ndarray) -> Shard:
        """The shard of documents with these words."""
        number = np.zeros(len(h), np.int64)
        at = np.flatnonzero(self.known[h & ta.U64((1 << 20) - 1)])
        if len(self.vocabulary):
            place = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
            same = self.vocabulary[place] == h[at]
            number[at[same]] = place[same] + 1
        row = np.repeat(np.arange(len(n)), n)
        s = np.zeros(len(h) + len(n) + self.longest + 8, np.int64)  # a 0, which no item holds, ends each document
        s[np.arange(len(h)) + row] = number
        return Shard(s, self._candidates(s), max(self.longest, 1), int(len(self.vocabulary) + 1).bit_length())

    def _candidates(self, s: np.ndarray) -> np.ndarray:
        if not self.groups:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(s)
        for j in range(1, self.begin):
            at = at[s[at + j] > 0]
        h = np.zeros(len(at), ta.U64)
        for j in range(self.begin):
            h = ta.mix(h * ta.U64(ta._BASE) + s[at + j].astype(ta.U64))
        return at[self.starts[h & self.mask]]


class Shard:
    """A suffix array over numbered words."""

    def __init__(self, s: np.ndarray, at: np.ndarray, depth: int, bits: int):
        self.s = s
        per = max(1, 63 // bits)
        rank, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        for deep in range(0, depth, per):
            if not len(open_):
                break
            key = np.zeros(len(open_), np.int64)
            for j in range(deep, deep + per):
                key = (key << bits) | s[np.minimum(at[open_] + j, len(s) - 1)]
            order = np.lexsort((key, rank[open_]))
            at[open_], key, old = at[open_][order], key[order], rank[open_][order]
            fresh = np.ones(len(open_), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
            rank[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
            alone = fresh & np.append(fresh[1:], True)
            open_ = open_[~alone]
        self.at = at

    def _compare(self, place: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-1, 0 or 1 as the suffix there is less than, begins with or is greater than each pattern; the words in common."""
        have = self.s[np.minimum(self.at[place][:, None] + np.arange(patterns.shape[1]), len(self.s) - 1)]
        differ = have != patterns
        first = np.where(differ.any(1), differ.argmax(1), patterns.shape[1])
        k = np.minimum(first, patterns.shape[1] - 1)
        rows = np.arange(len(place))
        return np.where(first == patterns.shape[1], 0, np.sign(have[rows, k] - patterns[rows, k])), first

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the array whose suffixes begin with each pattern, by binary search for all at once."""
        bounds = []
        for upper in (False, True):
            lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.at), np.int64)
            while (going := np.flatnonzero(lo < hi)).size:
                mid = (lo[going] + hi[going]) // 2
                side, _ = self._compare(mid, patterns[going])
                right = side < 0 if not upper else side <= 0
                lo[going[right]] = mid[right] + 1
                hi[going[~right]] = mid[~right]
            bounds.append(lo)
        return bounds[0], bounds[1]

    def longest(self, pattern: np.ndarray) -> tuple[int, int]:
        """The most words that a suffix here has in common with the pattern's beginning, and where it stands."""
        if not len(self.at):
            return 0, -1
        place, _ = self.search(pattern[None, :])
        near = np.unique(np.clip([place[0] - 1, place[0]], 0, len(self.at) - 1))
        _, common = self._compare(near, np.repeat(pattern[None, :], len(near), 0))
        k = int(common.argmax())
        return int(common[k]), int(self.at[near[k]])


def _ragged(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `which`, the places first[k] to first[k + 1]: how many, and all of them."""
    count = np.diff(first)[which]
    ends = np.cumsum(count)
    return count, np.repeat(first[which] - ends + count, count) + np.arange(int(count.sum()))


def _scan(bench: Benchmark, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """Each row's words; hit or not for every word; the items found in each row; where rows' words begin; each row's longest
    match (words, where it starts in the row, item, where it starts in the item), of 0 words if there is none."""
    h, n = words(raw, offsets)
    shard = bench.shard(h, n)
    begin = np.cumsum(n) - n + np.arange(len(n))
    cover = np.zeros(len(shard.s) + 1, np.int64)
    pairs, matches = [], []
    for size, patterns, first, owners, place_first, places in bench.groups if len(shard.at) else ():
        lo, hi = shard.search(patterns)
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        many = (hi - lo)[some]
        ends = np.cumsum(many)
        where = shard.at[np.repeat(lo[some] - ends + many, many) + np.arange(int(many.sum()))]
        window = np.repeat(some, many)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + size, -1)
        seen = np.unique(np.stack((np.searchsorted(begin, where, "right") - 1, window), 1), axis=0)
        count, at = _ragged(first, seen[:, 1])
        pairs.append(np.stack((np.repeat(seen[:, 0], count), owners[at]), 1))
        count, at = _ragged(place_first, window)
        where, place = np.repeat(where, count), places[at]
        order = np.lexsort((where, where - place))  # a match goes on along a diagonal
        where, place = where[order], place[order]
        item = bench.owner[place]
        fresh = np.ones(len(where), bool)
        fresh[1:] = (where[1:] - where[:-1] != 1) | (place[1:] - place[:-1] != 1) | (item[1:] != item[:-1])
        start = np.flatnonzero(fresh)
        row = np.searchsorted(begin, where[start], "right") - 1
        matches.append(np.stack((row, np.diff(start, append=len(where)) + size - 1, where[start] - begin[row], item[start], place[start] - bench.start_of[item[start]]), 1))
    found: list[list[int]] = [[] for _ in range(len(n))]
    if pairs:
        for row, item in np.unique(np.concatenate(pairs), axis=0).tolist():
            found[row].append(item)
    longest = np.zeros((len(n), 4), np.int64)
    if matches:
        m = np.concatenate(matches)
        m = m[np.lexsort((m[:, 4], bench.rank[m[:, 3]], -m[:, 2], m[:, 1]))]
        longest[m[:, 0]] = m[:, 1:]  # of several the last stays
    at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    return n, np.cumsum(cover)[at] > 0, found, np.concatenate(([0], np.cumsum(n))), longest


class Group:
    """Items that are searched for at once. What is built of them is kept in a process, not sent."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids, self.texts, self.built = ids, texts, {}

    def __getstate__(self) -> tuple:
        return self.ids, self.texts

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def benchmark(self, window: int) -> Benchmark:
        if window not in self.built:
            self.built[window] = Benchmark(self.ids, self.texts, window)
        return self.built[window]


def _items(items: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[Group]]:
    """The items in groups of about ITEM_BYTES, or a single longer item; the driver holds one group at a time."""
    kept = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    total = int(kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    groups = 1 + 2 * total // ITEM_BYTES

    def read() -> Iterator[Group]:
        for k in range(groups):
            rows = (kept if groups == 1 else kept.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == k)).orderBy("id", "text").collect()
            yield Group([r.id for r in rows], [r.text for r in rows])

    return groups, read()


def benchmark_hits(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document: its id, n_words, the hit stretches of words (`hits`: start and n), the items found, sorted, and
    the longest verbatim match (words, their start in the document, the item and their start there; null without one).

    A window is `window` consecutive words of an item, or all words of a shorter one; a word of a document is hit if
    it lies inside any occurrence of a window. Of equally long matches the one that starts first in the document is told, then
    that of the greater item id.
    """
    spark = documents.sparkSession
    arrow_rows(spark)
    many, groups = _items(items, item_id, item_text)
    base = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} {base.schema['id'].dataType.simpleString()}, n_words long, hits array<struct<start:long,n:long>>, items array<string>, longest struct<n:long,start:long,item:string,item_start:long>"
    if many == 1:
        return base.mapInArrow(_runner(spark, next(groups), window, id_col, False), schema)
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "passes")  # rows need a name under which the passes' results meet
    merged = None
    for group in groups:
        found = base.mapInArrow(_runner(spark, group, window, id_col, True), f"row long, {schema}")
        if merged is None:
            merged = written(found, "passes")
            continue
        o = found.select("row", F.col("hits").alias("h2"), F.col("items").alias("i2"), F.col("longest").alias("l2"))
        rank = lambda x: F.struct(x["n"], -x["start"], x["item"], x["item_start"])
        better = F.when(F.col("longest").isNull() | (rank(F.col("l2")) > rank(F.col("longest"))), F.coalesce("l2", "longest")).otherwise(F.col("longest"))
        joined = merged.join(o, "row").select("row", id_col, "n_words", F.expr("concat(hits, h2)").alias("hits"), F.expr("array_sort(array_distinct(concat(items, i2)))").alias("items"), better.alias("longest"))
        before, merged = merged, written(joined, "passes")
        discard(before)
    return merged.select(id_col, "n_words", _joined(F.col("hits")).alias("hits"), "items", "longest")


def _joined(spans: F.Column) -> F.Column:
    """Overlapping and touching stretches as one."""
    empty = F.expr("cast(array() as array<struct<start:long,n:long>>)")

    def add(out, x):
        top = F.try_element_at(out, F.lit(-1))
        meets = (F.size(out) > 0) & (x["start"] <= top["start"] + top["n"])
        end = F.greatest(top["start"] + top["n"], x["start"] + x["n"])
        grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(top["start"].alias("start"), (end - top["start"]).alias("n"))))
        return F.when(meets, grown).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def _runner(spark, group: Group, window: int, id_col: str, named: bool):
    sent = spark.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value.benchmark(window)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
        match = pa.struct([("n", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
        for batch in batches:
            raw, offsets = ta.flat(batch.column(1))
            for a, b in ta.blocks(offsets):
                n, hit, found, word, most = _scan(bench, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                start, end, row = ta.runs(hit, word)
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(start - word[row]), pa.array(end - start)], ["start", "n"])).cast(spans)
                names = pa.array([sorted({bench.items[k] for k in x}) for x in found], pa.list_(pa.string()))
                longest = pa.array([{"n": m[0], "start": m[1], "item": bench.items[m[2]], "item_start": m[3]} if m[0] else None for m in most.tolist()], match)
                columns = [batch.column(0)[a:b], pa.array(n, pa.int64()), hits, names, longest]
                labels = [id_col, "n_words", "hits", "items", "longest"]
                yield pa.RecordBatch.from_arrays(([batch.column(2)[a:b]] if named else []) + columns, (["row"] if named else []) + labels)

    return run


def longest_matches(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """For every benchmark suffix that a document repeats for at least a window: the longest match, and one place of it.

    Each shard answers for itself; the longest of all shards stands, ties going to the smaller document.
    """
    spark = documents.sparkSession
    arrow_rows(spark)
    base = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = None
    for group in _items(items, item_id, item_text)[1]:
        sent = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value.benchmark(window)
            for batch in batches:
                raw, offsets = ta.flat(batch.column(1))
                for a, b in ta.blocks(offsets):
                    h, n = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    shard = bench.shard(h, n)
                    begin = np.cumsum(n) - n + np.arange(len(n))
                    rows = []
                    for k, start, pattern in bench.suffixes if len(shard.at) else ():
                        size, at = shard.longest(pattern)
                        if size >= min(window, len(pattern)):
                            row = int(np.searchsorted(begin, at, "right")) - 1
                            rows.append((bench.items[k], start, size, batch.column(0)[a + row].as_py(), at - int(begin[row])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["item", "item_start", "n_words", "doc", "doc_start"])

        found = base.mapInArrow(run, "item string, item_start long, n_words long, doc long, doc_start long")
        parts = found if parts is None else parts.unionAll(found)
    best = F.max_by(F.struct("n_words", "doc", "doc_start"), F.struct("n_words", -F.col("doc"), -F.col("doc_start"))).alias("best")
    return parts.groupBy("item", "item_start").agg(best).select("item", "item_start", "best.*")


def remove_contaminated(documents: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The documents in which no word is hit, with all their columns."""
    spark = documents.sparkSession
    arrow_rows(spark)
    column = documents.columns.index(text_col)
    out = documents
    for group in _items(items, item_id, item_text)[1]:
        sent = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value.benchmark(window)
            for batch in batches:
                raw, offsets = ta.flat(batch.column(column))
                clean = np.ones(batch.num_rows, bool)
                for a, b in ta.blocks(offsets):
                    n, hit, _, word, _ = _scan(bench, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    clean[a:b] = np.diff(np.concatenate(([0], np.cumsum(hit)))[word]) == 0
                if clean.any():
                    yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
    return out
