"""Removes lines and re-flowed paragraphs that stand earlier in the corpus, by grouping digests of normalised units.

Words are maximal runs of other characters than ASCII white space. A sentence ends at a word that ends in . ! or ?, and
at each line's last word. A unit is a line of `least` words or more, or the shortest run of whole sentences, from any
sentence on, that has so many: a paragraph that is the same wherever its line breaks and its neighbours stand, so a passage
inside a longer line is found as well as a line of its own. A unit is normalised (A-Z to a-z, one blank between words)
and hashed to 128 bits. Of all units with a digest the one of the smallest document id, then of the smallest place, stays;
the others go, and what no unit covers stays. Shorter lines, which unrelated texts share by chance, are no units.

A chunk of documents sends each distinct digest once, whatever its copies there, and keeps count of its own copies; digests
are pre-aggregated again where they are read, and the join that finds other chunks' occurrences is one that Spark splits
when skewed. Answers are a number per unit that goes.

Defined results: a null text has no units and stays null; rows with equal ids rank by their place in the input; rows
without an id rank last. Units of one document that overlap the one that stays are left alone. Every removed word has an equal
one that stays. Removed stretches keep their offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm import textarrays as ta
from factmill.llm.chunks import chunked, opened
from factmill.llm.scratch import release, written

#: Words of the shortest unit.
LEAST_WORDS = 20
_SECOND = 0xC2B2AE3D27D4EB4F
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)
_LAST = np.iinfo(np.int64).max

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Units:
    """The units of some texts, in the order of their first and last words, with two 64-bit digests each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, least: int):
        low = _LOWER[raw]
        begin, end, row = ta.runs(low != 32, offsets)
        n = len(begin)
        broken = np.ones(n, bool)  # the last word of a line
        if n:
            lines = np.concatenate(([0], np.cumsum(raw == 10)))
            broken[:-1] = (lines[begin[1:]] > lines[end[:-1]]) | (row[1:] != row[:-1])
        stop = broken | _STOP[raw[end - 1]] if n else broken
        i = np.flatnonzero(np.concatenate(([True], stop[:-1]))) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(stop)
        at = np.searchsorted(ends, i + least - 1)
        i, at = i[at < len(ends)], at[at < len(ends)]
        j = ends[at]
        same = row[i] == row[j]
        x, y = np.flatnonzero(np.concatenate(([True], broken[:-1]))) if n else np.zeros(0, np.int64), np.flatnonzero(broken)
        wide = y - x + 1 >= least
        pairs = np.unique(np.concatenate(((i[same] << 32) | j[same], (x[wide] << 32) | y[wide])))
        self.i, self.j = pairs >> 32, pairs & 0xFFFFFFFF
        self.row = row[self.i]
        self.begin, self.end = begin[self.i], end[self.j]
        h = ta.stretch_hash(ta.prefix_hash(low), begin, end) if n else np.zeros(0, ta.U64)
        self.one = self._digest(h, ta._BASE, ta._INVERSE)
        self.two = self._digest(ta.mix(h + ta.U64(977)), _SECOND, _SECOND_INVERSE)

    def _digest(self, h: np.ndarray, base: int, inverse: int) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, ta.U64), np.cumsum(h * ta._powers(base, len(h)), dtype=ta.U64)))
        return ta.mix((sums[self.j + 1] - sums[self.i]) * ta._powers(inverse, len(sums))[self.i] + (self.j - self.i).astype(ta.U64))

    def groups(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units by digest and then by rank, and which of these begin a digest."""
        order = np.lexsort((self.i, self.row, ids[self.row], self.two, self.one))
        fresh = np.ones(len(order), bool)
        one, two = self.one[order], self.two[order]
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return order, fresh


def _opened(rows, id_col: str, text_col: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    docs = opened(rows.as_buffer())
    raw, offsets = ta.flat(docs.column(docs.schema.get_field_index(text_col)))
    ids = docs.column(docs.schema.get_field_index(id_col)).fill_null(_LAST).to_numpy(zero_copy_only=False)
    return docs, raw, offsets, ids


def remove_repeated_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: its id, n_units, n_removed units, the stretches removed (start, n in code points), the text left."""
    if least < 1:
        raise ValueError("a unit has a word at least")
    base = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    chunks = chunked(base, text_col)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, raw, offsets, ids = _opened(rows, id_col, text_col)
                u = Units(raw, offsets, least)
                order, fresh = u.groups(ids)
                mine = order[fresh]
                columns = [u.one[mine].view(np.int64), u.two[mine].view(np.int64), ids[u.row[mine]], np.full(len(mine), number), mine.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "doc", "chunk", "unit"])

    rows = written(chunks.select("chunk", "rows").mapInArrow(units, "h1 long, h2 long, doc long, chunk long, unit long"), "units")
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "chunk", "unit")).alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("h1", "h2", F.col("first.chunk").alias("first_chunk")), "first")
    release(documents.sparkSession)
    # merge joins whatever the size of the other side: what is moved then grows in step with the input
    later = rows.select("h1", "h2", "chunk", "unit").join(first.hint("merge"), ["h1", "h2"]).where("chunk <> first_chunk")
    gone = written(later.select("chunk", "unit"), "gone").groupBy("chunk").agg(F.collect_list("unit").alias("gone"))  # a chunk's own units
    release(documents.sparkSession)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, elsewhere in zip(batch.column(1), batch.column(2), strict=True):
                docs, raw, offsets, ids = _opened(data, id_col, text_col)
                u = Units(raw, offsets, least)
                order, fresh = u.groups(ids)
                lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
                goes = np.zeros(len(order), bool)
                if elsewhere.is_valid:
                    goes[np.asarray(elsewhere.values)] = True
                goes[order] = goes[lead] | (~fresh & ((u.row[order] != u.row[lead]) | (u.i[order] > u.j[lead])))
                cover = np.zeros(len(raw) + 1, np.int32)
                np.add.at(cover, u.begin[goes], 1)
                np.add.at(cover, u.end[goes], -1)
                gone = np.cumsum(cover[:-1]) > 0
                start, end, row = ta.runs(gone, offsets)
                point = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))
                at = point[start] - point[offsets[row]]
                removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32()), pa.StructArray.from_arrays([pa.array(at), pa.array(point[end] - point[start])], ["start", "n"])).cast(spans)
                column = docs.column(docs.schema.get_field_index(text_col))
                left = np.concatenate(([0], np.cumsum(~gone)))[offsets].astype(np.int64)
                kept = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(left), pa.py_buffer(raw[~gone].tobytes())).cast(pa.string())
                if column.null_count:
                    kept = pa.array(np.where(np.asarray(column.is_valid()), kept.to_numpy(zero_copy_only=False), None), pa.string())
                many = [pa.array(np.bincount(x, minlength=len(offsets) - 1).astype(np.int64)) for x in (u.row, u.row[goes])]
                yield pa.RecordBatch.from_arrays([docs.column(docs.schema.get_field_index(id_col)), *many, removed, kept], [id_col, "n_units", "n_removed", "removed", "kept"])

    both = chunks.select("chunk", "rows").join(gone.hint("merge"), "chunk", "left")
    return both.mapInArrow(cut, f"{id_col} long, n_units long, n_removed long, removed array<struct<start:long,n:long>>, kept string")
