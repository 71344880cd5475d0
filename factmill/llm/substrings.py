"""Removes passages that an earlier document also holds: every byte covered by a string of `length` bytes that also
starts in a document with a smaller id. Strings are judged on the input; matches never cross documents.

Documents are dealt into chunks once. Each string of `length` bytes has a least hash among those of its k-byte pieces,
its anchor; equal strings have equal anchors wherever they stand. Three passes over the chunks:

1. A chunk sends its distinct anchors, six bytes each, to the partitions that own them, and learns which of them other
   documents share. Strings with other anchors occur once and go no further.
2. A chunk sends each distinct slice of text around shared anchors once, with the smallest id that holds it there. The
   owner of an anchor builds the Burrows-Wheeler transform of its slices. Breadth-first backward extension finds the
   boundaries between suffixes by increasing length of their common prefix and stops at `length`; what has no boundary
   then is a repeated string, and the smallest id among its slices is its first holder.
3. A chunk gets back the strings to remove and cuts them out of its texts.

A passage that very many documents share is sent once per chunk, not once per document, so no task grows with the
number of copies. Nothing is capped or sampled. Distinct slices are told apart by 128 bits of hash.

Defined results: a null text is empty; texts shorter than `length` stay whole; rows with equal ids don't affect each
other; a null id counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm import textarrays as ta
from factmill.llm.chunks import chunked, opened
from factmill.llm.scratch import arrow_rows, release, shuffle_partitions, written

#: Bytes of a piece whose hash can be an anchor: shorter ones make fewer anchors, longer ones fewer chance matches.
PIECE = 20
#: Text of a partition of the exchanges, and of a transform.
PARTITION_BYTES, SHARD_BYTES = 64 << 20, 1 << 20
_LAST = np.iinfo(np.int64).max
_SEPARATOR = 0xFF  # no byte of UTF-8


class Chunk:
    """Texts and the anchors of all their strings of `length` bytes."""

    def __init__(self, rows: bytes, id_col: str, text_col: str, length: int, buckets: int):
        self.batch = opened(rows)
        self.raw, self.offsets = ta.flat(self.batch.column(self.batch.schema.get_field_index(text_col)))
        ids = self.batch.column(self.batch.schema.get_field_index(id_col)).cast(pa.int64())
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.length = length
        piece = min(PIECE, length)
        least = ta.window_minimum(ta.rolling_hash(self.raw, piece), length - piece + 1) if len(self.raw) >= length else np.zeros(0, ta.U64)
        n = len(least)
        inside = np.zeros(len(self.raw) + 1, np.int32)  # whether a string starts here and ends in the same text
        size = np.diff(self.offsets)
        fits = size >= length
        inside[self.offsets[:-1][fits]] += 1
        np.add.at(inside, (self.offsets[1:] - length + 1)[fits], -1)
        inside = np.cumsum(inside[:n]) > 0
        edge = np.zeros(n + 1, bool)
        edge[self.offsets[self.offsets <= n]] = True
        change = np.ones(n + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | edge[1:-1] | (inside[1:] != inside[:-1])
        begin = np.flatnonzero(change)
        self.start, self.end = begin[:-1], begin[1:]
        keep = inside[self.start] if n else np.zeros(0, bool)
        self.start, self.end = self.start[keep], self.end[keep]
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        value = ta.mix(least[self.start]) if n else np.zeros(0, ta.U64)  # minima crowd at small values: spread over all buckets
        self.anchors, self.which = np.unique(value, return_inverse=True)
        self.bucket = ((self.anchors >> ta.U64(32)) * ta.U64(buckets) >> ta.U64(32)).astype(np.int64)
        self.first = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def shared_here(self) -> np.ndarray:
        """Which anchors two of the chunk's texts have."""
        pairs = np.unique((self.which.astype(np.int64) << 32) | self.row)
        return np.bincount(pairs >> 32, minlength=len(self.anchors)) > 1

    def slices(self, masks: list[tuple[int, bytes]]) -> Slices:
        shared = np.zeros(len(self.anchors), bool)
        for bucket, mask in masks:
            a, b = self.first[bucket], self.first[bucket + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        return Slices(self, np.flatnonzero(shared[self.which]))


class Slices:
    """The distinct slices of a chunk's texts around shared anchors, ordered by anchor."""

    def __init__(self, chunk: Chunk, at: np.ndarray):
        self.start, self.end = chunk.start[at], chunk.end[at] + chunk.length - 1
        anchor, doc = chunk.which[at], chunk.ids[chunk.row[at]]
        h = ta.stretch_hash(ta.prefix_hash(chunk.raw), self.start, self.end)
        order = np.lexsort((doc, h, anchor))
        h, anchor, doc = h[order], anchor[order], doc[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (anchor[1:] != anchor[:-1])
        self.start, self.end = self.start[order], self.end[order]
        self.slice, self.doc = np.cumsum(fresh) - 1, doc
        self.least = doc[fresh]
        self.from_, self.to = self.start[fresh], self.end[fresh]
        self.first = np.searchsorted(chunk.bucket[anchor[fresh]], np.arange(len(chunk.first)))
        self.anchor = chunk.anchors[anchor[fresh]]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then from start[1] on."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def repeated_strings(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every position of `text` in suffix order, and a number that equal strings of `length` bytes have in common.

    The order is one by the first 2**k >= length bytes. Counting in the transform is exact for strings no longer than
    that, so backward extension needs no more.
    """
    n = len(text)
    depth = 8
    wide = np.concatenate((text, np.full(8, _SEPARATOR, np.uint8))).astype(ta.U64)
    two = (wide[:-1] << ta.U64(8)) | wide[1:]
    four = (two[:-2] << ta.U64(16)) | two[2:]
    eight = ((four[:-4] << ta.U64(32)) | four[4:])[:n]
    del wide, two, four
    suffixes = np.argsort(eight)
    key = eight[suffixes]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    del eight, key
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[suffixes] = place + 1
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while depth < length and len(open_):
        at = suffixes[open_]
        group = rank[at]
        key = (group.astype(ta.U64) << ta.U64(32)) | rank[np.minimum(at + depth, n)].astype(ta.U64)
        order = np.argsort(key)
        at, key = at[order], key[order]
        suffixes[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))] + 1
        rank[at] = new
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    del rank
    transform = text[suffixes - 1]
    onward = np.argsort(transform, kind="stable").astype(np.int32)  # row t's suffix, without its first byte, is at this row
    first = transform[onward]
    boundary = np.zeros(n, bool)
    boundary[0] = True
    boundary[1:] = first[1:] != first[:-1]
    left = np.flatnonzero(~boundary)
    here, before = onward[left], onward[left - 1]
    for _ in range(1, length):
        interval = np.cumsum(boundary, dtype=np.int32)
        new = interval[here] != interval[before]
        if not new.any():
            break
        boundary[left[new]] = True
        new = ~new
        left, here, before = left[new], here[new], before[new]
    return suffixes, np.cumsum(boundary, dtype=np.int32)


def _removals(raw: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For slices that stand one after another in raw, which strings an earlier document than the slice's own holds."""
    begin = np.cumsum(size) - size
    text = np.full(len(raw) + len(size), _SEPARATOR, np.uint8)  # a separator ends each slice
    text[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
    suffixes, kind = repeated_strings(text, length)
    starts = np.zeros(len(text), bool)
    starts[_ragged(begin + np.arange(len(size)), size - length + 1)] = True
    owner = np.repeat(least, size + 1)
    rows = np.flatnonzero(starts[suffixes])
    at, kind = suffixes[rows], kind[rows]
    doc = owner[at]
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    earliest = np.repeat(np.minimum.reduceat(doc, first), np.diff(first, append=len(doc)))
    out = np.zeros(len(text), bool)
    out[at[earliest < doc]] = True
    return out


def _mask_owner(length: int):
    """Pass 1: which of the anchors that chunks sent occur in another document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many, of = [], [], []
        for batch in batches:
            for bucket, chunk, anchors, here in zip(*(batch.column(k).to_pylist() for k in ("bucket", "chunk", "anchors", "here")), strict=True):
                k = ta.unpack(anchors, 6)
                keys.append(k | ta.U64((bucket & 0xFFFF) << 48))
                many.append(np.unpackbits(np.frombuffer(here, np.uint8), count=len(k)).astype(bool))
                of.append((chunk, bucket, len(k)))
        if not of:
            return
        key, shared = np.concatenate(keys), np.concatenate(many)
        del keys, many
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        at = 0
        out = []
        for chunk, bucket, n in of:
            if shared[at : at + n].any():
                out.append((chunk, bucket, np.packbits(shared[at : at + n]).tobytes()))
            at += n
        for k in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[k : k + 1000], strict=True)], ["chunk", "bucket", "mask"])

    return run


def _slice_owner(length: int):
    """Pass 2: the strings to remove from each slice that chunks sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        of, sizes, leasts, anchors, raws, hashes = [], [], [], [], [], []
        for batch in batches:
            for bucket, chunk, data in zip(*(batch.column(k).to_pylist() for k in ("bucket", "chunk", "slices")), strict=True):
                data = unzip.decompress(data)
                n = int.from_bytes(data[:8], "little")
                anchor, least, size = np.frombuffer(data, ta.U64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n), np.frombuffer(data, np.uint32, n, 8 + 16 * n).astype(np.int64)
                raw = np.frombuffer(data, np.uint8, offset=8 + 20 * n)
                end = np.cumsum(size)
                hashes.append(ta.stretch_hash(ta.prefix_hash(raw), end - size, end))
                of.append((chunk, bucket, n))
                for a, b in ((sizes, size), (leasts, least), (anchors, anchor), (raws, raw)):
                    a.append(b)
        if not of:
            return
        size, least, anchor, raw, h = (np.concatenate(x) for x in (sizes, leasts, anchors, raws, hashes))
        del sizes, leasts, anchors, raws, hashes
        begin = np.cumsum(size) - size
        order = np.lexsort((least, h, anchor))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        one = order[fresh]  # each distinct slice once, where its document is the smallest
        ends = np.cumsum(size[one])
        cut = [0]  # shards end where the anchor changes
        change = np.append(np.flatnonzero(anchor[one][1:] != anchor[one][:-1]) + 1, len(one))
        done = 0
        for k, total in zip(change.tolist(), ends[change - 1].tolist(), strict=True):
            if total - done >= SHARD_BYTES or k == len(one):
                cut.append(k)
                done = total
        start_of, n_of, slice_of = [], [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            which = one[a:b]
            gone = _removals(raw[_ragged(begin[which], size[which])], size[which], least[which], length)
            base = np.cumsum(size[which] + 1) - size[which] - 1
            start, end, row = ta.runs(gone, np.append(base, len(gone)))
            start_of.append(start - base[row])
            n_of.append(end - start)
            slice_of.append(row + a)
        start, n, slice_ = (np.concatenate(x) for x in (start_of, n_of, slice_of))
        first = np.searchsorted(slice_, np.arange(len(one) + 1))
        whole = least > least[one][number]
        at, out = 0, []
        for chunk, bucket, many in of:
            mine = np.arange(at, at + many)
            all_ = mine[whole[mine]]
            part = mine[~whole[mine]]
            k = first[number[part]]
            count = first[number[part] + 1] - k
            some = _ragged(k, count)
            found = np.concatenate((np.stack((all_ - at, np.zeros(len(all_), np.int64), size[all_] - length + 1), 1), np.stack((np.repeat(part - at, count), start[some], n[some]), 1)))
            if len(found):
                out.append((chunk, bucket, found.astype("<u4").tobytes()))
            at += many
        for k in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[k : k + 1000], strict=True)], ["chunk", "bucket", "gone"])

    return run


def _per_chunk(answers: DataFrame, column: str) -> DataFrame:
    """A chunk's answers in one row; each is a bit or a few bytes per thing that the chunk sent."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", column)).alias(column))


def find_repeats(documents: DataFrame, finish, schema, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Applies `finish(batch, raw, offsets, gone)` to batches of documents, `gone` telling the bytes to remove."""
    if length < 8:
        raise ValueError("length must be 8 at least")
    spark = documents.sparkSession
    arrow_rows(spark)
    chunks = chunked(documents, text_col)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), -(-total // PARTITION_BYTES))
    buckets = 4 * parts
    args = (id_col, text_col, length, buckets)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = Chunk(rows.as_buffer(), *args)
                here = c.shared_here()
                some = np.flatnonzero(np.diff(c.first))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some),
                        pa.array(np.full(len(some), number)),
                        pa.array([ta.pack(c.anchors[c.first[k] : c.first[k + 1]], 6) for k in some], pa.binary()),
                        pa.array([np.packbits(here[c.first[k] : c.first[k + 1]]).tobytes() for k in some], pa.binary()),
                    ],
                    ["bucket", "chunk", "anchors", "here"],
                )

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipper = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for number, rows, masks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                c = Chunk(rows.as_buffer(), *args)
                s = c.slices([(m["bucket"], m["mask"]) for m in masks or ()])
                some = np.flatnonzero(np.diff(s.first))
                out = []
                for k in some:
                    a, b = s.first[k], s.first[k + 1]
                    size = s.to[a:b] - s.from_[a:b]
                    text = c.raw[_ragged(s.from_[a:b], size)]
                    out.append(zipper.compress(b"".join((int(b - a).to_bytes(8, "little"), s.anchor[a:b].tobytes(), s.least[a:b].astype("<i8").tobytes(), size.astype("<u4").tobytes(), text.tobytes()))))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), number)), pa.array(out, pa.binary())], ["bucket", "chunk", "slices"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, masks, answers in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                c = Chunk(rows.as_buffer(), *args)
                s = c.slices([(m["bucket"], m["mask"]) for m in masks or ()])
                cover = np.zeros(len(c.raw) + 1, np.int32)
                later = s.doc > s.least[s.slice]
                np.add.at(cover, s.start[later], 1)
                np.add.at(cover, s.end[later], -1)
                found = [np.frombuffer(x["gone"], "<u4").reshape(-1, 3).astype(np.int64) + [s.first[x["bucket"]], 0, 0] for x in answers or ()]
                if found:
                    found = np.concatenate(found)
                    found = found[np.argsort(found[:, 0], kind="stable")]
                    own = np.flatnonzero(~later)
                    a, b = np.searchsorted(found[:, 0], s.slice[own], "left"), np.searchsorted(found[:, 0], s.slice[own], "right")
                    some = found[_ragged(a, b - a)]
                    base = np.repeat(s.start[own], b - a)
                    np.add.at(cover, base + some[:, 1], 1)
                    np.add.at(cover, base + some[:, 1] + some[:, 2] + length - 1, -1)
                yield from finish(c.batch, c.raw, c.offsets, np.cumsum(cover[:-1]) > 0)

    sent = chunks.select("chunk", "rows").mapInArrow(anchors, "bucket long, chunk long, anchors binary, here binary")
    masks = written(sent.repartition(parts, "bucket").mapInArrow(_mask_owner(length), "chunk long, bucket long, mask binary"), "masks")
    release(spark)
    first = chunks.select("chunk", "rows").join(_per_chunk(masks, "mask"), "chunk", "left")
    sent = first.mapInArrow(slices, "bucket long, chunk long, slices binary")
    gone = written(sent.repartition(parts, "bucket").mapInArrow(_slice_owner(length), "chunk long, bucket long, gone binary"), "gone")
    release(spark)
    both = chunks.select("chunk", "rows").join(_per_chunk(masks, "mask"), "chunk", "left").join(_per_chunk(gone, "gone"), "chunk", "left")
    return both.mapInArrow(last, schema)


def repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per document: its id, n_bytes, the removed stretches of bytes and the bytes that remain."""

    def finish(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, end, row = ta.runs(gone, offsets)
        removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32()), pa.StructArray.from_arrays([pa.array(start - offsets[row]), pa.array(end - start)], ["start", "n"]))
        left = np.concatenate(([0], np.cumsum(~gone)))[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(raw[~gone].tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), removed, kept], [id_col, "n_bytes", "removed", "kept"])

    base = documents.select(id_col, F.col(text_col).cast("string").alias(text_col))
    schema = f"{id_col} {base.schema[0].dataType.simpleString()}, n_bytes long, removed array<struct<start:long,n:long>>, kept binary"
    return find_repeats(base, finish, schema, id_col, text_col, length)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, length: int = 50) -> DataFrame:
    """The documents with repeats cut out of their texts, and all their columns. A cut character is dropped whole.

    `count_col`, if given, gets the characters that remain. A null text stays null.
    """

    def finish(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = batch.schema.get_field_index(text_col)
        columns = list(batch.columns)
        hit = np.concatenate(([0], np.cumsum(gone)))[offsets]
        texts = columns[at].to_pylist()
        for k in np.flatnonzero(np.diff(hit)).tolist():
            a, b = offsets[k : k + 2]
            texts[k] = raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore")
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if count_col:
            n = batch.schema.get_field_index(count_col)
            columns[n] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return find_repeats(documents, finish, documents.schema, id_col, text_col, length)
