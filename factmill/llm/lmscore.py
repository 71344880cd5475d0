"""Scores documents by the cross-entropy difference of a target and a background bigram model.

Both models have the same vocabulary of words, the same tables and the same smoothing:
p(w | v) = MIX * c(v, w) / c(v) + (1 - MIX) * (c(w) + 1) / (N + V), where V is the number of distinct words of all
documents, VOCABULARY at least. The target model counts the curated documents, the background model all documents. A
token's loss is -log p; a document's score is the mean difference of its tokens' losses, target less background, so lower
means more like the target.

Counts come from every token of every document, and every word and pair has a count of its own, under a key of 63 hashed
bits: the tables grow with the corpus. Each task sums its own share by chunks of text; a chunk sends its distinct keys to
the ranges of keys that own them, where they are summed and written. To score, a chunk asks the owners of its distinct
keys, and their answers meet the chunk's documents again. Neither the tables nor any count reach the driver; it gets the
totals, one row.

Words are what remains between white space after A-Z became a-z. Defined results: a null or empty text has no tokens,
losses of null and a null score. Without target documents every target probability is the smoothed one.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm import textarrays as ta
from factmill.llm.scratch import arrow_rows, discard, release, shuffle_partitions, written

#: Words that smoothing allows for at least, the weight of the pair counts, and bytes of text that are counted together.
VOCABULARY, MIX, CHUNK_BYTES = 1 << 18, 0.6, 18 << 20
#: Rows of a batch of parts of tables, which are larger than texts.
PART_ROWS = 64

#: Keys of words are odd, keys of pairs even. The word before a text's first is one that no text has.
_ONE, START = ta.U64(1), ta.U64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' words' keys, and how many words each row has."""
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, ta.U64), np.zeros(rows, np.int64)
    low = _LOWER[raw]
    begin, end, _ = ta.runs(low != 32, offsets)
    return ta.stretch_hash(ta.prefix_hash(low), begin, end) | _ONE, np.diff(np.searchsorted(begin, offsets))


def _before(word: np.ndarray, n: np.ndarray, start) -> np.ndarray:
    """What stands before each word, `start` before a row's first."""
    out = np.concatenate((np.array([start], word.dtype), word[:-1]))
    out[(np.cumsum(n) - n)[n > 0]] = start
    return out[: len(word)]


def pairs(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The key of each word with the one before it."""
    return ta.mix(ta.mix(_before(word, n, START)) + word) & ~_ONE


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed byte by byte; the first one's values ascend."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in (first, *columns[1:]))
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(-1))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _owned(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of ascending keys: equal ranges, so that keys ascend over the buckets as well."""
    bounds = np.searchsorted(((keys >> ta.U64(32)) * ta.U64(buckets)) >> ta.U64(32), np.arange(buckets + 1, dtype=ta.U64))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, slice(int(bounds[k]), int(bounds[k + 1]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows of CHUNK_BYTES of text or a bit more, with their words' keys and numbers of words. Text is column 1."""
    held: list[tuple] = []
    size = 0
    whole = lambda: ([x[0] for x in held], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]))
    for batch in batches:
        raw, offsets = ta.flat(batch.column(1))
        rest = batch.select([k for k in range(batch.num_columns) if k != 1])
        for a, b in ta.blocks(offsets):
            held.append((rest.slice(a, b - a), *tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            size += int(offsets[b] - offsets[a])
            if size >= CHUNK_BYTES:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(c[order], at) if len(at) else c[:0] for c in counts)


@dataclass
class Models:
    """Both models' counts: a written table with a row per range of keys, and the totals."""

    table: DataFrame  #: bucket, grams: keys with their counts in the target documents and in all documents
    buckets: int
    tokens: tuple[int, int]  #: of the target documents and of all documents
    words: int  #: distinct words of all documents
    vocabulary: int  #: V of the smoothing

    def discard(self) -> None:
        """Deletes the table, once all that is to be scored has been handed to score_documents."""
        discard(self.table)


def train(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Counts every word and pair, in the target documents and in all documents."""
    spark = documents.sparkSession
    arrow_rows(spark)
    marked = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = target_ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    marked = marked.join(F.broadcast(ids) if _few(ids) else ids, "id", "left").select("id", "text", "target")
    buckets = 2 * shuffle_partitions(spark)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, word, n in _chunks(batches):
            target = np.concatenate([np.asarray(x.column(1).fill_null(False)) for x in rows])
            start = np.array([(n > 0).sum(), (n[target] > 0).sum()])
            if not start[0]:
                continue
            mine = np.repeat(target, n)
            keys, all_ = np.unique(both := np.concatenate((word, pairs(word, n))), return_counts=True)
            some, many = np.unique(both[np.concatenate((mine, mine))], return_counts=True)
            given = np.zeros(len(keys), np.int64)
            given[np.searchsorted(keys, some)] = many
            keys, given, all_ = np.concatenate(([START], keys)), np.concatenate((start[1:], given)), np.concatenate((start[:1], all_))
            for bucket, part in _owned(keys, buckets):
                data = _pack(keys[part], given[part].astype("<u4"), all_[part].astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([data], pa.binary())], ["bucket", "grams"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(bucket: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
            keys, given, all_ = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            word = (keys & _ONE).astype(bool) & (keys != START)
            row = [bucket, int(word.sum()), int(given[word].sum()), int(all_[word].sum())]
            return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in row), pa.array([_pack(keys, given, all_)], pa.binary())], ["bucket", "words", "given", "counted", "grams"])

        now, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and bucket != now:
                    yield of(now, held)
                    held = []
                now = bucket
                keys, given, all_ = _unpack(data.as_buffer(), "<u8", "<u4", "<u4")
                held.append([keys, given.astype("<i8"), all_.astype("<i8")])
        if held:
            yield of(now, held)

    sent = marked.mapInArrow(local, "bucket long, grams binary").repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    table = written(sent.mapInArrow(total, "bucket long, words long, given long, counted long, grams binary"), "grams", "none")
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "given", "counted"))).first()
    del sent
    release(spark)
    return Models(table, buckets, (sums[1], sums[2]), sums[0], max(VOCABULARY, sums[0]))


def _few(ids: DataFrame, most: int = 500_000) -> bool:
    """Whether the ids are few enough to broadcast, by counting no further than that."""
    return ids.limit(most + 1).count() <= most


def _grams(words: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys that a chunk needs, ascending with START first, where its words are among them, and where the
    pair of each token is."""
    some, pair = np.unique(pairs(words[place], n), return_inverse=True)
    keys = np.concatenate(([START], words, some))
    order = np.argsort(keys, kind="stable")
    at = np.empty(len(keys), np.int64)
    at[order] = np.arange(len(keys))
    return keys[order], at[: len(words) + 1], at[len(words) + 1 :][pair]


def _by_count(many: np.ndarray) -> np.ndarray:
    """The words' places, most frequent words first."""
    return np.argsort(-many.astype(np.int64), kind="stable")


def _opened(data: pa.BinaryScalar) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
    words, place, n = (batch.column(k)[0].as_buffer() for k in (1, 2, 3))
    words, many = _unpack(words, "<u8", "<u4")
    return batch.column(0)[0].values, words, _by_count(many)[_unpack(place, "<u1", "<u4")[1]], _unpack(n, "<u1", "<u8")[1].astype(np.int64)


def score_documents(documents: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, target_loss and background_loss (means over tokens), and score, their difference."""
    spark = documents.sparkSession
    arrow_rows(spark)
    base = documents.select(id_col, F.col(text_col).cast("string").alias("text"))
    buckets, vocabulary, totals = models.buckets, models.vocabulary, models.tokens

    def structured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for rows, word, n in _chunks(batches):
            ids = pa.concat_arrays([x.column(0) for x in rows])
            words, place, many = np.unique(word, return_inverse=True, return_counts=True)
            place = np.argsort(_by_count(many))[place]  # frequent words get small numbers
            none = lambda x: np.zeros(len(x), np.uint8)
            parts = [_pack(words, many.astype("<u4")), _pack(none(place), place.astype("<u4")), _pack(none(n), n.astype("<u8"))]
            listed = pa.LargeListArray.from_arrays(pa.array([0, len(ids)], pa.int64()), ids)
            batch = pa.RecordBatch.from_arrays([listed, *(pa.array([x], pa.large_binary()) for x in parts)], ["ids", "words", "place", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])
            number += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, _, _ = _grams(*_opened(data)[1:])
                for bucket, part in _owned(keys, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([chunk]), pa.array([_pack(keys[part])], pa.binary())], ["bucket", "chunk", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        nothing = [np.zeros(0, "<u8"), np.zeros(0, "<i8"), np.zeros(0, "<i8")]
        for batch in batches:
            for bucket, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    now, table = bucket, nothing
                if chunk < 0:
                    table = _unpack(data.as_buffer(), "<u8", "<i8", "<i8")
                    continue
                (keys,) = _unpack(data.as_buffer(), "<u8")
                at = np.searchsorted(table[0], keys)
                known = at < len(table[0])
                known[known] = table[0][at[known]] == keys[known]
                found = [np.zeros(len(keys), "<i8") for _ in range(2)]
                for out, counts in zip(found, table[1:], strict=True):
                    out[known] = counts[at[known]]
                data = _pack(np.zeros(len(keys), np.uint8), *found)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket]), pa.array([data], pa.binary())], ["chunk", "bucket", "data"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(ids: pa.Array, words: np.ndarray, place: np.ndarray, n: np.ndarray, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
            keys, at, pair = _grams(words, place, n)
            before = at[_before(place + 1, n, 0)]
            word = at[1:][place]
            row = np.repeat(np.arange(len(n)), n)
            mean = []
            for k in (0, 1):
                counts = np.concatenate([x[k] for x in answers])
                if len(counts) != len(keys):
                    raise RuntimeError("a chunk's counts aren't whole")
                seen = counts[pair] / np.maximum(counts[before], 1)
                loss = -np.log(MIX * seen + (1 - MIX) * (counts[word] + 1) / (totals[k] + vocabulary))
                with np.errstate(invalid="ignore"):
                    mean.append(np.bincount(row, weights=loss, minlength=len(n)) / n)
            none = n == 0
            columns = [ids, pa.array(n, pa.int64()), pa.array(mean[0], mask=none), pa.array(mean[1], mask=none), pa.array(mean[0] - mean[1], mask=none)]
            return pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "target_loss", "background_loss", "score"])

        now, answers = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket < 0:
                    if now is not None:
                        yield of(*now, answers)
                    now, answers = _opened(data), []
                else:
                    answers.append(_unpack(data.as_buffer(), "<u1", "<i8", "<i8")[1:])
        if now is not None:
            yield of(*now, answers)

    chunks = written(base.mapInArrow(structured, "chunk long, data binary"), "words", "none")
    arrow_rows(spark, PART_ROWS)
    parts = shuffle_partitions(spark)

    def answered() -> DataFrame:
        asked = chunks.mapInArrow(ask, "bucket long, chunk long, data binary")
        owners = models.table.select("bucket", F.lit(-1).cast("long").alias("chunk"), F.col("grams").alias("data"))
        both = owners.unionAll(asked).repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
        return written(both.mapInArrow(answer, "chunk long, bucket long, data binary"), "answers", "none")

    answers = answered()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # its events hold the last plan
    release(spark)  # what was asked goes before the answers are dealt
    time.sleep(1)
    met = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "data").unionAll(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket")
    return met.mapInArrow(score, f"{id_col} {base.schema[0].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, score double")
