"""Counts documents' tokens in flat token files that have no index, by searching them for the end-of-document id.

A file is a stream of little-endian unsigned 16-bit ids in blocks of a fixed size; documents follow one another, each
ended by the separator, and cross blocks anywhere. Every block is searched by itself, with one vector comparison. What a
block must know of those before it - tokens and separators so far, and where the last separator stood - is a prefix sum
and a prefix maximum over one small row per block, taken in two levels (within runs of RUN blocks, then over the runs),
so a file of any length is scanned by many tasks.

Defined results: a null or empty text is a document of no tokens; tokens after a file's last separator are a document
that isn't ended; a file without tokens has no documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factmill.llm.scratch import arrow_rows, written

#: Tokens of a block, blocks of a run, and bytes of raw files for a task.
BLOCK_TOKENS, RUN, TASK_BYTES = 1 << 19, 1024, 64 << 20

BLOCKS = "file long, block long, tokens binary, docs array<long>"
_ENCODERS: dict[str, object] = {}


def _encoder(path: str, pattern: str):
    """The encoder of a file of ranks, loaded once in a process. Special tokens' strings are ordinary text to it."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def write_tokens(documents: DataFrame, ranks: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files, one per partition, as a written table of blocks; `docs` has the ids of the documents that end in
    a block, which the scan doesn't use."""
    if not 0 < eod < 1 << 16:
        raise ValueError("ids are unsigned 16-bit")
    arrow_rows(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks, pattern).encode_ordinary
        file, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        ids: list[tuple[int, int | None]] = []  # where each document ends among what is held
        size = 0

        def take(n: int) -> pa.RecordBatch:
            nonlocal held, ids, size, block
            all_ = np.concatenate(held)
            mine = [d for at, d in ids if at < n]
            ids = [(at - n, d) for at, d in ids if at >= n]
            held, size = [all_[n:]], size - n
            out = [pa.array([file]), pa.array([block]), pa.array([all_[:n].astype("<u2").tobytes()], pa.binary()), pa.array([mine], pa.list_(pa.int64()))]
            block += 1
            return pa.RecordBatch.from_arrays(out, ["file", "block", "tokens", "docs"])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(np.array([*encode(text or ""), eod], np.uint16))
                size += len(held[-1])
                ids.append((size - 1, d))
                while size >= block_tokens:
                    yield take(block_tokens)
        if size:
            yield take(size)

    base = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(base.mapInArrow(run, BLOCKS), "tokens")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Raw token files of any size, as a table of blocks, one at least for each file.

    Spark lists the files; each block's bytes are read by the task that searches it, so one file is the work of many tasks
    and none holds more than a block. Tasks open files with Arrow's file systems: local or shared folders, hdfs, s3, gs.
    """
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", F.greatest(F.ceil(F.col("length") / size), F.lit(1)).alias("n"))
    total = files.agg(F.sum("n")).first()[0] or 1
    ranges = files.select(F.xxhash64("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                local = name.removeprefix("file:") if name.startswith("file:") else None
                system, at = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local else fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    f.seek(block * size)
                    some = f.read(size)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([some], pa.binary()), pa.array([[]], pa.list_(pa.int64()))], ["file", "block", "tokens", "docs"])

    tasks = -(-total * size // TASK_BYTES)
    return ranges.repartition(tasks, "file", "block").mapInArrow(read, BLOCKS)


def scan_tokens(blocks: DataFrame, eod: int) -> DataFrame:
    """One row per document: file, ordinal, start (its first token's place in the file), n_tokens without the separator,
    whether it was ended, and doc_id where the writer knew it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer() if x.is_valid else b"", "<u2") for x in batch.column(2)]
            found = [np.flatnonzero(x == eod) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(found, pa.list_(pa.int64())), batch.column(3)],
                ["file", "block", "n", "ends", "docs"],
            )

    found = written(blocks.mapInArrow(search, "file long, block long, n long, ends array<long>, docs array<long>"), "ends")
    run = F.floor(F.col("block") / RUN)
    row = found.select("file", "block", run.alias("run"), "n", F.size("ends").cast("long").alias("many"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = row.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("many").over(before), F.lit(0))).withColumn("stop", F.col("at") + F.col("last"))
    here = here.withColumn("prior", F.max("stop").over(before))
    earlier = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = here.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("many").alias("many"), F.max("stop").alias("stop"), F.max("block").alias("final"))
    runs = runs.withColumn("run_at", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("run_ordinal", F.coalesce(F.sum("many").over(earlier), F.lit(0)))
    runs = runs.withColumn("run_prior", F.max(F.col("run_at") + F.col("stop")).over(earlier)).withColumn("end_run", F.max("run").over(Window.partitionBy("file")))
    runs = runs.select("file", "run", "run_at", "run_ordinal", "run_prior", F.when(F.col("run") == F.col("end_run"), F.col("final")).alias("final"))
    stitched = here.join(runs, ["file", "run"]).select(
        "file",
        "block",
        "final",
        (F.col("run_at") + F.col("at")).alias("at"),
        (F.col("run_ordinal") + F.col("ordinal")).alias("ordinal"),
        F.coalesce(F.col("run_at") + F.col("prior"), "run_prior", F.lit(-1)).alias("prior"),
    )
    docs = found.join(stitched, ["file", "block"])
    # the document after a file's last separator ends at the file's end
    tail = F.when((F.col("block") == F.col("final")) & (F.col("n") > F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.lit(0))), F.array(F.col("n"))).otherwise(F.expr("cast(array() as array<long>)"))
    open_ = F.when((F.col("block") == F.col("final")) & (F.size("ends") == 0) & (F.col("n") == 0) & (F.col("at") - 1 > F.col("prior")), F.array(F.col("n"))).otherwise(tail)
    ends = docs.select("file", "at", "ordinal", "prior", "docs", "ends", F.posexplode(F.concat("ends", open_)).alias("k", "stop"))
    before_ = F.when(F.col("k") > 0, F.col("at") + F.expr("try_element_at(ends, k)")).otherwise(F.col("prior"))
    out = ends.withColumn("start", before_ + 1)
    return out.select(
        "file",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        "start",
        (F.col("at") + F.col("stop") - F.col("start")).alias("n_tokens"),
        (F.col("k") < F.size("ends")).alias("ended"),
        F.expr("try_element_at(docs, k + 1)").alias("doc_id"),
    )
