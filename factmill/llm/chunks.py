"""Documents dealt into chunks: rows that travel and are answered together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from factmill.llm import textarrays as ta
from factmill.llm.scratch import arrow_rows, written


def _chunks(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            _, offsets = ta.flat(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in ta.blocks(offsets):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(offsets[b] - offsets[a])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "rows"])
                number += 1

    return run


def chunked(documents: DataFrame, text_col: str) -> DataFrame:
    """A written table with a row per chunk: its number, its bytes of text, and its rows in Arrow's compressed form.

    A chunk has some 1 MB of text, or one longer text, and less than 2**20 rows.
    """
    arrow_rows(documents.sparkSession)
    return written(documents.mapInArrow(_chunks(text_col), "chunk long, n_bytes long, rows binary"), "chunks", "none")


def opened(rows) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_next_batch()
