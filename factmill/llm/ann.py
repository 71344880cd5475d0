"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every row is indexed. A query probes the lists of its
nearest centroids, ranks their rows by asymmetric distance, and measures the best of them exactly on the original vectors, in
double precision. With q a query, c a centroid and r a coded residual, |q - c - r|^2 = |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r:
the bracket is stored with the row's code, and the last term is a sum of look-ups in a table made once per query.

Lists grow in number with the rows, and are dealt to tasks as (list, piece): a list is cut into as many pieces as its rows
need, by the hash of the row, so a vector that a third of all rows repeat fills many pieces and no task. Each task returns its
own best rows, which are then ranked again.

Defined results: vectors that are null, all zero, of another length than most, or that hold a null or non-finite
component take no part, and neither do rows without an id. Equal distances go to the smaller id. Fewer candidates than
`k` are all returned. A row is never its own neighbour, but other rows with its id are candidates like all others; query rows
with equal ids have an answer each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.scratch import arrow_rows, shuffle_partitions, written

#: Rows that centroids and codebooks are fitted on, at most: those whose ids hash lowest.
SAMPLE_ROWS = 8192
#: Coarse centroids at most, and sampled rows for each; the share of lists that a query probes, and the least number of them.
LISTS, ROWS_PER_LIST, SHARE, LEAST_PROBES = 1024, 8, 0.4, 32
#: Rows of a list's piece; rows of a task, about; rows that a task measures exactly for a query.
PIECE_ROWS, TASK_ROWS, RERANK = 8192, 1 << 16, 40
SUBSPACES, CODES, ROUNDS = 16, 256, 8


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances from each row to each centroid."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; rows are taken in blocks that bound the table of distances."""
    if not len(x):
        return np.zeros(0, np.int64)
    step = max(1, (1 << 21) // len(c))
    return np.concatenate([_far(x[a : a + step], c).argmin(1) for a in range(0, len(x), step)])


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from a random start."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    centroids: np.ndarray
    books: np.ndarray  #: for each subspace a codebook of residuals, as whole vectors that are 0 elsewhere
    cuts: list[int]

    @classmethod
    def fit(cls, sample: np.ndarray) -> Index:
        centroids = _means(sample, max(1, min(LISTS, len(sample) // ROWS_PER_LIST)), 1)
        rest = sample - centroids[_nearest(sample, centroids)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
        books = np.zeros((len(cuts) - 1, min(CODES, len(sample)), sample.shape[1]))
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            books[s, :, a:b] = _means(rest[:, a:b], CODES, 2 + a)
        return cls(centroids, books, cuts)

    @property
    def probes(self) -> int:
        return min(len(self.centroids), max(LEAST_PROBES, int(np.ceil(SHARE * len(self.centroids)))))

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's codes, as places in a query's table, and its stored term."""
        center = self.centroids[lists]
        rest, about = x - center, np.zeros_like(x)
        codes = np.zeros((len(x), len(self.books)), np.int32)
        for s, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            codes[:, s] = _nearest(rest[:, a:b], self.books[s, :, a:b])
            about[:, a:b] = self.books[s, codes[:, s], a:b]
        return codes + np.arange(len(self.books), dtype=np.int32) * self.books.shape[1], (about * about).sum(1) + 2 * (center * about).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, -2 q.r of every code of every subspace."""
        return -2 * q @ self.books.reshape(-1, self.books.shape[2]).T


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_index(clean: DataFrame) -> Index | None:
    """The index of the rows that `_clean` left, fitted on the most frequent length of vectors."""
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow()
    if not len(sample):
        return None
    return Index.fit(_matrix(sample.column("v")))


def nearest(vectors: DataFrame, queries: Callable[[F.Column], F.Column], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id `queries` holds for, its k nearest others: query_id, rank, the neighbour's id and its distance."""
    spark = vectors.sparkSession
    arrow_rows(spark, 10_000)
    size = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size["n"] if size else 0
    clean = _clean(vectors.where(F.size(vector_col) == dim), id_col, vector_col)
    index = fit_index(clean)
    schema = f"query_id long, rank int, {id_col} long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            near = _nearest(_matrix(batch.column(1)), sent.value.centroids) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(row + np.arange(batch.num_rows)), *batch.columns], ["list", "row", "id", "v"])
            row += batch.num_rows

    filed = written(clean.mapInArrow(assign, "list int, row long, id long, v array<double>"), "lists")
    sizes = filed.groupBy("list").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))  # a row per centroid: bounded
    parts = max(shuffle_partitions(spark), -(-(filed.count()) // TASK_ROWS))
    piece = F.pmod(F.xxhash64("row"), "pieces")
    base = filed.join(F.broadcast(sizes), "list").select(F.pmod(F.xxhash64("list", piece), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("role"), "list", "row", "id", "v")
    asked = filed.where(queries(F.col("id"))).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("role"), "list", "row", "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, task = None, [], None
        for batch in batches:
            place = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(1))
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(place)], strict=True):
                if place[a] >> 1 != part:
                    part, held, task = place[a] >> 1, [], None
                rows = batch.slice(a, b - a)
                if place[a] & 1 == 0:
                    held.append(rows)
                elif held:
                    task = task or _Rows(sent.value, held)
                    yield from task.best(rows, k)

    dealt = base.unionAll(asked).repartition(parts, "part").sortWithinPartitions("part", "role")
    found = dealt.mapInArrow(search, "query long, query_id long, id long, row long, score double")
    rows = F.array_sort(F.collect_list(F.struct("score", "id", "row")))
    best = found.groupBy("query", "query_id").agg(F.slice(rows, 1, k).alias("best"))  # k rows of each task
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


class _Rows:
    """The indexed rows of a task, in order of their lists and ids."""

    def __init__(self, index: Index, held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held)
        list_, row, id_ = (np.asarray(rows.column(c)).astype(np.int64) for c in ("list", "row", "id"))
        order = np.lexsort((row, id_, list_))
        self.index, self.list, self.row, self.id = index, list_[order], row[order], id_[order]
        self.x = _matrix(rows.column("v"))[order]
        self.codes, self.term = index.code(self.x, self.list)
        self.first = np.searchsorted(self.list, np.arange(len(index.centroids) + 1))

    def best(self, asked: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        """Each query's k nearest rows among those of the probed lists with the least asymmetric distances."""
        query, id_, q = np.asarray(asked.column(3)), np.asarray(asked.column(4)), _matrix(asked.column(5))
        out = []
        for a in range(0, len(q), 256):
            coarse = _far(q[a : a + 256], self.index.centroids)
            probed = np.argsort(coarse, axis=1, kind="stable")[:, : self.index.probes]
            tables = self.index.tables(q[a : a + 256])
            for j in range(len(tables)):
                lists = probed[j]
                n = self.first[lists + 1] - self.first[lists]
                ends = np.cumsum(n)
                at = np.repeat(self.first[lists] - ends + n, n) + np.arange(int(ends[-1]))
                if not len(at):
                    continue
                far = np.repeat(coarse[j, lists], n) + self.term[at] + tables[j][self.codes[at]].sum(1)
                near = at[np.argsort(far, kind="stable")[: max(RERANK, 2 * k)]]
                d = np.sqrt(((self.x[near] - q[a + j]) ** 2).sum(1))
                other = self.row[near] != query[a + j]
                near, d = near[other], d[other]
                top = np.lexsort((self.row[near], self.id[near], d))[:k]
                out.append((np.full(len(top), query[a + j]), np.full(len(top), id_[a + j]), self.id[near][top], self.row[near][top], d[top]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "query_id", "id", "row", "score"])
