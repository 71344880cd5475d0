"""A linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its hashed byte n-grams, each with the logarithm of one more than its count. Feature j is scaled by
r_j = log((p_j / |p|) / (q_j / |q|)), the log ratio of smoothed counts under the two labels; logistic regression over
the scaled features gives the weights. N-grams whose ratio is near 0, or that few documents hold, have weight 0. The model is a table of fixed size, so scoring is one pass without a shuffle.

Fitting reads labelled rows only: at most SAMPLE_ROWS of each label, those whose ids hash lowest. All rows of that
sample take part whole; longer texts than SAMPLE_BYTES are not sampled. Class weights follow the share of label 1 among all labelled rows.

Defined results: a null or empty text scores what a text without known n-grams scores. Rows with a null label or id
don't train. Without both labels every text scores the share of label 1, or 0.5 without any labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm import textarrays as ta
from factmill.llm.scratch import arrow_rows

#: Rows of each label that the classifier is fitted on, at most, and bytes of the longest text among them: what the driver holds.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 1 << 20
ORDERS = (3, 4, 5, 6)
BITS = 22
#: A feature counts if so many sampled rows hold it (fewer if there are not ten times as many of the rarer label, but two) and
#: its ratio is so far from 1, as a logarithm.
LEAST_ROWS, LEAST_RATIO = 10, 2.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


@dataclass
class Model:
    features: np.ndarray  #: sorted feature numbers
    weights: np.ndarray  #: what each adds to the log odds
    bias: float

    def score(self, table: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature, much = _features(raw, offsets, table)
        odds = np.bincount(row, weights=much * self.weights[np.searchsorted(self.features, feature)], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def table(self) -> np.ndarray:
        """Which feature numbers have a weight."""
        out = np.zeros(1 << BITS, bool)
        out[self.features] = True
        return out


def _features(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs and log2(1 + count), of the features in `table` if given. Texts stand between spaces."""
    n = np.diff(offsets)
    padded = np.full(len(raw) + 2 * len(n) + max(ORDERS), 32, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = _LOWER[raw]
    begin = offsets[:-1] + 2 * np.arange(len(n))
    end = begin + n + 2
    sums = ta.prefix_hash(padded)
    inverse = ta._powers(ta._INVERSE, len(padded))
    pairs = []
    for k in ORDERS:
        h = (sums[k:] - sums[:-k]) * inverse[: len(padded) - k + 1]
        h += ta.U64(k)
        h *= ta.U64(0xD6E8FEB86659FD93)
        h >>= ta.U64(64 - BITS)
        at = np.arange(len(h)) if table is None else np.flatnonzero(table[h])
        row = np.searchsorted(begin, at, "right") - 1
        inside = at + k <= end[row] if len(n) else np.zeros(0, bool)
        pairs.append((row[inside].astype(np.int64) << BITS) | h[at[inside]].astype(np.int64))
    both, n = np.unique(np.concatenate(pairs), return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), np.log2(n + 1.0)


def fit(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """The classifier of these texts, where label 1 has this share among the rows to score."""
    raw, offsets = ta.flat(pa.array(texts, pa.large_string()))
    p, q, held = np.ones(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), np.zeros(1 << BITS, np.int32)
    parts = list(ta.blocks(offsets, ta.BLOCK_BYTES // 4))
    for a, b in parts:  # the pairs of all rows would not fit a small driver
        row, feature, much = _features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        one = labels[row + a] == 1
        np.add.at(p, feature[one], much[one].astype(np.float32))
        np.add.at(q, feature[~one], much[~one].astype(np.float32))
        np.add.at(held, feature, 1)
    ratio = np.log(p / p.sum(dtype=np.float64)) - np.log(q / q.sum(dtype=np.float64))
    rarer = min(int((labels == 1).sum()), int((labels != 1).sum()))
    chosen = np.flatnonzero((held >= max(2, min(LEAST_ROWS, rarer // 10))) & (np.abs(ratio) >= LEAST_RATIO))
    ratio = ratio[chosen].astype(np.float64)
    table = np.zeros(1 << BITS, bool)
    table[chosen] = True
    found = []
    for a, b in parts:
        row, feature, much = _features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
        found.append(((row + a).astype(np.int32), np.searchsorted(chosen, feature).astype(np.int32), much))
    row, column, much = (np.concatenate(x) for x in zip(*found, strict=True))
    del table, found, raw, p, q, held
    x = much * ratio[column]
    w, bias = np.zeros(len(chosen)), 0.0
    target = (labels == 1).astype(float)
    weight = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 401):
        odds = np.bincount(row, weights=x * w[column], minlength=len(labels)) + bias
        slope = weight * (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - target)
        g = np.bincount(column, weights=x * slope[row], minlength=len(chosen)) + 1e-3 * w
        gb = slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.02 * (m / a) / (np.sqrt(v / c) + 1e-9)
        bias -= 0.02 * (mb / a) / (np.sqrt(vb / c) + 1e-9)
    scaled = w * ratio
    some = np.abs(scaled) > 1e-6
    return Model(chosen[some], scaled[some], float(bias + np.log(share / (1 - share))))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The classifier of the labelled documents, fitted on at most `sample_rows` rows of each label."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))  # a row marked both ways counts as marked
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = 0.5 if not total else min(max(counts.get(1, 0) / total, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    text = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = text.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "id").toArrow()  # at most 2 * sample_rows rows are broadcast
    rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
    label = np.asarray(rows.column("label"))
    if len(set(label.tolist())) < 2:
        share = min(max(counts.get(1, 0) / total, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    return fit(rows.column("text").to_pylist(), label, counts[1] / total)


def _scorer(sent, column: int):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        model = sent.value
        table = model.table()
        for batch in batches:
            raw, offsets = ta.flat(batch.column(column))
            out = np.zeros(batch.num_rows)
            for a, b in ta.blocks(offsets):
                out[a:b] = model.score(table, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch, out

    return scores


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the score, from 0 to 1, of every text."""
    spark = documents.sparkSession
    arrow_rows(spark)
    scores = _scorer(spark.sparkContext.broadcast(model), 1)
    base = documents.select(id_col, F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scores(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [id_col, "score"])

    return base.mapInArrow(run, f"{id_col} {base.schema[0].dataType.simpleString()}, score double")


def remove_toxic(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score less than the threshold, with all their columns."""
    spark = documents.sparkSession
    arrow_rows(spark)
    scores = _scorer(spark.sparkContext.broadcast(model), documents.columns.index(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scores(batches):
            if (score < threshold).any():
                yield batch.filter(pa.array(score < threshold))

    return documents.mapInArrow(run, documents.schema)
