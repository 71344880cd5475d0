"""Readers with declared schemas and reject tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import columns as C


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a file with an object a line, and the lines that don't fit the schema. Unknown fields are left out."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = raw.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select("value")


def html_pages(spark: SparkSession, path: str, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with their main text, host and the host's grade."""
    return spark.read.parquet(path).withColumns({"text": C.main_text(F.col(html)), "host": C.host(F.col(url)), "grade": C.host_grade(F.col(url))})


def page_numbers(spec: str, pages: int) -> list[int]:
    """The pages that '1-5' or '1,3,5' names; null or empty names all, and a page outside 1..pages is an error."""
    if not spec:
        return list(range(1, pages + 1))
    out: set[int] = set()
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        out |= set(range(int(first), int(last or first) + 1))
    if not out or min(out) < 1 or max(out) > pages:
        raise ValueError(f"pages must lie in 1..{pages}")
    return sorted(out)


def current_blocks(documents: DataFrame, sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of documents whose version and whose evidence set are current."""
    live = documents.where("status = 'current'").select("document_id", "document_version")
    version = sets.where("status = 'current'").select("document_id", "document_version", "evidence_set_version")
    return blocks.join(live, ["document_id", "document_version"]).join(version, ["document_id", "document_version", "evidence_set_version"], "left_semi")


def typed_cells(cells: DataFrame, unit: Column) -> DataFrame:
    """Text cells as candidates: exact amount, its least step, its value in the base unit, and a status."""
    amount, scale = C.amount(F.col("text")), C.unit_scale(unit)
    blank = F.lower(F.trim(F.coalesce("text", F.lit("")))).isin(*C.EMPTY_AMOUNTS)
    status = F.when(blank, "empty").when(amount.isNull(), "unparsable").when(scale.isNull(), "unknown_unit").otherwise("numeric")
    return cells.withColumns({"amount": amount, "step": C.display_increment(F.col("text")), "value": amount * scale, "status": status})


def period_columns(header: DataFrame) -> DataFrame:
    """Header cells (file, row, col, text) that name a period, of the first of 20 rows that names any."""
    named = header.where("row < 20").withColumn("period", C.header_period(F.col("text"))).where("period is not null")
    first = named.groupBy("file").agg(F.min("row").alias("row"))
    return named.join(first, ["file", "row"])
