"""Document structure: chunks, headings, repeated page lines, neighbours and values carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions import columns as C

CHUNK, OVERLAP = 1200, 100


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Paragraphs (between blank lines) packed greedily to at most `size` characters, two for each joint.

    A longer paragraph is cut every `size` characters, each piece but the first beginning `overlap` earlier.
    """
    step = size - overlap
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")

    def pieces(p: Column) -> Column:
        last = F.greatest(F.ceil((F.length(p) - overlap) / step) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(p, (i * step + 1).cast("int"), F.lit(size)))

    def add(state: Column, p: Column) -> Column:
        joined = F.concat_ws("\n\n", state["open"], p)
        flushed = F.when(state["open"].isNotNull(), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        long_, fits = F.length(p) > size, F.length(joined) <= size
        done = F.when(long_, F.concat(flushed, pieces(p))).when(fits, state["done"]).otherwise(flushed)
        return F.struct(done.alias("done"), F.when(long_, F.lit(None).cast("string")).when(fits, joined).otherwise(p).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(paragraphs, start, add, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def page_furniture(pages: DataFrame, document: str, text: str) -> DataFrame:
    """Lines that begin or end many of a document's pages: (document, place, line, n) with n >= max(2, a fifth of the pages).

    A page's only line is its first, not its last."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), C.without_space), lambda x: x != "")
    ends = pages.select(F.col(document).alias("document"), lines.alias("lines")).where(F.size("lines") > 0)
    both = F.array(F.struct(F.lit("header").alias("place"), F.element_at("lines", 1).alias("line")), F.struct(F.lit("footer").alias("place"), F.when(F.size("lines") > 1, F.element_at("lines", -1)).alias("line")))
    counted = ends.select("document", F.explode(both).alias("x")).where("x.line is not null").groupBy("document", "x.place", "x.line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy(F.col(document).alias("document")).agg(F.count("*").alias("pages"))
    return counted.join(sizes, "document").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.2))).select("document", "place", "line", "n")


def headings(lines: DataFrame, text: str = "line") -> DataFrame:
    """The lines that are numbered headings, with their level and title."""
    level = C.heading_level(F.col(text))
    return lines.withColumn("level", level).where("level is not null").withColumn("title", C.heading_title(F.col(text)))


def carried(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Each row's own value, or the last one before it in its group."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def neighbours(rows: DataFrame, key: list[str], order: list[str], anchor: Column, before: int, after: int) -> DataFrame:
    """Rows within `before` and `after` places of a row that `anchor` holds for, with the anchor's distance."""
    w = Window.partitionBy(*key).orderBy(*order)
    placed = rows.withColumn("at", F.row_number().over(w))
    anchors = placed.where(anchor).select(*key, F.explode(F.sequence(F.col("at") - before, F.col("at") + after)).alias("at"), F.col("at").alias("anchor_at"))
    return placed.join(anchors, [*key, "at"]).withColumn("distance", F.col("at") - F.col("anchor_at"))


def runs(rows: DataFrame, key: list[str], order: list[str], same: str) -> DataFrame:
    """Numbers the runs of neighbouring rows that have an equal value."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change")
