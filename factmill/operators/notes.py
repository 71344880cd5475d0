"""Tables that were flattened into lines: their lines' roles, headers, rows and what goes on across blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions import amounts as ax

# Shapes of lines and the words that head a table's label column.
TITLE, UNIT_LINE, NUMERIC, YEAR = r"^表\s*(\d+)-(\d+)\s*(.*)$", r"^单位\s*[:：]\s*(.*)$", r"^-?[\d,]+(\.\d+)?%?$", r"(20\d{2}|19\d{2})"
LABELS = ("项目", "科目", "指标", "名称", "产品", "业务", "板块", "客户", "区域")
NEW_TABLE = ("表", "项目", "科目", "指标", "单位", "金额", "占比")
CLOSING = ("合计", "总计", "小计")
PAGE_NUMBER = r"^(第\s*\d{1,4}\s*页|[Pp]age\s*\d{1,4}|\d{1,4}|[—\-–·]\s*\d{1,4}\s*[—\-–·])$"
CONTENTS_LINE, CONTENTS_TITLE = r"\.{5,}\s*\d+$|^\d+\.?\s*\.{5,}", r"目\s*录|目次"


def data_row(tokens: Column) -> Column:
    """A label and then numbers only."""
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return (F.size(tokens) >= 2) & ~tokens[0].rlike(NUMERIC) & F.forall(rest, lambda t: t.rlike(NUMERIC))


def cells(line: Column) -> Column:
    """A line's columns, cut at two or more blanks, each with single blanks inside."""
    parts = F.filter(F.split(F.trim(line), r"\s{2,}"), lambda c: c != "")
    return F.transform(parts, lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))


def numeric_cell(cell: Column) -> Column:
    """A number, or several that were glued into one cell."""
    token = lambda p: p.rlike(r"\d") & p.rlike(r"^[0-9,，.%\-+（）()]+$")
    s = F.trim(cell)
    return F.coalesce((s != "") & (s.rlike(r"^[-+]?[\d,，.]+(?:%|％)?$") | F.forall(F.split(s, r"\s+"), token)), F.lit(False))


def line_role(line: Column) -> Column:
    """What a line is by its shape: blank, page, title, unit, total, data, columns or prose, the first that fits."""
    s = F.trim(line)
    c = cells(s)
    prose = s.rlike("[。！？；]")
    closing = s.rlike("|".join(CLOSING))
    return (
        F.when(s == "", "blank")
        .when(s.rlike(PAGE_NUMBER), "page")
        .when(s.rlike(r"^表\s*\d"), "title")
        .when(s.rlike(r"单位\s*[:：]"), "unit")
        .when(closing & F.exists(c, numeric_cell), "total")
        .when(F.exists(c, numeric_cell), "data")
        .when((F.size(c) >= 2) & ~prose, "columns")
        .otherwise("prose")
    )


def flat_headers(first: Column, second: Column) -> Column:
    """Two layers of headers as one: the label column, then each year with each of its share of the second layer."""
    years = F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0)))
    each = F.when(F.size(years) > 0, F.floor(F.size(second) / F.greatest(F.size(years), F.lit(1))).cast("int")).otherwise(0)
    crossed = F.flatten(F.transform(years, lambda y, i: F.transform(F.slice(second, i * each + 1, each), lambda x: F.concat(y, x))))
    label = F.array(F.coalesce(F.try_element_at(first, F.lit(1)), F.lit("项目")))
    return F.concat(label, F.when(F.size(second) > 0, crossed).otherwise(years))


def note_tables(blocks: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """The tables of notes in a document's lines: (document, table, title, unit, headers, rows, block of the first row).

    A title '表 m-n' opens a table; then a unit line, a first header (a label word and a year), a second one (sums and shares)
    and data rows may follow, each kind of header once; any other line closes it. Without a header or rows there is no table.

    A line's kind hangs on the lines of its table before it only through "has there been one of these yet", so kinds
    follow from running counts over the table, not from a fold: the window is sorted once by document, block and line.
    """
    lines = blocks.select(document, F.col(order).alias("block"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("tokens", F.split("line", r"\s+"))
    whole = Window.partitionBy(document).orderBy("block", "at")
    lines = lines.withColumn("is_title", F.col("line").rlike(TITLE)).withColumn("table", F.count_if("is_title").over(whole)).where("table > 0")
    here = Window.partitionBy(document, "table").orderBy("block", "at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    label = F.col("tokens")[0].rlike("|".join(LABELS))
    unit = F.col("line").rlike(UNIT_LINE) & ~F.col("is_title")
    named = F.split(F.regexp_replace(F.regexp_extract("line", UNIT_LINE, 1), "[，、；%]", ","), ",")[0]
    lines = lines.withColumn("unit_value", F.when(unit, F.nullif(F.trim(named), F.lit(""))))
    first_unit = F.coalesce(F.max(F.col("unit_value").isNotNull()).over(before), F.lit(False))
    head = label & F.exists("tokens", lambda t: t.rlike(YEAR))
    lines = lines.withColumn("is_unit", unit & ~first_unit).withColumn("head", head & ~F.col("is_title") & ~F.col("is_unit"))
    lines = lines.withColumn("had_head", F.coalesce(F.max("head").over(before), F.lit(False)))
    lines = lines.withColumn("is_head", F.col("head") & ~F.col("had_head"))
    second = F.col("had_head") & ~label & F.forall("tokens", lambda t: t.rlike(r"占比|比例|%|^\d+$") | (t == "金额")) & ~F.col("is_title") & ~F.col("is_unit")
    lines = lines.withColumn("second", second)
    lines = lines.withColumn("is_second", F.col("second") & ~F.coalesce(F.max("second").over(before), F.lit(False)))
    lines = lines.withColumn("is_data", ~F.col("is_title") & ~F.col("is_unit") & ~F.col("is_head") & ~F.col("is_second") & data_row(F.col("tokens")))
    lines = lines.withColumn("closes", ~(F.col("is_title") | F.col("is_unit") | F.col("is_head") | F.col("is_second") | F.col("is_data")))
    lines = lines.withColumn("closed", F.max("closes").over(here)).where("not closed")
    place = F.struct("block", "at")
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_data"), F.struct("block", "at", F.array_join("tokens", " ").alias("row"))))), lambda x: x["row"])
    found = lines.groupBy(document, "table").agg(
        F.max(F.when(F.col("is_title"), F.concat(F.lit("表"), F.regexp_extract("line", TITLE, 1), F.lit("-"), F.regexp_extract("line", TITLE, 2), F.when(F.regexp_extract("line", TITLE, 3) != "", F.concat(F.lit(" "), F.regexp_extract("line", TITLE, 3))).otherwise("")))).alias("title"),
        F.min_by("unit_value", F.when(F.col("is_unit") & F.col("unit_value").isNotNull(), place)).alias("unit"),
        F.max(F.when(F.col("is_head"), F.col("tokens"))).alias("first"),
        F.coalesce(F.max(F.when(F.col("is_second"), F.col("tokens"))), F.array().cast("array<string>")).alias("second"),
        rows.alias("rows"),
        F.min(F.when(F.col("is_data"), F.col("block"))).alias("data_block"),
    )
    return found.where("first is not null and size(rows) > 0").select(document, "table", "title", "unit", flat_headers(F.col("first"), F.col("second")).alias("headers"), "rows", "data_block")


def note_items(tables: DataFrame, document: str) -> DataFrame:
    """A row per cell of the tables: label, header, the year it names, whether it is a share, and the number."""
    row = tables.select(document, "table", "unit", "headers", F.posexplode("rows").alias("row", "line")).withColumn("cells", F.split("line", " "))
    cell = row.select(document, "table", "unit", "headers", "row", F.col("cells")[0].alias("label"), F.posexplode("cells").alias("at", "cell")).where("at > 0")
    header = F.try_element_at("headers", F.col("at") + 1)
    year = F.regexp_extract(header, YEAR, 1)
    return cell.select(document, "table", "row", "label", "at", header.alias("header"), F.when(year != "", F.concat(year, F.lit("-12-31"))).alias("period"), F.coalesce(header.rlike("占比|比例|%"), F.lit(False)).alias("is_share"), "unit", ax.note_number(F.col("cell")).alias("value"))


def continued(blocks: DataFrame, seeds: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """The rows of blocks that go on a seed's table: later blocks of the same document version and section whose first line
    names no new table. A block that does is left out, and those after it still count. One row per seed: its rows and how many
    blocks went in."""
    rows = lambda t: F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    placed = blocks.select(*key, F.col(order).alias("at"), rows(F.col(text)).alias("lines"))
    fresh = F.coalesce(F.col("lines")[0].rlike("|".join(NEW_TABLE)), F.lit(False))
    later = placed.where((F.size("lines") > 0)).withColumn("fresh", fresh).where("not fresh").select(*key, "at", "lines")
    seed = seeds.select(*key, F.col(order).alias("seed"), rows(F.col(text)).alias("own"))
    met = seed.join(later, key, "left").where("at is null or at > seed")
    kept = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "lines"))), lambda x: x["lines"]))
    some = met.where("at is not null").groupBy(*key, "seed").agg(kept.alias("more"), F.count("*").alias("blocks"))
    out = seed.join(some, [*key, "seed"], "left")
    return out.select(*key, "seed", F.concat("own", F.coalesce("more", F.array().cast("array<string>"))).alias("rows"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def contents_page(text: Column) -> Column:
    """A page that is a table of contents: its title, three lines with leaders, or more than three in ten of them."""
    lines = F.split(text, "\n")
    solid = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    titled = F.exists(solid, lambda x: x.rlike(CONTENTS_TITLE))
    n = F.size(F.filter(solid, lambda x: x.rlike(CONTENTS_LINE)))
    return F.coalesce((F.length(text) >= 20) & (titled | (n >= 3) | ((F.size(lines) > 3) & (n / F.size(lines) > 0.3))), F.lit(False))


def stripped_lines(text: Column, gone: Column) -> Column:
    """A page without the lines in `gone` (compared without white space), unless more than half of its characters would go."""
    lines = F.split(text, "\n")
    norm = lambda x: F.regexp_replace(x, r"\s+", "")
    marks = F.transform(gone, norm)
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(F.trim(x)))
    hit = F.filter(lines, lambda x: F.array_contains(marks, norm(x)))
    kept = F.filter(lines, lambda x: ~F.array_contains(marks, norm(x)))
    return F.when(size(hit) * 2 > size(lines), text).otherwise(F.array_join(kept, "\n"))
