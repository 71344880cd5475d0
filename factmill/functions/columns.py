"""Scalar functions over text, money, periods and identities, as Column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of account and their size in yuan, those that others end in last, and the codes they go by.
UNITS = {"千万元": 10_000_000, "百万元": 1_000_000, "亿元": 100_000_000, "万元": 10_000, "千元": 1_000, "元": 1}
UNIT_CODES = {"qianwan_yuan": 10_000_000, "baiwan_yuan": 1_000_000, "yi_yuan": 100_000_000, "wan_yuan": 10_000, "qian_yuan": 1_000, "yuan": 1}
# Texts that stand for "no amount".
EMPTY_AMOUNTS = ("", "-", "--", "—", "——", "n/a", "na", "不适用", "无")
# The domains of each grade of source; others have the last one.
HOST_GRADES = {
    "A": ("gov.cn", "csrc.gov.cn", "sse.com.cn", "szse.cn", "bse.cn", "ndrc.gov.cn", "pbc.gov.cn", "miit.gov.cn", "samr.gov.cn", "stats.gov.cn", "cma.gov.cn"),
    "B": ("cninfo.com.cn",),
    "C": ("eastmoney.com", "10jqka.com.cn", "sina.com.cn", "163.com", "thepaper.cn", "yicai.com", "cls.cn", "stcn.com", "caixin.com", "hexun.com", "xueqiu.com", "cnstock.com"),
}
# The numberings of headings, in the order in which they are tried, with their levels, and what is no heading.
HEADINGS = (
    (r"^第[一二三四五六七八九十百零\d]+[节章]\s*[：:]*\s*(.*)", 1),
    (r"^[一二三四五六七八九十]+、\s*(.*)", 1),
    (r"^（[一二三四五六七八九十]+）\s*(.*)", 2),
    (r"^\d+\.?\d*\s+(.*)", 2),
    (r"^\d+\.\d+(?:\.\d+)?\s+(.*)", 3),
)
NO_HEADING = r"^\d{4}年|^\d{2,4}万|^\d{2,4}亿|^\d+%|^\d+元|^\d+人"


def squashed(text: Column) -> Column:
    """Runs of three or more line breaks as two, of three or more blanks as two, nothing at either end."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {3,}", "  "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def half_width(text: Column) -> Column:
    """Full-width letters, digits and signs as their ASCII forms."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def tokens(text: Column) -> Column:
    """Search tokens: pairs of neighbouring CJK characters (a lone one stands alone), other words and numbers whole."""
    runs = F.regexp_extract_all(half_width(text), F.lit(r"([\x{4e00}-\x{9fff}]+|[A-Za-z0-9]+(?:\.[0-9]+)?%?)"), F.lit(1))

    def split(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(r"^[\x{4e00}-\x{9fff}]"), F.when(F.length(run) == 1, F.array(run)).otherwise(pairs)).otherwise(F.array(F.lower(run)))

    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(runs, split)))


def item_name(text: Column) -> Column:
    """An item's name without numbering, punctuation or case."""
    plain = F.regexp_replace(F.lower(half_width(text)), r"^\s*([0-9]+|[ivx]+)[.)]\s*", "")
    return F.regexp_replace(plain, r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether the text holds any of the keywords, as a part of it."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(text, F.lit(k))
    return F.coalesce(found, F.lit(False))


def amount(text: Column, scale: int = 6) -> Column:
    """An amount as an exact decimal: parentheses are a minus, commas separate thousands; percentages are no amounts."""
    plain = F.trim(half_width(text))
    negative = plain.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.regexp_replace(plain, r"^\((.*)\)$", "$1"), ",", "")
    fine = bare.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$") & ~F.lower(plain).isin(*EMPTY_AMOUNTS)
    value = F.when(fine, bare.try_cast(f"decimal(38,{scale})"))
    return F.when(negative, -value).otherwise(value)


def display_increment(text: Column) -> Column:
    """The least step that an amount's digits show: 0.01 for two decimals, 1 for none."""
    decimals = F.length(F.regexp_extract(F.regexp_replace(half_width(text), r"[),\s]", ""), r"\.([0-9]+)$", 1))
    return F.when(text.isNotNull(), F.pow(F.lit(10.0), -decimals.cast("double")))


def unit_scale(unit: Column) -> Column:
    """Yuan to one unit, by name or code; an unknown unit has no scale."""
    out = F.lit(None).cast("long")
    for name, scale in (UNITS | UNIT_CODES).items():
        out = F.when(F.lower(F.trim(unit)) == name, F.lit(scale).cast("long")).otherwise(out)
    return out


def unit_of(text: Column) -> Column:
    """The first unit, longest names before shorter ones, that the text mentions."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(name)), F.lit(name)) for name in UNITS))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def growth(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / F.abs(before))


def large_number(value: Column) -> Column:
    """A decimal with the unit that suits its size, two digits rounded half up, trailing zeros cut."""
    size = F.abs(value)

    def shown(v: Column, unit: str) -> Column:
        text = F.round(v, 2).cast("decimal(30,2)").cast("string")
        return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit(unit))

    return F.when(size >= 100_000_000, shown(value / 100_000_000, "亿")).when(size >= 10_000, shown(value / 10_000, "万")).otherwise(shown(value, ""))


def header_period(text: Column) -> Column:
    """The period end that a column header names: a date, month, quarter, half or year, in this order; else null."""
    t = without_space(text)
    date = F.regexp_extract(t, r"((?:19|20)[0-9]{2})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})", 0)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    ymd, ym, yq, yh, y = r"((?:19|20)[0-9]{2})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})", r"((?:19|20)[0-9]{2})[-/年.]([0-9]{1,2})(?:月|$)", r"((?:19|20)[0-9]{2})(?:年)?[Qq]([1-4])", r"((?:19|20)[0-9]{2})(?:年)?[Hh]([12])", r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"
    day = lambda *parts: F.try_to_date(F.concat_ws("-", *parts), "y-M-d")
    return (
        F.when(date != "", day(part(ymd, 1), part(ymd, 2), part(ymd, 3)))
        .when(part(ym, 1) != "", F.last_day(day(part(ym, 1), part(ym, 2), F.lit("1"))))
        .when(part(yq, 1) != "", F.last_day(day(part(yq, 1), (part(yq, 2).try_cast("int") * 3).cast("string"), F.lit("1"))))
        .when(part(yh, 1) != "", F.last_day(day(part(yh, 1), (part(yh, 2).try_cast("int") * 6).cast("string"), F.lit("1"))))
        .when(part(y, 1) != "", day(part(y, 1), F.lit("12"), F.lit("31")))
    )


def period_type(end: Column) -> Column:
    """What a report with this period end is."""
    md = F.date_format(end, "MM-dd")
    return F.when(md == "12-31", "annual").when(md == "06-30", "interim").when(md.isin("03-31", "09-30"), "quarterly")


def prior_period(end: Column, kind: Column) -> Column:
    """The end of the period one year before; only annual, interim and quarterly periods have one."""
    return F.when(kind.isin("annual", "interim", "quarterly"), F.last_day(F.add_months(end, -12)))


def content_hash(text: Column, payload: Column | None = None) -> Column:
    """A digest of the text with its white space folded, and of a payload already in canonical form."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.sha2(F.concat(folded, F.lit("\u0000"), F.lit("") if payload is None else F.coalesce(payload, F.lit(""))), 256)


def coordinates_id(*parts: Column) -> Column:
    """An id of 32 hex digits from coordinates, one a line; nulls are empty lines."""
    return F.substring(F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def canonical_pairs(fields: dict[str, Column]) -> Column:
    """'name=value' of the non-null fields, by name, joined with ';'."""
    return F.concat_ws(";", *(F.when(fields[k].isNotNull(), F.concat(F.lit(f"{k}="), fields[k].cast("string"))) for k in sorted(fields)))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def host_grade(url: Column) -> Column:
    """The grade of a URL's host: one of the graded domains, or a host below one."""
    name = host(url)
    out = F.lit("D")
    for grade in ("C", "B", "A"):
        own = name.isin(*HOST_GRADES[grade])
        for d in HOST_GRADES[grade]:
            own = own | name.endswith(f".{d}")
        out = F.when(own, grade).otherwise(out)
    return out


def heading_level(line: Column) -> Column:
    """The level of a heading line by its numbering; null if it is none, has over 60 characters or begins with an amount."""
    s = F.trim(line)
    level = F.lit(None).cast("int")
    for pattern, n in reversed(HEADINGS):
        level = F.when(s.rlike(pattern), n).otherwise(level)
    return F.when((s != "") & (F.length(s) <= 60) & ~s.rlike(NO_HEADING), level)


def heading_title(line: Column) -> Column:
    """A heading's title without its numbering, or the whole line if nothing else stands there; at most 50 characters."""
    s = F.trim(line)
    title = F.lit(None).cast("string")
    for pattern, _ in reversed(HEADINGS):
        title = F.when(s.rlike(pattern), F.trim(F.regexp_extract(s, pattern, 1))).otherwise(title)
    whole = F.when(title == "", s).otherwise(title)
    return F.when(F.length(whole) > 50, F.concat(F.left(whole, F.lit(50)), F.lit("…"))).otherwise(whole)


def main_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def snippet(text: Column, head: int = 1200, tail: int = 300) -> Column:
    """A long text's beginning and end."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail))))
