"""The engine's own operators on small literal tables."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factmill.functions import columns as C
from factmill.operators import documents as dx
from factmill.operators import facts as fx
from factmill.operators import formulas as fm
from factmill.operators import history as hx
from factmill.operators import retrieval as rx


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("1,234.50", "1234.500000"), ("(12)", "-12.000000"), ("25%", None), ("—", None), ("n/a", None), ("", None), (None, None), ("－３.５", "-3.500000"), ("1.2.3", None)],
)
def test_amount(spark, text, want):
    got = one(spark, C.amount(F.col("t")), t=text)
    assert got == (Decimal(want) if want else None)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-12-31", date(2024, 12, 31)),
        ("2024年3月", date(2024, 3, 31)),
        ("2023Q2", date(2023, 6, 30)),
        ("2023H1", date(2023, 6, 30)),
        ("FY 2022", date(2022, 12, 31)),
        ("12345", None),
        ("2024-13-01", None),
        (None, None),
    ],
)
def test_header_period(spark, text, want):
    assert one(spark, C.header_period(F.col("t")), t=text) == want


def test_tokens(spark):
    assert one(spark, C.tokens(F.col("t")), t="实际控制人 BGE-M3 25.3% 款 １２") == ["实际", "际控", "控制", "制人", "bge", "m3", "25.3%", "款", "12"]
    assert one(spark, C.tokens(F.col("t")), t=None) == []


def test_units_and_display(spark):
    df = spark.createDataFrame([("baiwan_yuan", Decimal("123456789.50")), ("furlong", Decimal("9999.00")), ("万元", None), (None, None)], "u string, v decimal(20,2)")
    rows = df.select(C.unit_scale(F.col("u")).alias("s"), C.large_number(F.col("v")).alias("v")).collect()
    assert [(r["s"], r["v"]) for r in rows] == [(1_000_000, "1.23亿"), (None, "9999"), (10_000, None), (None, None)]


def test_host_grade(spark):
    assert one(spark, C.host_grade(F.col("t")), t="https://www.stats.gov.cn/x?y") == "A"
    assert one(spark, C.host_grade(F.col("t")), t="http://user@static.cninfo.com.cn:80/") == "B"
    assert one(spark, C.host_grade(F.col("t")), t="ftp://finance.sina.com.cn/x") == "C"
    assert one(spark, C.host_grade(F.col("t")), t="http://notsina.com.cn") == "D"


def chunks_of(text, size, overlap):
    import re

    out, now = [], None
    for p in (x.strip(" ") for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) > size:
            if now is not None:
                out.append(now)
            now, at = None, 0
            while True:
                out.append(p[at : at + size])
                if at + size >= len(p):
                    break
                at += size - overlap
        elif now is None:
            now = p
        elif len(now) + 2 + len(p) <= size:
            now += "\n\n" + p
        else:
            out.append(now)
            now = p
    return out + ([now] if now is not None else [])


@pytest.mark.parametrize("text", ["", "a\n\nbb\n\nccc", "x" * 25, "aa\n\n" + "b" * 31 + "\n\ncc\n\ndd", "one two\n\n\n\nthree four five", "abcdefghij\n\nk"])
def test_chunks(spark, text):
    assert one(spark, dx.chunks(F.col("t"), 10, 3), t=text) == chunks_of(text, 10, 3)


def test_chunks_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", dx.chunks(F.col("text")).alias("c")).collect()
    assert all(r["c"] == chunks_of(r["text"], dx.CHUNK, dx.OVERLAP) for r in rows)


def test_reconcile(spark):
    rows = [("touch", "a", "9.995", "0.010"), ("touch", "b", "10.005", "0.010"), ("apart", "a", "10", "0.01"), ("apart", "b", "10.1", "0.01"), ("alone", "a", "1", "1"), ("gap", "a", None, "1"), ("gap", "b", "1", "1")]
    df = spark.createDataFrame([(k, s, v and Decimal(v), Decimal(d)) for k, s, v, d in rows], "k string, source string, value decimal(20,4), step decimal(20,4)")
    got = {r["k"]: r["state"] for r in fx.reconcile(df, ["k"]).collect()}
    assert got == {"touch": "MATCHED", "apart": "CONFLICT", "alone": "SINGLE_SOURCE", "gap": "INSUFFICIENT_SCOPE"}


def test_first_failing_treats_null_as_failed(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (1, 2)], "a int, b int")
    got = [r[0] for r in df.select(fx.first_failing({"a": F.col("a") > 0, "b": F.col("b") > 0})).collect()]
    assert got == ["b", "a", None]


def outcome(spark, formula, annual=True, **items):
    row = {i: None for i in fm.ITEMS} | {f"prior_{i}": None for i in fm.ITEMS} | {k: Decimal(v) for k, v in items.items()}
    df = spark.createDataFrame([("c", "p", *row.values())], "company string, period string, " + ", ".join(f"{k} decimal(20,4)" for k in row))
    r = fm.compute(df, F.lit(annual), [formula]).first()
    return r["value"], r["status"], r["reason"]


def test_formulas(spark):
    assert outcome(spark, "SOLV_CURRENT_RATIO", CURRENT_ASSETS="3", CURRENT_LIABILITIES="2") == (1.5, "CALCULATED", None)
    assert outcome(spark, "SOLV_CURRENT_RATIO", CURRENT_ASSETS="3") == (None, "MISSING_INPUT", "MISSING_REQUIRED_ITEM")
    assert outcome(spark, "SOLV_CURRENT_RATIO", CURRENT_ASSETS="3", CURRENT_LIABILITIES="0") == (None, "ZERO_DENOMINATOR", "ZERO_DENOMINATOR")
    assert outcome(spark, "SOLV_INTEREST_COVER", TOTAL_PROFIT="8", FINANCE_EXPENSES="2") == (5.0, "CALCULATED_PROXY", "PROXY_FINANCE_EXPENSES")
    assert outcome(spark, "SOLV_INTEREST_COVER", TOTAL_PROFIT="8", FINANCE_EXPENSES="2", INTEREST_EXPENSE="4") == (3.0, "CALCULATED", None)
    assert outcome(spark, "OPER_ASSET_TURNOVER", TOTAL_REVENUE="8", TOTAL_ASSETS="2") == (None, "MISSING_INPUT", "MISSING_PRIOR_PERIOD")
    assert outcome(spark, "OPER_AR_TURNOVER", TOTAL_REVENUE="8", ACCOUNTS_RECEIVABLE="2", prior_ACCOUNTS_RECEIVABLE_COMBINED="3")[2] == "MIXED_RECEIVABLE_BASIS_FORBIDDEN"
    assert outcome(spark, "GROWTH_REVENUE", TOTAL_REVENUE="1", prior_TOTAL_REVENUE="-2") == (1.5, "CALCULATED", None)
    assert outcome(spark, "GROWTH_REVENUE", annual=False, TOTAL_REVENUE="1", prior_TOTAL_REVENUE="-2")[1] == "NOT_APPLICABLE"
    assert outcome(spark, "INTEREST_BEARING_DEBT", BONDS_PAYABLE="1")[1] == "PARTIAL_INPUT"
    with pytest.raises(ValueError, match="unknown"):
        outcome(spark, "NO_SUCH_RATIO")


def test_prior_is_a_key_not_a_neighbour(spark):
    snap = spark.createDataFrame([("c", date(2020, 12, 31), Decimal(1)), ("c", date(2022, 12, 31), Decimal(2))], "company string, period date, X decimal(10,2)")
    got = fx.with_prior(snap, ["X"], C.prior_period(F.col("period"), F.lit("annual"))).select("prior_X").collect()
    assert [r[0] for r in got] == [None, None]


def test_fusion_counts_a_repeat_once(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query int, doc string, rank int")
    b = spark.createDataFrame([(1, "b", 1)], "query int, doc string, rank int")
    got = [(r["doc"], r["rank"]) for r in rx.fuse({"s": a, "d": b}).orderBy("rank").collect()]
    assert got == [("b", 1), ("a", 2)]
    with pytest.raises(ValueError, match="positive"):
        rx.fuse({"s": a}, 0)


def test_as_of_includes_the_same_moment(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("m", 1)], "key string, at int")
    right = spark.createDataFrame([("k", 1, "x"), ("k", 4, "y"), ("k", 6, "z")], "key string, at int, v string")
    got = sorted((r["key"], r["at"], r["v"] or "") for r in hx.on_or_before(left, right, "key", "at", "v").collect())
    assert got == [("k", 1, "x"), ("k", 5, "y"), ("m", 1, "")]


def test_closure_with_cycle_and_gap(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 7), (8, None)], "id int, up int")
    good = spark.createDataFrame([(3,)], "id int")
    got = {r["id"]: r["valid"] for r in hx.closure(edges, "id", "up", good, "id").collect()}
    assert got == {1: True, 2: True, 4: True, 5: True, 6: False, 8: False}


def test_closure_has_no_depth_limit(spark):
    links = [(k, k + 1) for k in range(1, 101)] + [(k, k + 1) for k in range(201, 301)] + [(301, None), (301, 290)]
    links += [(k, k + 1) for k in range(401, 500)] + [(500, 401), (600, 401), (600, 300), (601, 401)] + [(k, k + 1) for k in range(701, 801)]
    edges = spark.createDataFrame(links, "id int, up int")
    good = spark.createDataFrame([(101,), (301,), (750,)], "id int")
    got = {r["id"]: r["valid"] for r in hx.closure(edges, "id", "up", good, "id").collect()}
    want = {k: True for k in (*range(1, 101), *range(201, 301), *range(401, 501), 600, 601)}
    assert got == want | {301: False} | {k: k < 750 for k in range(701, 801)}


def test_quotas_sum_up(spark):
    rows = spark.createDataFrame([(i, "abc"[min(i // 5, 2)]) for i in range(23)], "id int, layer string")
    got = hx.quotas(rows, "layer", "id", 10).groupBy("layer").count().collect()
    assert sum(r["count"] for r in got) == 10


def test_runs_and_head(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([("u", t(0), 1, "a"), ("u", t(1), 2, "a"), ("u", t(2), 3, "b"), ("u", t(3), 4, "a")], "u string, ts timestamp, id int, kind string")
    assert [r["run"] for r in dx.runs(log, ["u"], ["ts"], "kind").orderBy("ts").collect()] == [1, 1, 2, 3]
    assert hx.head(log, ["u"], ["ts"]).first()["id"] == 4
