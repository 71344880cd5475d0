"""Amounts in text, note tables, routes, sections and records against literals."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factmill.functions import amounts as ax
from factmill.functions import columns as C
from factmill.operators import notes as nx
from factmill.operators import records as rx
from factmill.operators import routing as gx
from factmill.operators import sections as sx


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("token,kind,value", [("40,000万元", "money", "400000000"), ("4亿元", "money", "400000000"), ("12.5%", "percent", "12.5"), ("18.12 percent", "percent", "18.12"), ("133219980000.00 yuan", "money", "133219980000"), ("１２", "unknown", "12"), ("-3千元", "money", "-3000"), ("x", "unknown", None), (None, "unknown", None)])
def test_amounts(spark, token, kind, value):
    assert one(spark, ax.amount_value(F.col("t")), token) == (None if value is None else Decimal(value))
    if token is not None:
        assert one(spark, ax.amount_kind(F.col("t")), token) == kind


@pytest.mark.parametrize("text,want", [("截至2025年12月31日，资产为4亿元", ["4亿元"]), ("2023—2025年", []), ("2025万元", ["2025万元"]), ("第2位、54,538项专利[3]", ["54,538"]), ("", []), (None, [])])
def test_business_tokens(spark, text, want):
    assert one(spark, ax.business_tokens(F.col("t")), text) == want


def test_value_presence_in_text(spark):
    schema = "id int, text string"
    claims = spark.createDataFrame([(1, "为3万元，占5%"), (2, "为3万元"), (3, "有3家"), (4, None)], schema)
    proofs = spark.createDataFrame([(1, "单位：万元，%\n甲 3 5"), (2, "单位：万元，%\n甲 3"), (3, "3"), (4, "1万元")], schema)
    got = sorted(tuple(r) for r in ax.text_value_presence(claims, proofs, "id", "text").collect())
    assert got == [(1, "3万元", "SUPPORTED"), (1, "5%", "SUPPORTED"), (2, "3万元", "PARTIAL"), (3, "3", "UNSUPPORTED")]
    assert ax.text_value_presence(claims.limit(0), proofs, "id", "text").count() == 0


@pytest.mark.parametrize("text,want", [("2024", "2024-12-31"), ("2024Q1", "2024-03-31"), ("2024-H1", "2024-06-30"), ("2024-02", "2024-02-29"), ("2023-02-29", None), ("近两年", None), (None, None)])
def test_canonical_period(spark, text, want):
    assert one(spark, ax.canonical_period(F.col("t")).cast("string"), text) == want


@pytest.mark.parametrize("line,level,title", [("第三节 管理层讨论", 1, "管理层讨论"), ("一、公司概况", 1, "公司概况"), ("（二）主要产品", 2, "主要产品"), ("2.1 行业概况", 2, "行业概况"), ("2.3.1 子标题", 3, "子标题"), ("2024年 概述", None, None), ("12亿 收入", None, None), ("第一章", 1, "第一章"), ("无", None, None)])
def test_headings(spark, line, level, title):
    assert one(spark, C.heading_level(F.col("t")), line) == level
    assert one(spark, C.heading_title(F.col("t")), line) == title


def test_note_tables(spark):
    blocks = [(1, 1, "表5-10 主营业务收入构成\n单位：万元，%"), (1, 2, "项目 2025年 2024年\n金额 占比 金额 占比\n动力电池 100 60% 90 55%\n正文。\n材料 1 2% 3 4%"), (1, 3, "表5-11\n项目 2025年"), (2, 1, None)]
    t = nx.note_tables(spark.createDataFrame(blocks, "d int, b int, t string"), "d", "b", "t")
    got = [tuple(r) for r in t.select("title", "unit", "headers", "rows", "data_block").collect()]
    assert got == [("表5-10 主营业务收入构成", "万元", ["项目", "2025年金额", "2025年占比", "2024年金额", "2024年占比"], ["动力电池 100 60% 90 55%"], 2)]
    items = {(r["header"], r["period"], r["is_share"], r["value"]) for r in nx.note_items(t, "d").collect()}
    assert ("2025年占比", "2025-12-31", True, Decimal(60)) in items and len(items) == 4


@pytest.mark.parametrize("question,kind,code", [("净资产收益率是多少", "metric", "PROF_ROE"), ("流动资产与资产负债率", "metric", "SOLV_DEBT_RATIO"), ("毛利率和净利率", None, None), ("归母净利润", "field", "NET_PROFIT_PARENT"), ("受限货币资金", None, None), ("货币资金", "field", "CASH_AND_EQUIVALENTS"), ("", None, None), (None, None, None)])
def test_db_target(spark, question, kind, code):
    r = gx.db_target(spark.createDataFrame([(question,)], "q string"), "q").first()
    assert (r["target_type"], r["target_code"]) == (kind, code)


@pytest.mark.parametrize("question,scope,source,route", [("审计意见是否一致", "2023—2025年", "x", "DIRECT_EVIDENCE"), ("主要客户", "近两年", "x", "FALLBACK"), ("最新毛利率", "2024", "x", "FALLBACK"), ("处罚新闻", None, "x", "EXTERNAL_RESEARCH"), ("主要客户比较", None, "external", "EXTERNAL_RESEARCH"), ("主要客户变化", None, "x", "DEEP_RETRIEVAL"), ("毛利率", None, "x", "DB_LOOKUP"), ("董事长是谁", None, "x", "DIRECT_EVIDENCE"), ("发展战略", None, "x", "STANDARD_RAG"), ("客户", "2025", "x", "EXTERNAL_RESEARCH")])
def test_routes(spark, question, scope, source, route):
    df = spark.createDataFrame([(question, scope, "2024-12-31", [], [source])], "q string, s string, r string, t array<string>, o array<string>")
    assert gx.routed(df, "q", "s", "r", "t", "o").first()["route"] == route


def test_hybrid(spark):
    needs = spark.createDataFrame([(k,) for k in range(6)], "need int")
    hits = spark.createDataFrame([(0, "sparse", "a", 1), (0, "dense", "a", 2), (0, "dense", "b", 1), (1, "dense", "b", 1), (4, "sparse", "c", 1)], "need int, channel string, id string, rank int")
    failures = spark.createDataFrame([(1, "sparse"), (2, "sparse"), (2, "dense"), (4, "TIMEOUT"), (5, "dense")], "need int, channel string")
    got = {r["need"]: (r["status"], r["failure_code"]) for r in gx.hybrid(needs, hits, failures, 10, 5).collect()}
    assert got == {0: ("COMPLETED", None), 1: ("PARTIAL", "SPARSE_FAILED"), 2: ("FAILED", "BOTH_CHANNELS_FAILED"), 3: ("EMPTY", None), 4: ("PARTIAL", "TIMEOUT"), 5: ("PARTIAL", "DENSE_FAILED")}


def test_value_decisions(spark):
    groups = spark.createDataFrame([("g", "CONFLICT", False, ["a", "b"]), ("m", "MATCHED", False, ["c"])], "group_id string, state string, decided boolean, members array<string>")
    records = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, False)], "record_id string, std_value int, quarantined boolean")
    rows = [(1, 0, "g", ["a"], ["b"], "SCOPE_MATCH", None), (2, 0, "g", ["a", "b"], [], "SCOPE_MATCH", None), (2, 1, "m", ["c"], [], "SCOPE_MATCH", None), (3, 0, "g", ["a"], [], "OTHER_WITH_NOTE", " "), (4, 0, "g", ["a"], ["b"], "AUDITED_SOURCE", None), (4, 1, "g", ["a"], ["b"], "AUDITED_SOURCE", None), (5, 0, None, ["a"], ["b"], "AUDITED_SOURCE", None), (6, 0, "g", ["a", "z"], ["b"], "AUDITED_SOURCE", None)]
    items = spark.createDataFrame(rows, "batch int, at int, group_id string, accepted array<string>, rejected array<string>, reason string, note string")
    got = {(r["batch"], r["at"]): (r["error"], r["written"]) for r in rx.checked_decisions(items, groups, records).collect()}
    assert got == {(1, 0): (None, True), (2, 0): ("accepted_values_differ", False), (2, 1): ("group_not_in_conflict", False), (3, 0): ("note_missing", False), (4, 0): (None, False), (4, 1): ("group_repeated", False), (5, 0): ("group_missing", False), (6, 0): ("record_of_other_group", False)}


def test_sources_suffice(spark):
    rows = [(1, "A", "x", None), (2, "C", "x", "2024-01-01"), (2, "C", "x", None), (3, "C", "x", None), (3, "C", "y", None), (4, "D", "x", None), (4, None, "y", None), (5, "C", "x", None), (5, "D", "z", None)]
    df = spark.createDataFrame(rows, "k int, grade string, host string, published string")
    got = {r["k"]: r["reason"] for r in sx.sources_suffice(df, ["k"]).collect()}
    assert got == {1: "has_ab", 2: "single_c_only", 3: "two_independent_c", 4: "d_only", 5: "insufficient_independent_sources"}


def test_resumable(spark):
    now = spark.createDataFrame([(1, "a", 1, 7, "v"), (1, "b", 2, 8, "v"), (1, "c", 3, 9, "v")], "run int, stage string, at int, input_hash int, versions string")
    done = spark.createDataFrame([(1, "a", True, 7, "v"), (1, "b", True, 0, "v"), (1, "c", True, 9, "v")], "run int, stage string, done boolean, input_hash int, versions string")
    assert {r["stage"]: r["skip"] for r in rx.resumable(done, now).collect()} == {"a": True, "b": False, "c": False}


def test_covering(spark):
    rows = [(1, "a", [1, 2]), (1, "b", [2, 1, 3]), (1, "c", [4]), (1, "d", [4]), (2, "e", [])]
    df = spark.createDataFrame(rows, "k int, id string, m array<int>")
    assert sorted(r["id"] for r in rx.covering(df, "k", "id", "m").collect()) == ["b", "c", "e"]


def shuffles(df):
    """Exchanges of the plan as it is before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("query", ["section_issues", "section_verdicts"])
def test_section_rules_meet_after_one_shuffle(spark, query):
    from factmill.plans import registry

    assert shuffles(registry.QUERIES[query](spark, "/root/testdata/sf0.001")) == 1


def section_tables(spark):
    """Section 1 with two rows of one claim, 2 empty and hiding nothing, 3 without a row of its own."""
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    sections = rows([(1, "COMPLETED", "x"), (2, "COMPLETED", " "), (None, "COMPLETED", "x")], "section_id int, status string, markdown string")
    topics = rows([(1, "t0"), (1, "t1")], "section_id int, topic_id string")
    questions = rows([(1, "q0", ["SECTION_BLOCKED"], ["收入", ""]), (1, "q1", None, [])], "section_id int, question_id string, policy array<string>, aspects array<string>")
    claims = rows([(1, "a", "t0", ["q0"], "fact", "不存在违约", True, False)] * 2 + [(3, None, "t0", ["q0"], "fact", "预计增长", True, False)], "section_id int, claim_id string, topic_id string, question_ids array<string>, claim_type string, text string, impact boolean, derived boolean")
    refs = rows([(1, "a", "external", None, None, None, None, None, False, "D"), (1, "a", "structured", "s", "authority_unavailable", True, "12%", False, True, None), (3, None, "external", None, "page_mismatch", None, None, None, True, "D")], "section_id int, claim_id string, ref_type string, snapshot_id string, reason string, known boolean, display string, proxy boolean, dated boolean, grade string")
    gaps = rows([(1, "u", "q0", "t9", "NOT_FOUND_AFTER_SEARCH", ["JOB_BLOCKED"]), (1, "v", None, "t9", "CONFLICT", [])], "section_id int, unresolved_id string, question_id string, topic_id string, state string, effects array<string>")
    return sections, topics, questions, claims, refs, gaps


def test_section_issues(spark):
    got = {tuple(r) for r in sx.section_issues(sx.section_parts(*section_tables(spark))).collect()}
    assert got == {
        (1, "blocking_policy_mismatch", "blocking", "unresolved:u", 1),
        (1, "conflict_unresolved", "blocking", "unresolved:v", 1),
        (1, "status_not_blocked", "blocking", "section", 1),
        (2, "empty_section", "blocking", "section", 1),
        (1, "coverage_missing_topic", "rework", "topic:t1", 1),
        (1, "coverage_missing_question", "rework", "question:q1", 1),
        (1, "aspect_uncovered", "warning", "question:q0", 1),
        (1, "external_missing_date", "warning", "claim:a", 2),
        (1, "financial_value_mismatch", "rework", "claim:a", 2),
        (1, "citation_authority_unavailable", "warning", "ref_type:structured", 1),
        (1, "d_source_sole_basis", "rework", "claim:a", 2),
        (1, "absence_contradicts_gap", "rework", "claim:a", 2),
        (3, "claim_missing_citation", "rework", None, 1),
        (3, "fact_hedged", "rework", None, 1),
    }


def test_section_verdicts(spark):
    got = {tuple(r) for r in sx.verdicts(sx.section_parts(*section_tables(spark))).collect()}
    assert got == {(1, 3, 8, 4, False), (2, 1, 0, 0, False), (None, 0, 0, 0, True)}


def test_decisions_meet_after_one_shuffle(spark):
    from factmill.plans import registry

    assert shuffles(registry.QUERIES["value_decisions"](spark, "/root/testdata/sf0.001")) == 1
