"""Queries of amounts, notes, routing and sections, over texts built from keys, and the SQL they agree with.

Inputs are column expressions that both engines read; each query's own logic is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import amounts as ax
from factmill.operators import notes as nx
from factmill.operators import routing as gx
from factmill.operators import sections as sx

#: Tells the lines of an order apart; line numbers repeat.
KEY = "l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey"
#: name -> (table, condition, columns): inputs derived from the tables.
INPUTS: dict[str, tuple[str, str, list[str]]] = {
    "sayings": (
        "lineitem",
        "true",
        [
            "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id",
            """CASE l_partkey % 7
 WHEN 0 THEN concat('2024年收入', CAST(l_partkey AS STRING), '万元，占比', CAST(l_suppkey AS STRING), '.5%')
 WHEN 1 THEN concat('2023—2025年第', CAST(l_linenumber AS STRING), '位，资产为', CAST(l_orderkey AS STRING), ',000.25元[2]')
 WHEN 2 THEN concat('净利润-', CAST(l_partkey AS STRING), '千元 and ', CAST(l_suppkey AS STRING), ' percent')
 WHEN 3 THEN concat(CAST(l_partkey AS STRING), ' yuan, ', CAST(l_suppkey AS STRING), ' pct; 35.5亿')
 WHEN 4 THEN concat('截至2025年12月31日，', CAST(l_partkey AS STRING), '百万元、', CAST(l_partkey AS STRING), '百万元')
 WHEN 5 THEN concat('2024-12-31 paid ', CAST(l_orderkey AS STRING)) END AS text""",
        ],
    ),
    "claims": (
        "lineitem",
        "true",
        [
            "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id",
            """CASE l_suppkey % 3
 WHEN 0 THEN concat('2024年为', CAST(l_partkey AS STRING), '万元')
 WHEN 1 THEN concat(CAST(l_partkey AS STRING), '千元，', CAST(l_suppkey AS STRING), '%')
 ELSE concat(CAST(l_suppkey AS STRING), '%和', CAST(l_partkey AS STRING), '元及', CAST(l_partkey AS STRING)) END AS text""",
        ],
    ),
    "proofs": (
        "lineitem",
        "true",
        [
            "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id",
            """CASE l_partkey % 4
 WHEN 0 THEN concat('单位：万元，%', chr(10), '甲 ', CAST(l_partkey AS STRING), ' ', CAST(l_suppkey AS STRING), chr(10), '乙 ', CAST(l_partkey AS STRING))
 WHEN 1 THEN concat('项目 金额（千元） 占比（%）', chr(10), '甲 ', CAST(l_partkey AS STRING), ' ', CAST(l_suppkey AS STRING), ' ', CAST(l_linenumber AS STRING))
 WHEN 2 THEN concat('单位：千元', chr(10), '合计 ', CAST(l_partkey AS STRING), ' 其中 ', CAST(l_suppkey AS STRING), '万元')
 ELSE concat('甲 ', CAST(l_partkey AS STRING), ' ', CAST(l_suppkey AS STRING), '%') END AS text""",
        ],
    ),
    "blocks": (
        "lineitem",
        "true",
        [
            "l_orderkey AS document",
            f"{KEY} AS block",
            """CASE l_partkey % 6
 WHEN 0 THEN concat('表 5-', CAST(l_linenumber AS STRING), '发行人收入构成', chr(10), '单位：万元，%', chr(10), '项目 2025年 2024年', chr(10), '金额 占比 金额 占比')
 WHEN 1 THEN concat('电池 ', CAST(l_partkey AS STRING), ' 60% 90 55%', chr(10), '合计 1,', CAST(l_suppkey % 900 + 100 AS STRING), ' 100% -5.5 45%')
 WHEN 2 THEN concat('表5-', CAST(l_suppkey AS STRING), chr(10), '产品 2023年度', chr(10), '甲 ', CAST(l_partkey AS STRING))
 WHEN 3 THEN concat('材料 ', CAST(l_suppkey AS STRING), ' 1% 2 3%')
 WHEN 4 THEN concat('  ', chr(10), '储能 7 8% 9 10%', chr(10), '本期收入增长。')
 ELSE '单位：千元' END AS text""",
            "l_returnflag AS section",
        ],
    ),
    "lines": (
        "lineitem",
        "true",
        [
            "l_orderkey",
            "l_linenumber",
            """CASE l_partkey % 10
 WHEN 0 THEN concat('第 ', CAST(l_linenumber AS STRING), ' 页') WHEN 1 THEN concat('表 ', CAST(l_suppkey AS STRING), ' 构成') WHEN 2 THEN '单位：万元'
 WHEN 3 THEN concat('合计  ', CAST(l_partkey AS STRING), '  100%') WHEN 4 THEN concat('名称  ', CAST(l_partkey AS STRING), ' 67.8 23.8  4.15%-11.04%')
 WHEN 5 THEN '企业名称  注册  资本' WHEN 6 THEN '本公司经营稳健。' WHEN 7 THEN '   ' WHEN 8 THEN concat('- ', CAST(l_linenumber AS STRING), ' -') ELSE concat('甲 ', CAST(l_suppkey AS STRING), ' 3.5% (2)') END AS line""",
        ],
    ),
    "needs": (
        "part",
        "true",
        [
            "p_partkey AS need",
            """concat(CASE p_partkey % 13 WHEN 0 THEN '公司的净资产收益率' WHEN 1 THEN '归母净利润和净利润' WHEN 2 THEN '总资产与毛利率' WHEN 3 THEN '受限货币资金' WHEN 4 THEN '货币资金'
 WHEN 5 THEN '资产负债率、销售净利率' WHEN 6 THEN '主要客户' WHEN 7 THEN '会计师事务所' WHEN 8 THEN '负债' WHEN 9 THEN '固定资产中机器设备' WHEN 10 THEN '董事长' WHEN 11 THEN 'ＥＢＩＴＤＡ 总 资 产' ELSE '股权质押' END,
 CASE p_size % 9 WHEN 0 THEN '是多少' WHEN 1 THEN '近三年变化' WHEN 2 THEN '最新情况' WHEN 3 THEN '的处罚新闻' WHEN 4 THEN '是谁' WHEN 5 THEN '如何' WHEN 6 THEN '2024年是多少' WHEN 7 THEN '2023年和2024年比较' ELSE '' END) AS question""",
            "CASE p_partkey % 8 WHEN 0 THEN '2024' WHEN 1 THEN '2025-06-30' WHEN 2 THEN '2024Q3' WHEN 3 THEN '近两年' WHEN 4 THEN '2024-H1' WHEN 5 THEN '2024-02-30' WHEN 6 THEN '2025-02' END AS scope",
            "'2024-12-31' AS report",
            "CASE WHEN p_size % 5 = 0 THEN 'web' ELSE 'text' END AS type",
            "CASE p_size % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'annual_report' ELSE 'other' END AS source",
        ],
    ),
    "sections": ("orders", "true", ["o_orderkey AS section_id", "CASE o_orderstatus WHEN 'P' THEN 'SECTION_BLOCKED' WHEN 'F' THEN 'COMPLETED' ELSE 'WAITING_HUMAN' END AS status", "CASE WHEN o_custkey % 3 = 0 THEN '  ' ELSE 'text' END AS markdown", "CASE o_orderpriority WHEN '1-URGENT' THEN 'BLOCKED' WHEN '2-HIGH' THEN 'REWORK' WHEN '3-MEDIUM' THEN 'PASS_WITH_GAPS' ELSE 'PASS' END AS decision", "o_custkey % 2 = 0 AS rules_passed", "o_custkey % 11 = 0 AS conflict"]),
    "section_claims": (
        "lineitem",
        "l_returnflag <> 'A'",
        [
            "l_orderkey AS section_id",
            f"{KEY} AS claim_id",
            "concat('t', CAST(l_partkey % 3 AS STRING)) AS topic_id",
            "concat('q', CAST(l_partkey % 4 AS STRING)) AS q1",
            "concat('q', CAST(l_suppkey % 4 AS STRING)) AS q2",
            "CASE l_suppkey % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'calculation' ELSE 'inference' END AS claim_type",
            """CASE l_partkey % 11 WHEN 0 THEN '未发现诉讼' WHEN 1 THEN '不存在违约' WHEN 2 THEN '预计增长' WHEN 3 THEN '建议授信额度一亿' WHEN 4 THEN '目前建议维持担保' WHEN 5 THEN '无'
 WHEN 6 THEN '精确值为12.5%' WHEN 7 THEN '收入结构清晰' WHEN 8 THEN '' ELSE concat('收入', CAST(l_suppkey AS STRING), '万元') END AS text""",
            "l_suppkey % 2 = 0 AS impact",
            "l_partkey % 13 = 0 AS derived",
        ],
    ),
    "section_refs": (
        "lineitem",
        "k < l_suppkey % 5",
        [
            "l_orderkey AS section_id",
            f"{KEY} AS claim_id",
            "k AS place",
            "CASE (l_partkey + k) % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'external' ELSE 'evidence' END AS ref_type",
            "concat('s', CAST((l_partkey + k) % 2 AS STRING)) AS snapshot_id",
            "CASE (l_partkey + k) % 7 WHEN 0 THEN 'authority_unavailable' WHEN 1 THEN 'page_mismatch' END AS reason",
            "(l_partkey + k) % 4 <> 0 AS known",
            "CASE (l_suppkey + k) % 4 WHEN 0 THEN '12.5%' WHEN 1 THEN '' ELSE '收入' END AS display",
            "(l_suppkey + k) % 3 = 0 AS proxy",
            "(l_partkey + k) % 5 <> 0 AS dated",
            "CASE (l_partkey + k) % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 4 THEN 'D' WHEN 7 THEN 'C' WHEN 8 THEN 'C' END AS grade",
            "concat('h', CAST(l_suppkey % 3 AS STRING)) AS host",
            "CASE WHEN (l_partkey + k) % 5 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS published",
        ],
    ),
    "section_gaps": (
        "lineitem",
        "l_returnflag = 'A'",
        [
            "l_orderkey AS section_id",
            f"concat('u', CAST({KEY} AS STRING)) AS unresolved_id",
            "CASE WHEN l_partkey % 6 = 5 THEN NULL ELSE concat('q', CAST(l_partkey % 6 AS STRING)) END AS question_id",
            "concat('t', CAST(l_suppkey % 4 AS STRING)) AS topic_id",
            "CASE l_partkey % 5 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'WAITING_HUMAN' ELSE 'NOT_FOUND_AFTER_SEARCH' END AS state",
            "CASE l_suppkey % 4 WHEN 0 THEN 'SECTION_BLOCKED' WHEN 1 THEN 'TOPIC_GAP' END AS effect",
            "l_suppkey % 5 = 0 AS core",
        ],
    ),
}

#: Inputs with up to four rows for each of the table's, numbered k.
SEVERAL = {"section_refs"}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, condition, columns = INPUTS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name in SEVERAL:
        rows = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    return rows.where(condition).selectExpr(*columns)


def _sql(*names: str) -> str:
    more = lambda n: ", (VALUES (0), (1), (2), (3)) v(k)" if n in SEVERAL else ""
    return ",\n".join(f"{n} AS (SELECT {', '.join(INPUTS[n][2])} FROM {INPUTS[n][0]}{more(n)} WHERE {INPUTS[n][1]})" for n in names)


def _words(words: tuple[str, ...], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _signs(t: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(lower({t}), '{e}') THEN rtrim(left({t}, length({t}) - {len(e)})) || '{s}'" for e, s in ax.ENGLISH) + f" ELSE {t} END"


def _size(s: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({s}, '{n}') THEN {k}" for n, k in ax.SUFFIXES) + " END"


_KIND = f"CASE WHEN regexp_matches(s, '[%％]$') THEN 'percent' WHEN ({_size('s')}) IS NOT NULL THEN 'money' ELSE 'unknown' END"
_BARE = "TRY_CAST(replace(regexp_replace(regexp_replace(translate(s, '０１２３４５６７８９，．－−', '0123456789,.--'), '\\s*[%％]\\s*$', ''), '\\s*(千万元|百万元|亿元|万元|千元|亿|万|千|元)$', ''), ',', '') AS DECIMAL(28,6))"


def _blanked(t: str) -> str:
    for pattern in ax.NO_AMOUNTS:
        t = f"regexp_replace({t}, '{pattern}', ' ', 'g')"
    return t


def _tokens(source_: str, text: str) -> str:
    """CTEs of the distinct tokens of a text: w(id, token, kind, bare, value)."""
    return f"""k AS (SELECT DISTINCT id, trim(unnest(regexp_extract_all({text}, '{ax.AMOUNT}', 0))) AS token FROM {source_}),
g AS (SELECT id, token, {_signs('token')} AS s FROM k),
w AS (SELECT id, token, {_KIND} AS kind, {_BARE} AS bare, {_BARE} * coalesce({_size('s')}, 1) AS value FROM g)"""


def amount_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.col("token")
    found = source(spark, sf_dir, "sayings").select("id", F.explode(ax.amount_tokens(F.col("text"))).alias("token")).distinct()
    return found.select("id", "token", ax.amount_kind(token).alias("kind"), ax.amount_value(token).cast("double").alias("value"))


def business_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.col("token")
    found = source(spark, sf_dir, "sayings").select("id", F.explode(ax.business_tokens(F.col("text"))).alias("token")).distinct()
    return found.select("id", "token", ax.amount_kind(token).alias("kind"), ax.amount_value(token).cast("double").alias("value"))


def evidence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ax.evidence_amounts(source(spark, sf_dir, "proofs"), "id", "text").withColumn("value", F.col("value").cast("double"))


def text_value_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ax.text_value_presence(source(spark, sf_dir, "claims"), source(spark, sf_dir, "proofs"), "id", "text")


def number_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices, blown up by the order's key, as yuan and by unit; whether quantity and price differ by over a twentieth."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = F.expr("cast(l_extendedprice as decimal(14,2)) * (l_orderkey % 5000)").cast("decimal(24,2)")
    unit = F.expr("CASE l_partkey % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'yuan' ELSE 'ratio' END")
    code = F.expr("CASE l_suppkey % 5 WHEN 0 THEN 'wan_yuan' WHEN 1 THEN 'yi_yuan' WHEN 2 THEN 'box' ELSE 'yuan' END")
    return rows.select("l_orderkey", "l_linenumber", ax.yuan_shown(value).alias("yuan"), ax.metric_shown(value, unit).alias("shown"), ax.differs(F.col("l_quantity"), F.col("l_partkey").cast("double")).alias("differs"), ax.legacy_yuan(F.col("l_quantity"), code).alias("legacy"))


def canonical_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = source(spark, sf_dir, "needs")
    end = ax.canonical_period(F.col("scope"))
    anchor = ax.iso_prefix(F.concat("report", F.lit("T00:00")))
    return n.select("need", end.cast("string").alias("period"), ax.late_scope(F.col("scope"), F.col("report")).alias("late"), ax.target_period(F.col("question")).alias("target"), ax.relative_period(F.lit("期初"), anchor, F.when(F.col("need") % 2 == 0, "annual").otherwise("interim")).cast("string").alias("begins"), ax.page_anchor(F.concat(F.lit("2024年13月1日 2023年"), (F.col("need") % 14).cast("string"), F.lit("月5日"))).cast("string").alias("anchor"))


def note_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nx.note_tables(source(spark, sf_dir, "blocks"), "document", "block", "text")
    return t.select("document", "title", "unit", F.array_join("headers", "|").alias("headers"), F.array_join("rows", "|").alias("rows"), "data_block")


def note_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nx.note_tables(source(spark, sf_dir, "blocks"), "document", "block", "text")
    return nx.note_items(t, "document").groupBy("header", "period", "is_share").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


def table_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's first block with those that go on its table."""
    b = source(spark, sf_dir, "blocks")
    first = b.groupBy("document", "section").agg(F.min_by(F.struct("block", "text"), "block").alias("x")).select("document", "section", "x.*")
    out = nx.continued(b, first, ["document", "section"], "block", "text")
    return out.select("document", "section", F.array_join("rows", "|").alias("rows"), "blocks")


def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return source(spark, sf_dir, "lines").select("l_orderkey", "l_linenumber", nx.line_role(line).alias("role"), F.array_join(nx.cells(line), "|").alias("cells"), nx.data_row(F.split(F.trim(line), r"\s+")).alias("is_data"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: whether one is a table of contents once its full stops lead, and what is left without its first line."""
    text = F.coalesce("text", F.lit(""))
    first = F.array(F.split(text, "\n")[0])
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", nx.contents_page(F.regexp_replace(text, r"\. ?\n", "...... 7\n")).alias("contents"), F.sha2(nx.stripped_lines(text, first), 256).alias("left_sha256"))


def db_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gx.db_target(source(spark, sf_dir, "needs"), "question").select("need", "target_type", "target_code")


def routed_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = source(spark, sf_dir, "needs").withColumn("types", F.array("type")).withColumn("sources", F.array("source"))
    return gx.routed(n, "question", "scope", "report", "types", "sources").select("need", "route", "reason", "mixed", F.col("budget.fused").alias("fused"), F.col("budget.timeout_ms").alias("timeout_ms"))


def hybrid_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as needs; views and clicks as the hits of two channels, errors and sign-ups as their failures."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    from pyspark.sql import Window

    hit = e.where("event_type in ('view', 'click') and value > 12").select(F.col("user_id").alias("need"), F.when(F.col("event_type") == "view", "sparse").otherwise("dense").alias("channel"), (F.col("event_id") % 50).alias("id"), "event_id")
    one = hit.groupBy("need", "channel", "id").agg(F.min("event_id").alias("seen"))
    hits = one.withColumn("rank", F.row_number().over(Window.partitionBy("need", "channel").orderBy("seen")))
    failures = e.where("event_type = 'error' and value > 150").select(F.col("user_id").alias("need"), F.expr("CASE event_id % 3 WHEN 0 THEN 'sparse' WHEN 1 THEN 'dense' ELSE 'TIMEOUT' END").alias("channel"))
    out = gx.hybrid(e.select(F.col("user_id").alias("need")).distinct(), hits, failures, 10, 5)
    shown = F.transform("evidence", lambda x: F.concat_ws(":", x["id"].cast("string"), F.coalesce(x["sparse"].cast("string"), F.lit("-")), F.coalesce(x["dense"].cast("string"), F.lit("-"))))
    return out.select("need", "status", "failure_code", F.array_join(shown, " ").alias("evidence"))


def structured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for an item or a metric of a year; their orders' sums are the items, their counts the metrics."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("company"), F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31")).alias("period"), F.col("o_orderstatus").alias("code"), F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    sums = o.groupBy("company", "period", "code").agg(F.sum("price").cast("double").alias("amount"), F.count("*").alias("n"))
    metrics = sums.select("company", "period", "code", F.when(F.col("n") > 1, "CALCULATED").otherwise("NOT_AVAILABLE").alias("status"), F.lit("v1").alias("version"), F.col("n").cast("double").alias("value"))
    ask = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS request", "c_custkey AS company", "CASE WHEN c_custkey % 2 = 0 THEN 'field' ELSE 'metric' END AS target_type", "CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS code", "CASE WHEN c_nationkey % 2 = 0 THEN concat(CAST(1995 + c_nationkey % 5 AS STRING), '-12-31') END AS period", "CASE WHEN c_nationkey % 7 = 0 THEN 'v0' END AS version")
    return gx.structured_lookup(ask, sums, metrics, ["CALCULATED"])


_TOPICS = "SELECT section_id, concat('t', CAST(k AS STRING)) AS topic_id, k AS place, concat('T', CAST(k AS STRING)) AS title"


#: What a section's contract asks, by the number k.
_TOPIC_ID = "concat('t', CAST(k AS STRING))"
_QUESTION = {
    "question_id": "concat('q', CAST(k AS STRING))",
    "topic_id": "concat('t', CAST(k % 3 AS STRING))",
    "policy": "CAST(CASE WHEN k % 2 = 0 THEN array('SECTION_BLOCKED') ELSE array() END AS array<string>)",
    "aspects": "CASE WHEN k < 3 THEN array('收入', '') ELSE array('诉讼') END",
}


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    s = source(spark, sf_dir, "sections")
    topics = s.select("section_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).selectExpr("section_id", f"{_TOPIC_ID} AS topic_id", "k AS place", "concat('T', CAST(k AS STRING)) AS title")
    q = s.select("section_id", F.explode(F.array(*(F.lit(k) for k in range(5)))).alias("k"))
    questions = q.selectExpr("section_id", *(f"{c} AS {name}" for name, c in _QUESTION.items()))
    claims = source(spark, sf_dir, "section_claims").withColumn("question_ids", F.array_distinct(F.array("q1", "q2")))
    refs = source(spark, sf_dir, "section_refs")
    gaps = source(spark, sf_dir, "section_gaps").withColumn("effects", F.array_compact(F.array("effect")))
    return s, topics, questions, claims, refs, gaps


def _section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that section rules judge. Orders and lines are dealt out by section as they are stored; claims, references and
    open questions of a line are made of it afterwards, since they are many times its size."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("section_id"), F.lit(False).alias("is_section"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("section_id"), F.lit(True).alias("is_section"), "o_orderstatus", "o_custkey")
    rows = lines.unionByName(orders, allowMissingColumns=True).repartition("section_id")
    made = {name: {c.rpartition(" AS ")[2]: c.rpartition(" AS ")[0] for c in INPUTS[name][2]} for name in ("sections", "section_claims", "section_refs", "section_gaps")}
    made["section_claims"]["question_ids"] = "array_distinct(array({q1}, {q2}))".format(**made["section_claims"])
    made["section_gaps"]["effects"] = "array_compact(array({effect}))".format(**made["section_gaps"])
    struct = lambda of, *names: f"named_struct({', '.join(f"'{n}', {of[n]}" for n in names)})"
    holds = lambda name: f"NOT is_section AND {INPUTS[name][1]}"
    one = f"CASE WHEN {INPUTS['section_refs'][1]} THEN {struct(made['section_refs'], 'ref_type', 'snapshot_id', 'reason', 'known', 'display', 'proxy', 'dated', 'grade')} END"
    refs = lambda k: re.sub(r"\bk\b", str(k), one)
    return rows.selectExpr(
        "section_id",
        f"CASE WHEN is_section THEN {struct(made['sections'], 'status', 'markdown')} END AS section",
        f"CASE WHEN is_section THEN named_struct('topics', transform(array(0, 1, 2), k -> {_TOPIC_ID}), 'questions', transform(array(0, 1, 2, 3, 4), k -> {struct(_QUESTION, 'question_id', 'policy', 'aspects')})) END AS contract",
        f"CASE WHEN NOT is_section THEN {made['section_claims']['claim_id']} END AS claim_id",
        f"CASE WHEN {holds('section_claims')} THEN {struct(made['section_claims'], 'topic_id', 'question_ids', 'claim_type', 'text', 'impact', 'derived')} END AS claim",
        f"CASE WHEN NOT is_section THEN array({', '.join(refs(k) for k in range(4))}) END AS refs",
        f"CASE WHEN {holds('section_gaps')} THEN {struct(made['section_gaps'], 'unresolved_id', 'question_id', 'topic_id', 'state', 'effects')} END AS gap",
    )


def section_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.section_issues(_section_rows(spark, sf_dir))


def section_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.verdicts(_section_rows(spark, sf_dir))


def industry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims, lines as their sources."""
    claims = source(spark, sf_dir, "sections").selectExpr("section_id AS claim_id", "section_id % 3 = 0 AS strong", "section_id % 2 = 0 AS key")
    refs = source(spark, sf_dir, "section_refs").where("ref_type = 'external'").selectExpr("section_id AS claim_id", "grade", "host", "published")
    return sx.industry_policy(claims, refs, F.lit("1998-06-30").cast("date"), 365)


def publication_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, _, claims, _, gaps = _parts(spark, sf_dir)
    excluded = claims.where("derived").selectExpr("section_id", "CASE WHEN impact THEN 'self_invented_scheme' ELSE 'other' END AS reason", "CAST(claim_id AS STRING) AS claim_id")
    return sx.publication(s, gaps, excluded)


def edited_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, topics, _, claims, refs, _ = _parts(spark, sf_dir)
    shown = refs.selectExpr("section_id", "claim_id", "place AS at", "concat(ref_type, CAST(place AS STRING)) AS shown")
    return sx.edited(claims.withColumn("at", F.col("claim_id")), topics.where("place > 0"), shown)


def rework_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose gaps name what to ask again, their claims after the rework."""
    _, _, questions, claims, _, gaps = _parts(spark, sf_dir)
    targets = gaps.join(claims.groupBy("section_id").agg(F.min("claim_id").cast("string").alias("claim")), "section_id", "left").selectExpr("section_id", "CASE state WHEN 'CONFLICT' THEN 'topic' WHEN 'WAITING_HUMAN' THEN 'question' ELSE 'claim' END AS kind", "CASE state WHEN 'CONFLICT' THEN topic_id WHEN 'WAITING_HUMAN' THEN coalesce(question_id, '') ELSE claim END AS ref", "unresolved_id AS reason")
    again = sx.rework_targets(targets, questions, claims)
    fresh = again.select("section_id", F.lit(0).cast("long").alias("claim_id"), F.array("question_id").alias("question_ids"))
    merged = sx.merged_rework(claims.select("section_id", "claim_id", "question_ids"), fresh, again)
    return merged.groupBy("section_id").agg(F.count_if(F.col("origin") == "parent").alias("kept"), F.count_if(F.col("origin") == "rework").alias("fresh"))


QUERIES = {f.__name__: f for f in (amount_extract, business_amounts, evidence_values, text_value_presence, number_display, canonical_periods, note_tables, note_items, table_continuation, line_roles, page_lines, db_targets, routed_needs, hybrid_status, structured_lookup, section_issues, section_verdicts, industry_policy, publication_status, edited_sections, rework_merge)}

_LABEL = "CASE WHEN p IN ('%', '％') THEN 'percent' ELSE 'money' END"
_PLAIN_SIZE = "CASE " + " ".join(f"WHEN p = '{n}' THEN {k}" for n, k in ax.SUFFIXES) + " END"
_EVIDENCE = rf"""
pl AS (SELECT id, text, string_split(text, chr(10)) AS ls FROM proofs),
tp AS (SELECT id, unnest(regexp_split_to_array(trim(regexp_extract(text, '单位\s*[:：]\s*([^\n\r]*)', 1)), '[，,、;；/\t\s]+')) AS p, generate_subscripts(regexp_split_to_array(trim(regexp_extract(text, '单位\s*[:：]\s*([^\n\r]*)', 1)), '[，,、;；/\t\s]+'), 1) AS i FROM pl),
tu AS (SELECT id, kind, arg_min(size, i) AS size, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS nth FROM (SELECT id, i, {_LABEL} AS kind, {_PLAIN_SIZE} AS size FROM tp WHERE p IN ('%', '％') OR ({_PLAIN_SIZE}) IS NOT NULL) GROUP BY id, kind),
tn AS (SELECT id, count(*) AS n FROM tu GROUP BY id),
pi AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM pl),
ch AS (SELECT id, arg_min(line, ln) AS line FROM pi WHERE NOT contains(line, '单位') AND regexp_matches(line, '{"|".join(ax.HEADER_WORDS)}') AND regexp_matches(line, '{ax.COLUMN_UNIT}') GROUP BY id),
cu AS (SELECT id, {_LABEL} AS kind, {_PLAIN_SIZE} AS size, nth FROM (SELECT id, unnest(regexp_extract_all(line, '{ax.COLUMN_UNIT}', 1)) AS p, generate_subscripts(regexp_extract_all(line, '{ax.COLUMN_UNIT}', 1), 1) AS nth FROM ch)),
pt AS (SELECT id, ln, trim(unnest(regexp_extract_all(line, '{ax.AMOUNT}', 0))) AS token, generate_subscripts(regexp_extract_all(line, '{ax.AMOUNT}', 0), 1) AS pos FROM pi),
ps AS (SELECT *, {_signs('token')} AS s FROM pt),
pk AS (SELECT *, {_KIND} AS own, {_BARE} AS bare, {_size('s')} AS mine FROM ps),
pn AS (SELECT *, CASE WHEN own = 'unknown' THEN sum(CAST(own = 'unknown' AS INT)) OVER (PARTITION BY id, ln ORDER BY pos) END AS nth, sum(CAST(own = 'unknown' AS INT)) OVER (PARTITION BY id, ln) AS many FROM pk),
pa AS (SELECT pn.id, ln, pos, token, own, bare, mine, pn.nth, EXISTS (SELECT 1 FROM cu WHERE cu.id = pn.id) AS byc, coalesce(n, 0) AS n, cu.kind AS ck, cu.size AS cs, tu.kind AS tk, tu.size AS ts, many
       FROM pn LEFT JOIN tn ON tn.id = pn.id LEFT JOIN cu ON cu.id = pn.id AND cu.nth = pn.nth LEFT JOIN tu ON tu.id = pn.id AND tu.nth = (pn.nth - 1) % n + 1 AND (n = 1 OR many >= n)),
pz AS (SELECT id, ln, pos, token, CASE WHEN own <> 'unknown' THEN own WHEN byc THEN coalesce(ck, 'unknown') ELSE coalesce(tk, 'unknown') END AS kind,
              CASE WHEN own <> 'unknown' THEN bare * coalesce(mine, 1) WHEN byc THEN bare * coalesce(cs, 1) ELSE bare * coalesce(ts, 1) END AS value,
              own = 'unknown' AND CASE WHEN byc THEN ck IS NULL ELSE n >= 2 AND tk IS NULL END AS ambiguous FROM pa WHERE bare IS NOT NULL),
ev AS (SELECT id, token, kind, arg_min(value, (ln, pos)) AS value, arg_min(ambiguous, (ln, pos)) AS ambiguous FROM pz GROUP BY id, token, kind)"""

_PERIOD = r"""CASE WHEN regexp_matches(x, '^\d{4}$') THEN TRY_CAST(x || '-12-31' AS DATE)
 WHEN regexp_matches(x, '^\d{4}-?[Qq][1-4]$') THEN last_day(TRY_CAST(left(x, 4) || '-' || lpad(CAST(CAST(right(x, 1) AS INT) * 3 AS VARCHAR), 2, '0') || '-01' AS DATE))
 WHEN regexp_matches(x, '^\d{4}-?[Hh][12]$') THEN last_day(TRY_CAST(left(x, 4) || '-' || lpad(CAST(CAST(right(x, 1) AS INT) * 6 AS VARCHAR), 2, '0') || '-01' AS DATE))
 WHEN regexp_matches(x, '^\d{4}-\d{2}$') THEN last_day(TRY_CAST(x || '-01' AS DATE)) WHEN regexp_matches(x, '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(x AS DATE) END"""


def _period(x: str) -> str:
    return "(" + re.sub(r"\bx\b", x, _PERIOD) + ")"


def _shown_yuan(v: str) -> str:
    def one(x: str, unit: str) -> str:
        return f"regexp_replace(regexp_replace(format('{{:,.2f}}', CAST(round(CAST({x} AS DECIMAL(30,6)), 2) AS DECIMAL(24,2))), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || '{unit}'"

    return f"CASE WHEN abs({v}) >= 100000000 THEN {one(v + ' / 100000000', '亿元')} WHEN abs({v}) >= 10000 THEN {one(v + ' / 10000', '万元')} ELSE {one(v, '元')} END"


_NOTES = rf"""
nl AS (SELECT document, block, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM blocks),
nt AS (SELECT document, block, pos, trim(line) AS line, regexp_split_to_array(trim(line), '\s+') AS tok FROM nl WHERE trim(line) <> ''),
n1 AS (SELECT *, regexp_matches(line, '{nx.TITLE}') AS ttl, sum(CAST(regexp_matches(line, '{nx.TITLE}') AS INT)) OVER (PARTITION BY document ORDER BY block, pos) AS tab FROM nt),
n2 AS (SELECT *, regexp_matches(tok[1], '{"|".join(nx.LABELS)}') AS lab, NOT ttl AND regexp_matches(line, '{nx.UNIT_LINE}') AS unl,
              nullif(trim(string_split(regexp_replace(regexp_extract(line, '{nx.UNIT_LINE}', 1), '[，、；%]', ',', 'g'), ',')[1]), '') AS uv FROM n1 WHERE tab > 0),
n3 AS (SELECT *, unl AND NOT coalesce(bool_or(unl AND uv IS NOT NULL) OVER p, false) AS isu FROM n2 WINDOW p AS (PARTITION BY document, tab ORDER BY block, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n4 AS (SELECT *, lab AND NOT ttl AND NOT isu AND len(list_filter(tok, lambda t: regexp_matches(t, '{nx.YEAR}'))) > 0 AS hd FROM n3),
n5 AS (SELECT *, coalesce(bool_or(hd) OVER p, false) AS had FROM n4 WINDOW p AS (PARTITION BY document, tab ORDER BY block, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n6 AS (SELECT *, hd AND NOT had AS ish, had AND NOT lab AND NOT ttl AND NOT isu AND len(list_filter(tok, lambda t: NOT (regexp_matches(t, '占比|比例|%|^\d+$') OR t = '金额'))) = 0 AS sec FROM n5),
n7 AS (SELECT *, sec AND NOT coalesce(bool_or(sec) OVER p, false) AS iss FROM n6 WINDOW p AS (PARTITION BY document, tab ORDER BY block, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n8 AS (SELECT *, NOT ttl AND NOT isu AND NOT ish AND NOT iss AND len(tok) >= 2 AND NOT regexp_matches(tok[1], '{nx.NUMERIC}') AND len(list_filter(tok[2:], lambda t: NOT regexp_matches(t, '{nx.NUMERIC}'))) = 0 AS dat FROM n7),
n9 AS (SELECT *, bool_or(NOT (ttl OR isu OR ish OR iss OR dat)) OVER (PARTITION BY document, tab ORDER BY block, pos) AS shut FROM n8),
na AS (SELECT document, tab, max(CASE WHEN ttl THEN '表' || regexp_extract(line, '{nx.TITLE}', 1) || '-' || regexp_extract(line, '{nx.TITLE}', 2) || CASE WHEN regexp_extract(line, '{nx.TITLE}', 3) <> '' THEN ' ' || regexp_extract(line, '{nx.TITLE}', 3) ELSE '' END END) AS title,
              arg_min(uv, (block, pos)) FILTER (isu AND uv IS NOT NULL) AS unit, max(tok) FILTER (ish) AS h1, coalesce(max(tok) FILTER (iss), []) AS h2,
              list(array_to_string(tok, ' ') ORDER BY block, pos) FILTER (dat) AS rows, min(block) FILTER (dat) AS data_block FROM n9 WHERE NOT shut GROUP BY document, tab),
nb AS (SELECT *, len(h1) - 1 AS years, CASE WHEN len(h1) > 1 THEN len(h2) // (len(h1) - 1) ELSE 0 END AS each FROM na WHERE h1 IS NOT NULL AND len(rows) > 0),
nc AS (SELECT document, tab, title, unit, rows, data_block, list_concat([h1[1]], CASE WHEN len(h2) > 0 THEN flatten(list_transform(range(1, years + 1), lambda y: list_transform(range(1, each + 1), lambda k: h1[y + 1] || h2[(y - 1) * each + k]))) ELSE h1[2:] END) AS headers FROM nb)"""

_CELLS = r"list_transform(list_filter(regexp_split_to_array(trim(line), '\s{2,}'), lambda c: c <> ''), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g')))"
_NUMBER_CELL = r"(trim(c) <> '' AND (regexp_matches(trim(c), '^[-+]?[\d,，.]+(?:%|％)?$') OR len(list_filter(regexp_split_to_array(trim(c), '\s+'), lambda p: NOT (regexp_matches(p, '\d') AND regexp_matches(p, '^[0-9,，.%\-+（）()]+$')))) = 0))"


def _names(of: dict[str, tuple[str, ...]]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{code}')" for code, aliases in of.items() for a in aliases) + ")"


def _resolved(name: str, of: dict[str, tuple[str, ...]]) -> str:
    return f"""{name}a AS (SELECT need, a.alias, code, i AS b, i + length(a.alias) AS e FROM q0, LATERAL (SELECT unnest(range(1, greatest(length(q), 1) + 1)) AS i) r, {_names(of)} a(alias, code) WHERE substr(q, i, length(a.alias)) = a.alias),
{name}m AS (SELECT * FROM {name}a s WHERE NOT EXISTS (SELECT 1 FROM {name}a o WHERE o.need = s.need AND o.b <= s.b AND s.e <= o.e AND (o.b, o.e, o.code) <> (s.b, s.e, s.code))),
{name} AS (SELECT need, count(DISTINCT code) AS n, min(code) AS code FROM {name}m GROUP BY need)"""


_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_PARTS_BLOCKED = " OR ".join(f"(f.code = '{code}' AND {_words(words, 'q')})" for code, words in gx.PARTS.items())
_TARGETS = f"""
q0 AS (SELECT *, regexp_replace(lower(translate(question, '{_FULL}', '{_HALF}')), '[\\s\\x{{3000}}]+', '', 'g') AS q FROM needs),
{_resolved('m', gx.METRICS)},
{_resolved('f', gx.FIELDS)},
db AS (SELECT q0.*, CASE WHEN m.n = 1 THEN 'metric' WHEN m.n IS NULL AND f.n = 1 AND NOT ({_PARTS_BLOCKED}) THEN 'field' END AS target_type,
              CASE WHEN m.n = 1 THEN m.code WHEN m.n IS NULL AND f.n = 1 AND NOT ({_PARTS_BLOCKED}) THEN f.code END AS target_code FROM q0 LEFT JOIN m ON m.need = q0.need LEFT JOIN f ON f.need = q0.need)"""

_SECTION_PARTS = f"""{_sql('sections', 'section_refs')},
section_claims AS (SELECT *, CASE WHEN q1 = q2 THEN [q1] ELSE [q1, q2] END AS question_ids FROM (SELECT {', '.join(INPUTS['section_claims'][2])} FROM lineitem WHERE {INPUTS['section_claims'][1]})),
section_gaps AS (SELECT *, CASE WHEN effect IS NULL THEN [] ELSE [effect] END AS effects FROM (SELECT {', '.join(INPUTS['section_gaps'][2])} FROM lineitem WHERE {INPUTS['section_gaps'][1]})),
topics AS ({_TOPICS} FROM sections, (VALUES (0), (1), (2)) v(k)),
questions AS (SELECT section_id, 'q' || k AS question_id, 't' || (k % 3) AS topic_id, CASE WHEN k % 2 = 0 THEN ['SECTION_BLOCKED'] ELSE [] END AS policy, CASE WHEN k < 3 THEN ['收入'] ELSE ['诉讼'] END AS aspects FROM sections, (VALUES (0), (1), (2), (3), (4)) v(k))"""
_RULES = f"""{_SECTION_PARTS},
cq AS (SELECT section_id, claim_id, text, unnest(question_ids) AS question_id FROM section_claims),
cr AS (SELECT r.*, c.text, c.impact FROM section_refs r JOIN section_claims c USING (section_id, claim_id)),
rs AS (SELECT section_id, claim_id, bool_or(ref_type = 'structured') AS sums, count(DISTINCT snapshot_id) FILTER (ref_type = 'structured') AS snaps, min(grade) FILTER (ref_type = 'external') AS best, max(grade) FILTER (ref_type = 'external') AS worst FROM section_refs GROUP BY 1, 2),
cf AS (SELECT c.*, rs.section_id IS NOT NULL AS cited, coalesce(sums, false) AS sums, coalesce(snaps, 0) AS snaps, best, worst,
              EXISTS (SELECT 1 FROM section_gaps g WHERE g.section_id = c.section_id AND g.state = 'NOT_FOUND_AFTER_SEARCH' AND g.question_id IN (c.q1, c.q2)) AS gap FROM section_claims c LEFT JOIN rs USING (section_id, claim_id)),
issues AS (
SELECT g.section_id, 'blocking_policy_mismatch' AS rule_id, 'blocking' AS severity, 'unresolved:' || unresolved_id AS location FROM section_gaps g LEFT JOIN questions q USING (section_id, question_id) WHERE effects <> coalesce(policy, [])
UNION ALL SELECT section_id, 'conflict_unresolved', 'blocking', 'unresolved:' || unresolved_id FROM section_gaps WHERE state = 'CONFLICT'
UNION ALL SELECT section_id, 'waiting_human', 'blocking', 'unresolved:' || unresolved_id FROM section_gaps WHERE state = 'WAITING_HUMAN'
UNION ALL SELECT section_id, 'status_not_blocked', 'blocking', 'section' FROM sections s WHERE status <> 'SECTION_BLOCKED' AND EXISTS (SELECT 1 FROM section_gaps g WHERE g.section_id = s.section_id AND effect = 'SECTION_BLOCKED')
UNION ALL SELECT section_id, 'empty_section', 'blocking', 'section' FROM sections s WHERE trim(markdown) = '' AND NOT EXISTS (SELECT 1 FROM section_gaps g WHERE g.section_id = s.section_id) AND NOT EXISTS (SELECT 1 FROM section_claims c WHERE c.section_id = s.section_id)
UNION ALL SELECT section_id, 'coverage_missing_topic', 'rework', 'topic:' || topic_id FROM topics t WHERE (section_id, topic_id) NOT IN (SELECT section_id, topic_id FROM section_claims) AND (section_id, topic_id) NOT IN (SELECT section_id, topic_id FROM section_gaps)
UNION ALL SELECT section_id, 'coverage_missing_question', 'rework', 'question:' || question_id FROM questions q WHERE NOT EXISTS (SELECT 1 FROM cq WHERE cq.section_id = q.section_id AND cq.question_id = q.question_id) AND NOT EXISTS (SELECT 1 FROM section_gaps g WHERE g.section_id = q.section_id AND g.question_id = q.question_id)
UNION ALL SELECT section_id, 'aspect_uncovered', 'warning', 'question:' || question_id FROM questions JOIN cq USING (section_id, question_id) GROUP BY section_id, question_id, aspects HAVING NOT bool_or(contains(text, aspects[1]))
UNION ALL SELECT section_id, 'citation_unresolvable', 'rework', 'claim:' || claim_id FROM cr WHERE reason <> 'authority_unavailable'
UNION ALL SELECT DISTINCT section_id, 'citation_authority_unavailable', 'warning', 'ref_type:' || ref_type FROM cr WHERE reason = 'authority_unavailable'
UNION ALL SELECT section_id, 'financial_unresolvable_value', 'rework', 'claim:' || claim_id FROM cr WHERE ref_type = 'structured' AND NOT known
UNION ALL SELECT section_id, 'financial_value_mismatch', 'rework', 'claim:' || claim_id FROM cr WHERE ref_type = 'structured' AND known AND display <> '' AND NOT contains(text, display)
UNION ALL SELECT section_id, 'proxy_claimed_exact', 'rework', 'claim:' || claim_id FROM cr WHERE ref_type = 'structured' AND known AND proxy AND {_words(sx.EXACT, 'text')}
UNION ALL SELECT section_id, 'external_missing_date', 'warning', 'claim:' || claim_id FROM cr WHERE ref_type = 'external' AND NOT dated
UNION ALL SELECT section_id, 'claim_missing_citation', 'rework', 'claim:' || claim_id FROM cf WHERE claim_type IN ('fact', 'calculation') AND NOT cited AND NOT derived
UNION ALL SELECT section_id, 'd_source_sole_basis', 'rework', 'claim:' || claim_id FROM cf WHERE impact AND best = 'D' AND worst = 'D'
UNION ALL SELECT section_id, 'single_c_source', 'warning', 'claim:' || claim_id FROM cf WHERE impact AND best = 'C' AND worst = 'C'
UNION ALL SELECT section_id, 'unfound_claimed_absent', 'rework', 'claim:' || claim_id FROM cf WHERE claim_type = 'fact' AND {_words(sx.NOT_FOUND, 'text')}
UNION ALL SELECT section_id, 'absence_contradicts_gap', 'rework', 'claim:' || claim_id FROM cf WHERE gap AND {_words(sx.ABSENT, 'text')}
UNION ALL SELECT section_id, 'calculation_missing_structured', 'rework', 'claim:' || claim_id FROM cf WHERE claim_type = 'calculation' AND NOT sums
UNION ALL SELECT section_id, 'fact_hedged', 'rework', 'claim:' || claim_id FROM cf WHERE claim_type = 'fact' AND {_words(sx.HEDGES, 'text')}
UNION ALL SELECT section_id, 'dimension_mismatch', 'rework', 'claim:' || claim_id FROM cf WHERE snaps > 1
UNION ALL SELECT section_id, 'empty_shell_claim', 'rework', 'claim:' || claim_id FROM cf WHERE length(trim(text)) < 2
UNION ALL SELECT section_id, 'self_invented_scheme', 'rework', 'claim:' || claim_id FROM cf WHERE {_words(sx.ADVICE, 'text')} AND {_words(sx.TERMS, 'text')} AND NOT (cited AND {_words(sx.STANDING, 'text')}))"""

_GRADES = "count(*) FILTER (grade IN ('A', 'B')) AS ab, count(DISTINCT host) FILTER (grade = 'C') AS c"

ORACLE_SQL: dict[str, str] = {
    "amount_extract": f"WITH {_sql('sayings')},\n{_tokens('sayings', 'text')}\nSELECT id, token, kind, CAST(value AS DOUBLE) AS value FROM w",
    "business_amounts": f"WITH {_sql('sayings')},\nb AS (SELECT id, {_blanked('text')} AS text FROM sayings),\n{_tokens('b', 'text')}\nSELECT id, token, kind, CAST(value AS DOUBLE) AS value FROM w",
    "evidence_values": f"WITH {_sql('proofs')},{_EVIDENCE}\nSELECT id, token, kind, CAST(value AS DOUBLE) AS value, ambiguous FROM ev",
    "text_value_presence": f"""WITH {_sql('proofs', 'claims')},{_EVIDENCE},
b AS (SELECT id, {_blanked('text')} AS text FROM claims),
{_tokens('b', 'text')}
SELECT w.id, w.token AS claimed, CASE WHEN bool_or(coalesce(w.kind <> 'unknown' AND ev.kind = w.kind AND ev.value = w.value, false)) THEN 'SUPPORTED' WHEN bool_or(coalesce(w.kind <> 'unknown' AND ambiguous AND ev.value = w.bare, false)) THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS verdict
FROM w LEFT JOIN ev ON ev.id = w.id GROUP BY 1, 2""",
    "number_display": f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (l_orderkey % 5000) AS DECIMAL(24,2)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, {_shown_yuan('v')} AS yuan,
 CASE l_partkey % 3 WHEN 0 THEN regexp_replace(regexp_replace(CAST(v AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || '%' WHEN 1 THEN {_shown_yuan('v')} ELSE regexp_replace(regexp_replace(CAST(v AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END AS shown,
 l_partkey <> 0 AND abs(l_quantity - l_partkey) / l_partkey > 0.05 AS differs, CASE WHEN l_quantity <> 0 THEN l_quantity * CASE l_suppkey % 5 WHEN 0 THEN 10000 WHEN 1 THEN 100000000 ELSE 1 END END AS legacy FROM v""",
    "canonical_periods": f"""WITH {_sql('needs')}
SELECT need, CAST({_period('scope')} AS VARCHAR) AS period, coalesce({_period('scope')} > DATE '2024-12-31', false) AS late,
 CASE WHEN len(list_distinct(regexp_extract_all(question, '(?:19|20)\\d{{2}}'))) = 1 THEN regexp_extract(question, '(?:19|20)\\d{{2}}') || '-12-31' END AS target,
 CASE WHEN need % 2 = 0 THEN '2023-12-31' END AS begins, CASE WHEN need % 14 BETWEEN 1 AND 12 THEN '2023-' || lpad(CAST(need % 14 AS VARCHAR), 2, '0') || '-05' END AS anchor FROM needs""",
    "note_tables": f"WITH {_sql('blocks')},{_NOTES}\nSELECT document, title, unit, array_to_string(headers, '|') AS headers, array_to_string(rows, '|') AS rows, data_block FROM nc",
    "note_items": f"""WITH {_sql('blocks')},{_NOTES},
c AS (SELECT headers, string_split(unnest(rows), ' ') AS tok FROM nc),
d AS (SELECT headers[k] AS header, tok[k] AS cell FROM (SELECT headers, tok, unnest(range(2, len(tok) + 1)) AS k FROM c))
SELECT header, CASE WHEN regexp_matches(header, '{nx.YEAR}') THEN regexp_extract(header, '{nx.YEAR}', 1) || '-12-31' END AS period, coalesce(regexp_matches(header, '占比|比例|%'), false) AS is_share, count(*) AS n,
 CAST(sum(TRY_CAST(replace(replace(cell, ',', ''), '%', '') AS DECIMAL(18,6))) AS DOUBLE) AS total FROM d GROUP BY 1, 2, 3""",
    "table_continuation": f"""WITH {_sql('blocks')},
p AS (SELECT document, section, block, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM blocks),
l AS (SELECT * FROM p WHERE len(ls) > 0 AND NOT regexp_matches(ls[1], '{"|".join(nx.NEW_TABLE)}')),
s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY document, section ORDER BY block) = 1)
SELECT s.document, s.section, array_to_string(list_concat(any_value(s.ls), coalesce(flatten(list(l.ls ORDER BY l.block) FILTER (l.block IS NOT NULL)), [])), '|') AS rows, count(l.block) AS blocks
FROM s LEFT JOIN l ON l.document = s.document AND l.section = s.section AND l.block > s.block GROUP BY s.document, s.section""",
    "line_roles": f"""WITH {_sql('lines')},
c AS (SELECT *, {_CELLS} AS cs, regexp_split_to_array(trim(line), '\\s+') AS tok FROM lines),
d AS (SELECT *, len(list_filter(cs, lambda c: {_NUMBER_CELL})) > 0 AS num FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '{nx.PAGE_NUMBER}') THEN 'page' WHEN regexp_matches(trim(line), '^表\\s*\\d') THEN 'title' WHEN regexp_matches(line, '单位\\s*[:：]') THEN 'unit'
 WHEN regexp_matches(line, '{"|".join(nx.CLOSING)}') AND num THEN 'total' WHEN num THEN 'data' WHEN len(cs) >= 2 AND NOT regexp_matches(line, '[。！？；]') THEN 'columns' ELSE 'prose' END AS role,
 array_to_string(cs, '|') AS cells, len(tok) >= 2 AND NOT regexp_matches(tok[1], '{nx.NUMERIC}') AND len(list_filter(tok[2:], lambda t: NOT regexp_matches(t, '{nx.NUMERIC}'))) = 0 AS is_data FROM d""",
    "page_lines": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '\\. ?\\n', '...... 7' || chr(10), 'g') AS u FROM documents),
e AS (SELECT *, string_split(t, chr(10)) AS ls, string_split(u, chr(10)) AS us FROM d),
f AS (SELECT *, list_filter(ls, lambda x: regexp_replace(x, '[ \\t\\n\\v\\f\\r]+', '', 'g') = regexp_replace(ls[1], '[ \\t\\n\\v\\f\\r]+', '', 'g')) AS hit, len(list_filter(us, lambda x: regexp_matches(trim(x), '{nx.CONTENTS_LINE}'))) AS n FROM e)
SELECT doc_id, length(u) >= 20 AND (len(list_filter(us, lambda x: regexp_matches(x, '{nx.CONTENTS_TITLE}'))) > 0 OR n >= 3 OR (len(us) > 3 AND n / len(us) > 0.3)) AS contents,
 sha256(CASE WHEN list_sum(list_transform(hit, lambda x: length(trim(x)))) * 2 > list_sum(list_transform(ls, lambda x: length(trim(x)))) THEN t ELSE array_to_string(list_filter(ls, lambda x: regexp_replace(x, '[ \\t\\n\\v\\f\\r]+', '', 'g') <> regexp_replace(ls[1], '[ \\t\\n\\v\\f\\r]+', '', 'g')), chr(10)) END) AS left_sha256 FROM f""",
    "db_targets": f"WITH {_sql('needs')},{_TARGETS}\nSELECT need, target_type, target_code FROM db",
    "routed_needs": f"""WITH {_sql('needs')},{_TARGETS},
r AS (SELECT *, CASE WHEN {_words(gx.AUDIT, 'question')} THEN 'AUDIT_OPINION_FIELD' WHEN scope IS NOT NULL AND {_period('scope')} IS NULL THEN 'TIME_SCOPE_UNPARSEABLE'
 WHEN target_type IS NOT NULL AND (outside OR {_words(gx.RECENT, 'question')}) THEN 'DB_EXTERNAL_CONFLICT' WHEN outside THEN 'EXPLICIT_EXTERNAL_RECENCY' WHEN {_words(gx.DEEP, 'question')} THEN 'CROSS_DOCUMENT_OR_CONFLICT'
 WHEN target_type = 'field' THEN 'REGISTERED_DB_FIELD' WHEN target_type = 'metric' THEN 'REGISTERED_FINANCIAL_METRIC' WHEN {_words(gx.DIRECT, 'question')} AND NOT {_words(gx.SYNTHESIS, 'question')} THEN 'EXACT_DOCUMENT_FIELD' ELSE 'SECTION_TOPIC_SYNTHESIS' END AS reason
 FROM (SELECT *, {_words(gx.EXTERNAL, 'question')} OR coalesce({_period('scope')} > DATE '2024-12-31', false) OR type = 'web' OR source = 'external' AS outside FROM db)),
s AS (SELECT *, CASE WHEN reason IN ('AUDIT_OPINION_FIELD', 'EXACT_DOCUMENT_FIELD') THEN 'DIRECT_EVIDENCE' WHEN reason IN ('TIME_SCOPE_UNPARSEABLE', 'DB_EXTERNAL_CONFLICT') THEN 'FALLBACK' WHEN reason = 'EXPLICIT_EXTERNAL_RECENCY' THEN 'EXTERNAL_RESEARCH' WHEN reason = 'CROSS_DOCUMENT_OR_CONFLICT' THEN 'DEEP_RETRIEVAL' WHEN starts_with(reason, 'REGISTERED') THEN 'DB_LOOKUP' ELSE 'STANDARD_RAG' END AS route FROM r)
SELECT need, route, reason, (type = 'web' OR source = 'external') AND (source = 'annual_report' OR {_words(gx.DEEP, 'question')}) AS mixed,
 CASE route WHEN 'DIRECT_EVIDENCE' THEN 10 WHEN 'DEEP_RETRIEVAL' THEN 40 WHEN 'STANDARD_RAG' THEN 20 ELSE 1 END AS fused, CASE WHEN route IN ('DIRECT_EVIDENCE', 'DEEP_RETRIEVAL', 'STANDARD_RAG') THEN 5000 ELSE 1000 END AS timeout_ms FROM s""",
    "hybrid_status": """WITH one AS (SELECT user_id AS need, CASE event_type WHEN 'view' THEN 'sparse' ELSE 'dense' END AS channel, event_id % 50 AS id, min(event_id) AS seen FROM events WHERE event_type IN ('view', 'click') AND value > 12 GROUP BY 1, 2, 3),
h AS (SELECT *, row_number() OVER (PARTITION BY need, channel ORDER BY seen) AS rank FROM one),
f AS (SELECT need, id, sum(1.0 / CAST(60 + rank AS DOUBLE)) AS score, min(rank) FILTER (channel = 'sparse') AS s, min(rank) FILTER (channel = 'dense') AS d FROM h GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY need ORDER BY score DESC, id) AS r FROM f),
e AS (SELECT need, string_agg(id || ':' || coalesce(CAST(s AS VARCHAR), '-') || ':' || coalesce(CAST(d AS VARCHAR), '-'), ' ' ORDER BY r) AS evidence FROM t WHERE r <= 5 GROUP BY 1),
b AS (SELECT user_id AS need, bool_or(event_id % 3 = 0) AS ns, bool_or(event_id % 3 = 1) AS nd, bool_or(event_id % 3 = 2) AS late FROM events WHERE event_type = 'error' AND value > 150 GROUP BY 1),
x AS (SELECT n.need, evidence, coalesce(ns, false) AS ns, coalesce(nd, false) AS nd, coalesce(late, false) AS late, evidence IS NOT NULL AS has FROM (SELECT DISTINCT user_id AS need FROM events) n LEFT JOIN e ON e.need = n.need LEFT JOIN b ON b.need = n.need)
SELECT need, CASE WHEN late THEN CASE WHEN has THEN 'PARTIAL' ELSE 'FAILED' END WHEN has THEN CASE WHEN ns OR nd THEN 'PARTIAL' ELSE 'COMPLETED' END WHEN ns AND nd THEN 'FAILED' WHEN ns OR nd THEN 'PARTIAL' ELSE 'EMPTY' END AS status,
 CASE WHEN late THEN 'TIMEOUT' WHEN NOT has AND ns AND nd THEN 'BOTH_CHANNELS_FAILED' WHEN ns THEN 'SPARSE_FAILED' WHEN nd THEN 'DENSE_FAILED' END AS failure_code, evidence FROM x""",
    "structured_lookup": """WITH s AS (SELECT o_custkey AS company, year(o_orderdate) || '-12-31' AS "at", o_orderstatus AS code, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS amount, count(*) AS n FROM orders GROUP BY 1, 2, 3),
a AS (SELECT company, 'field' AS target_type, code, "at", NULL AS v, amount AS value FROM s UNION ALL SELECT company, 'metric', code, "at", 'v1', CAST(n AS DOUBLE) FROM s WHERE n > 1),
r AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 2 = 0 THEN 'field' ELSE 'metric' END AS target_type, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS code, CASE WHEN c_nationkey % 2 = 0 THEN (1995 + c_nationkey % 5) || '-12-31' END AS period, CASE WHEN c_nationkey % 7 = 0 THEN 'v0' END AS version FROM customer),
m AS (SELECT request, min("at") AS "at", arg_min(value, "at") AS value FROM r JOIN a ON a.company = request AND a.target_type = r.target_type AND a.code = r.code WHERE (period IS NULL OR period = "at") AND (version IS NULL OR v IS NULL OR version = v) GROUP BY 1)
SELECT request, CASE WHEN "at" IS NULL THEN target_type || '_unavailable' ELSE 'available' END AS state, "at" AS period, value FROM r LEFT JOIN m USING (request)""",
    "section_issues": f"WITH {_RULES}\nSELECT section_id, rule_id, severity, location, count(*) AS n FROM issues GROUP BY ALL",
    "section_verdicts": f"""WITH {_RULES}
SELECT s.section_id, count(*) FILTER (severity = 'blocking') AS blocking, count(*) FILTER (severity = 'rework') AS rework, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity IN ('blocking', 'rework')) = 0 AS passed
FROM sections s LEFT JOIN issues i ON i.section_id = s.section_id GROUP BY 1""",
    "industry_policy": f"""WITH {_sql('sections', 'section_refs')},
x AS (SELECT section_id AS claim_id, grade, host, published, published <= DATE '1998-06-30' AND published >= DATE '1998-06-30' - INTERVAL 365 DAY AS fresh FROM section_refs WHERE ref_type = 'external'),
a AS (SELECT claim_id, {_GRADES}, count(*) AS n, count(*) FILTER (published IS NULL) AS undated FROM x GROUP BY 1),
b AS (SELECT claim_id, {_GRADES} FROM x WHERE fresh GROUP BY 1)
SELECT section_id AS claim_id, CASE WHEN a.n IS NULL THEN NULL WHEN section_id % 3 = 0 AND undated = a.n THEN 'strong_timepoint_published_at_unknown' WHEN section_id % 3 = 0 AND NOT coalesce(b.ab > 0 OR b.c >= 2, false) THEN 'strong_timepoint_source_insufficient'
 WHEN section_id % 3 <> 0 AND section_id % 2 = 0 AND NOT (a.ab > 0 OR a.c >= 2) THEN 'insufficient_industry_sources' END AS removed_for
FROM sections LEFT JOIN a ON a.claim_id = section_id LEFT JOIN b ON b.claim_id = section_id""",
    "publication_status": f"""WITH {_SECTION_PARTS},
r AS (SELECT section_id, CASE WHEN state IN ('WAITING_HUMAN', 'CONFLICT') THEN 'unresolved_' || state WHEN len(effects) > 0 THEN 'unresolved_blocking' WHEN core THEN 'unresolved_core_impact' END || ':' || coalesce(question_id, unresolved_id) AS reason FROM section_gaps
 UNION SELECT section_id, 'excluded_self_invented_scheme:' || claim_id FROM section_claims WHERE derived AND impact
 UNION SELECT section_id, 'status=' || status FROM sections WHERE status IN ('WAITING_HUMAN', 'SECTION_BLOCKED', 'FAILED')
 UNION SELECT section_id, 'decision=' || decision FROM sections WHERE decision IN ('BLOCKED', 'PASS_WITH_GAPS') OR decision = 'REWORK' AND NOT rules_passed
 UNION SELECT section_id, 'conflict' FROM sections WHERE conflict)
SELECT s.section_id, CASE WHEN count(reason) > 0 THEN 'BLOCKED' ELSE 'READY' END AS status, count(reason) AS reasons FROM sections s LEFT JOIN r ON r.section_id = s.section_id GROUP BY 1""",
    "edited_sections": f"""WITH {_SECTION_PARTS},
c AS (SELECT section_id, claim_id, list(ref_type || place ORDER BY place, ref_type) AS xs FROM section_refs GROUP BY 1, 2),
j AS (SELECT s.*, coalesce(array_to_string(xs[1:3], '；') || CASE WHEN len(xs) > 3 THEN ' 等 ' || len(xs) || ' 项' ELSE '' END, '') AS cites FROM section_claims s LEFT JOIN c USING (section_id, claim_id)),
p AS (SELECT section_id, topic_id, min(claim_id) AS seen, string_agg(text, '' ORDER BY claim_id) AS body, string_agg(cites, chr(10) ORDER BY claim_id) AS citations FROM j GROUP BY 1, 2)
SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY place NULLS LAST, seen, topic_id) AS paragraph, topic_id, coalesce(title, topic_id) AS title, body, citations FROM p LEFT JOIN (SELECT * FROM topics WHERE place > 0) USING (section_id, topic_id)""",
    "rework_merge": f"""WITH {_SECTION_PARTS},
a AS (SELECT g.section_id, q.question_id FROM section_gaps g JOIN questions q ON q.section_id = g.section_id AND q.topic_id = g.topic_id WHERE state = 'CONFLICT'
 UNION SELECT section_id, question_id FROM section_gaps WHERE state = 'WAITING_HUMAN'
 UNION SELECT g.section_id, unnest(question_ids) FROM section_gaps g JOIN (SELECT * FROM section_claims QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY CAST(claim_id AS BIGINT)) = 1) c ON c.section_id = g.section_id WHERE state = 'NOT_FOUND_AFTER_SEARCH'),
k AS (SELECT * FROM a WHERE (section_id, question_id) IN (SELECT section_id, question_id FROM questions)),
m AS (SELECT section_id, 'parent' AS o FROM section_claims c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.section_id = c.section_id AND k.question_id IN (c.q1, c.q2)) UNION ALL SELECT section_id, 'rework' FROM k)
SELECT section_id, count(*) FILTER (o = 'parent') AS kept, count(*) FILTER (o = 'rework') AS fresh FROM m GROUP BY 1""",
}
