"""Where a question goes: its structured target, its route, its budget, and what its channels return."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions import amounts as ax

# What people call metrics and fields, and the parts of a field that the field itself doesn't answer.
METRICS = {
    "PROF_ROE": ("净资产收益率", "净资产回报率", "股东权益报酬率"),
    "PROF_ROA": ("总资产收益率", "总资产净利率", "资产收益率", "资产净利率"),
    "SOLV_INTEREST_COVER": ("利息覆盖倍数", "利息保障倍数", "已获利息倍数"),
    "EBITDA": ("息税折旧摊销前利润", "息税折旧及摊销前利润"),
    "SOLV_DEBT_RATIO": ("资产负债率",),
    "PROF_GROSS_MARGIN": ("毛利率",),
    "PROF_NET_MARGIN": ("净利率", "销售净利率"),
}
FIELDS = {
    "TOTAL_ASSETS": ("总资产", "资产总额"),
    "TOTAL_LIABILITIES": ("总负债", "负债总额", "负债"),
    "TOTAL_EQUITY": ("净资产", "股东权益", "所有者权益", "权益"),
    "TOTAL_REVENUE": ("营业总收入", "总营收"),
    "OPERATING_REVENUE": ("营收",),
    "NET_PROFIT_PARENT": ("归母净利润", "归母净利", "归属于母公司股东的净利润"),
    "OPERATING_CASH_FLOW": ("经营活动现金流", "经营现金流", "经营活动现金流量"),
    "CURRENT_ASSETS": ("流动资产",),
    "CURRENT_LIABILITIES": ("流动负债",),
    "CASH_AND_EQUIVALENTS": ("货币资金",),
    "FIXED_ASSETS": ("固定资产",),
}
PARTS = {
    "CASH_AND_EQUIVALENTS": ("受限资金", "受限货币资金", "受限", "保证金", "质押"),
    "FIXED_ASSETS": ("机器设备", "设备净值", "房屋及建筑物", "房屋建筑物", "运输设备", "电子设备", "专用设备", "办公设备"),
}
# The words by which a question is routed.
EXTERNAL = ("市值", "股价", "行情", "涨跌", "市盈率", "市净率", "新闻", "处罚", "监管", "政策", "评级", "研报", "融资余额", "北向资金", "最新公告", "股价表现", "股价走势", "收购", "并购", "重组", "排名")
RECENT = ("最新", "近期", "最近", "当前", "截至", "目前", "实时", "今日", "现阶段")
DEEP = ("变化", "同比", "环比", "趋势", "演变", "对比", "比较", "相比", "差异", "变动", "过程", "历年", "近三年", "近五年", "是否一致", "核对", "复核", "矛盾", "穿透", "关联方", "关联关系", "控制链", "原因", "为什么", "如何变化", "多期", "多个年度", "三年", "五年")
DIRECT = ("是多少", "是谁", "何时", "几位", "哪家", "什么时间", "哪一年", "哪年", "多少", "股票代码", "代码", "几家", "哪些子公司", "哪一家", "什么时候")
SYNTHESIS = ("如何", "哪些", "方面", "历程", "格局", "战略", "计划", "优势", "地位", "现状", "情况", "分析", "评价", "影响", "概述", "特点", "模式", "竞争", "风险", "发展历程", "核心竞争力", "业务发展", "结构", "规划", "布局")
AUDIT = ("审计意见", "无保留意见", "保留意见", "否定意见", "无法表示意见", "强调事项", "关键审计事项", "会计师事务所", "审计结论")
LOCAL = ("annual_report", "company_industry", "prospectus", "announcement", "structured_db")
# Candidates of either channel, fused and kept hits, and milliseconds, by route.
BUDGETS = {"DIRECT_EVIDENCE": (10, 10, 10, 10, 5000), "DEEP_RETRIEVAL": (40, 40, 40, 10, 5000), "STANDARD_RAG": (20, 20, 20, 10, 5000)}
NO_BUDGET = (1, 1, 1, 1, 1000)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def plain(text: Column) -> Column:
    """Half width, lower case, without white space."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), wide, "".join(chr(c) for c in range(0x21, 0x7F)))), r"[\s\x{3000}]+", "")


def _spans(q: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """Every occurrence of every name, overlapping ones too: (start, stop, code)."""
    pairs = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(code).alias("code")) for code, aliases in names.items() for a in aliases))
    hits = F.filter(pairs, lambda p: F.contains(q, p["alias"]))
    places = lambda p: F.filter(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), lambda i: F.substring(q, i, F.length(p["alias"])) == p["alias"])
    return F.flatten(F.transform(hits, lambda p: F.transform(places(p), lambda i: F.struct(i.alias("start"), (i + F.length(p["alias"])).alias("stop"), p["code"].alias("code")))))


def _codes(spans: Column) -> Column:
    """The codes of those spans that no other one holds."""
    outer = F.filter(spans, lambda s: ~F.exists(spans, lambda o: (o["start"] <= s["start"]) & (s["stop"] <= o["stop"]) & ((o["start"] != s["start"]) | (o["stop"] != s["stop"]) | (o["code"] != s["code"]))))
    return F.array_distinct(F.transform(outer, lambda s: s["code"]))


def db_target(questions: DataFrame, text: str) -> DataFrame:
    """Adds target_type and target_code. Metrics go before fields: a question that names metrics never falls back to a field,
    even if it names several. A field isn't the answer to a question about one of its parts."""
    q = questions.withColumn("_q", plain(F.col(text))).withColumn("_m", _spans(F.col("_q"), METRICS)).withColumn("_f", _spans(F.col("_q"), FIELDS))
    q = q.withColumn("_mc", _codes(F.col("_m"))).withColumn("_fc", _codes(F.col("_f")))
    blocked = reduce(lambda a, b: a | b, ((F.col("_fc")[0] == code) & any_of(F.col("_q"), words) for code, words in PARTS.items()))
    metric, field = F.size("_mc") == 1, (F.size("_m") == 0) & (F.size("_fc") == 1)
    field = field & ~F.when(F.size("_fc") == 1, blocked).otherwise(False)
    kind = F.when(metric, "metric").when(field, "field")
    return q.withColumn("target_type", kind).withColumn("target_code", F.when(metric, F.col("_mc")[0]).when(field, F.col("_fc")[0])).drop("_q", "_m", "_f", "_mc", "_fc")


def routed(needs: DataFrame, question: str, scope: str, report: str, types: str, sources: str) -> DataFrame:
    """Adds the route and its reason: an audit field first; a time scope that can't be read, and a structured target that is asked
    for with an outside source or as of now, fall back; then outside sources, comparisons, structured targets, single facts and
    the rest. Mixed needs ask outside and inside."""
    n = db_target(needs, question)
    q = F.coalesce(question, F.lit(""))
    given = F.coalesce(F.col(scope), F.lit("")) != ""
    unread = given & ax.canonical_period(F.col(scope)).isNull()
    required = F.coalesce(F.array_contains(types, "web"), F.lit(False)) | F.coalesce(F.array_contains(sources, "external"), F.lit(False))
    outside = any_of(q, EXTERNAL) | (given & ax.late_scope(F.col(scope), F.col(report))) | required
    db = F.col("target_type").isNotNull()
    deep = any_of(q, DEEP)
    reason = (
        F.when(any_of(q, AUDIT), "AUDIT_OPINION_FIELD")
        .when(unread, "TIME_SCOPE_UNPARSEABLE")
        .when(db & (outside | any_of(q, RECENT)), "DB_EXTERNAL_CONFLICT")
        .when(outside, "EXPLICIT_EXTERNAL_RECENCY")
        .when(deep, "CROSS_DOCUMENT_OR_CONFLICT")
        .when(F.col("target_type") == "field", "REGISTERED_DB_FIELD")
        .when(db, "REGISTERED_FINANCIAL_METRIC")
        .when(any_of(q, DIRECT) & ~any_of(q, SYNTHESIS), "EXACT_DOCUMENT_FIELD")
        .otherwise("SECTION_TOPIC_SYNTHESIS")
    )
    # The route of each reason.
    route = {
        "AUDIT_OPINION_FIELD": "DIRECT_EVIDENCE",
        "TIME_SCOPE_UNPARSEABLE": "FALLBACK",
        "DB_EXTERNAL_CONFLICT": "FALLBACK",
        "EXPLICIT_EXTERNAL_RECENCY": "EXTERNAL_RESEARCH",
        "CROSS_DOCUMENT_OR_CONFLICT": "DEEP_RETRIEVAL",
        "REGISTERED_DB_FIELD": "DB_LOOKUP",
        "REGISTERED_FINANCIAL_METRIC": "DB_LOOKUP",
        "EXACT_DOCUMENT_FIELD": "DIRECT_EVIDENCE",
        "SECTION_TOPIC_SYNTHESIS": "STANDARD_RAG",
    }
    names = F.create_map(*(F.lit(x) for pair in route.items() for x in pair))
    local = F.coalesce(F.exists(sources, lambda s: s.isin(*LOCAL)), F.lit(False)) | deep
    out = n.withColumn("reason", reason).withColumn("route", names[F.col("reason")]).withColumn("mixed", required & local)
    return out.withColumn("budget", budget(F.col("route")))


def budget(route: Column) -> Column:
    shape = lambda b: F.struct(*(F.lit(v).alias(k) for k, v in zip(("sparse", "dense", "fused", "kept", "timeout_ms"), b, strict=True)))
    out = shape(NO_BUDGET)
    for name, b in BUDGETS.items():
        out = F.when(route == name, shape(b)).otherwise(out)
    return out


def hybrid(needs: DataFrame, hits: DataFrame, failures: DataFrame, fused: int, kept: int) -> DataFrame:
    """One row per need: status, failure code and evidence (id, score, ranks by channel), from the hits (need, channel, id, rank)
    and the failures (need, channel; channel TIMEOUT if the time ran out) of its two channels.

    Ranks fuse by 1 / (60 + rank); the best `fused` are kept, `kept` of them returned.
    """
    score = F.sum(F.lit(1.0) / (F.lit(60) + F.col("rank")))
    one = hits.groupBy("need", "id").agg(score.alias("score"), F.min(F.when(F.col("channel") == "sparse", F.col("rank"))).alias("sparse"), F.min(F.when(F.col("channel") == "dense", F.col("rank"))).alias("dense"))
    order = Window.partitionBy("need").orderBy(F.col("score").desc(), "id")
    top = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(fused, kept))
    found = top.groupBy("need").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "sparse", "dense"))).alias("evidence"))
    bad = failures.groupBy("need").agg(F.bool_or(F.col("channel") == "TIMEOUT").alias("late"), F.bool_or(F.col("channel") == "sparse").alias("no_sparse"), F.bool_or(F.col("channel") == "dense").alias("no_dense"))
    out = needs.join(found, "need", "left").join(bad, "need", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    late, any_, both, some = yes("late"), yes("no_sparse") | yes("no_dense"), yes("no_sparse") & yes("no_dense"), F.col("evidence").isNotNull()
    first = F.when(yes("no_sparse"), "SPARSE_FAILED").when(yes("no_dense"), "DENSE_FAILED")
    status = F.when(late, F.when(some, "PARTIAL").otherwise("FAILED")).when(some, F.when(any_, "PARTIAL").otherwise("COMPLETED")).when(any_, F.when(both, "FAILED").otherwise("PARTIAL")).otherwise("EMPTY")
    code = F.when(late, "TIMEOUT").when(~some & both, "BOTH_CHANNELS_FAILED").otherwise(first)
    return out.select("need", status.alias("status"), code.alias("failure_code"), "evidence")


def structured_lookup(requests: DataFrame, items: DataFrame, metrics: DataFrame, available: list[str]) -> DataFrame:
    """The field or metric that each request (request, company, target_type, code, period or null, version or null) names, in its
    company's current snapshot: the earliest period that fits. Fields need an amount, metrics an available status."""
    field = items.where("amount is not null").select("company", F.lit("field").alias("target_type"), "code", F.col("period").alias("at"), F.lit(None).cast("string").alias("of_version"), F.col("amount").alias("value"))
    metric = metrics.where(F.col("status").isin(*available)).select("company", F.lit("metric").alias("target_type"), "code", F.col("period").alias("at"), F.col("version").alias("of_version"), "value")
    met = requests.join(field.unionAll(metric), ["company", "target_type", "code"], "left")
    fits = F.col("at").isNotNull() & (F.col("period").isNull() | (F.col("period") == F.col("at"))) & (F.col("version").isNull() | F.col("of_version").isNull() | (F.col("version") == F.col("of_version")))
    best = met.groupBy("request", "target_type").agg(F.min_by(F.struct("at", "value"), F.when(fits, F.col("at"))).alias("x"), F.bool_or(fits).alias("found"))
    state = F.when(F.col("found"), "available").otherwise(F.concat("target_type", F.lit("_unavailable")))
    return best.select("request", state.alias("state"), F.when(F.col("found"), F.col("x.at")).alias("period"), F.when(F.col("found"), F.col("x.value")).alias("value"))
