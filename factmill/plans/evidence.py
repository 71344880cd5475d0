"""Queries of the retrieval, document and history operators, and the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factmill.functions import columns as C
from factmill.operators import documents as dx
from factmill.operators import history as hx
from factmill.operators import retrieval as rx

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(C.tokens(F.col("text"))).alias("term"))
    return rx.bm25(_t(spark, sf_dir, "documents"), queries, "doc_id", C.tokens(F.col("text"))).withColumn("score", F.round("score", 6))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark text."""
    return rx.ranked(_bm25(spark, sf_dir), 10)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second channel: how many distinct query tokens a document holds."""
    queries = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(C.tokens(F.col("text")))).alias("term"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(C.tokens(F.col("text")))).alias("term"))
    return rx.ranked(docs.join(queries, "term").groupBy("query", "doc").agg(F.count("*").alias("score")), 10)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rx.fuse({"sparse": bm25(spark, sf_dir), "cover": coverage(spark, sf_dir)})
    return out.select("query", "doc", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), F.col("rank_sparse").cast("long").alias("rank_sparse"), F.col("rank_cover").cast("long").alias("rank_cover"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows, itself among them, of each vector whose id is divisible by 50."""
    e = _t(spark, sf_dir, "embeddings").where("embedding is not null")
    found = rx.dense(e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 10)
    return found.select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    gold = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") % 2).alias("grp"), F.col("l_partkey").alias("page"))
    found = lines.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("page"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("rank"))
    return rx.case_scores(gold, found, 3)


def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir).join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("priority")), "case_id")
    return rx.macro(cases, ["priority"]).select("priority", "n", *(F.round(c, 6).alias(c) for c in ("page_hit", "all_groups", "coverage", "precision", "mrr")))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles of balances by nation."""
    return _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.expr("round(percentile(c_acctbal, 0.5), 6)").alias("p50"),
        F.expr("round(percentile(c_acctbal, 0.95), 6)").alias("p95"),
        F.expr("percentile_disc(0.95) within group (order by c_acctbal)").alias("p95_rank"),
    )


#: Texts and URLs that the tables lack, in words that both engines read.
GRADED_URL = "CASE page_id % 5 WHEN 0 THEN concat('https://www.csrc.gov.cn/', CAST(page_id AS STRING)) WHEN 1 THEN concat('http://news', CAST(page_id % 3 AS STRING), '.10jqka.com.cn/a') WHEN 2 THEN 'https://static.cninfo.com.cn/x' WHEN 3 THEN 'http://notsina.com.cn/' ELSE url END"
GRADE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in of) + f" THEN '{g}'" for g, of in C.HOST_GRADES.items()) + " ELSE 'D' END"
PAGE = "CASE WHEN l_partkey % 4 = 0 THEN concat(' Report ', l_returnflag) ELSE concat('Report  ', l_returnflag, chr(10), chr(10), 'body ', CAST(l_partkey AS STRING), chr(10), 'page ', l_linestatus) END"
NUMBERED = """CASE p_partkey % 10 WHEN 0 THEN concat('第', '三节：', p_name) WHEN 1 THEN concat('二、', p_type) WHEN 2 THEN concat('（一） ', p_name) WHEN 3 THEN concat(CAST(p_size AS STRING), ' ', p_brand) WHEN 4 THEN concat('1.2.', CAST(p_size AS STRING), ' ', p_name)
 WHEN 5 THEN '2024年 概述' WHEN 6 THEN concat('12亿 ', p_name) WHEN 7 THEN '第一章' WHEN 8 THEN concat('一、', p_name, ' ', p_type, ' ', p_brand, ' ', p_name) ELSE p_name END"""


def source_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host grade, some of them moved to graded hosts."""
    p = _t(spark, sf_dir, "pages").select(F.expr(GRADED_URL).alias("url")).select(C.host(F.col("url")).alias("host"), C.host_grade(F.col("url")).alias("grade"))
    return p.groupBy("host", "grade").agg(F.count("*").alias("n"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(C.main_text(F.col("html")), 256).alias("text_hash"), F.length(C.main_text(F.col("html"))).cast("long").alias("n"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(dx.chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return d.select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("n"), C.content_hash(F.col("chunk")).alias("content_hash"))


def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as pages; some have one line only."""
    return dx.page_furniture(_t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS source", f"{PAGE} AS text"), "source", "text")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of parts, numbered in all ways."""
    lines = _t(spark, sf_dir, "part").selectExpr("p_partkey", f"{NUMBERED} AS line")
    return dx.headings(lines).select("p_partkey", "level", "title")


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    out = dx.carried(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase")
    return out.select("event_id", "last_purchase")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return dx.neighbours(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2, 3).select("user_id", "event_id", "anchor_at", F.col("distance").cast("long").alias("distance"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dx.runs(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return e.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return hx.head(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, the value of the user's latest purchase until then."""
    e = _t(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("bought"))
    return hx.on_or_before(e.where("event_type = 'error'").select("user_id", "ts", "event_id"), buys, "user_id", "ts", "bought").select("event_id", "bought")


def backward_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return hx.backward_steps(e, ["user_id"], ["ts", "event_id"], "event_type", {"signup": 0, "view": 1, "click": 2, "purchase": 3}).select("user_id", "event_id", "event_type")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each of a user's stages, and the final state by precedence."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    last = hx.head(e, ["user_id", "event_type"], ["ts", "event_id"])
    state = F.when(F.max((F.col("event_type") == "error") & (F.col("value") > 20)), "FAILED").when(F.count_if(F.col("event_type") == "purchase") == 0, "WAITING").otherwise("COMPLETED")
    return last.groupBy("user_id").agg(state.alias("state"), F.count("*").alias("stages"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    old = o.where("o_orderdate < timestamp '1998-01-01 00:00:00'").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderdate >= timestamp '1997-01-01 00:00:00'").select("o_orderkey", F.when(F.col("o_totalprice") > 150_000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    return hx.conflicts(new, old, ["o_orderkey"], ["o_orderstatus", "o_custkey"]).groupBy("verdict").agg(F.count("*").alias("n"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content, white space aside."""
    d = _t(spark, sf_dir, "documents").select(C.content_hash(F.col("text")).alias("content_hash"), "doc_id", "source")
    return hx.first_by(d, ["content_hash"], ["doc_id"])


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return hx.fingerprint(c, ["c_nationkey"], F.col("c_custkey").cast("string"), F.sha2(F.col("c_name"), 256))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", C.coordinates_id(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_size")).alias("id"), C.canonical_pairs({"size": F.col("p_size"), "brand": F.col("p_brand")}).alias("pairs"))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as claims derived from the part of half their number; those of some brands are adopted."""
    p = _t(spark, sf_dir, "part")
    edges = p.select("p_partkey", F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return hx.closure(edges, "p_partkey", "parent", p.where("p_size < 10"), "p_partkey")


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return hx.quotas(c, "c_mktsegment", "c_custkey", 97)


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders."""
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts shipped and never returned, per supplier."""
    lines = _t(spark, sf_dir, "lineitem")
    both = lines.select("l_suppkey", "l_partkey").distinct().subtract(lines.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey"))
    return both.groupBy("l_suppkey").agg(F.count("*").alias("n"))


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.where(C.any_keyword(F.col("text"), ["license", "token = ", "thhe"])).groupBy("lang").agg(F.count("*").alias("n"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in several ways, read back exactly, with their least step and a readable form."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("("), F.col("price").cast("string"), F.lit(")"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("1,"), F.lpad(F.floor("price").cast("string"), 4, "0"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.col("price").cast("string"), F.lit("%"))).otherwise(F.col("price").cast("string"))
    t = p.select("p_partkey", text.alias("text"))
    return t.select("p_partkey", "text", C.amount(F.col("text")).cast("double").alias("amount"), F.round(C.display_increment(F.col("text")), 6).alias("step"))


def header_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    y = F.date_format("o_orderdate", "yyyy")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(k == 1, F.concat(y, F.lit("年"), F.date_format("o_orderdate", "M"), F.lit("月"))).when(k == 2, F.concat(y, F.lit("Q"), F.quarter("o_orderdate").cast("string"))).when(k == 3, F.concat(y, F.lit("H1"))).otherwise(F.concat(F.lit("FY "), y))
    return o.select("o_orderkey", text.alias("text")).select("o_orderkey", "text", C.header_period(F.col("text")).cast("string").alias("period"), C.period_type(C.header_period(F.col("text"))).alias("kind"))


def pair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order, each with the next: same part, same period, relation of values."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("l_partkey", "l_shipdate", "l_quantity")), "l_partkey", "l_shipdate", "l_quantity").where("next_l_partkey is not null")
    relation = F.when(F.col("l_quantity") < F.col("next_l_quantity"), "increased").when(F.col("l_quantity") > F.col("next_l_quantity"), "decreased").otherwise("unchanged")
    return lines.select("l_orderkey", "l_linenumber", (F.col("l_partkey") == F.col("next_l_partkey")).alias("same_part"), (F.year("l_shipdate") == F.year("next_l_shipdate")).alias("same_period"), relation.alias("relation"))


def statement_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' revenue by region and year: the four-way chain of keys."""
    r, n, c, o = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


QUERIES = {
    "bm25_topk": bm25, "token_coverage": coverage, "rrf_fusion": fused, "dense_topk": dense, "case_scores": case_scores, "macro_scores": macro_scores, "percentiles": percentiles,
    "source_grades": source_sufficiency, "main_text": main_text, "chunker": chunked, "page_furniture": page_furniture, "headings": headings, "fill_forward": carried, "neighbours": neighbours,
    "same_runs": runs, "log_heads": heads, "as_of_latest": as_of, "backward_steps": backward_steps, "progress_fold": progress, "reuse_verdicts": conflicts, "content_dedup": content_dedup,
    "fingerprints": fingerprints, "coordinate_ids": coordinates, "derived_closure": closure, "stratified_quotas": quotas, "anti_join": anti_join, "set_difference": set_difference,
    "keyword_filter": keyword_filter, "amount_parse": amounts, "header_periods": header_periods, "pair_relation": pair_compare, "statement_join": statement_join,
}

_TOK = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:\\.[0-9]+)?%?'), lambda x: lower(x))"
_BM = f"""d AS (SELECT doc_id AS doc, {_TOK} AS w FROM documents), st AS (SELECT count(*) AS n, greatest(avg(len(w)), 1e-9) AS av FROM d),
tf AS (SELECT doc, len(w) AS dl, t AS term, count(*) AS tf FROM (SELECT doc, w, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id AS query, t AS term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS t FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT query, doc, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
br AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM b QUALIFY rank <= 10)"""
_CV = """cv AS (SELECT query, doc, count(*) AS score FROM (SELECT DISTINCT doc, term FROM tf) JOIN (SELECT DISTINCT query, term FROM q) USING (term) GROUP BY 1, 2),
cr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM cv QUALIFY rank <= 10)"""
_CASES = """g AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber % 2 AS grp, l_partkey AS page FROM lineitem WHERE l_linestatus = 'O'),
f AS (SELECT case_id, page, min(rank) AS rank FROM (SELECT l_orderkey AS case_id, l_partkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem WHERE l_returnflag <> 'A') WHERE rank <= 3 GROUP BY 1, 2),
j AS (SELECT g.*, f.rank FROM g LEFT JOIN f USING (case_id, page)),
gr AS (SELECT case_id, bool_and(hit) AS all_groups FROM (SELECT case_id, grp, bool_or(rank IS NOT NULL) AS hit FROM j GROUP BY 1, 2) GROUP BY 1),
sz AS (SELECT case_id, count(*) AS n_top FROM f GROUP BY 1),
cs AS (SELECT case_id, page_hit, all_groups, found * 1.0 / pages AS coverage, coalesce(found * 1.0 / n_top, 0.0) AS precision, rr FROM
 (SELECT case_id, bool_or(rank IS NOT NULL) AS page_hit, count(DISTINCT CASE WHEN rank IS NOT NULL THEN page END) AS found, count(DISTINCT page) AS pages, coalesce(1.0 / min(rank), 0.0) AS rr FROM j GROUP BY 1) JOIN gr USING (case_id) LEFT JOIN sz USING (case_id))"""
_EV = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"

ORACLE_SQL = {
    "bm25_topk": f"WITH {_BM} SELECT query, doc, score, rank FROM br",
    "token_coverage": f"WITH {_BM}, {_CV} SELECT query, doc, score, rank FROM cr",
    "rrf_fusion": f"""WITH {_BM}, {_CV}, u AS (SELECT coalesce(br.query, cr.query) AS query, coalesce(br.doc, cr.doc) AS doc, br.rank AS rank_sparse, cr.rank AS rank_cover FROM br FULL JOIN cr ON br.query = cr.query AND br.doc = cr.doc),
s AS (SELECT *, coalesce(1.0 / (60 + rank_sparse), 0) + coalesce(1.0 / (60 + rank_cover), 0) AS sc FROM u)
SELECT query, doc, round(CAST(sc AS DOUBLE), 9) AS score, row_number() OVER (PARTITION BY query ORDER BY CAST(sc AS DOUBLE) DESC, doc) AS rank, CAST(rank_sparse AS BIGINT) AS rank_sparse, CAST(rank_cover AS BIGINT) AS rank_cover FROM s""",
    "dense_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query, e.vec_id AS doc, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 9) AS sc FROM e, e q WHERE q.vec_id % 50 = 0)
SELECT query, doc, rank, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sc DESC, doc) AS rank FROM s) WHERE rank <= 10""",
    "case_scores": f"WITH {_CASES} SELECT case_id, page_hit, all_groups, CAST(coverage AS DOUBLE) AS coverage, CAST(precision AS DOUBLE) AS precision, CAST(rr AS DOUBLE) AS rr FROM cs",
    "macro_scores": f"WITH {_CASES} SELECT o_orderpriority AS priority, count(*) AS n, round(avg(CAST(page_hit AS INT)), 6) AS page_hit, round(avg(CAST(all_groups AS INT)), 6) AS all_groups, round(avg(coverage), 6) AS coverage, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS mrr FROM cs JOIN orders ON case_id = o_orderkey GROUP BY 1",
    "percentiles": "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.95), 6) AS p95, quantile_disc(c_acctbal, 0.95) AS p95_rank FROM customer GROUP BY 1",
    "source_grades": f"""WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host FROM (SELECT {GRADED_URL} AS url FROM pages))
SELECT host, {GRADE_SQL} AS grade, count(*) AS n FROM h GROUP BY 1, 2""",
    "main_text": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS t FROM pages)
SELECT page_id, sha256(t) AS text_hash, length(t) AS n FROM t""",
    "page_furniture": rf"""WITH p AS (SELECT l_suppkey AS source, {PAGE} AS text FROM lineitem), l AS (SELECT source, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\n\v\f\r]+', '', 'g')), lambda x: x <> '') AS l FROM p),
e AS (SELECT source AS document, 'header' AS place, l[1] AS line FROM l WHERE len(l) > 0 UNION ALL SELECT source, 'footer', l[-1] FROM l WHERE len(l) > 1), c AS (SELECT document, place, line, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT source AS document, count(*) AS pages FROM p GROUP BY 1) SELECT document, place, line, n FROM c JOIN s USING (document) WHERE n >= greatest(2, floor(pages * 0.2))""",
    "headings": rf"""WITH l AS (SELECT p_partkey, trim({NUMBERED}) AS s FROM part),
h AS (SELECT p_partkey, s, CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN {n}" for p, n in C.HEADINGS)} END AS level, CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN trim(regexp_extract(s, '{p}', 1))" for p, _ in C.HEADINGS)} END AS t FROM l WHERE s <> '' AND length(s) <= 60 AND NOT regexp_matches(s, '{C.NO_HEADING}'))
SELECT p_partkey, level, CASE WHEN length(CASE WHEN t = '' THEN s ELSE t END) > 50 THEN left(CASE WHEN t = '' THEN s ELSE t END, 50) || '…' ELSE CASE WHEN t = '' THEN s ELSE t END END AS title FROM h WHERE level IS NOT NULL""",
    "fill_forward": f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events",
    "neighbours": f"""WITH p AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS at FROM events {_EV}) SELECT p.user_id, p.event_id, a.at AS anchor_at, CAST(p.at - a.at AS BIGINT) AS distance FROM p JOIN p a ON p.user_id = a.user_id AND a.event_type = 'error' AND p.at BETWEEN a.at - 2 AND a.at + 3""",
    "same_runs": f"""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM events {_EV}), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL""",
    "log_heads": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "as_of_latest": "SELECT event_id, (SELECT arg_max(bought, ts) FROM (SELECT user_id, ts, max(value) AS bought FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b WHERE b.user_id = e.user_id AND b.ts <= e.ts) AS bought FROM events e WHERE event_type = 'error'",
    "backward_steps": f"""WITH r AS (SELECT *, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS rank FROM events), b AS (SELECT *, lag(rank) OVER w AS before FROM r {_EV}) SELECT user_id, event_id, event_type FROM b WHERE rank < before""",
    "progress_fold": """WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 20) THEN 'FAILED' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'WAITING' ELSE 'COMPLETED' END AS state, count(*) AS stages FROM l GROUP BY 1""",
    "reuse_verdicts": """WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'X' ELSE o_orderstatus END AS s, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN o.o_orderstatus = n.s THEN 'identical' ELSE 'conflict' END AS verdict, count(*) AS n FROM n LEFT JOIN o USING (o_orderkey) GROUP BY 1""",
    "content_dedup": r"SELECT sha256(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), ' ') || chr(0)) AS content_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "fingerprints": "SELECT c_nationkey, sha256(string_agg(l, chr(10) ORDER BY l)) AS fingerprint, count(*) AS n FROM (SELECT c_nationkey, c_custkey || ':' || sha256(c_name) AS l FROM customer) GROUP BY 1",
    "coordinate_ids": "SELECT p_partkey, substr(sha256(p_partkey || chr(10) || p_name || chr(10) || p_brand || chr(10) || '' || chr(10) || p_size), 1, 32) AS id, 'brand=' || p_brand || ';size=' || p_size AS pairs FROM part",
    "derived_closure": """WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS up FROM part), a AS (SELECT p_partkey AS node FROM part WHERE p_size < 10),
w AS (SELECT node AS start, up AS node FROM e UNION SELECT w.start, e.up FROM w JOIN e ON e.node = w.node WHERE w.node NOT IN (SELECT node FROM a)),
s AS (SELECT DISTINCT start FROM w WHERE node IS NULL OR (node NOT IN (SELECT node FROM a) AND node NOT IN (SELECT node FROM e))) SELECT e.node AS p_partkey, s.start IS NULL AS valid FROM e LEFT JOIN s ON s.start = e.node""",
    "stratified_quotas": """WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT c_mktsegment, n * 97 / (SELECT sum(n) FROM n) AS ex FROM n), b AS (SELECT *, floor(ex) AS base FROM x),
q AS (SELECT c_mktsegment, base + CASE WHEN row_number() OVER (ORDER BY ex - base DESC, c_mktsegment) <= 97 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS place FROM customer) SELECT c_custkey, c_mktsegment FROM p JOIN q USING (c_mktsegment) WHERE place <= quota""",
    "anti_join": "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "set_difference": "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, l_partkey FROM lineitem EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "keyword_filter": "SELECT lang, count(*) AS n FROM documents WHERE contains(text, 'license') OR contains(text, 'token = ') OR contains(text, 'thhe') GROUP BY 1",
    "amount_parse": """WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part),
t AS (SELECT p_partkey, price, CASE p_partkey % 4 WHEN 0 THEN '(' || price || ')' WHEN 1 THEN '1,' || lpad(CAST(floor(price) AS BIGINT)::VARCHAR, 4, '0') WHEN 2 THEN price || '%' ELSE price::VARCHAR END AS text FROM p)
SELECT p_partkey, text, CASE p_partkey % 4 WHEN 0 THEN -CAST(price AS DOUBLE) WHEN 1 THEN CAST(replace(text, ',', '') AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(price AS DOUBLE) END AS amount, CAST(CASE WHEN p_partkey % 4 IN (1, 2) THEN 1.0 ELSE 0.01 END AS DOUBLE) AS step FROM t""",
    "header_periods": """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders),
p AS (SELECT o_orderkey, CASE k WHEN 0 THEN year(d) || '-' || month(d) || '-' || day(d) WHEN 1 THEN year(d) || '年' || month(d) || '月' WHEN 2 THEN year(d) || 'Q' || quarter(d) WHEN 3 THEN year(d) || 'H1' ELSE 'FY ' || year(d) END AS text,
CASE k WHEN 0 THEN d WHEN 1 THEN last_day(d) WHEN 2 THEN last_day(make_date(year(d), quarter(d) * 3, 1)) WHEN 3 THEN make_date(year(d), 6, 30) ELSE make_date(year(d), 12, 31) END AS e FROM t)
SELECT o_orderkey, text, CAST(e AS VARCHAR) AS period, CASE strftime(e, '%m-%d') WHEN '12-31' THEN 'annual' WHEN '06-30' THEN 'interim' WHEN '03-31' THEN 'quarterly' WHEN '09-30' THEN 'quarterly' END AS kind FROM p""",
    "pair_relation": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, lead(l_partkey) OVER w AS np, lead(l_shipdate) OVER w AS ns, lead(l_quantity) OVER w AS nq FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice))
SELECT l_orderkey, l_linenumber, l_partkey = np AS same_part, year(l_shipdate) = year(ns) AS same_period, CASE WHEN l_quantity < nq THEN 'increased' WHEN l_quantity > nq THEN 'decreased' ELSE 'unchanged' END AS relation FROM l WHERE np IS NOT NULL""",
    "statement_join": "SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
