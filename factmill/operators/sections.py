"""Sections of a report: the rules that judge their claims, the sources that claims may rest on, status, text and rework."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that the rules look for.
NOT_FOUND = ("未发现", "未检索到", "未找到", "未查到", "查无")
ABSENT = ("不存在", "未发生")
HEDGES = ("预计", "推测", "预测", "估计", "大概率", "或可", "倾向认为", "判断为")
ADVICE = ("建议", "拟", "应予", "应授", "应给予")
TERMS = ("授信额度", "授信", "额度", "期限", "担保", "增信", "评级", "利率", "抵押率")
STANDING = ("现有", "目前", "存量", "截至", "当前", "已获批", "已取得")
EXACT = ("精确", "确切", "精确值", "准确", "权威精确")
STOPPED = ("SECTION_BLOCKED", "JOB_BLOCKED")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


#: Rules by severity; an issue holds its rule's number, counted over all three.
BLOCKING = ("blocking_policy_mismatch", "conflict_unresolved", "waiting_human", "status_not_blocked", "empty_section")
REWORK = (
    "coverage_missing_topic",
    "coverage_missing_question",
    "citation_unresolvable",
    "financial_unresolvable_value",
    "financial_value_mismatch",
    "proxy_claimed_exact",
    "claim_missing_citation",
    "d_source_sole_basis",
    "unfound_claimed_absent",
    "absence_contradicts_gap",
    "calculation_missing_structured",
    "fact_hedged",
    "dimension_mismatch",
    "empty_shell_claim",
    "self_invented_scheme",
)
WARNING = ("aspect_uncovered", "citation_authority_unavailable", "external_missing_date", "single_c_source")
RULES = BLOCKING + REWORK + WARNING
SEVERITIES = {"blocking": BLOCKING, "rework": REWORK, "warning": WARNING}


def _rule(name: str) -> Column:
    return F.lit(RULES.index(name))


def _broken(rules: dict[str, Column]) -> Column:
    """The numbers of the rules whose condition holds."""
    return F.array_remove(F.array(*(F.when(bad, _rule(name)).otherwise(-1) for name, bad in rules.items())), -1)


def _issue(rule: Column, location: Column) -> Column:
    return F.struct(rule.alias("rule"), location.alias("location"))


def section_parts(sections: DataFrame, topics: DataFrame, questions: DataFrame, claims: DataFrame, refs: DataFrame, unresolved: DataFrame) -> DataFrame:
    """A table of each kind as the rows that `judged` takes, dealt out by section."""
    asked = F.struct("question_id", "policy", "aspects")
    contract = lambda t, q: F.struct(t.cast("array<string>").alias("topics"), q.cast("array<struct<question_id: string, policy: array<string>, aspects: array<string>>>").alias("questions")).alias("contract")
    rows = (
        sections.select("section_id", F.struct("status", "markdown").alias("section")),
        topics.select("section_id", contract(F.array("topic_id"), F.array())),
        questions.select("section_id", contract(F.array(), F.array(asked))),
        claims.select("section_id", "claim_id", F.struct("topic_id", "question_ids", "claim_type", "text", "impact", "derived").alias("claim")),
        refs.select("section_id", "claim_id", F.array(F.struct("ref_type", "snapshot_id", "reason", "known", "display", "proxy", "dated", "grade")).alias("refs")),
        unresolved.select("section_id", F.struct("unresolved_id", "question_id", "topic_id", "state", "effects").alias("gap")),
    )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).repartition("section_id")


def judged(parts: DataFrame) -> DataFrame:
    """Each section_id with its rows of sections and its issues, an array (rule, location) of every breach of every rule.

    Parts are rows (section_id, section, contract, claim_id, claim, refs, gap), each with any of these: a section, topics and
    questions of its contract, a claim, references of the claim named (null ones are none), an open question. All of a section's are judged where
    they meet, so nothing is shuffled if rows come dealt out by section_id.

    Blocking: open questions whose effects differ from their policy, conflicts, waits for a person, a status that hides a block,
    an empty section. Rework: topics and questions without an answer, claims without support, values that are not the
    authority's, absence claimed for what was not found, hedged facts, mixed snapshots, advice on credit. Warnings: aspects that
    no claim names, sources without a date or of the third grade only.
    """
    is_ = lambda c: F.coalesce(c, F.lit(False))
    no = lambda c: ~is_(c)
    # what all rows of a claim hold meets at its key; an absent key meets nothing
    keyed = F.col("section_id").isNotNull() & F.col("claim_id").isNotNull()
    together = F.flatten(F.collect_list("refs").over(Window.partitionBy("section_id", "claim_id")))
    met = parts.withColumn("refs", F.when(keyed, together)).withColumn("refs", F.coalesce(F.filter("refs", lambda r: r.isNotNull()), F.array()))
    sums = lambda r: r["ref_type"] == "structured"
    snapshots = F.transform(F.filter("refs", sums), lambda r: r["snapshot_id"])
    grades = F.transform(F.filter("refs", lambda r: (r["ref_type"] == "external") & r["grade"].isNotNull()), lambda r: r["grade"])
    raw, kind = F.col("claim.text"), F.col("claim.claim_type")
    text, cited = F.coalesce(raw, F.lit("")), F.size("refs") > 0
    met = met.withColumns({"snapshots": snapshots, "grades": grades, "exact": holds(raw, EXACT)})
    sole = lambda g: is_(F.col("claim.impact") & (F.array_min("grades") == g) & (F.array_max("grades") == g))
    each = F.transform(
        "refs",
        lambda r: _broken(
            {
                "citation_unresolvable": r["reason"] != "authority_unavailable",
                "financial_unresolvable_value": sums(r) & no(r["known"]),
                "financial_value_mismatch": sums(r) & r["known"] & (r["display"] != "") & ~F.contains(raw, r["display"]),
                "proxy_claimed_exact": F.col("exact") & sums(r) & r["known"] & r["proxy"],
                "external_missing_date": (r["ref_type"] == "external") & no(r["dated"]),
            }
        ),
    )
    own = _broken(
        {
            "claim_missing_citation": kind.isin("fact", "calculation") & ~cited & ~F.col("claim.derived"),
            "d_source_sole_basis": sole("D"),
            "single_c_source": sole("C"),
            "unfound_claimed_absent": (kind == "fact") & holds(text, NOT_FOUND),
            "calculation_missing_structured": (kind == "calculation") & no(F.exists("refs", sums)),
            "fact_hedged": (kind == "fact") & holds(text, HEDGES),
            "dimension_mismatch": F.array_min("snapshots") < F.array_max("snapshots"),
            "empty_shell_claim": F.length(F.trim(text)) < 2,
            "self_invented_scheme": holds(text, ADVICE) & holds(text, TERMS) & ~(cited & holds(text, STANDING)),
        }
    )
    unable = F.transform(F.filter("refs", lambda r: r["reason"] == "authority_unavailable"), lambda r: r["ref_type"])
    said = F.struct("claim.topic_id", F.coalesce("claim.question_ids", F.array()).alias("asked"), raw.alias("text"), holds(text, ABSENT).alias("absent"), F.concat(F.lit("claim:"), F.col("claim_id").cast("string")).alias("at"), F.concat(own, F.flatten(each)).alias("rules"), unable.alias("unable"))
    whole = (
        met.select("section_id", "section", "contract", "gap", F.when(F.col("claim").isNotNull(), said).alias("claim"))
        .groupBy("section_id")
        .agg(F.collect_list("section").alias("sections"), F.collect_list("contract").alias("contracts"), F.collect_list("claim").alias("claims"), F.collect_list("gap").alias("gaps"))
    )
    # what the section's parts say about it; parts without a section_id belong to none
    here = F.col("section_id").isNotNull()
    of = lambda list_, name: F.transform(list_, lambda x: x[name])
    unfound = F.filter("gaps", lambda g: g["state"] == "NOT_FOUND_AFTER_SEARCH")
    whole = whole.select(
        "*",
        F.flatten(of("contracts", "topics")).alias("topics"),
        F.flatten(of("contracts", "questions")).alias("questions"),
        F.concat(of("claims", "topic_id"), of("gaps", "topic_id")).alias("told"),
        F.concat(F.flatten(of("claims", "asked")), of("gaps", "question_id")).alias("answered"),
        of(unfound, "question_id").alias("missing"),
        F.array_max(F.transform("gaps", lambda g: F.exists(g["effects"], lambda e: e.isin(*STOPPED)))).alias("stops"),
    )
    where = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    within = lambda list_, x: is_(here & F.array_contains(list_, x))
    stops, none = here & F.col("stops"), ~here | ((F.size("claims") == 0) & F.col("stops").isNull())
    # an open question meets each of the contract's by its id, or else no policy
    nothing = F.array().cast("array<string>")
    policies = F.transform("gaps", lambda g: F.struct(g.alias("gap"), of(F.filter("questions", lambda q: here & (q["question_id"] == g["question_id"])), "policy").alias("policies")))
    policies = F.transform(policies, lambda x: x.withField("policies", F.when(F.size(x["policies"]) == 0, F.array(nothing)).otherwise(x["policies"])))
    times = lambda x: F.size(F.filter(x["policies"], lambda p: x["gap"]["effects"] != F.coalesce(p, nothing)))
    state = lambda x: _broken({"conflict_unresolved": x["gap"]["state"] == "CONFLICT", "waiting_human": x["gap"]["state"] == "WAITING_HUMAN"})
    open_ = F.transform(policies, lambda x: F.transform(F.concat(F.array_repeat(_rule("blocking_policy_mismatch"), times(x)), state(x)), lambda k: _issue(k, where("unresolved", x["gap"]["unresolved_id"]))))
    status = F.transform("sections", lambda s: F.transform(_broken({"status_not_blocked": stops & (s["status"] != "SECTION_BLOCKED"), "empty_section": none & (F.trim(F.coalesce(s["markdown"], F.lit(""))) == "")}), lambda k: _issue(k, F.lit("section"))))
    aspects = F.array_distinct(F.flatten(F.transform("questions", lambda q: F.transform(F.filter(F.coalesce(q["aspects"], nothing), lambda a: a != ""), lambda a: F.struct(q["question_id"].alias("question_id"), a.alias("aspect"))))))
    answers = F.transform(aspects, lambda x: F.struct(x["question_id"].alias("question_id"), F.transform(F.filter("claims", lambda c: within(c["asked"], x["question_id"]) & c["text"].isNotNull()), lambda c: F.contains(c["text"], x["aspect"])).alias("named")))
    unnamed = F.filter(answers, lambda x: F.array_max(x["named"]) == F.lit(False))
    issues = F.concat(
        F.flatten(open_),
        F.flatten(status),
        F.transform(F.filter("topics", lambda t: ~within("told", t)), lambda t: _issue(_rule("coverage_missing_topic"), where("topic", t))),
        F.transform(F.filter("questions", lambda q: ~within("answered", q["question_id"])), lambda q: _issue(_rule("coverage_missing_question"), where("question", q["question_id"]))),
        F.transform(unnamed, lambda x: _issue(_rule("aspect_uncovered"), where("question", x["question_id"]))),
        F.flatten(F.transform("claims", lambda c: F.transform(c["rules"], lambda k: _issue(k, c["at"])))),
        F.transform(F.filter("claims", lambda c: is_(here & c["absent"] & F.arrays_overlap(c["asked"], "missing"))), lambda c: _issue(_rule("absence_contradicts_gap"), c["at"])),
        F.transform(F.array_distinct(F.flatten(of("claims", "unable"))), lambda t: _issue(_rule("citation_authority_unavailable"), where("ref_type", t))),
    )
    return whole.select("section_id", "sections", issues.alias("issues"))


def section_issues(parts: DataFrame) -> DataFrame:
    """The breaches of every rule: (section_id, rule_id, severity, location) and n, how often."""
    # explode would test each array before it is taken apart, and so build it twice
    each = judged(parts).select("section_id", F.explode_outer("issues").alias("i")).where("i is not null")
    many = each.groupBy("section_id", "i.rule", "i.location").agg(F.count("*").alias("n"))
    told = lambda names: F.array(*map(F.lit, names))[F.col("rule")]
    return many.select("section_id", told(RULES).alias("rule_id"), told([s for s, rules in SEVERITIES.items() for _ in rules]).alias("severity"), "location", "n")


def verdicts(parts: DataFrame) -> DataFrame:
    """Whether a section passes: no blocking issue and nothing to rework."""
    own = judged(parts).withColumn("issues", F.when(F.col("section_id").isNotNull(), F.col("issues")).otherwise(F.array()))
    many = lambda s: F.size(F.filter("issues", lambda i: i["rule"].between(RULES.index(SEVERITIES[s][0]), RULES.index(SEVERITIES[s][-1])))).cast("long").alias(s)
    out = own.select("section_id", *map(many, SEVERITIES), F.explode("sections")).drop("col")
    return out.withColumn("passed", (F.col("blocking") == 0) & (F.col("rework") == 0))


def sources_suffice(sources: DataFrame, key: list[str], eligible: Column | None = None) -> DataFrame:
    """What a key's sources (grade, host, published) allow: enough are one A or B, or two hosts of grade C.

    Reasons, the first that fits: has_ab, two_independent_c, single_c_only, d_only, insufficient_independent_sources.
    """
    rows = sources if eligible is None else sources.where(eligible)
    grade = F.coalesce("grade", F.lit("unknown"))
    weak = grade.isin("D", "unknown")
    out = rows.groupBy(*key).agg(
        F.count_if(grade.isin("A", "B")).alias("ab"),
        F.count_distinct(F.when((grade == "C") & (F.col("host") != ""), F.col("host"))).alias("independent_c"),
        F.count_if(weak).alias("weak"),
        F.count("*").alias("sources"),
        F.count_if(F.col("published").isNull()).alias("undated"),
    )
    reason = F.when(F.col("ab") > 0, "has_ab").when(F.col("independent_c") >= 2, "two_independent_c").when((F.col("independent_c") == 1) & (F.col("weak") == 0), "single_c_only").when(F.col("weak") == F.col("sources"), "d_only").otherwise("insufficient_independent_sources")
    return out.withColumn("reason", reason).withColumn("enough", F.col("reason").isin("has_ab", "two_independent_c"))


def industry_policy(claims: DataFrame, sources: DataFrame, report: Column, days: int) -> DataFrame:
    """Which claims (claim_id, strong, key) must go for want of external sources, and why; null keeps them.

    A claim that hangs on a point in time counts only sources dated up to the report and no more than `days` before it; others
    are judged only if their topic is a key one. Claims without external sources stay.
    """
    day = F.to_date("published")
    fresh = day.isNotNull() & (day <= report) & (F.datediff(report, day) <= days)
    all_ = sources_suffice(sources, ["claim_id"]).select("claim_id", "sources", "undated", "enough")
    some = sources_suffice(sources, ["claim_id"], fresh).select("claim_id", F.col("enough").alias("fresh_enough"))
    met = claims.join(all_, "claim_id", "left").join(some, "claim_id", "left")
    reason = (
        F.when(F.col("sources").isNull(), None)
        .when(F.col("strong") & (F.col("undated") == F.col("sources")), "strong_timepoint_published_at_unknown")
        .when(F.col("strong") & ~F.coalesce("fresh_enough", F.lit(False)), "strong_timepoint_source_insufficient")
        .when(~F.col("strong") & F.col("key") & ~F.col("enough"), "insufficient_industry_sources")
    )
    return met.select("claim_id", reason.alias("removed_for"))


def publication(sections: DataFrame, unresolved: DataFrame, excluded: DataFrame) -> DataFrame:
    """READY or BLOCKED, with the number of distinct reasons. `sections` has status, decision, rules_passed and conflict."""
    stuck = F.col("state").isin("WAITING_HUMAN", "CONFLICT")
    reason = F.when(stuck, F.concat(F.lit("unresolved_"), "state")).when(F.size("effects") > 0, "unresolved_blocking").when(F.col("core"), "unresolved_core_impact")
    open_ = unresolved.select("section_id", F.concat(reason, F.lit(":"), F.coalesce("question_id", "unresolved_id")).alias("reason"))
    bad = excluded.where(F.col("reason").isin("conflict_unresolved", "financial_value_mismatch", "self_invented_scheme", "cross_section_exact_conflict"))
    out = bad.select("section_id", F.concat(F.lit("excluded_"), "reason", F.lit(":"), "claim_id").alias("reason"))
    own = F.array_compact(
        F.array(
            F.when(F.col("status").isin("WAITING_HUMAN", "SECTION_BLOCKED", "FAILED"), F.concat(F.lit("section_status="), "status")),
            F.when(F.col("decision").isin("BLOCKED", "FAILED", "PASS_WITH_GAPS"), F.concat(F.lit("evaluation_decision="), "decision")).when((F.col("decision") == "REWORK") & ~F.col("rules_passed"), "rules_not_passed"),
            F.when(F.col("conflict"), "potential_cross_section_conflict"),
        )
    )
    reasons = open_.unionAll(out).unionAll(sections.select("section_id", F.explode(own).alias("reason"))).where("reason is not null").distinct()
    many = reasons.groupBy("section_id").agg(F.count("*").alias("reasons"))
    joined = sections.select("section_id").join(many, "section_id", "left")
    return joined.select("section_id", F.when(F.col("reasons") > 0, "BLOCKED").otherwise("READY").alias("status"), F.coalesce("reasons", F.lit(0)).alias("reasons"))


def edited(claims: DataFrame, topics: DataFrame, refs: DataFrame) -> DataFrame:
    """A section's paragraphs: adopted claims by topic, contract topics first and others as they appear, sentences joined in
    order, and at most three citations shown per claim."""
    cites = refs.groupBy("section_id", "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]).alias("all"))
    cut = F.concat(F.array_join(F.slice("all", 1, 3), "；"), F.when(F.size("all") > 3, F.concat(F.lit(" 等 "), F.size("all").cast("string"), F.lit(" 项"))).otherwise(""))
    rows = claims.join(cites, ["section_id", "claim_id"], "left").withColumn("cites", F.coalesce(cut, F.lit("")))
    list_ = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("x")))), lambda v: v["x"])
    parts = rows.groupBy("section_id", "topic_id").agg(F.min("at").alias("seen"), F.array_join(list_("text"), "").alias("body"), F.array_join(list_("cites"), "\n").alias("citations"))
    placed = parts.join(topics, ["section_id", "topic_id"], "left")
    rank = F.row_number().over(Window.partitionBy("section_id").orderBy(F.col("place").asc_nulls_last(), "seen", "topic_id"))
    return placed.select("section_id", rank.alias("paragraph"), "topic_id", F.coalesce("title", "topic_id").alias("title"), "body", "citations")


def rework_targets(targets: DataFrame, questions: DataFrame, claims: DataFrame) -> DataFrame:
    """The questions that rework targets (kind, ref) ask again: their own, a topic's, or a claim's; unknown ones are ignored."""
    own = targets.where("kind = 'question'").select("section_id", F.col("ref").alias("question_id"), "reason")
    topic = targets.where("kind = 'topic'").select("section_id", F.col("ref").alias("topic_id"), "reason").join(questions.select("section_id", "topic_id", "question_id"), ["section_id", "topic_id"])
    claim = targets.where("kind = 'claim'").select("section_id", F.col("ref").alias("claim_id"), "reason").join(claims.select("section_id", F.col("claim_id").cast("string").alias("claim_id"), F.explode("question_ids").alias("question_id")), ["section_id", "claim_id"])
    cols = ["section_id", "question_id", "reason"]
    found = own.select(*cols).unionAll(topic.select(*cols)).unionAll(claim.select(*cols))
    known = found.join(questions.select("section_id", "question_id", "topic_id"), ["section_id", "question_id"])
    return known.groupBy("section_id", "question_id").agg(F.max("topic_id").alias("topic_id"), F.count("*").alias("instructions"))


def merged_rework(parent: DataFrame, fresh: DataFrame, targets: DataFrame) -> DataFrame:
    """The parent's claims that touch no question asked again, and the new ones."""
    again = targets.select("section_id", "question_id").distinct()
    touched = parent.select("section_id", "claim_id", F.explode("question_ids").alias("question_id")).join(again, ["section_id", "question_id"]).select("section_id", "claim_id").distinct()
    kept = parent.join(touched, ["section_id", "claim_id"], "left_anti").withColumn("origin", F.lit("parent"))
    return kept.unionByName(fresh.withColumn("origin", F.lit("rework")))
