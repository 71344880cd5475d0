"""Record sets: mapping and normalising candidates, people's decisions about them, and what a corpus holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions import amounts as ax

# Why a person may decide.
REASONS = ("AUDITED_SOURCE", "LATEST_RESTATEMENT", "SCOPE_MATCH", "PERIOD_MATCH", "CORRECTED_MATERIAL", "OTHER_WITH_NOTE")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def mapped(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates with code and mapping: by statement type and normalised name, a code unless one of its exclude words stands in
    the name; unique, ambiguous or none. Rules: (statement, alias, code, exclude)."""
    hits = candidates.select("candidate_id", "statement", F.col("name").alias("alias")).join(rules, ["statement", "alias"])
    kept = hits.where(~F.coalesce((F.col("exclude") != "") & F.contains("alias", "exclude"), F.lit(False)))
    codes = kept.groupBy("candidate_id").agg(F.count_distinct("code").alias("codes"), F.min("code").alias("code"))
    out = candidates.join(codes, "candidate_id", "left")
    state = F.when(F.col("codes").isNull(), "none").when(F.col("codes") == 1, "unique").otherwise("ambiguous")
    return out.withColumn("mapping", state).withColumn("code", F.when(F.col("codes") == 1, F.col("code"))).drop("codes")


def normalised(candidates: DataFrame, rules: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Every candidate's outcome: MAPPING_REQUIRED, NOT_NUMERIC, BLOCKED with the first missing dimension, or RECORD with its value
    in yuan and its least displayed step in yuan.

    Confirmed scope and currency (company, scope, currency) fill what the candidate lacks and change nothing that it has.
    Amounts stay exact; a unit without a rule blocks.
    """
    both = mapped(candidates, rules).join(confirmed.select("company", F.col("scope").alias("_s"), F.col("currency").alias("_c")), "company", "left")
    filled = both.withColumn("scope", F.when(_blank("scope"), F.col("_s")).otherwise(F.col("scope"))).withColumn("currency", F.when(_blank("currency"), F.col("_c")).otherwise(F.col("currency")))
    scale = ax.unit_code_scale(F.col("unit"))
    missing = F.when(_blank("statement"), "statement_type").when(_blank("period"), "period").when(_blank("scope"), "scope").when(_blank("currency"), "currency").when(scale.isNull(), "unit")
    numeric = (F.col("status") == "EXTRACTED") & F.col("value").isNotNull()
    outcome = F.when(F.col("mapping") != "unique", "MAPPING_REQUIRED").when(~numeric, "NOT_NUMERIC").when(missing.isNotNull(), "BLOCKED").otherwise("RECORD")
    out = filled.withColumn("outcome", outcome).withColumn("missing", F.when(F.col("outcome") == "BLOCKED", missing))
    good = F.col("outcome") == "RECORD"
    std = F.when(good, (F.col("value") * scale).cast("decimal(38,4)"))
    return out.withColumn("std_value", std).withColumn("step", F.when(good, (F.col("increment") * scale).cast("decimal(38,4)"))).drop("_s", "_c")


def record_sets(records: DataFrame, key: list[str]) -> DataFrame:
    """A set's header: periods, counts, and currency, unit and scope only where all records agree."""
    agreed = lambda c: F.when(F.count_distinct(F.coalesce(F.col(c), F.lit(""))) == 1, F.min(c)).alias(c)
    good = records.where("outcome = 'RECORD'").groupBy(*key).agg(F.array_sort(F.collect_set("period")).alias("periods"), F.count("*").alias("records"), agreed("currency"), agreed("unit"), agreed("scope"))
    issues = records.groupBy(*key).agg(F.count_if(F.col("outcome") == "BLOCKED").alias("issues"))
    return issues.join(good, key, "left")


def checked_decisions(items: DataFrame, groups: DataFrame, records: DataFrame) -> DataFrame:
    """`decided`, with the items' groups (group_id, state, decided, members) and their records (record_id, std_value,
    quarantined) from tables of their own. Records are looked up once for each group, not for each item on it."""
    looked = groups.select("group_id", F.explode("members").alias("record_id")).join(records, "record_id", "left")
    facts = looked.groupBy("group_id").agg(F.collect_list(F.struct("record_id", "std_value", "quarantined")).alias("facts"))
    group = F.struct("state", "decided", F.coalesce("facts", F.array()).alias("members"))
    return decided(items.join(groups.join(facts, "group_id", "left").select("group_id", group.alias("group")), "group_id", "left"))


def decided(items: DataFrame) -> DataFrame:
    """What is wrong with each item (batch, at, group_id, accepted, rejected, reason, note) of a batch of decisions on values, and
    whether its batch may be written: all of it or nothing.

    Its group (state, decided, members; null if there is none) must be in conflict and undecided; accepted records are some, none
    of them rejected, both together are the group, none quarantined, and share one value. A repeated group is an error from its
    second item on. Members are (record_id, std_value, quarantined), without a value if no such record is known.
    """
    members = F.col("group.members")
    ids, all_ = F.transform(members, lambda m: m["record_id"]), F.array_distinct(F.concat("accepted", "rejected"))
    values = F.transform(F.filter(members, lambda m: F.array_contains("accepted", m["record_id"])), lambda m: m["std_value"])
    # all that an item alone tells comes before the sort, which so takes no arrays
    alone = (
        F.when(F.col("group.state").isNull(), "group_unknown")
        .when(F.col("group.state") != "CONFLICT", "group_not_in_conflict")
        .when(F.col("group.decided"), "group_already_decided")
        .when(~F.col("reason").isin(*REASONS), "reason_unknown")
        .when((F.col("reason") == "OTHER_WITH_NOTE") & (F.trim(F.coalesce("note", F.lit(""))) == ""), "note_missing")
        .when(F.size("accepted") == 0, "nothing_accepted")
        .when(F.arrays_overlap("accepted", "rejected"), "accepted_and_rejected")
        .when(F.size(F.array_except(all_, ids)) > 0, "record_of_other_group")
        .when(F.size(F.array_except(ids, all_)) > 0, "record_left_out")
        .when(F.exists(members, lambda m: m["std_value"].isNull()), "record_unknown")
        .when(F.exists(members, lambda m: F.coalesce(m["quarantined"], F.lit(False))), "record_quarantined")
        .when(F.size(F.array_distinct(values)) > 1, "accepted_values_differ")
    )
    judged = items.select("batch", "at", "group_id", "accepted", "rejected", alone.alias("alone"))
    repeat = F.row_number().over(Window.partitionBy("batch", "group_id").orderBy("at")) > 1
    error = F.when(_blank("group_id"), "group_missing").when(F.col("repeat"), "group_repeated").otherwise(F.col("alone"))
    out = judged.withColumn("repeat", repeat).withColumn("error", error).drop("alone", "repeat")
    return out.withColumn("written", F.max(F.col("error").isNotNull()).over(Window.partitionBy("batch")) == F.lit(False))


def confirmed_records(candidates: DataFrame, records: DataFrame, decisions: DataFrame) -> DataFrame:
    """The record set that decisions on mappings (candidate_id, code or null) derive: all records that were there, and those
    candidates that got a code. `origin` says which."""
    chosen = decisions.where("code is not null").select("candidate_id", "code")
    had = records.select("candidate_id")
    fresh = candidates.drop("code").join(chosen, "candidate_id").join(had, "candidate_id", "left_anti").withColumn("origin", F.lit("decided"))
    return records.withColumn("origin", F.lit("mapped")).unionByName(fresh, allowMissingColumns=True)


def pending_mappings(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues about mappings without a decision that holds."""
    return issues.where("issue = 'MAPPING_REQUIRED' and candidate_id is not null").join(decisions.select("candidate_id"), "candidate_id", "left_anti")


def stale_causes(snapshots: DataFrame, sets: DataFrame, sources: DataFrame, groups: DataFrame, runs: DataFrame) -> DataFrame:
    """Why a snapshot no longer holds, each cause once: a record set, a source, a decision's candidates or a reconciliation
    moved. Snapshots: (snapshot_id, company, record_set, source_hash, group_id, candidate_hash, run)."""
    met = snapshots.join(sets.select("company", F.col("record_set").alias("now_set")), "company", "left").join(sources.select("company", F.col("source_hash").alias("now_source")), "company", "left")
    met = met.join(groups.select("group_id", F.col("candidate_hash").alias("now_hash")), "group_id", "left").join(runs.select("company", F.col("run").alias("now_run")), "company", "left")
    moved = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    causes = F.array_compact(
        F.array(
            F.when(moved("record_set", "now_set"), "RECORD_SET_MOVED"),
            F.when(moved("source_hash", "now_source"), "SOURCE_MOVED"),
            F.when(F.col("group_id").isNotNull() & moved("candidate_hash", "now_hash"), "RESOLUTION_STALE"),
            F.when(moved("run", "now_run"), "RECONCILIATION_MOVED"),
        )
    )
    return met.select("snapshot_id", causes.alias("causes"))


def invalidated(validity: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """The objects that hold (object_id and the column `by`) and that an event on that column makes stale."""
    return validity.where("status = 'valid'").join(events.select(by).distinct(), by, "left_semi")


def failed_check_records(checks: DataFrame, records: DataFrame) -> DataFrame:
    """Records that a failed check took in."""
    bad = checks.where("status = 'FAILED'").select(F.explode("record_ids").alias("record_id")).distinct()
    return records.join(bad, "record_id", "left_semi")


def formula_gaps(required: DataFrame, items: DataFrame) -> DataFrame:
    """Missing input codes of required formulas (formula_id, period, inputs) by company, and which formulas want them."""
    asked = required.select("formula_id", "company", "period", F.explode("inputs").alias("code"))
    gone = asked.join(items.select("company", "period", "code").distinct(), ["company", "period", "code"], "left_anti")
    return gone.groupBy("company", "period", "code").agg(F.array_sort(F.collect_set("formula_id")).alias("formulas"))


def inventory(chunks: DataFrame, file: str, page: str) -> DataFrame:
    """What a corpus holds of each file."""
    return chunks.groupBy(file).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("chunks"), F.size(F.collect_set(page)).cast("long").alias("pages"))


def funnel(events: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """How many distinct things reached each stage, having reached all before it."""
    reached = events.groupBy(key, "thing").agg(*(F.max((F.col("stage") == s).cast("int")).alias(s) for s in stages))
    through = [reduce(lambda a, b: a & b, (F.col(s) == 1 for s in stages[: k + 1])) for k in range(len(stages))]
    return reached.groupBy(key).agg(*(F.count_if(c).alias(s) for s, c in zip(stages, through, strict=True)))


def folded(rows: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """The first of the rows with an equal identity; nulls are equal."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*identity).orderBy(*order))).where("_n = 1").drop("_n")


def covering(rows: DataFrame, key: str, id_: str, members: str) -> DataFrame:
    """The projections that no other one of their key covers. Of equal ones the least id stays.

    Projections meet by a member: one that covers another holds its least member, so no pairs are tried without one.
    """
    own = rows.select(key, F.col(id_).alias("id"), F.array_sort(F.array_distinct(members)).alias("own"))
    least = own.where("size(own) > 0").withColumn("member", F.col("own")[0])
    holders = own.select(key, F.col("id").alias("other"), F.col("own").alias("theirs"), F.explode("own").alias("member"))
    met = least.join(holders, [key, "member"]).where("id <> other")
    inside = (F.size(F.array_except("own", "theirs")) == 0) & ((F.size("theirs") > F.size("own")) | (F.col("other") < F.col("id")))
    return rows.join(met.where(inside).select(key, F.col("id").alias(id_)).distinct(), [key, id_], "left_anti")


def both_ways(a: Column, b: Column) -> Column:
    """What either set has alone: (only_first, only_second)."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("only_first"), F.array_sort(F.array_except(b, a)).alias("only_second"))


def drifted(saved: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of a manifest that changed, appeared or went: (key, field, was, is)."""
    pair = lambda df, as_: df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x")).select(key, "x.field", F.col("x.v").alias(as_))
    return pair(saved, "was").join(pair(now, "is"), [key, "field"], "full").where("not (was <=> is)")


def resumable(checkpoints: DataFrame, now: DataFrame) -> DataFrame:
    """The stages that may be skipped: done, with the same input hash and dependency versions as now, and every stage before
    them too. Checkpoints and now: (run, stage, at, input_hash, versions), checkpoints also done."""
    met = now.join(checkpoints.select("run", "stage", "done", F.col("input_hash").alias("h"), F.col("versions").alias("v")), ["run", "stage"], "left")
    fits = F.coalesce(F.col("done") & (F.col("h") == F.col("input_hash")) & (F.col("v") == F.col("versions")), F.lit(False))
    so_far = F.min(fits.cast("int")).over(Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return met.select("run", "stage", (so_far == 1).alias("skip"))


def cache_misses(wanted: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """Distinct texts whose hash the cache (hash) doesn't have: only these are encoded."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return wanted.select(h.alias("hash"), F.coalesce(F.col(text), F.lit("")).alias(text)).dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")


def reindexed(documents: DataFrame, built: DataFrame) -> DataFrame:
    """Companies whose inventory fingerprint isn't the one their index was built from."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("doc").cast("string"), "hash"))), "\n")
    now = documents.groupBy("company").agg(F.sha2(lines, 256).alias("fingerprint"))
    return now.join(built.select("company", F.col("fingerprint").alias("was")), "company", "left").where("not (fingerprint <=> was)").drop("was")


def answer_status(answers: DataFrame) -> DataFrame:
    """COMPLETED or COMPLETED_WITH_GAPS with the first gate that an answer fails: route, answer, structure, aspects, numbers,
    scope, closed sets, entailment."""
    gates = [("route_undecided", "routed"), ("answer_missing", "answered"), ("citations_invalid", "valid"), ("aspects_uncovered", "covered"), ("values_missing", "numbers"), ("scope_at_risk", "scoped"), ("set_not_closed", "closed"), ("not_entailed", "entailed")]
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c), F.lit(False)), name) for name, c in gates)))
    return answers.select("answer_id", F.when(F.size(reasons) == 0, "COMPLETED").otherwise("COMPLETED_WITH_GAPS").alias("status"), F.try_element_at(reasons, F.lit(1)).alias("first_gap"), F.size(reasons).alias("gaps"))


def pack_status(aspects: DataFrame) -> DataFrame:
    """A pack's two statuses from its aspects' (state: covered, not_applicable, gap, blocked or pending): coverage and process."""
    s = F.col("state")
    n = F.count("*")
    fine, blocked, open_ = F.count_if(s.isin("covered", "not_applicable")), F.count_if(s == "blocked"), F.count_if(s.isin("pending", "blocked"))
    coverage = F.when(fine == n, "complete").when(open_ == 0, "complete_with_gaps").otherwise("insufficient")
    process = F.when(open_ == 0, "finished").when(blocked > 0, "blocked").when(F.count_if(s == "covered") == 0, "pending").otherwise("running")
    return aspects.groupBy("pack").agg(coverage.alias("coverage"), process.alias("process"))


def unfetched(found: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """URLs a search returned that were not fetched, in order of rank."""
    return found.join(fetched.select(key, "url").distinct(), [key, "url"], "left_anti")


def reconciled_objects(expected: DataFrame, recovered: DataFrame) -> DataFrame:
    """Each expected object's outcome by its table number: not obtained, ambiguous, its recovery's own state, or failed if the
    title differs. Titled tables that nothing expected are ORPHAN."""
    many = recovered.groupBy("document", "number").agg(F.count("*").alias("n"), F.min("state").alias("state"), F.min("title").alias("found_title"))
    met = expected.join(many, ["document", "number"], "left")
    state = F.when(F.col("n").isNull(), "TARGET_NOT_OBTAINED").when(F.col("n") >= 2, "RECOVERY_FAILED").when(F.col("title") != F.col("found_title"), "RECOVERY_FAILED").otherwise(F.upper("state"))
    out = met.select("document", "number", state.alias("state"))
    extra = recovered.join(expected.select("document", "number"), ["document", "number"], "left_anti").where("title is not null and title <> ''")
    return out.unionAll(extra.select("document", "number", F.lit("ORPHAN").alias("state")))


def planned(jobs: DataFrame, topics: list[tuple[str, str, int, str, tuple[str, ...]]], questions: DataFrame) -> DataFrame:
    """A report's tasks: every question of the topics whose condition fits the job's credit type, in order, with an id from job,
    topic and question. Topics are a contract's: (section, topic, place, kind of condition, credit types). Unknown kinds of
    condition never fit."""

    def fits(kind: str, values: tuple[str, ...]) -> Column:
        if kind == "always":
            return F.lit(True)
        if kind not in ("credit_type_in", "credit_type_not_in"):
            return F.lit(False)
        inside = F.col("credit_type").isin(*values)
        return inside if kind == "credit_type_in" else ~inside

    chosen = F.array_compact(F.array(*(F.when(fits(kind, values), F.struct(F.lit(section).alias("section"), F.lit(topic).alias("topic_id"), F.lit(place).alias("place"))) for section, topic, place, kind, values in topics)))
    rows = jobs.select("job", F.explode(chosen).alias("t")).select("job", "t.*").join(questions, "topic_id")
    order = Window.partitionBy("job").orderBy("section", "place", "question_id")
    task = F.substring(F.sha2(F.concat_ws("\n", F.col("job").cast("string"), "topic_id", "question_id"), 256), 1, 24)
    return rows.select("job", F.row_number().over(order).alias("at"), "section", "topic_id", "question_id", task.alias("task_id"))


def matrix(topics: DataFrame, claims: DataFrame, gaps: DataFrame) -> DataFrame:
    """A cell per section and topic: covered, gap or missing, with counts."""
    c = claims.groupBy("section_id", "topic_id").agg(F.count("*").alias("claims"))
    g = gaps.groupBy("section_id", "topic_id").agg(F.count("*").alias("gaps"))
    met = topics.join(c, ["section_id", "topic_id"], "left").join(g, ["section_id", "topic_id"], "left")
    cell = F.when(F.col("claims").isNotNull() & F.col("gaps").isNull(), "covered").when(F.col("claims").isNotNull(), "covered_with_gaps").when(F.col("gaps").isNotNull(), "gap").otherwise("missing")
    return met.select("section_id", "topic_id", cell.alias("cell"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("gaps", F.lit(0)).alias("gaps"))


def scope_flag(text: str, scopes: Column) -> Column:
    """A claim that speaks for the group while its evidence is the parent company's, or the other way round."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(t, F.lit("合并")) & F.array_contains(scopes, "parent") & ~F.array_contains(scopes, "consolidated"), "CONSOLIDATED_FROM_PARENT").when(F.contains(t, F.lit("母公司")) & ~F.array_contains(scopes, "parent"), "PARENT_FROM_CONSOLIDATED")
