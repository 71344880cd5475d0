"""Append-only logs and their heads, version pointers, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.sources.shared import written


def head(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by one partially summed aggregation rather than a sort of each key's log."""
    rest = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return log.groupBy(*key).agg(best).select(*key, "row.*")


def on_or_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds to each row of `left` the `value` of the key's latest row in `right` that isn't later: an as-of join as one
    window over both, so that nothing is paired and dropped again."""
    mine = left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias("given"), F.struct(*left.columns).alias("row"))
    theirs = right.select(key, at, F.col(value).alias("given"), F.lit(None).cast(mine.schema["row"].dataType).alias("row"))
    w = Window.partitionBy(key).orderBy(at, F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return mine.unionByName(theirs).withColumn("found", F.last("given", ignorenulls=True).over(w)).where("row is not null").select("row.*", F.col("found").alias(value))


def backward_steps(log: DataFrame, key: list[str], order: list[str], state: str, ranks: dict[str, int]) -> DataFrame:
    """Rows whose state ranks lower than the one before: forbidden steps of a monotone status."""
    rank = F.lit(None).cast("int")
    for name, r in ranks.items():
        rank = F.when(F.col(state) == name, r).otherwise(rank)
    w = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("rank", rank).withColumn("before", F.lag("rank").over(w)).where("rank < before").drop("rank", "before")


def conflicts(new: DataFrame, old: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """How each new row relates to what is stored: new, identical (reused) or conflict (an error, never overwritten)."""
    digest = F.sha2(F.to_json(F.struct(*payload)), 256)
    mine, theirs = new.select(*key, digest.alias("new_hash")), old.select(*key, digest.alias("old_hash"))
    joined = mine.join(theirs, key, "left")
    return joined.select(*key, F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("new_hash"), "identical").otherwise("conflict").alias("verdict"))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key's first row."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def fingerprint(rows: DataFrame, by: list[str], id_: Column, digest: Column) -> DataFrame:
    """A digest of a group's sorted 'id:hash' lines. Lines are sorted within a group that is listed whole by contract."""
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", id_, digest)))), 256).alias("fingerprint"), F.count("*").alias("n"))


def closure(edges: DataFrame, child: str, parent: str, adopted: DataFrame, key: str) -> DataFrame:
    """For every child that a walk over its parents starts from: whether all walks end in adopted rows.

    A missing or parentless row that isn't adopted breaks a chain, however long; cycles end nowhere and break nothing.
    Hops double each round: a start that meets a broken end within as many steps as its hops span is settled, the others'
    hops are joined to the hops of where they lead. No walk to a broken end needs more steps than there are rows.
    """
    links = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).distinct(), "links")
    starts = written(links.select("node").distinct(), "starts")
    ends = adopted.select(F.col(key).alias("up")).where("up is not null").distinct()
    open_ = links.join(ends, "up", "left_anti")
    known = starts.where("node is not null").select(F.col("node").alias("up"), F.lit(True).alias("known"))
    step = written(open_.join(known, "up", "left").select("node", "up", F.col("known").isNotNull().alias("known")), "steps")
    bad = written(step.where("not known and node is not null").select("node").distinct(), "broken")
    hops = written(step.where("known and node is not null").select("node", "up").join(bad, "node", "left_anti"), "hops")
    span, most = 1, starts.count() + 1
    while span < most and not hops.isEmpty():
        found = written(hops.join(bad.select(F.col("node").alias("up")), "up").select("node").distinct(), "broken")
        on = hops.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
        hops = written(hops.join(found, "node", "left_anti").join(on, "up").select("node", F.col("beyond").alias("up")).distinct(), "hops")
        bad = written(bad.unionAll(found), "broken")
        span *= 2
    stuck = bad.select("node", F.lit(True).alias("stuck"))
    return starts.join(stuck, "node", "left").select(F.col("node").alias(child), F.col("stuck").isNull().alias("valid"))


def quotas(rows: DataFrame, layer: str, id_: str, total: int) -> DataFrame:
    """A stratified sample of `total` rows: largest-remainder quotas per layer, rows in the order of their ids' digests."""
    sizes = rows.groupBy(layer).agg(F.count("*").alias("n"))
    all_ = sizes.agg(F.sum("n").alias("all"))
    share = sizes.join(F.broadcast(all_)).withColumn("exact", F.col("n") * F.lit(total) / F.col("all")).withColumn("base", F.floor("exact"))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("exact") - F.col("base")), layer))
    quota = share.withColumn("quota", F.col("base") + (order <= left).cast("int")).select(layer, "quota")  # a row per layer
    place = F.row_number().over(Window.partitionBy(layer).orderBy(F.sha2(F.col(id_).cast("string"), 256), id_))
    return rows.withColumn("place", place).join(quota, layer).where("place <= quota").drop("place", "quota")
