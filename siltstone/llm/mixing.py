"""Mixing sources to target weights by capped water-filling.

Targets: sources share `total` words by weight; no target exceeds `cap` times its source's size, and the excess
is shared again by weight until none does. Solved in one pass: with sources sorted by cap / weight, a source is
capped if and only if the level reached once all before it are capped is at least its own cap / weight.

Sample: every document of a source is taken floor(target / size) times; what is left of the target is filled
with documents in a seeded order (md5 of seed and id), the last one in part. So a source's taken words equal
its target up to rounding, no document is taken more than `cap` times, and reruns agree.

Plan: sizes are counted in one scan and stored as narrow rows. A source's order is cut into 65,536 buckets by
the first 16 bits of the md5; sums by bucket find, in two steps of 256, the bucket in which the target is reached,
and only that bucket is sorted. So a source with a third of all rows is never in one task, and texts are never shuffled.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own
(last in order); a source without words has target 0; rows with equal ids are ordered by size; an empty table
gives an empty result; a null weight counts as 0; extra columns pass through, whatever their names (mixing()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.shared import BROADCAST_ROWS, stored, words

CAP = 3
SEED = "mix-1"


def repeating_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """source, weight: the weights dealt to the sources in order of code point, null last, again and again."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # one row a source
    return sources.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, cap: float = CAP, total: float | None = None) -> DataFrame:
    """source, source_size, target: from one row (source, source_size, weight) a source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sources.select(
        "source",
        "source_size",
        F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"),
        (F.lit(cap) * F.col("source_size")).alias("limit"),
        (F.sum("source_size").over(everything) if total is None else F.lit(total)).alias("total"),
        F.sum(F.coalesce(F.col("weight"), F.lit(0.0))).over(everything).alias("all_weight"),
    )
    ratio = F.when(F.col("weight") > 0, F.col("limit") / F.col("weight"))
    order = Window.orderBy(F.asc_nulls_last(ratio), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(
        F.col("all_weight") > F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    rows = rows.select("*", ratio.alias("ratio"), level.alias("level"), F.row_number().over(order).alias("rank"))
    rows = rows.withColumn("capped", F.coalesce(F.col("level") >= F.col("ratio"), F.lit(False)))
    final = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("rank"))).over(everything)
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(F.coalesce(final * F.col("weight"), F.lit(0.0)))
    return rows.select("source", "source_size", target.alias("target"))


def seeded_order(id_col: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))


def plan(sizes: DataFrame, weights=repeating_weights, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row a source: source, source_size, target, whole (times that every document is taken), cut (bucket in
    which the rest is reached), left (words still wanted at its start). sizes: doc_id, source, size.
    weights: a function from a DataFrame of sources to (source, weight)."""
    buckets = sizes.groupBy("source", F.substring(seeded_order(F.col("doc_id"), seed), 1, 4).alias("bucket")).agg(F.sum("size").alias("size"))
    buckets = stored(buckets, "mix-buckets")
    totals = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = weights(totals.select("source")).withColumnRenamed("source", "s")
    targets = water_fill(totals.join(dealt, totals["source"].eqNullSafe(F.col("s"))).drop("s"), cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.select("*", whole.alias("whole"))
    targets = targets.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))
    # Where the rest is reached: among 256 sums of a source, then among the 256 inside the one found.
    found = targets.where("rest > 0").select(F.col("source").alias("s"), F.col("rest").alias("left"), F.lit("").alias("cut"))
    for width in (2, 4):
        inside = buckets.join(found, buckets["source"].eqNullSafe(F.col("s")) & F.col("bucket").startswith(F.col("cut")))
        sums = inside.groupBy("s", "left", F.substring("bucket", 1, width).alias("bucket")).agg(F.sum("size").alias("size"))
        running = sums.select("*", F.sum("size").over(Window.partitionBy("s").orderBy("bucket")).alias("upto"))
        hit = running.where("upto >= left").groupBy("s").agg(F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("size")).alias("left"))).alias("at"))
        found = hit.select("s", "at.left", F.col("at.bucket").alias("cut"))
    out = targets.join(found, targets["source"].eqNullSafe(F.col("s")), "left")
    return out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("left", F.lit(0)).alias("left"))


def take(rows: DataFrame, table: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (with doc_id, source, size) with source_size, target and taken words."""
    table = stored(table, "mix-plan")
    side = table.select(*[F.col(c).alias(f"__{c}") for c in table.columns])
    if table.count() <= BROADCAST_ROWS:  # one row a source; else Spark joins by shuffle and splits skewed keys
        side = F.broadcast(side)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    out = rows.join(side, rows["source"].eqNullSafe(F.col("__source"))).withColumn("__key", seeded_order(F.col("doc_id"), seed))
    bucket = F.substring("__key", 1, 4)
    done = [*kept, F.col("__source_size").alias("source_size"), F.col("__target").alias("target")]
    base = F.col("__whole") * F.col("size")
    sure = out.where(bucket != F.col("__cut")).select(*done, (base + F.when(bucket < F.col("__cut"), F.col("size")).otherwise(F.lit(0))).cast("long").alias("taken"))
    order = Window.partitionBy("__source").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = out.where(bucket == F.col("__cut")).withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - F.col("__before")))
    return sure.unionByName(cut.select(*done, (base + extra).cast("long").alias("taken")))


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size of every row, stored."""
    return stored(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size")), "mix-sizes")


def mixing(df: DataFrame, weights=repeating_weights, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed table: rows of df with all their columns, each as often as it is taken (a part of half or more counts as once)."""
    table = plan(sized(df, id_col, text_col, source_col), weights, cap, seed)
    rows = df.select(F.struct("*").alias("__row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    out = take(rows, table, seed).where((F.col("size") > 0) & (copies > 0)).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    return out.select("__row.*")
