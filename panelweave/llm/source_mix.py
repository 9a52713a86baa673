"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

Each source's share of the mix is its weight's share, clamped at a number of epochs of the
source; what is clamped away is shared by weight among the others until none is above its
clamp. A source is then repeated wholly as often as its target holds it, and the rest is
filled with documents in seeded order, the last of them in part. All of it is DataFrame
functions.

Order within a source goes by a hash of id and text. Its leading bits make buckets, as many
as the rows need: bucket totals are summed first, so a source with a third of all rows is
never ordered in one task, and the order does not depend on the number of buckets.

Defined results: null text or text without words has size 0 and is taken 0 times; null
source is a source of its own, last in order; rows with null or repeated ids are drawn by
their texts; repeated rows count each, and ties among them do not matter; very long texts
count all their words; extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BUCKET_ROWS = 100_000
LEAST_BITS, MOST_BITS = 10, 24
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than space, tab, newline and the like; null: 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("bigint")


def water_fill(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> these and target.

    With sources in order of clamp over weight, the first k are clamped and the rest share
    what is left by weight, for the least k at which the next one stays under its clamp.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("weight", weight).withColumn("clamp", (F.col("source_size") * epochs).cast("bigint"))
    filling = Window.orderBy((F.col("clamp") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("below", F.coalesce(F.sum("clamp").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("above", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") * F.lit(share) - F.col("below")) / F.col("above"))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("clamp"), F.struct("below", "level"))).over(whole)["level"]
    share_of = F.col("water") * F.col("weight")
    target = F.when(F.col("water").isNull() | (share_of > F.col("clamp")), F.col("clamp").cast("double")).otherwise(share_of)
    return ranked.withColumn("water", level).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, keep: tuple = ()) -> DataFrame:
    """key, source, size, source_size, target, and taken: the words that the mix takes of the row, repeats counted; and the columns `keep`."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(F.col(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw.alias("draw"), *keep)
    rows = saved(rows)
    bits = min(MOST_BITS, max(LEAST_BITS, (rows.count() // BUCKET_ROWS).bit_length()))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint"), 32 - bits))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(parts.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "bucket", "before", "source_size", "target")
    inside = Window.partitionBy("r.source", "r.bucket").orderBy("draw", key, "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("words") - F.col("repeats") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("ahead")))
    return (
        rows.alias("r")
        .join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
        .select(F.col(f"r.{key}"), "r.source", "r.size", "p.source_size", "p.target", "p.before", F.coalesce(F.sum("r.size").over(inside), F.lit(0)).alias("ahead"), *keep)
        .withColumn("repeats", repeats)
        .withColumn("words", F.floor(F.col("target")).cast("bigint"))
        .withColumn("rest", rest)
        .select(key, "source", "size", "source_size", "target", (F.col("repeats") * F.col("size") + part).cast("bigint").alias("taken"), *keep)
    )
