"""Sharding through a fixed number of virtual slots.

A record's id, text and number among its equals hash it into one of SLOTS slots. Equal
records are interchangeable, so they are counted and numbered anew, in at most PARTS blocks
that share a slot each: a record that repeats without end spreads as others do. Bytes are summed by slot, and a versioned
map says which shard a slot belongs to. Version 0 deals slots out in turn; each later
version is an edit of the one before, in which slots move off shards that hold more than an
even share of the bytes, and is stored beside it. All of it is DataFrame functions; only the map, whose size
is fixed, is ever in one row.

Defined results: null text has 0 bytes of text; rows with null or repeated ids spread by
their texts; repeated rows spread by their number and get positions of their own; a record of
more than an even share is alone over it, and its shard gets nothing else that can move;
extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import saved

SLOTS, PARTS = 4096, 16384
SLACK = 0.005
OVERHEAD = 16


def virtual_slot(*identity: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*identity), F.lit(slots)).cast("int")


def first_map(slot_bytes: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: virtual_slot, bytes, rows -> these, shard and version."""
    return slot_bytes.withColumn("shard", F.pmod("virtual_slot", F.lit(shards)).cast("int")).withColumn("version", F.lit(0))


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map's next version: a shard within an even share (and SLACK) keeps all its slots; others keep their heaviest while these fit, and the rest goes, heaviest first, to the lightest shard."""
    held = Window.partitionBy("shard")
    whole = Window.partitionBy()
    even = F.sum("bytes").over(whole) / F.lit(shards)
    marked = slot_map.withColumn("even", even).withColumn("total", F.sum("bytes").over(held)).withColumn("ahead", F.sum("bytes").over(held.orderBy(F.desc("bytes"), "virtual_slot")))
    leaves = (F.col("total") > F.col("even") * F.lit(1 + SLACK)) & (F.col("ahead") > F.col("even")) & (F.col("bytes") > 0)
    heavy = F.array_sort(F.collect_list(F.struct("leaves", (-F.col("bytes")).alias("minus"), "virtual_slot", "shard", "rows", "version")))
    packed = marked.withColumn("leaves", leaves).groupBy().agg(heavy.alias("slots"))
    kind = "struct<virtual_slot:int,bytes:bigint,rows:bigint,shard:int,version:int>"
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"), F.expr(f"cast(array() as array<{kind}>)").alias("dealt"))

    def step(acc, s):
        size = -s["minus"]
        loads = acc["loads"]
        lightest = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        to = F.when(s["leaves"], lightest).otherwise(s["shard"])
        row = F.struct(s["virtual_slot"].alias("virtual_slot"), size.alias("bytes"), s["rows"].alias("rows"), to.alias("shard"), (s["version"] + 1).alias("version"))
        return F.struct(F.transform(loads, lambda x, i: F.when(i == to, x + size).otherwise(x)).alias("loads"), F.concat(acc["dealt"], F.array(row)).alias("dealt"))

    return packed.select(F.explode(F.aggregate("slots", start, step, lambda acc: acc["dealt"])).alias("s")).select("s.*")


def last_map(spark: SparkSession, maps: str) -> DataFrame | None:
    """virtual_slot, shard and version of the last version stored in the folder, if there is one; a folder without files holds none."""
    try:
        stored = spark.read.parquet(maps)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return stored.filter(F.col("version") == stored.agg(F.max("version")).first()[0])


def next_map(slot_bytes: DataFrame, shards: int, maps: str, slots: int = SLOTS) -> DataFrame:
    """The last stored map, edited to the bytes of now and stored as its next version where a slot moves; the first is version 1.

    The map holds every slot, those without rows, too. A slot on a shard that is no more is dealt anew.
    """
    spark = slot_bytes.sparkSession
    sums = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(slot_bytes, "virtual_slot", "left").fillna(0)
    was, last = first_map(sums, shards), last_map(spark, maps)
    if last is not None:
        old = last.filter(F.col("shard") < shards).select("virtual_slot", F.col("shard").alias("kept"))
        was = was.join(old, "virtual_slot", "left").withColumn("shard", F.coalesce("kept", "shard")).drop("kept").withColumn("version", F.lit(last.first()["version"]))
    new = saved(rebalanced(was, shards))
    if last is not None and new.join(last.select("virtual_slot", F.col("shard").alias("kept")), "virtual_slot").filter("shard <> kept").isEmpty():
        return new.withColumn("version", F.col("version") - 1)
    new.select("virtual_slot", "shard", "version").write.mode("append").parquet(maps)
    return new


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """key, size, text_crc32, virtual_slot, shard, and slot: the row's place in its shard, without gaps.

    maps: the folder of the stored map, which is read and edited; without one, the map starts from version 0 and is not kept.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(said) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(said.cast("binary")).alias("text_crc32"))
    equal = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("n"))
    each = F.ceil(F.col("n") / PARTS)
    blocks = equal.withColumn("each", each).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("each")))))
    blocks = blocks.withColumn("rows", F.least(F.col("each"), F.col("n") - F.col("block") * F.col("each")))
    blocks = blocks.withColumn("virtual_slot", virtual_slot(F.col(key), F.col("text_crc32"), F.col("size"), F.col("block"), slots=slots))
    blocks = saved(blocks.select(key, "size", "text_crc32", "block", "rows", "virtual_slot"))
    sums = blocks.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("rows")).alias("bytes"), F.sum("rows").alias("rows"))
    slot_map = rebalanced(first_map(sums, shards), shards) if maps is None else next_map(sums, shards, maps, slots)
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slot_map = slot_map.withColumn("ahead", before(Window.partitionBy("shard").orderBy("virtual_slot")))
    inside = blocks.withColumn("inside", before(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size", "block")))
    placed = inside.join(slot_map.select("virtual_slot", "shard", "ahead", "version"), "virtual_slot").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    return placed.select(key, "size", "text_crc32", "shard", (F.col("ahead") + F.col("inside") + F.col("nth")).alias("slot"), "virtual_slot", F.col("version").alias("map_version"))
