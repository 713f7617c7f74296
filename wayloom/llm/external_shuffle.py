"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters the records uniformly into buckets that fit into memory, by a
seeded hash of their whole content: one exchange. Pass 2 gathers a bucket, brings
it into a fixed order, and Fisher-Yates shuffles it with a seeded generator. There
is a partition for each bucket; where this would be more than MOST_PARTITIONS, so
that the driver's table of shuffle blocks would grow too large, a partition holds
several smaller buckets, sorted one after the other, of which an aggregation holds
128 at most at a time. The records, numbered through all buckets, are dealt out to
the shards in turn, so the law is `rows`: the shards' counts are at most one apart,
and slots have no gaps. write_shards writes each shard in the order of its slots.

Records that are equal in all columns are interchangeable. Where there are more
of them than the 100,000th part of all (and than HOT_ROWS), they are counted
instead of scattered, and written again from the count with numbers, which are
hashed too; so no bucket gets a hot record as a whole, and at most 100,000 hashes
are broadcast. A bucket's place depends on content, seed and bucket count alone:
reruns and retried tasks agree.

Cases: nulls are hashed as such; an empty table gives an empty result; columns
shard and slot are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES, SMALL_BUCKET_BYTES = 24 << 20, 4 << 20
MOST_PARTITIONS = 16_384  # so that the driver's table of shuffle blocks stays small
HOT_ROWS, MOST_HOT = 1000, 100_000
COPIES = 10_000  # rows written again by one task's row


def shuffle_into_shards(df: DataFrame, size: Column, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (place in the shard); size: a record's bytes, for the bucket count."""
    df = df.drop("shard", "slot")
    content = [F.col(f"`{f.name}`") for f in df.schema.fields]
    total, rows = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // bucket_bytes))
    if buckets > MOST_PARTITIONS:
        buckets = -(-total // min(bucket_bytes, SMALL_BUCKET_BYTES))
    parts = min(buckets, MOST_PARTITIONS)
    hashed = df.select(F.xxhash64(F.lit(seed), *content).alias("·h"), F.struct(*content).alias("·r"))
    numbered = spread(hashed, max(hot_rows, rows // MOST_HOT))
    # Two hashes order a bucket: records that agree in both and in their number are equal.
    keyed = numbered.select(F.xxhash64("·h", "·k").alias("·x"), F.xxhash64(F.lit(seed + 1), "·r").alias("·y"), "·k", "·r").withColumn("·b", F.pmod("·x", F.lit(buckets))).withColumn("·p", F.pmod("·b", F.lit(parts)).cast("int"))
    dealt = keyed.repartitionById(parts, F.col("·p"))
    if parts < buckets:  # the generator goes on from bucket to bucket, so these need an order
        dealt = dealt.sortWithinPartitions("·b")
    gathered = dealt.groupBy("·p", "·b").agg(F.sort_array(F.collect_list(F.struct("·x", "·y", "·k", "·r"))).alias("·a"))
    earlier = Window.orderBy("·p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = keyed.groupBy("·p").count().select("·p", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("·o"))
    before = Window.partitionBy("·p").orderBy("·b").rowsBetween(Window.unboundedPreceding, -1)
    counted = gathered.withColumn("·n", F.coalesce(F.sum(F.size("·a")).over(before), F.lit(0)))
    mixed = counted.join(F.broadcast(offsets), "·p").select((F.col("·o") + F.col("·n")).alias("·s"), F.posexplode(F.shuffle("·a", seed)).alias("·i", "·e"))
    place = F.col("·s") + F.col("·i")
    return mixed.select("·e.·r.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def spread(hashed: DataFrame, most: int) -> DataFrame:
    """(·h, ·r, ·k): the records, those equal to more than most others numbered by ·k, which is 0 elsewhere."""
    hot = hashed.groupBy("·h").agg(F.count("*").alias("·n")).filter(F.col("·n") > most).select("·h")
    plain = hashed.join(F.broadcast(hot), "·h", "left_anti").withColumn("·k", F.lit(0).cast("long"))
    counted = hashed.join(F.broadcast(hot), "·h", "left_semi").groupBy("·h", "·r").agg(F.count("*").alias("·n"))
    starts = counted.select("·h", "·r", "·n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("·n") - 1, F.lit(COPIES).cast("long"))).alias("·s"))
    dealt = starts.repartition(F.col("·h"), F.col("·s"))
    again = dealt.select("·h", "·r", F.explode(F.sequence(F.col("·s"), F.least(F.col("·n"), F.col("·s") + COPIES) - 1)).alias("·k"))
    return plain.unionByName(again)


def write_shards(sharded: DataFrame, path: str, files: int | None = None) -> None:
    """Write each shard as a folder shard=<n> of Parquet files, which hold following ranges of slots, each in order."""
    spark = sharded.sparkSession
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
