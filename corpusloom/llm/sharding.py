"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters the records into memory-sized buckets by a seeded hash, one bucket to a partition; pass 2 gathers each
bucket, shuffles it with Spark's seeded Fisher-Yates `shuffle` and lays the buckets end to end. A record's place in that
sequence gives shard and slot, so shard counts are at most one apart and slots have no gaps. The generator's seed is the
given one and the partition's number, which is the bucket's: the order follows from seed and rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exclusive_prefix, fits, materialize, sized

#: Bytes of records that a bucket holds on average: at least and at most, and buckets in between.
BUCKET_BYTES, MOST_BYTES, BUCKETS = 8 << 20, 256 << 20, 4096
#: A bucket over this many times that size holds many equal rows, and is dealt out by copy number.
HOT = 4


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 8).cast("long")


def two_pass_shuffle(docs: DataFrame, n_shards: int = 24, seed: int = 20240601, bucket_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of `docs`, with size (long), shard (int) and slot (long) added or replaced.

    Law `rows`: shard counts differ by one at most, slots count from 0 without gaps. Nulls in any column are kept (null
    text: size 8). A bucket that is far too large can only hold many equal rows or one huge one: equal rows are counted
    (combined before the shuffle), their number is divided among further buckets, and only there they become rows again.
    No rows: no rows. Rows can hold any types but maps. The same rows and seed give the same shards and slots, however
    the rows are dealt over partitions.
    """
    taken = {"size", "shard", "slot"}
    rows = docs.select(
        F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"), record_size(text).alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]).alias("row"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    if bucket_bytes is None:
        bucket_bytes = max(BUCKET_BYTES, min(MOST_BYTES, total // BUCKETS))
    n = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(n)).cast("int"))
    buckets = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "buckets")
    hot = buckets.where(F.col("bytes") > HOT * bucket_bytes).select("bucket", F.ceil(F.col("bytes") / bucket_bytes).cast("long").alias("ways"))
    counts, placed, most = buckets.select("bucket", "n"), rows, n
    if hot.limit(1).count():
        # the parts of hot buckets are numbered after all others
        hot = materialize(exclusive_prefix(hot, "bucket", "ways", "ahead"), "hot-buckets")
        most = n + hot.agg(F.sum("ways")).first()[0]
        hot = F.broadcast(hot) if fits(hot) else hot
        copies = rows.join(hot, "bucket").groupBy("bucket", "ways", "ahead", "h", "size", "row").agg(F.count("*").alias("copies"))
        parts = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.least("ways", "copies") - 1)))
        share = F.expr("copies div ways") + (F.col("part") < F.col("copies") % F.col("ways")).cast("long")
        parts = parts.select((n + F.col("ahead") + F.pmod(F.pmod(F.col("h"), F.col("ways")) + F.col("part"), F.col("ways"))).cast("int").alias("bucket"), "h", "size", "row", share.alias("copies"))
        parts = parts.repartitionById(int(most), "bucket").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        counts = counts.join(hot, "bucket", "left_anti").unionByName(parts.groupBy("bucket").agg(F.count("*").alias("n")))
        placed = placed.join(hot, "bucket", "left_anti").unionByName(parts.select(placed.columns))
    counts = materialize(counts, "counts")
    offsets = sized(exclusive_prefix(counts, "bucket", "n", "before").select("bucket", "before"), "offsets")
    count = counts.agg(F.sum("n")).first()[0] or 0
    dealt = placed.select("bucket", F.struct("h", "size", "row").alias("r")).repartitionById(int(most), "bucket")
    gathered = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list("r")).alias("rs")).select("bucket", F.shuffle("rs", F.lit(seed)).alias("rs"))
    laid = gathered.join(offsets, "bucket").select("before", F.posexplode("rs").alias("pos", "r")).withColumn("g", F.col("before") + F.col("pos"))
    each, more = count // n_shards, count % n_shards
    head = more * (each + 1)
    in_head = F.col("g") < head
    shard = F.when(in_head, F.expr(f"g div {each + 1}")).otherwise(more + F.expr(f"(g - {head}) div {max(each, 1)}"))
    slot = F.when(in_head, F.col("g") % (each + 1)).otherwise((F.col("g") - head) % max(each, 1))
    return laid.select("r.row.*", F.col("r.size").alias("size"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as folders shard=i, as the second pass yields them: a bucket's rows lie in one shard, or in a few
    that follow each other, in the order of their slots. Nothing is shuffled again."""
    sharded.write.partitionBy("shard").parquet(path)
