"""What the operators of this subpackage share: shared scratch tables, checked broadcasts, prefix sums, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: The most bytes (as JSON) of a side that is broadcast; a larger side is joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 4 << 20
#: Rows of such a piece at most, for texts that are short or empty.
CHUNK_ROWS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir. A local session (tests)
    may do without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it once the results that were derived from them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(side: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether a written side is small enough to be broadcast, by the bytes of all its values."""
    n = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return n <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def sized(side: DataFrame, label: str, max_bytes: int | None = None) -> DataFrame:
    """A written side, marked for broadcast only if its measured size allows."""
    side = materialize(side, label)
    return F.broadcast(side) if fits(side, max_bytes) else side


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def place(df: DataFrame, name: str) -> int:
    """Where a column stands; names match in any case, as Spark's do."""
    return [c.lower() for c in df.columns].index(name.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exclusive_prefix(df: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add the sum of `value` over all smaller `key`s (distinct, not negative) in two levels: no window holds more than
    `block` keys, apart from one over the block totals."""
    b = fresh(df, "block")
    df = df.withColumn(b, F.floor(F.col(key) / block))
    totals = df.groupBy(b).agg(F.sum(value).alias("total"))
    before = W.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(b, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy(b).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(totals, b).withColumn(out, (F.col(out) + F.col("base")).cast("long")).drop(b, "base")


def give_back() -> None:
    """Hand memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def give_back_heap(spark: SparkSession) -> None:
    """Have the executors' JVMs collect garbage, so that they hand heap that is free to the system: a heap that an earlier
    step made grow stays that large otherwise, beside the Python workers of the next. A task for each core; an executor
    that gets none keeps its heap. Results don't depend on it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def text_chunks(batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut or join record batches so that each piece has about max_bytes of text, and CHUNK_ROWS rows at most; whole rows,
    in order, none dropped. At the end the worker gives free memory back, as it may stay idle for a while."""
    held: list[pa.RecordBatch] = []
    total = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes or rows == CHUNK_ROWS:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held, start, total, rows = [], i, 0, 0
            total += int(n)
            rows += 1
        held.append(batch.slice(start))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)
    held.clear()
    give_back()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame, label: str, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long): root is the smallest node reachable.

    Alternating large-star and small-star passes; each is one aggregation and one join, and is written to the shared
    folder, so the plan doesn't grow. Stops when a round changes nothing; fails if max_rounds didn't suffice.
    """
    def star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs, least

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    was = state(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both, least = star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs, least = star(materialize(large, label))
        small = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        if (state_now := state(now)) == was:
            break
        was = state_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def keep_least(docs: DataFrame, rows: DataFrame, nodes: DataFrame, key_of: Callable[[Column], Column], text: str, doc_id: str) -> DataFrame:
    """The row of `docs` for the least (doc_id, key), null ids last, of each root in `nodes` (root, doc_id, key), with all
    columns; one of several rows that share both. `rows` has (doc_id, key) of every row, key_of(text) makes a key again.

    Rows whose id one row has stay unless it is among the ids that go, which are broadcast if they fit; keys are made again
    only for rows without an id or with a shared one."""
    least = nodes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    k, x, i, f = (fresh(docs, c) for c in ("least_id", "least_key", "own_id", "own_key"))
    least = materialize(least.select(F.col("x.doc_id").alias(k), F.col("x.key").alias(x)), "kept")
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(i))
    shared = sized(shared, "shared-ids")
    names = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.withColumn(i, F.col(f"`{doc_id}`"))
    once = least.where(F.col(k).isNotNull()).join(shared, F.col(k) == F.col(i), "left_anti").select(F.col(k).alias(i))
    lost = materialize(rows.where("doc_id is not null").select(F.col("doc_id").alias(i)).join(once, i, "left_anti").distinct(), "lost")
    if fits(lost):
        kept = docs.where(F.col(i).isNotNull()).join(F.broadcast(lost), i, "left_anti").select(names)
    else:
        kept = docs.join(sized(once, "kept-once"), i, "left_semi").select(names)
    again = least.where(F.col(k).isNull()).unionByName(least.join(shared, F.col(k) == F.col(i), "left_semi"))
    again = materialize(again, "kept-by-key")
    if not again.limit(1).count():
        return kept
    again = F.broadcast(again) if fits(again) else again
    unsure = docs.where(F.col(i).isNull()).unionByName(docs.join(shared, i, "left_semi").select(docs.columns))
    unsure = unsure.withColumn(f, key_of(F.col(f"`{text}`")))
    unsure = unsure.join(again, F.col(i).eqNullSafe(F.col(k)) & (F.col(f) == F.col(x)), "left_semi")
    return kept.unionByName(unsure.dropDuplicates([i, f]).select(names))


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The frame's schema without the named fields, then these."""
    new = {name.lower() for name, _ in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + [T.StructField(n, t) for n, t in fields])
