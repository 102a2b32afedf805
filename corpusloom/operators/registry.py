"""The registry of documents that stages have taken: one row for each content, and no token sequence twice.

A table of COLUMNS. What changes it returns a new table; `commit` writes that beside the old one, and readers follow a
pointer, so that they see a whole state always. One writer at a time (the driver's lock).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("content_sha256", "token_ids_sha256", "stage_id", "purpose", "language", "split", "source_id", "document_index", "token_start", "token_end")
SCHEMA = ", ".join(f"{c} {'long' if c in ('document_index', 'token_start', 'token_end') else 'string'}" for c in COLUMNS)
KEYS = ("content_sha256", "token_ids_sha256")


class OverlapError(ValueError):
    """A document that another stage has."""


def rest(key: str, prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in COLUMNS if c != key])


def lookup(registry: DataFrame, rows: DataFrame, key: str = "content_sha256") -> DataFrame:
    """rows (with key and stage_id) with found_stage and reason: duplicate_within_stage, overlap_registry (content) or
    token_sequence_overlap (tokens) of another stage, or null."""
    known = registry.select(F.col(key).alias("_key"), F.col("stage_id").alias("found_stage"))
    other = "overlap_registry" if key == "content_sha256" else "token_sequence_overlap"
    j = rows.join(known, F.col(key) == F.col("_key"), "left").drop("_key")
    return j.withColumn("reason", F.when(F.col("found_stage") == F.col("stage_id"), "duplicate_within_stage").when(F.col("found_stage").isNotNull(), other))


def conflicts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, column): columns in which two registries' rows of one key differ, null-safe, over all ten."""
    l = left.select(F.col(key), *[F.col(c).alias(f"l_{c}") for c in COLUMNS if c != key])
    r = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in COLUMNS if c != key])
    differ = F.filter(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in COLUMNS if c != key]), lambda x: x.isNotNull())
    return l.join(r, key).select(key, F.explode(differ).alias("column"))


def fresh_rows(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose content and tokens the registry doesn't have; of rows that share either, the first by document_index."""
    new = rows.join(registry.select("content_sha256"), "content_sha256", "left_anti").join(registry.select("token_ids_sha256"), "token_ids_sha256", "left_anti")
    for key in KEYS:
        least = new.groupBy(key).agg(F.min(F.struct("document_index", "stage_id")).alias("_least"))
        new = new.join(least, key).where(F.col("_least") == F.struct("document_index", "stage_id")).drop("_least")
    return new.select(*COLUMNS)


def register(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with rows added. Those that their own stage has already are left out; a content or token sequence of
    another stage is an OverlapError."""
    for key in KEYS:
        hit = lookup(registry, rows, key).where("reason is not null and reason <> 'duplicate_within_stage'").select(key, "found_stage").first()
        if hit:
            raise OverlapError(f"{key} {hit[0]} belongs to stage {hit[1]}")
    return registry.unionByName(fresh_rows(registry, rows))


def insert_checked(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with rows added that the accept loop has checked; a key that exists, or comes twice, is an error."""
    for key in KEYS:
        twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
        if hit := rows.join(registry.select(key), key, "left_semi").select(key).unionByName(twice).first():
            raise OverlapError(f"{key} {hit[0]} is registered already")
    return registry.unionByName(rows.select(*COLUMNS))


def merge_lanes(lanes: list[DataFrame], stages: list[str]) -> tuple[DataFrame, int]:
    """The union of independent lanes' rows of the wanted stages (superseded ones stay out), and their number. Lanes must
    not disagree on a content or a token sequence, and no row may get lost."""
    rows = lanes[0].select(*COLUMNS)
    for lane in lanes[1:]:
        rows = rows.unionByName(lane.select(*COLUMNS))
    rows = rows.where(F.col("stage_id").isin(list(stages))).distinct()
    for key in KEYS:
        if hit := rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").first():
            raise OverlapError(f"lanes disagree on {key} {hit[0]}")
    return rows, rows.count()


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregation that combines before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_row")).select(key, "_row.*").select(rows.columns)


def stage_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("stage_id").agg(F.count("*").alias("n"), F.countDistinct("content_sha256").alias("hashes"), F.max("document_index").alias("last_index"))


def stage_pivot(registry: DataFrame, stages: list[str]) -> DataFrame:
    """One scan: a row for each language, a column for each stage."""
    return registry.groupBy("language").agg(*[F.count_if(F.col("stage_id") == s).alias(s) for s in stages])


def truncated(registry: DataFrame, stage: str, keep: int) -> DataFrame:
    """Without the stage's rows from document_index `keep` on."""
    return registry.where(~((F.col("stage_id") == stage) & (F.col("document_index") >= keep)))


def recovered(registry: DataFrame, boundaries: DataFrame, stage: str) -> DataFrame:
    """The registry with the stage's boundaries that it lacks (they follow what it has), or without those that the
    boundaries don't reach: both end at the same document."""
    have = registry.where(F.col("stage_id") == stage).count()
    want = boundaries.count()
    if want < have:
        return truncated(registry, stage, want)
    return insert_checked(registry, boundaries.where(F.col("document_index") >= have))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def commit(registry: DataFrame, root: str) -> None:
    """Write a new state in the shared folder, then point to it."""
    spark = registry.sparkSession
    name = f"state-{uuid.uuid4().hex}"
    registry.write.parquet(f"{root.rstrip('/')}/{name}")
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part, pointer = fs_path(f"{root.rstrip('/')}/{name}.pointer"), fs_path(f"{root.rstrip('/')}/current.json")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"state": name}).encode()))
    out.close()
    fs.delete(pointer, False)
    if not fs.rename(part, pointer):
        raise OSError(f"pointer of {root} could not be moved")


def opened(spark: SparkSession, root: str) -> DataFrame:
    """The state that was committed last; an empty registry where none was."""
    path = f"{root.rstrip('/')}/current.json"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return empty(spark)
    state = json.loads(spark.read.text(path, wholetext=True).first()[0])["state"]
    return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/{state}")
