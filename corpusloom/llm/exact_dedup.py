"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; their groups are counted exactly, and the winners (a number
with a proven bound) are broadcast, so that copies in hot groups are decided map-side. All other digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import fresh, materialize

#: Counters of a Misra-Gries summary: digests in more than 2 / (COUNTERS + 1) of all rows are found for certain.
COUNTERS = 4096
#: Groups below this many copies are never treated as frequent.
MIN_COPIES = 32


@F.arrow_udf(returnType=T.BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased (bytes.lower() changes ASCII only); null counts as empty. Built-in
    translate and sha2 give the same, and took three times as long."""
    return pa.array([hashlib.sha256((t or b"").lower()).digest() for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def shrink(counts: Counter, k: int) -> Counter:
    """A Misra-Gries summary of k counters at most: subtract the (k+1)-th largest count, keep what is positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({d: n - cut for d, n in counts.items() if n > cut})


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, low): all digests with over 2n / (counters + 1) of the n rows, and counters + 1 rows at most.

    A partition's summary is short of the true count by n_i / (counters + 1) at most, their sum by n / (counters + 1);
    the sums add up to n at most, so no more than counters + 1 digests can reach that bound.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        rows = 0
        for batch in batches:
            kept.update(batch.column(0).to_pylist())
            rows += batch.num_rows
            kept = shrink(kept, counters)
        yield pa.record_batch({"digest": pa.array([*kept, None], pa.binary()), "low": pa.array([*kept.values(), rows], pa.int64())})

    parts = materialize(digests.select("digest").mapInArrow(summarise, "digest binary, low long"), "misra-gries")
    n = parts.where("digest is null").agg(F.sum("low")).first()[0] or 0
    low = parts.where("digest is not null").groupBy("digest").agg(F.sum("low").alias("low"))
    return low.where(F.col("low") >= n / (counters + 1)).orderBy(F.desc("low"), "digest").limit(counters + 1)


def heavy_winners(digests: DataFrame, counters: int = COUNTERS, min_copies: int = MIN_COPIES) -> DataFrame:
    """(digest, keep_id, group_size, n_top) of the frequent groups, counted exactly; n_top rows have the id that stays."""
    candidates = materialize(frequent_digests(digests, counters), "candidates")
    rows = digests.join(F.broadcast(candidates.select("digest")), "digest")
    exact = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where(F.col("group_size") >= min_copies)
    exact = materialize(exact, "verified")
    top = digests.join(F.broadcast(exact), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.count("*").alias("n_top"))
    return materialize(exact.join(top, "digest"), "winners")


def dedup_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS, min_copies: int = MIN_COPIES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest. The largest doc_id of equal texts stays.

    Null text counts as empty. A null id is less than any other; a group of null ids has keep_id null. Of rows that share
    text and id, one stays. Other columns, whatever their names, are ignored. No rows: no rows.
    """
    rows = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("digest")), "digests")
    winners = heavy_winners(rows, counters, min_copies)
    out = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    # of the others, too, only combined counts are shuffled by digest, and the rows are joined to them
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("n_top"),
    )
    groups = materialize(groups, "groups")
    lost = light.join(groups, "digest").unionByName(rows.join(F.broadcast(winners), "digest")).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    top = groups.unionByName(winners).select("*", F.col("keep_id").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_top"))).alias("copy"))
    return lost.withColumn("kept", F.lit(False)).select(out).unionByName(top.withColumn("kept", F.col("copy") == 1).select(out))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS, min_copies: int = MIN_COPIES) -> DataFrame:
    """The rows that stay, with all their columns; which these are, dedup_report says. Of rows alike in text and id any
    one stays. Copies in frequent groups never reach a shuffle."""
    d, rank = fresh(docs, "digest"), fresh(docs, "copy_rank")
    rows = docs.withColumn(d, text_digest(F.col(f"`{text}`")))
    ids = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("digest")), "digests")
    winners = heavy_winners(ids, counters, min_copies).select(F.col("digest").alias(d), F.col("keep_id").alias(fresh(docs, "keep_id")))
    keep = winners.columns[1]
    light = rows.join(F.broadcast(winners.select(d)), d, "left_anti")
    light = light.withColumn(rank, F.row_number().over(W.partitionBy(d).orderBy(F.col(f"`{doc_id}`").desc_nulls_last()))).where(F.col(rank) == 1)
    hot = rows.join(F.broadcast(winners), d).where(F.col(f"`{doc_id}`").eqNullSafe(F.col(keep))).dropDuplicates([d])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return light.select(names).unionByName(hot.select(names))
