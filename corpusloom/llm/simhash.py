"""SimHash near-dedup by covering locality-sensitive hashing.

Bit i of a fingerprint gets a nonzero vector m(i) of r + 1 bits. Each nonzero vector v makes a mask: the bits i with odd
<m(i), v>. r differing bits span at most r of the r + 1 dimensions, so some v is orthogonal to all of them: under its mask
the two fingerprints are equal. So every pair within radius r meets in one of the 2^(r+1) - 1 tables, for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, connected_components, fits, keep_least, materialize, text_chunks

RADIUS = 4
#: A bucket with more fingerprints than this is split by a second family of masks over the bits that are still free.
BUCKET = 8192
#: Fingerprints in more than one of HOT_SHARE rows are joined by broadcast.
HOT_SHARE = 2000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the 4-word shingles (A-Z lower-cased, repeats included): a bit is 1 if set in over half the hashes."""
    words = text.lower().split()  # ASCII white space only, as [^\x20\x09-\x0D]+
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    last = ends[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a : b - 1], seed) for a, b in zip(starts[:n], last, strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(returnType=T.LongType())
def text_fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in as_bytes(text)], dtype=np.uint64).view(np.int64), pa.int64())


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over the given bit positions, as signed 64-bit integers."""
    vectors = 2 ** (radius + 1) - 1
    masks = [sum(1 << b for i, b in enumerate(bits) if bin((i % vectors + 1) & v).count("1") % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def forest(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (a, b) within the radius that connect what is connected within this bucket, without emitting all pairs."""
    links, rest = [], found
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                reached = rest[near]
                links += [(int(x), int(y)) for y in reached]
                rest = rest[~near]
                frontier += list(reached)
    return links


def bucket_links(keyed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) inside the buckets of `keyed` (keys, fp); streams sorted buckets, one in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            cuts = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1
            edges = np.concatenate([[0], cuts])
            held = [rows[edges[-1] :]]
            yield from emit(rows, edges)
        if held:
            yield from emit(held[0], np.array([0, len(held[0])]))

    def emit(rows: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(edges)
        fps, links = np.ascontiguousarray(rows[:, -1]).view(np.uint64), []
        two = edges[:-1][sizes == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        pairs = np.stack([fps[near], fps[near + 1]], axis=1)
        for a, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            links += forest(fps[a : a + n], radius)
        if links:
            pairs = np.concatenate([pairs, np.array(links, dtype=np.uint64)])
        if len(pairs):
            yield pa.record_batch({"a": pairs.min(axis=1).view(np.int64), "b": pairs.max(axis=1).view(np.int64)})

    dealt = keyed.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def covering_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fps` (fp: long) whose components are those of all pairs within the radius.

    A bucket of over `bucket` fingerprints agrees on about half the bits. It is split by masks over the other bits, which
    cover the radius again; then a quarter of the bits is free, so that the parts are bounded whatever the input's size.
    """
    masks = covering_masks(list(range(64)), radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("x")).select("x.t", "x.key", "fp")
    hot = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("t", "key")
    hot = materialize(hot, "hot-buckets")
    if not hot.limit(1).count():
        return bucket_links(keyed, ["t", "key"], radius)
    hot = F.broadcast(hot) if fits(hot) else hot
    second = [covering_masks([b for b in range(64) if not m >> b & 1], radius) for m in masks]
    parts = F.arrays_zip(F.sequence(F.lit(0), F.lit(len(masks) - 1)).alias("u"), F.element_at(F.array(*[F.array(*[F.lit(x) for x in ms]) for ms in second]), (F.col("t") + 1).cast("int")).alias("mask"))
    split = keyed.join(hot, ["t", "key"]).select("t", "key", "fp", F.explode(parts).alias("x"))
    split = split.select("t", "key", F.col("x.u").cast("long").alias("u"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key2"), "fp")
    cool = keyed.join(hot, ["t", "key"], "left_anti")
    return bucket_links(cool, ["t", "key"], radius).unionByName(bucket_links(split, ["t", "key", "u", "key2"], radius)).distinct()


def labelled(docs: DataFrame, text: str, doc_id: str, radius: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (doc_id, fp) of each row, (fp, first: its least id), and (node, root) of the fingerprints with links."""
    rows = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_fingerprint(F.col(f"`{text}`")).alias("fp")), "fingerprints")
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    labels = materialize(connected_components(materialize(covering_links(first.select("fp"), radius, bucket), "links"), "components"), "labels")
    return rows, first, labels


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that is reachable by
    links of `radius` differing bits or fewer.

    Null and empty texts have the fingerprint zero and are linked like others. A null id is skipped when the smallest is
    taken; a component of null ids has a null component_id. Repeated rows stay. Other columns are ignored.
    """
    rows, first, labels = labelled(docs, text, doc_id, radius, bucket)
    linked = first.join(labels, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = first.join(labels.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "fp", "left")
    of_fp = materialize(of_fp.select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "classes")
    # a fingerprint of many rows isn't joined in one task; no more than HOT_SHARE fingerprints can have as many
    many = of_fp.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(of_fp.where(F.col("n") * HOT_SHARE > many).select("fp", "component_id"))
    joined = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(of_fp.select("fp", "component_id"), "fp"))
    return joined.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: one with the smallest id, of these with the least fingerprint.
    Rows with a null id in a component that has other ids go; of each component without ids, one row stays."""
    rows, first, labels = labelled(docs, text, doc_id, radius, BUCKET)
    nodes = first.join(labels, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), F.col("first").alias("doc_id"), F.col("fp").alias("key"))
    return keep_least(docs, rows.withColumnRenamed("fp", "key"), nodes, text_fingerprint, text, doc_id)
