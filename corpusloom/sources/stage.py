"""A materialised stage: token shards, boundaries and a manifest, written, checked and read.

The manifest comes last and at once, so that a stage without one is no stage: an interrupted run is simply run again, and
gives the same bytes. Shards are Parquet rows (p: place in the stream, body: uint32 tokens) below shard_index=i; a row
never crosses a shard or a document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.values import ConfigError, canonical, fingerprint, plain, utc_now
from ..functions.hashing import EOS, token_bytes, token_slice
from ..operators.corpus import accept_reasons, budget_outcome, capped, fragments, merged_counts, pack_to_budget, purpose_counts, select_documents, validity
from ..operators.metrics import two_level_digest
from ..operators.prefix import blocked
from ..plans.budget import resolve, stage_bytes_of

VERSION = 1
BOUNDARY = "document_index long, source_id string, content_sha256 string, token_ids_sha256 string, token_start long, content_token_count long, token_end long, eos_after boolean, truncated boolean, split string"
BOUNDARY_COLUMNS = [x.split()[0] for x in BOUNDARY.split(", ")]
SHARD = "shard_index long, p long, body binary"
#: What identifies the data: everything but times and counters that depend on how a run went.
ORDERED = ("dataset", "stage", "tokenizer", "selection", "reader", "token_count", "target_token_count", "shards", "boundaries")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file through Spark's file system, whole or not at all."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be put in place")


def get_text(spark: SparkSession, path: str) -> str | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def shard_digests(shards: DataFrame) -> DataFrame:
    """(shard_index, token_count, bytes, most, sha256) of rows (shard_index, p, body): a shard's rows pass one task in
    order and are hashed as they come, so that memory doesn't grow with the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n, most = None, hashlib.sha256(), 0, -1

        def done() -> pa.RecordBatch:
            return pa.record_batch({"shard_index": [now], "token_count": [n], "bytes": [4 * n], "most": pa.array([most], pa.int64()), "sha256": [h.hexdigest()]})

        for b in batches:
            for shard, body in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, h, n, most = shard, hashlib.sha256(), 0, -1
                raw = body.as_py()
                h.update(raw)
                n += len(raw) // 4
                most = max(most, int(np.frombuffer(raw, "<u4").max())) if raw else most
        if now is not None:
            yield done()

    dealt = shards.select("shard_index", "p", "body").repartition("shard_index").sortWithinPartitions("shard_index", "p")
    return dealt.mapInArrow(run, "shard_index long, token_count long, bytes long, most long, sha256 string")


def boundaries_of(packed: DataFrame, identity: str = "source_id") -> DataFrame:
    return packed.select(
        "document_index", F.col(identity).cast("string").alias("source_id"), F.col("content").alias("content_sha256"), F.col("tok_sha").alias("token_ids_sha256"),
        "token_start", "content_token_count", "token_end", F.lit(True).alias("eos_after"), "truncated", "split",
    )


def build_manifest(spark: SparkSession, path: str, config: Mapping[str, Any], counts: Mapping[str, Any]) -> dict[str, Any]:
    """The manifest of the tokens and boundaries that are written below path."""
    shards = sorted((r.asDict() for r in shard_digests(read_shards(spark, path)).collect()), key=lambda r: r["shard_index"])  # one small row a shard
    b = read_boundaries(spark, path)
    records, digest = b.count(), two_level_digest(b.withColumn("record", F.to_json(F.struct(*BOUNDARY_COLUMNS))), "document_index", "record").first()
    total, length = sum(s["token_count"] for s in shards), config["reader"]["sequence_length"]
    out = {k: plain(config[k]) for k in ("dataset", "stage", "tokenizer", "selection", "reader")} | {
        "version": VERSION, "complete": True, "shards": shards, "token_count": total, "target_token_count": total // length * (length - 1),
        "adjacent_target_token_count": max(total - 1, 0), "hit_output_token_cap": total == config["selection"]["max_output_tokens"],
        "boundaries": {"record_count": records, "sha256": digest["digest"] if digest else hashlib.sha256(b"").hexdigest()},
        "accepted_document_count": records, "rejection_counts": dict(sorted(counts.items())), "config_sha256": fingerprint(semantic(config)), "finished_at": utc_now(),
    }
    return signed(out)


def signed(manifest: dict[str, Any]) -> dict[str, Any]:
    """With the hash of what identifies the data, and that of the whole manifest."""
    out = {k: v for k, v in manifest.items() if k != "manifest_content_sha256"}
    out["ordered_data_sha256"] = fingerprint({k: out[k] for k in ORDERED})
    return out | {"manifest_content_sha256": fingerprint(out)}


def load_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    text = get_text(spark, f"{path}/manifest.json")
    if text is None:
        raise ConfigError(f"no stage at {path}")
    m = json.loads(text)
    if m.get("version") != VERSION or m.get("complete") is not True:
        raise ConfigError("manifest is of another version, or not complete")
    if m.get("manifest_content_sha256") != fingerprint({k: v for k, v in m.items() if k != "manifest_content_sha256"}):
        raise ConfigError("manifest was changed")
    return m


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(f"{path}/tokens")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOUNDARY).json(f"{path}/boundaries")


def semantic(config: Mapping[str, Any]) -> dict[str, Any]:
    """What decides the data; how fast or long a run may be doesn't."""
    return {k: ({a: b for a, b in v.items() if a not in ("max_runtime_seconds", "checkpoint_every")} if isinstance(v, Mapping) else v) for k, v in config.items()}


def check_extension(old: Mapping[str, Any], config: Mapping[str, Any]) -> None:
    """A stage may be built again only from the same configuration or with larger caps: what was accepted stays its beginning."""
    caps = ("max_input_documents", "max_output_tokens")
    new = semantic(config)
    same = {k: v for k, v in new["selection"].items() if k not in caps} == {k: v for k, v in old["selection"].items() if k not in caps + ("max_runtime_seconds", "checkpoint_every")}
    if not same or any(plain(new[k]) != old[k] for k in ("dataset", "stage", "tokenizer", "reader")) or any(new["selection"][c] < old["selection"][c] for c in caps):
        raise ConfigError("a stage can only be extended by larger caps")


def estimate(config: Mapping[str, Any]) -> dict[str, Any]:
    """What a run would need, before anything is read."""
    s = config["selection"]
    return resolve(s["max_output_tokens"], config["reader"]["sequence_length"]) | {"bytes": stage_bytes_of(s["max_output_tokens"], s["max_input_documents"])}


def materialise(rows: DataFrame, path: str, config: Mapping[str, Any], registered: DataFrame | None = None, registered_tokens: DataFrame | None = None, progress: Callable[..., None] | None = None) -> dict[str, Any]:
    """Select, reject, pack and write a stage of byte tokens, and return its manifest. A complete stage of the same
    configuration is returned as it is. rows: an ordinal, an identity and a text (selection names them)."""
    spark, s = rows.sparkSession, config["selection"]
    say = progress or (lambda event, **_: None)
    if get_text(spark, f"{path}/manifest.json") is not None:
        old = load_manifest(spark, path)
        if old["config_sha256"] == fingerprint(semantic(config)):
            say("complete", tokens=old["token_count"])
            return old
        check_extension(old, config)
    wanted = {"continual_train": "train", "language_validation": "validation", "inspection": None}[config["stage"]["purpose"]]
    rows = capped(rows, s["ordinal"], s["max_input_documents"])
    text = F.col(s["text"])
    invalid = rows.groupBy(validity(text).alias("reason")).agg(F.count("*").alias("n")).where("reason is not null")
    both = select_documents(rows.withColumn("text", text), "text", s["identity"], s["order_seed"], s["split_seed"], s["validation_permyriad"], None)
    chosen = both if wanted is None else both.where(F.col("split") == wanted)
    reasons = accept_reasons(chosen.select(F.col(s["identity"]).alias("source_id"), "text", "content", "split", "ord"), registered, s.get("max_token_id"), registered_tokens)
    cap = s["max_output_tokens"]
    outcome = budget_outcome(reasons, cap).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    counts = {r["reason"]: r["n"] for r in merged_counts(invalid, purpose_counts(both, wanted), outcome).collect()}  # a row a reason
    say("selected", rejected=counts)
    packed = pack_to_budget(reasons.where("reason is null"), cap)
    boundaries_of(packed).write.mode("overwrite").json(f"{path}/boundaries")
    parts = fragments(packed, s["max_shard_tokens"], token_bytes(F.col("text"))).withColumnRenamed("part", "shard_index")
    parts.repartitionByRange("shard_index", "p").sortWithinPartitions("shard_index", "p").write.mode("overwrite").partitionBy("shard_index").parquet(f"{path}/tokens")
    say("written")
    m = build_manifest(spark, path, config, counts)
    if config["stage"].get("require_exact_output_tokens") and not m["hit_output_token_cap"]:
        raise ConfigError(f"{m['token_count']} of {cap} tokens: the stage must be filled exactly")
    put_text(spark, f"{path}/manifest.json", json.dumps(m, sort_keys=True))
    say("complete", tokens=m["token_count"])
    return m


def manifest_violations(m: Mapping[str, Any], tokenizer_sha256: str | None = None) -> list[tuple[str, str]]:
    """Rules that the manifest alone decides."""
    t, out = m["tokenizer"], []
    broken = lambda rule, detail="": out.append((rule, str(detail)))
    if m["ordered_data_sha256"] != fingerprint({k: m[k] for k in ORDERED}):
        broken("ordered_data_hash", m["ordered_data_sha256"])
    if tokenizer_sha256 is not None and t.get("sha256") != tokenizer_sha256:
        broken("tokenizer_identity", t.get("sha256"))
    sizes = [t.get(k) for k in ("base_vocab_size", "effective_vocab_size", "embedding_rows")]
    if any(type(x) is not int or x <= 0 for x in sizes):
        broken("vocabulary_size", sizes)
    most, rows = t.get("max_emitted_id"), t.get("embedding_rows")
    if type(most) is not int or type(rows) is not int or not 0 <= most < rows:
        broken("max_id_beyond_embedding", most)
    elif t.get("unused_tail") != rows - most - 1:
        broken("unused_tail", t.get("unused_tail"))
    if [s["shard_index"] for s in m["shards"]] != list(range(len(m["shards"]))):
        broken("shard_order")
    total = sum(s["token_count"] for s in m["shards"])
    if total <= 0:
        broken("no_tokens")
    if total != m["token_count"]:
        broken("token_count", m["token_count"])
    length = m["reader"]["sequence_length"]
    if length <= 1:
        broken("sequence_length", length)
    elif m["target_token_count"] != total // length * (length - 1):
        broken("target_token_count", m["target_token_count"])
    if m["adjacent_target_token_count"] != max(total - 1, 0):
        broken("adjacent_target_token_count", m["adjacent_target_token_count"])
    hit = total == m["selection"]["max_output_tokens"]
    if m["hit_output_token_cap"] is not hit:
        broken("cap_status", m["hit_output_token_cap"])
    if m["stage"].get("require_exact_output_tokens") and not hit:
        broken("underfilled", total)
    if m["accepted_document_count"] != m["boundaries"]["record_count"]:
        broken("document_count", m["accepted_document_count"])
    return out


def boundary_rules(b: DataFrame, shards: DataFrame, total: int, eos: int = EOS) -> DataFrame:
    """(rule, document_index) of records that break a rule of their own, of their place, or of the tokens they point to."""
    ends = shards.select((F.col("p") + F.octet_length("body") / 4).cast("long").alias("_end_at"), F.expr("right(hex(body), 8)").alias("_last"))
    d = blocked(b, [], "document_index", lags={"_end": "token_end", "_i": "document_index"}).join(ends, F.col("token_end") == F.col("_end_at"), "left")
    sha = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    last = eos.to_bytes(4, "little").hex().upper()
    rules = {
        "index_not_dense": F.col("document_index") != F.coalesce("_i", F.lit(-1)) + 1, "not_contiguous": F.col("token_start") != F.coalesce("_end", F.lit(0)),
        "empty_or_inverted": F.col("token_end") <= F.col("token_start"), "beyond_tokens": F.col("token_end") > total, "no_content": F.col("content_token_count") <= 0,
        "wrong_length": F.col("token_end") - F.col("token_start") != F.col("content_token_count") + 1, "eos_flag": ~F.coalesce("eos_after", F.lit(False)),
        "truncated_flag": F.col("truncated").isNull(), "unknown_split": ~F.coalesce(F.col("split").isin("train", "validation"), F.lit(False)),
        "no_source_id": F.coalesce("source_id", F.lit("")) == "", "content_hash_format": sha("content_sha256"), "token_hash_format": sha("token_ids_sha256"),
        "no_eos_token": F.coalesce("_last", F.lit("")) != last,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())
    return d.select(F.explode(found).alias("rule"), "document_index")


def violations(m: Mapping[str, Any], shards: DataFrame, boundaries: DataFrame, tokenizer_sha256: str | None = None) -> DataFrame:
    """(rule, detail) of everything that is wrong with a stage; empty: it is valid."""
    spark = shards.sparkSession
    own = spark.createDataFrame(manifest_violations(m, tokenizer_sha256), "rule string, detail string")
    said = spark.createDataFrame([(s["shard_index"], s["token_count"], s["sha256"]) for s in m["shards"]], "shard_index long, said_count long, said_sha string")
    most = m["tokenizer"].get("max_emitted_id") or 0
    s = said.join(shard_digests(shards), "shard_index", "full")
    rules = {
        "shard_missing": F.col("token_count").isNull(), "shard_unknown": F.col("said_count").isNull(), "shard_size": F.col("token_count") != F.col("said_count"),
        "shard_checksum": F.col("sha256") != F.col("said_sha"), "token_id_out_of_range": F.col("most") > most,
    }
    found = lambda r: F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in r.items()]), lambda x: x.isNotNull())).alias("rule")
    of_shards = s.select(found(rules), F.concat(F.lit("shard "), "shard_index").alias("detail"))
    of_records = boundary_rules(boundaries, shards, m["token_count"]).select("rule", F.concat(F.lit("document "), "document_index").alias("detail"))
    sums = boundaries.agg(F.count("*").alias("n"), F.max("token_end").alias("e"))
    whole = {"record_count": F.col("n") != m["boundaries"]["record_count"], "not_covered": F.coalesce("e", F.lit(0)) != m["token_count"]}
    digest = two_level_digest(boundaries.withColumn("record", F.to_json(F.struct(*BOUNDARY_COLUMNS))), "document_index", "record")
    changed = digest.where(F.col("digest") != m["boundaries"]["sha256"]).select(F.lit("boundary_checksum").alias("rule"), F.col("digest").alias("detail"))
    return own.unionByName(of_shards).unionByName(of_records).unionByName(sums.select(found(whole), F.lit("boundaries").alias("detail"))).unionByName(changed)


def read_tokens(shards: DataFrame, start: int, n: int) -> bytes:
    """n tokens from a place in the stream, across shards; the caller bounds n."""
    at, size = F.col("p"), (F.octet_length("body") / 4).cast("long")
    rows = shards.where((at < start + n) & (at + size > start)).select("p", "body").orderBy("p").collect()
    out = b"".join(bytes(r["body"])[4 * max(0, start - r["p"]) : 4 * max(0, start + n - r["p"])] for r in rows)
    if len(out) != 4 * n:
        raise ValueError(f"the stream has no {n} tokens at {start}")
    return out


def read_sequences(shards: DataFrame, length: int, first: int = 0, end: int | None = None) -> DataFrame:
    """(seq_id, ids) of the complete sequences first..end (exclusive; none: all)."""
    size = (F.octet_length("body") / 4).cast("long")
    rows = shards.select("p", "body", size.alias("n"))
    rows = rows.where((F.col("p") + F.col("n") > first * length) & (F.lit(True) if end is None else F.col("p") < end * length))
    rows = rows.select("*", F.explode(F.sequence(F.expr(f"p div {length}"), F.expr(f"(p + n - 1) div {length}"))).alias("seq_id"))
    a, b = F.greatest(F.col("p"), F.col("seq_id") * length), F.least(F.col("p") + F.col("n"), (F.col("seq_id") + 1) * length)
    part = rows.select("seq_id", F.struct(a.alias("a"), token_slice(F.col("body"), a - F.col("p"), b - a).alias("s")).alias("part"))
    ids = F.aggregate(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["s"]), F.lit(b""), lambda x, y: F.concat(x, y))
    out = part.groupBy("seq_id").agg(ids.alias("ids")).where(F.octet_length("ids") == 4 * length)
    return out.where(F.col("seq_id") >= first) if end is None else out.where((F.col("seq_id") >= first) & (F.col("seq_id") < end))


def dealt(sequences: DataFrame, first: int, batch: int, world: int, micro: int) -> DataFrame:
    """Sequences from `first` on, with batch_id, place in the batch, the rank that takes it, place at the rank and micro
    batch. Batches are full but for the last; a rank may have none of it."""
    d = sequences.withColumn("_i", F.col("seq_id") - first).where("_i >= 0")
    size = d.groupBy(F.expr(f"_i div {batch}").alias("batch_id")).agg(F.count("*").alias("_size"))
    d = d.withColumn("batch_id", F.expr(f"_i div {batch}")).withColumn("place", F.col("_i") % batch).join(size, "batch_id")
    # rank r has [size * r / world, size * (r + 1) / world): the inverse of that floor
    rank = F.expr(f"((place + 1) * {world} - 1) div _size")
    local = F.col("place") - F.expr(f"_size * rank div {world}")
    return d.withColumn("rank", rank).withColumn("local", local).withColumn("micro_batch", F.expr(f"local div {micro}")).drop("_i", "_size")


def position(shards: list[int], offset: int) -> tuple[int, int]:
    """(shard, offset in it) of a place in the stream, for shards of the given sizes; the end is (number of shards, 0)."""
    for i, n in enumerate(shards):
        if offset < n:
            return i, offset
        offset -= n
    if offset:
        raise ValueError("beyond the end")
    return len(shards), 0


def view_identity(source: str, first: int, end: int) -> str:
    """The identity of a window of sequences of a frozen source."""
    return fingerprint({"source": source, "sequence_start": first, "sequence_end": end})


def identity_faults(m: Mapping[str, Any], **expected: Any) -> list[str]:
    """Fields (stage.language and so on) in which a manifest isn't what a consumer expects."""
    out = []
    for name, want in expected.items():
        have: Any = m
        for part in name.split("__"):
            have = have.get(part) if isinstance(have, Mapping) else None
        if canonical(have) != canonical(want):
            out.append(name.replace("__", "."))
    return sorted(out)


def array_sequences(spark: SparkSession, tokens: list[int], length: int) -> DataFrame:
    """The same interface over tokens in memory."""
    raw = np.array(tokens, dtype="<u4").tobytes()
    return read_sequences(spark.createDataFrame([(0, 0, raw)], SHARD), length)


def opened_source(spark: SparkSession, mode: str, length: int, **args: Any) -> DataFrame:
    """Sequences of a packed stage (path, expected identity), of tokens in memory, or synthetic ones."""
    if mode == "packed":
        m = load_manifest(spark, args["path"])
        if faults := identity_faults(m, reader__sequence_length=length, **args.get("expected", {})):
            raise ConfigError(f"the stage isn't the expected one: {faults}")
        return read_sequences(read_shards(spark, args["path"]), length, args.get("first", 0), args.get("end"))
    if mode == "array":
        return array_sequences(spark, args["tokens"], length)
    if mode == "synthetic":
        return synthetic(spark, args["sequences"], length, args["vocabulary"], args["seed"])
    raise ConfigError(f"unknown mode {mode}")


def synthetic(spark: SparkSession, n: int, length: int, vocabulary: int, seed: int) -> DataFrame:
    """(seq_id, ids) of tokens that seed, sequence and place decide."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array([int.from_bytes(hashlib.sha256(f"{seed}:{i}:{j}".encode()).digest()[:4], "big") % vocabulary for j in range(length)], "<u4").tobytes() for i in b.column(0).to_pylist()]
            yield pa.record_batch({"seq_id": b.column(0), "ids": pa.array(rows, pa.binary())})

    return spark.range(n).mapInArrow(run, "seq_id long, ids binary")
