import json
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom import queries as Q
from corpusloom.config.values import ConfigError
from corpusloom.operators import registry as R
from corpusloom.sources import stage as ST
from corpusloom.streaming import jobs as J


def config(**selection):
    return {
        "dataset": {"name": "fixture", "revision": "a" * 40},
        "stage": {"stage_id": "en-0", "purpose": "continual_train", "language": "en", "task_index": 0, "require_exact_output_tokens": True},
        "tokenizer": {"sha256": "b" * 64, "base_vocab_size": 256, "effective_vocab_size": 256, "embedding_rows": 256, "max_emitted_id": 255, "unused_tail": 0},
        "selection": {"ordinal": "i", "identity": "url", "text": "text", "max_input_documents": 128, "max_output_tokens": 512, "order_seed": 31, "split_seed": 41, "validation_permyriad": 100, "max_shard_tokens": 128, **selection},
        "reader": {"sequence_length": 8},
    }


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"https://example.test/{i}", f"ordered unique document {i:04d} " + "x" * 48) for i in range(128)], "i long, url string, text string")


def test_stage_is_complete_valid_and_read_by_place(spark, rows, tmp_path):
    path, seen = f"file://{tmp_path}/s", []
    m = ST.materialise(rows, path, config(), progress=lambda event, **_: seen.append(event))
    assert m == ST.load_manifest(spark, path) and seen == ["selected", "written", "complete"]
    assert m["token_count"] == 512 and m["hit_output_token_cap"] and [s["token_count"] for s in m["shards"]] == [128] * 4 and m["target_token_count"] == 448
    shards, b = ST.read_shards(spark, path), ST.read_boundaries(spark, path)
    assert ST.violations(m, shards, b, "b" * 64).count() == 0
    texts = {r["url"]: r["text"] for r in rows.collect()}
    stream = b"".join(np.array([*texts[r["source_id"]].encode()[: r["content_token_count"]], 255], "<u4").tobytes() for r in b.orderBy("document_index").collect())
    assert ST.read_tokens(shards, 0, 512) == stream and ST.read_tokens(shards, 120, 20) == stream[480:560]
    with pytest.raises(ValueError):
        ST.read_tokens(shards, 500, 20)
    got = ST.read_sequences(shards, 8, 2, 5).orderBy("seq_id").collect()
    assert [(r["seq_id"], bytes(r["ids"])) for r in got] == [(i, stream[32 * i : 32 * i + 32]) for i in (2, 3, 4)]
    assert ST.position([128] * 4, 130) == (1, 2) and ST.position([128] * 4, 512) == (4, 0)
    assert ST.identity_faults(m, stage__language="en", reader__sequence_length=16) == ["reader.sequence_length"]
    assert ST.opened_source(spark, "packed", 8, path=path, expected={"stage__language": "en"}).count() == 64
    with pytest.raises(ConfigError):
        ST.opened_source(spark, "packed", 16, path=path)


def test_interrupted_and_extended_runs_equal_a_whole_one(spark, rows, tmp_path):
    whole = ST.materialise(rows, f"file://{tmp_path}/a", config())
    (tmp_path / "b/tokens/shard_index=9").mkdir(parents=True)
    (tmp_path / "b/tokens/shard_index=9/part-0.parquet").write_bytes(b"torn")
    assert ST.materialise(rows.repartition(7), f"file://{tmp_path}/b", config())["ordered_data_sha256"] == whole["ordered_data_sha256"]
    path = f"file://{tmp_path}/c"
    ST.materialise(rows, path, config(max_output_tokens=300))
    first = ST.read_tokens(ST.read_shards(spark, path), 0, 200)
    assert ST.materialise(rows, path, config())["ordered_data_sha256"] == whole["ordered_data_sha256"]  # a larger cap
    assert ST.read_tokens(ST.read_shards(spark, path), 0, 200) == first
    for bad in (config(max_output_tokens=400), config(order_seed=32)):
        with pytest.raises(ConfigError):
            ST.materialise(rows, path, bad)
    again = []
    ST.materialise(rows, path, config(max_runtime_seconds=9), progress=lambda event, **_: again.append(event))
    assert again == ["complete"]
    with pytest.raises(ConfigError):
        ST.materialise(rows.limit(2), f"file://{tmp_path}/d", config())


def test_counts_and_registry_overlap(spark, rows, tmp_path):
    more = rows.unionByName(spark.createDataFrame([(200, "u", None), (201, "v", ""), (202, "w", "ordered unique document 0003 " + "x" * 48)], rows.schema))
    c = config(max_output_tokens=1 << 20, max_input_documents=1000, validation_permyriad=2000)
    c["stage"]["require_exact_output_tokens"] = False
    known = rows.where("i < 5").select(F.sha2("text", 256).alias("content"))
    m = ST.materialise(more, f"file://{tmp_path}/s", c, registered=known)
    n = m["rejection_counts"]
    assert n["missing_or_non_string_text"] == n["empty_text"] == 1 and n["overlap_registry"] + n["assigned_to_validation"] >= 5
    assert m["accepted_document_count"] + n.get("overlap_registry", 0) + n["assigned_to_validation"] + n.get("duplicate_within_stage", 0) == 129
    assert ST.estimate(config())["bytes"] == 4 * 512 + 320 * 128 + 2 * (1 << 20)
    empty = ST.materialise(rows.where("false"), f"file://{tmp_path}/none", c)
    assert empty["token_count"] == 0 and empty["shards"] == []


@pytest.mark.parametrize("rule", ["ordered_data_hash", "tokenizer_identity", "vocabulary_size", "max_id_beyond_embedding", "unused_tail", "shard_order", "no_tokens", "token_count", "sequence_length", "target_token_count", "adjacent_target_token_count", "cap_status", "underfilled", "document_count"])
def test_manifest_rules(rule, manifest):
    m = json.loads(json.dumps(manifest))
    if rule == "ordered_data_hash":
        m["dataset"]["name"] = "other"
    elif rule == "tokenizer_identity":
        m["tokenizer"]["sha256"] = "c" * 64
    elif rule in ("vocabulary_size", "max_id_beyond_embedding", "unused_tail"):
        m["tokenizer"].update({"vocabulary_size": {"base_vocab_size": 0}, "max_id_beyond_embedding": {"max_emitted_id": 256}, "unused_tail": {"unused_tail": 1}}[rule])
    elif rule == "shard_order":
        m["shards"] = m["shards"][::-1]
    elif rule == "no_tokens":
        m["shards"] = []
    elif rule == "sequence_length":
        m["reader"]["sequence_length"] = 1
    elif rule == "cap_status":
        m["hit_output_token_cap"] = False
    elif rule == "underfilled":
        m["selection"]["max_output_tokens"] = 600
    elif rule == "document_count":
        m["accepted_document_count"] += 1
    else:
        m[rule] += 1
    assert rule in {r for r, _ in ST.manifest_violations(ST.signed(m) if rule != "ordered_data_hash" else m, "b" * 64)}


@pytest.fixture(scope="module")
def manifest(spark, rows, tmp_path_factory):
    return ST.materialise(rows, f"file://{tmp_path_factory.mktemp('m')}/s", config())


def test_changed_files_are_seen(spark, rows, tmp_path):
    path = f"file://{tmp_path}/s"
    m = ST.materialise(rows, path, config())
    shards, b = ST.read_shards(spark, path), ST.read_boundaries(spark, path)
    rules = lambda s, x: {r["rule"] for r in ST.violations(m, s, x).collect()}
    assert "shard_checksum" in rules(shards.withColumn("body", F.when(F.col("p") == 0, F.expr("overlay(body placing X'01' from 1)")).otherwise(F.col("body"))), b)
    assert {"shard_missing"} <= rules(shards.where("shard_index <> 1"), b) and {"shard_size"} <= rules(shards.where("p <> 0"), b)
    assert "token_id_out_of_range" in rules(shards.withColumn("body", F.when(F.col("p") == 0, F.expr("overlay(body placing X'01' from 2)")).otherwise(F.col("body"))), b)
    assert {"record_count", "boundary_checksum", "index_not_dense"} <= rules(shards, b.where("document_index <> 1"))
    text = (tmp_path / "s/manifest.json").read_text()
    (tmp_path / "s/.manifest.json.crc").unlink()
    (tmp_path / "s/manifest.json").write_text(text.replace('"complete": true', '"complete": false'))
    for _ in range(2):
        with pytest.raises(ConfigError):
            ST.load_manifest(spark, path)
        (tmp_path / "s/manifest.json").write_text(text.replace('"fixture"', '"other"'))


def test_other_sources(spark):
    got = ST.dealt(ST.array_sequences(spark, list(range(40)), 4), 2, 2, 1, 2).orderBy("seq_id").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got[:2]] == [[8, 9, 10, 11], [12, 13, 14, 15]] and got[0]["batch_id"] == got[1]["batch_id"] == 0
    a, b = (sorted((r["seq_id"], bytes(r["ids"])) for r in ST.opened_source(spark, "synthetic", 16, sequences=9, vocabulary=100, seed=s).collect()) for s in (1, 2))
    assert len(a) == 9 and a != b and all(np.frombuffer(x, "<u4").max() < 100 for _, x in a)
    few = ST.dealt(ST.array_sequences(spark, list(range(12)), 4), 0, 8, 5, 1)  # more ranks than sequences
    assert sorted((r["rank"], r["local"]) for r in few.collect()) == [(1, 0), (3, 0), (4, 0)]


def reg(spark, *rows):
    return spark.createDataFrame([(c, t, s, "continual_train", s[:2], "train", f"id{i}", i, 0, 1) for c, t, s, i in rows], R.SCHEMA)


def test_registry(spark, tmp_path):
    a = reg(spark, ("c1", "t1", "en-0", 0), ("c2", "t2", "en-0", 1))
    key = lambda df: sorted((r["content_sha256"], r["stage_id"]) for r in df.collect())
    assert key(R.register(a, reg(spark, ("c1", "t1", "en-0", 5), ("c3", "t3", "fr-0", 0), ("c4", "t3", "fr-0", 1)))) == [("c1", "en-0"), ("c2", "en-0"), ("c3", "fr-0")]
    for bad in (("c1", "t9", "fr-0", 0), ("c9", "t1", "fr-0", 0)):
        with pytest.raises(R.OverlapError):
            R.register(a, reg(spark, bad))
    for bad in ([("c1", "t9", "en-0", 9)], [("c8", "t8", "en-0", 8), ("c8", "t7", "en-0", 9)]):
        with pytest.raises(R.OverlapError):
            R.insert_checked(a, reg(spark, *bad))
    fr = reg(spark, ("f1", "u1", "fr-0", 0), ("f2", "u2", "fr-old", 1))
    merged, n = R.merge_lanes([a, fr], ["en-0", "fr-0"])
    assert n == 3 and key(merged) == [("c1", "en-0"), ("c2", "en-0"), ("f1", "fr-0")]
    for clash in (("c1", "u7", "fr-0", 3), ("f7", "t1", "fr-0", 3)):
        with pytest.raises(R.OverlapError):
            R.merge_lanes([a, reg(spark, clash)], ["en-0", "fr-0"])
    changed = {r["column"] for r in R.conflicts(a, a.withColumn("split", F.lit(None).cast("string")).withColumn("token_end", F.lit(7).cast("long")), "content_sha256").collect()}
    assert changed == {"split", "token_end"} and R.conflicts(a, a, "token_ids_sha256").count() == 0
    assert key(R.recovered(a, reg(spark, ("c1", "t1", "en-0", 0)), "en-0")) == [("c1", "en-0")]
    root = f"file://{tmp_path}/r"
    assert R.opened(spark, root).count() == 0
    R.commit(a, root)
    R.commit(R.register(R.opened(spark, root), fr), root)
    assert R.opened(spark, root).count() == 4 and R.stage_counts(R.opened(spark, root)).count() == 3


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema, path = "doc_id long, text string", f"file://{tmp_path}/q"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    put("a", [(1, "x"), (2, "x"), (3, None), (4, "")])
    J.ingest(stream(), f"file://{tmp_path}/reg", "en", path)
    put("b", [(5, "x"), (6, "y")])
    got = {r["document_index"]: r["reason"] for r in J.ingest(stream(), f"file://{tmp_path}/reg", "en", path).collect()}
    assert got == {1: None, 2: "duplicate_within_stage", 3: "missing_or_non_string_text", 4: "empty_text", 5: "duplicate_within_stage", 6: None}
    other = {r["document_index"]: r["reason"] for r in J.ingest(stream(), f"file://{tmp_path}/reg", "fr", f"{path}2").collect()}
    assert other[1] == other[6] == "overlap_registry"
    assert sorted(r["document_index"] for r in R.opened(spark, f"file://{tmp_path}/reg").collect()) == [1, 6]


def test_stream_registry_does_not_depend_on_the_order_of_files(spark, tmp_path):
    """Files of overlapping ids, the largest first, in several batches; texts and ids that are null, empty or repeated."""
    files = [[(70, "a"), (71, "b"), (72, None), (73, ""), (None, "c")], [(60, "x"), (61, "x")], [(62, "y")], [(63, "c"), (63, "c")], [(5, "a"), (70, "a"), (None, "a")], [(6, "b"), (7, ""), (8, None)]]
    (tmp_path / "documents.parquet").mkdir()
    for i, rows in enumerate(files):
        part = tmp_path / f"documents.parquet/part-{i}.parquet"
        pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), part)
        os.utime(part, (1_000_000 + i, 1_000_000 + i))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.stream_registry(spark, f"file://{tmp_path}").select("doc_id", "reason").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(f"select doc_id, reason from ({Q.SQL['stream_registry']})").fetchall(), key=repr)
