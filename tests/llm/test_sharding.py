import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sharding


@pytest.mark.parametrize("bucket_bytes", [1 << 23, 4000, 200])
def test_law_rows(docs, rows, bucket_bytes):
    got = sharding.two_pass_shuffle(docs.withColumn("shard", F.lit("clash")).withColumn("H", F.lit(1)), n_shards=7, bucket_bytes=bucket_bytes).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[i]) for i in range(7)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_order_is_shuffled_and_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    run = lambda seed: [r["doc_id"] for r in sharding.two_pass_shuffle(docs, 1, seed=seed).orderBy("slot").collect()]
    a = run(1)
    assert a == run(1) and a != run(2) and a != sorted(a)


def test_few_rows(no_docs, docs):
    assert sharding.two_pass_shuffle(no_docs).count() == 0
    got = sharding.two_pass_shuffle(docs.limit(3), 24).select("shard", "slot").collect()
    assert sorted(r[0] for r in got) == [0, 1, 2] and {r[1] for r in got} == {0}


@pytest.mark.parametrize("bucket_bytes", [None, 4000])
def test_order_follows_from_seed_and_rows(spark, docs, bucket_bytes):
    found = []
    for parts in (4, 7, 211):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 4)
        try:
            got = sharding.two_pass_shuffle(docs.repartition(parts % 5 + 1), 24, seed=5, bucket_bytes=bucket_bytes).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
        found.append(sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text"] or "", str(r["n_chars"])) for r in got))
    assert found[0] == found[1] == found[2]


def test_written(docs, tmp_path):
    done = sharding.two_pass_shuffle(docs, 4, bucket_bytes=4000)
    sharding.write_shards(done, str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(p.name for p in (tmp_path / "out").glob("shard=*")) == {f"shard={i}" for i in range(4)}
    assert sorted((r["shard"], r["slot"]) for r in back.collect()) == sorted((r["shard"], r["slot"]) for r in done.collect())


def test_query(spark, sf):
    from corpusloom.llm.queries import op6_sharding

    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op6_sharding(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts)) and all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["law"] == "rows" for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[i]) for i in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
