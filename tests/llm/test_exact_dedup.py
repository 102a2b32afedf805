import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def norm(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        d, first = hashlib.sha256(t.encode()).digest(), True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), first, d))
            first = False
    return Counter(out)


@pytest.mark.parametrize("counters,min_copies", [(4096, 32), (4, 5), (2, 1), (4096, 10**9)])
def test_report(docs, rows, counters, min_copies):
    got = Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in exact_dedup.dedup_report(docs, counters=counters, min_copies=min_copies).collect())
    assert got == expected(rows)


@pytest.mark.parametrize("min_copies", [1, 32, 10**9])
def test_rows_that_stay(docs, rows, min_copies):
    kept = exact_dedup.dedup(docs.withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2)), min_copies=min_copies)
    assert kept.columns == [*docs.columns, "digest", "keep_id"]
    want = Counter((i, d) for (i, _, _, k, d), n in expected(rows).items() if k for _ in range(n))
    assert Counter((r["doc_id"], hashlib.sha256(norm(r["text"]).encode()).digest()) for r in kept.collect()) == want


def test_frequent_are_found(spark):
    rows = [(bytes([9]) * 32,)] * 300 + [(i.to_bytes(32, "big"),) for i in range(600)]
    found = exact_dedup.frequent_digests(spark.createDataFrame(rows, "digest binary").repartition(5), counters=8).collect()
    assert bytes([9]) * 32 in {bytes(r["digest"]) for r in found} and len(found) <= 9


def test_empty(no_docs):
    assert exact_dedup.dedup_report(no_docs).count() == 0 and exact_dedup.dedup(no_docs).count() == 0
