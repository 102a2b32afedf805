import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.queries import op9_simhash


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for a, b in itertools.combinations(sorted(root), 2):
        if bin(a ^ b).count("1") <= radius:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def expected(rows):
    rows = [(i, plain(t)) for i, t in rows]
    of = classes({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return sorted(((i, f"{f:016x}", least.get(of[f])) for i, f in rows), key=repr)


def test_components(docs, rows):
    got = simhash.components(docs.withColumn("fp", F.lit(1)).withColumn("key", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=repr) == expected([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("bucket", [8192, 1])
def test_links_cover_every_pair(spark, bucket):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fps = set(centres)
    for c in centres:
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.covering_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), bucket=bucket).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[find(a & (2**64 - 1))] = find(b & (2**64 - 1))
    want = classes(fps)
    assert {frozenset(f for f in fps if find(f) == r) for r in map(find, fps)} == {frozenset(f for f in fps if want[f] == r) for r in want.values()}


def test_one_of_each_component_stays(docs, rows):
    want = expected([(r[0], r[1]) for r in rows])
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    got = [r["doc_id"] for r in got.collect()]
    ids = {c for _, _, c in want}
    assert len(got) == len(set(got)) and set(got) == ids


def test_query_and_empty(spark, sf, no_docs):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op9_simhash(spark, sf).collect()), key=repr) == expected(texts)
    assert simhash.components(no_docs).count() == 0 and simhash.drop_near_copies(no_docs).count() == 0


def test_components_that_share_an_id_or_have_none(spark):
    x, y, z = (" ".join(f"{c}{i % 50}" for i in range(200)) for c in "xyz")
    keep = lambda rows: sorted(map(tuple, simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert keep([(None, x), (None, y), (None, y), (7, z), (None, z)]) == sorted([(None, x), (None, y), (7, z)], key=repr)
    assert keep([(5, x), (5, y)]) == sorted([(5, x), (5, y)], key=repr)
    assert keep([(3, x), (5, x.upper()), (5, y)]) == sorted([(3, x), (5, y)], key=repr)


def test_hot_fingerprints_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 4)
    x, y = (" ".join(f"{c}{i % 50}" for i in range(200)) for c in "xy")
    rows = [(i, None) for i in range(9)] + [(20 + i, x) for i in range(6)] + [(40, y), (None, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.components(docs).collect()), key=repr) == expected(rows)
    names = {n: F.lit("mine") for n in ("least_id", "least_key", "own_id", "own_key", "n", "root", "key")}
    got = simhash.drop_near_copies(docs.withColumns(names)).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 20, 40] and all(r[n] == "mine" for r in got for n in names)
