import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import packing
from corpusloom.llm.queries import PATTERN, RANKS, op3_packing


def plain_bfd(lengths, capacity):
    rows, left = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [c for c in left if c >= lengths[i]]
        if fits:
            r = next(j for j, c in enumerate(left) if c == min(fits))
        else:
            r = len(rows)
            rows.append([])
            left.append(capacity)
        rows[r].append(i)
        left[r] -= lengths[i]
    return rows


def test_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.randint(1, 70)
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        got, want = packing.best_fit_decreasing(lengths, cap), plain_bfd(lengths, cap)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        fill = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)
        assert fill(got) == fill(want)  # which of equally full rows is taken doesn't change the fill


def test_round_trip(docs, rows):
    enc = packing.encoding(RANKS, PATTERN)
    packed = packing.pack(docs.withColumn("ids", F.lit(1)), RANKS, PATTERN, length=64, eos=50256, group_tokens=3000).collect()
    parts = []
    for r in packed:
        ids, pos, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] and (ids[cu[-1] :] == 0).all()
        for a, b, p in zip(cu[:-1], cu[1:], r["pieces"], strict=True):
            assert b - a == p["n"] and pos[a:b].tolist() == list(range(b - a))
            parts.append((p["doc_id"], p["start"], tuple(ids[a:b].tolist())))
    want = []
    for r in rows:
        ids = [*enc.encode_ordinary(r[1] or ""), 50256]
        want += [(r[0], i, tuple(ids[i : i + 64])) for i in range(0, len(ids), 64)]
    assert sorted(parts, key=repr) == sorted(want, key=repr)


def test_written(docs, tmp_path):
    packed = packing.pack(docs, RANKS, PATTERN, length=64, eos=50256)
    packing.write_packed(packed, str(tmp_path / "out"))
    back = docs.sparkSession.read.schema(packing.PACKED).parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, packed.collect()))


def test_query_and_empty(spark, sf, no_docs):
    enc = packing.encoding(RANKS, PATTERN)
    want = {r[0]: len(enc.encode_ordinary(r[1])) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op3_packing(spark, sf).collect()
    have = {}
    for r in got:
        lengths = [b - a for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:])]
        assert sum(lengths) == r["n_tokens"] <= packing.LENGTH
        for d, at, n in zip(r["doc_ids"], r["starts"], lengths, strict=True):
            have.setdefault(d, []).append((at, n))
    for d, parts in have.items():  # every token once, in parts that follow each other
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == want[d]
    assert have.keys() == want.keys() and sum(r["n_tokens"] for r in got) / (len(got) * packing.LENGTH) > 0.97
    assert packing.pack(no_docs, RANKS, PATTERN).count() == 0
