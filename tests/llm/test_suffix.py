import hashlib
import random

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import suffix
from corpusloom.llm.queries import op10_suffix


def plain(rows):
    """(id, bytes) -> the defined result, by a dictionary of all windows."""
    big = 2**63 - 1
    least = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(least.get(w, big), big if i is None else i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < (big if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_hashes():
    data = np.frombuffer(random.Random(1).randbytes(400), np.uint8)
    for k in (1, 2, 3, 25, 50):
        got = suffix.rolling(data, k, suffix.BASE)
        want = []
        for i in range(len(data) - k + 1):
            h = 0
            for c in data[i : i + k].tolist():
                h = (h * suffix.BASE + c + 1) % 2**64
            want.append(h)
        assert got.tolist() == want
    a = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    assert suffix.sliding(a, 3, np.minimum).tolist() == [3, 1, 1, 1]


def test_runs_cover_every_window_once():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab ") for _ in range(n)) for n in (0, 10, 49, 50, 51, 300, 0, 700)] + [b"z" * 200]
    r = suffix.Runs(texts)
    start = np.concatenate([np.arange(a, b + 1) for a, b in zip(r.lo, r.hi)])
    at, want = 0, []
    for t in texts:
        want += range(at, at + max(0, len(t) - 49))
        at += len(t)
    assert start.tolist() == want


def check(spark, rows, monkeypatch=None, **sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(suffix, k, v)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("body", F.lit("x")).repartition(3)
    got = suffix.remove_repeats(docs, keep_bytes=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain([(i, (t or "").encode()) for i, t in rows])


def test_fixture(spark, rows):
    check(spark, [(r[0], r[1]) for r in rows])


def test_overlaps_and_edits(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 25)))
        if rng.random() < 0.3 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((rng.randrange(90), t))
    rows += [(500, "ab" * 400), (501, "ab" * 300 + "c"), (502, "abc" * 99), (None, "ab" * 100), (None, rows[3][1]), (503, None), (2, "ab" * 60)]
    check(spark, rows)
    check(spark, rows, monkeypatch, BLOCK_BYTES=3000, STEP_BYTES=700, BUCKET_ROWS=16, STORE_BYTES=2000)


def in_process(rows, n_blocks, buckets):
    """All passes without Spark, so that constants and hashes can be replaced: workers import their own."""
    blocks = []
    for k in range(n_blocks):
        part = rows[k::n_blocks]
        blocks.append(suffix.Block([i for i, _ in part], [len(t) for _, t in part], zstandard.compress(b"".join(t for _, t in part)), buckets))

    def exchange(sent, reducer):
        by_bucket, answers = {}, [[] for _ in blocks]
        for k, found in enumerate(sent):
            for x, payload in found:
                by_bucket.setdefault(x, []).append((k, x, payload))
        for x in sorted(by_bucket):
            out = reducer(pd.DataFrame(by_bucket[x], columns=["block", "bucket", "payload"]))
            for k, answer in zip(out["block"], out["answer"]):
                answers[k].append(answer)
        return answers

    first = exchange([list(suffix.first_pass(b)) for b in blocks], suffix.reduce_first)
    second = exchange([list(suffix.Live(b, f).sent()) for b, f in zip(blocks, first)], suffix.reduce_bytes(buckets))
    gone = []
    for b, f, x in zip(blocks, first, second):
        cut = np.split(suffix.removed_bytes(b, f, x), np.cumsum([len(t) for t in b.texts])[:-1])
        gone += [(i, t, bytes(c for c, g in zip(t, mine) if not g)) for i, t, mine in zip(b.raw_ids, b.texts, cut)]
    return sorted(((i, len(t), hashlib.sha256(kept).hexdigest()) for i, t, kept in gone), key=repr)


def test_hot_anchors_and_crafted_hashes(monkeypatch):
    rng = random.Random(12)
    word = lambda: bytes(rng.choice(b"abcde ") for _ in range(rng.randint(2, 9)))
    passage = [b" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = [(rng.randrange(70), b" ".join(rng.choice(passage) if rng.random() < 0.4 else word() for _ in range(12))) for _ in range(90)]
    rows += [(99, b"z" * 400), (98, b"z" * 70), (97, b""), (None, passage[0] * 2)]
    want = sorted(((i, n, d) for i, n, _, _, d in plain(rows)), key=repr)
    assert in_process(rows, 1, 1) == in_process(rows, 4, 3) == want
    monkeypatch.setattr(suffix, "HOT_BLOCK", 2)
    monkeypatch.setattr(suffix, "HOT_ALL", 9)
    assert in_process(rows, 4, 3) == want
    mixed, row_hash = suffix.mixed, suffix.row_hash
    for mask in (7 << 61 | 3, 0):  # hashes that tell little or nothing apart: bytes decide
        monkeypatch.setattr(suffix, "mixed", lambda h: mixed(h) & np.uint64(mask))
        monkeypatch.setattr(suffix, "row_hash", lambda r: row_hash(r) & np.uint64(mask))
        assert in_process(rows, 4, 3) == want
        monkeypatch.setattr(suffix, "HOT_ALL", 1 << 16)
        monkeypatch.setattr(suffix, "HOT_BLOCK", 256)
        assert in_process(rows, 4, 3) == want


def test_radix_passes_equal_a_dictionary():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 2, (400, 16)).astype(np.uint8)
    rows[:, :12] = rows[rng.integers(0, 5, 400), :12]
    group, ids = rng.integers(0, 3, 400), rng.integers(0, 1000, 400)
    least = {}
    for r, g, i in zip(rows, group, ids):
        least[r.tobytes(), g] = min(i, least.get((r.tobytes(), g), 10**6))
    assert suffix.least_equal(rows, group, ids).tolist() == [least[r.tobytes(), g] for r, g in zip(rows, group)]


def test_query_and_empty(spark, sf, no_docs):
    texts = [(r[0], r[1].encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_suffix(spark, sf).collect()), key=repr) == plain(texts)
    assert suffix.remove_repeats(no_docs).count() == 0
