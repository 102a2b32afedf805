import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import quality
from corpusloom.llm.queries import op2_quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_statistics(docs, rows):
    extra = ["a b c d e f a b c d e", "x " * 40, "l\nl\n l\n\n \nl", "\x1c a\x85b c", "a b c d e a b c d e a b c d e", None]
    for t in [r[1] for r in rows] + extra:
        assert quality.text_statistics((t or "").encode()) == plain(t)
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.outlier_report(docs).collect()}
    assert got == {(r[0], *(s := plain(r[1])), s[0] < 10 or 100 * s[4] > 20 * s[0]) for r in rows}


def test_constants():
    assert abs(quality.chi2_cdf(quality.INSIDE, quality.D) - 0.975) < 1e-3
    assert 1 < quality.consistency(0.75) < 2 and abs(quality.consistency(0.9999) - 1) < 0.01


def plain_mcd(x, tries=60):
    """Centre and scatter of least determinant by many random starts, exact order statistics, and one reweighting."""
    rng, h, best = np.random.default_rng(8), -(-3 * len(x) // 4), None
    for _ in range(tries):
        some = x[rng.choice(len(x), quality.D + 2, replace=False)]
        mu, cov = some.mean(axis=0), np.cov(some.T) + np.eye(quality.D)
        for _ in range(40):
            near = np.argsort(np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu))[:h]
            mu, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + np.eye(quality.D) / 12
        det = np.linalg.slogdet(cov)[1]
        best = min(best or (det, mu, cov), (det, mu, cov), key=lambda b: b[0])
    _, mu, cov = best
    inside = x[np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov * quality.consistency(0.75)), x - mu) <= quality.INSIDE]
    return inside.mean(axis=0), np.cov(inside.T, bias=True) * quality.consistency(0.975) + np.eye(quality.D) / 12


def squared(x, mu, cov):
    return np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)


def estimate(spark, groups, parts=3):
    rows = [(g, v) for g, x in groups.items() for v in x.tolist()]
    out = {}
    for r in quality.robust_models(spark.createDataFrame(rows, "g string, x array<long>").repartition(parts)).collect():
        inv = np.zeros((quality.D, quality.D))
        for (i, j), v in zip(quality.PAIRS, r["inverse"]):
            inv[i, j] = inv[j, i] = v
        out[r["g"]] = (np.array(r["med"]) + np.array(r["centre"]), np.linalg.inv(inv))
    return out


def test_estimate_equals_brute_force_and_scatter_decides(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(5, 5))
    tight, wide = (np.round(rng.normal(size=(400, 5)) @ mix * s + [6600, 16000, 3900, -7000, 22000]).astype(int) for s in (40, 400))
    bad = np.round(rng.normal([9500, 9000, 9000, 900, 20000], 200, (90, 5))).astype(int)
    line = tight.copy()
    line[:, 2] = 4096  # one statistic is the same everywhere: rounding's ridge keeps the scatter regular
    groups = {"tight": np.concatenate([tight, bad]), "wide": np.concatenate([wide, bad]), "line": np.concatenate([line, bad])}
    found = estimate(spark, groups)
    assert [[m.tolist() for m in v] for v in found.values()] == [[m.tolist() for m in estimate(spark, groups, 7)[g]] for g in found]  # exact sums: partitions don't matter
    for g, x in groups.items():
        kept, want = squared(x, *found[g]) <= quality.CUTOFF, squared(x, *plain_mcd(x)) <= quality.CUTOFF
        assert kept.tolist() == want.tolist() and not kept[400:].any() and kept[:400].mean() > 0.99, g
    far = (tight.mean(axis=0) + 8 * (tight.std(axis=0) @ np.eye(5)) * [1, -1, 1, -1, 1])[None]
    assert squared(far, *found["tight"])[0] > quality.CUTOFF > squared(far, *found["wide"])[0]


def test_cycle_of_choices_ends_with_its_least_determinant(spark, monkeypatch):
    """Whole bins make the first start of these rows alternate between two choices from the sixth step on."""
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(3000, 5)) * [300, 900, 200, 700, 2000] * rng.choice([1, 1, 1, 3], (3000, 1))).astype(int)
    lower = lambda a: np.sort(a, axis=0)[(len(a) + 1) // 2 - 1]
    v -= lower(v)
    mad = np.maximum(np.round(lower(abs(v)) * 1.4826).astype(int), 1).tolist()
    calls, step = [], quality.concentrate
    monkeypatch.setattr(quality, "concentrate", lambda rows, models: calls.append(1) or step(rows, models))
    rows = spark.createDataFrame([("g", x, mad) for x in v.tolist()], "g string, v array<long>, mad array<long>")
    (r,) = quality.least_determinants(rows).collect()
    cov = np.zeros((5, 5))
    for (i, j), x in zip(quality.PAIRS, r["q"]):
        cov[i, j] = cov[j, i] = (x - r["s"][i] * r["s"][j] / r["n"]) / r["n"]
    assert len(calls) < 20 and np.linalg.slogdet(cov + np.eye(5) * quality.RIDGE)[1] < 63.74


def test_verdicts(spark, sf, no_docs):
    got = op2_quality(spark, sf).collect()
    assert len(got) == 200 and all(not r["kept"] for r in got if r["base_failed"])
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"]]
    good = [k for q, k in judged if q]
    assert sum(good) >= 0.95 * len(good)


def test_clean_and_poor_documents(spark, no_docs):
    d = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").collect()}
    got = [(labels[r["doc_id"]], r["kept"]) for r in op2_quality(spark, d).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, poor = [k for q, k in got if q], [k for q, k in got if not q]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.05 * len(poor)
    assert quality.outlier_report(no_docs).count() == 0


def test_few_rows_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "four", "other", "words"]) + str(rng.randint(0, 999)) for _ in range(60)), None, None) for i in range(5)]
    got = quality.outlier_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == 5 and all(r["kept"] for r in got)
