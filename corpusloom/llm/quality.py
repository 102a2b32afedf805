"""Quality rules: robust multivariate outliers of document statistics.

Per language and source, the minimum-covariance-determinant estimate of transformed statistics gives centre and scatter;
documents at a large Mahalanobis distance are rejected. Concentration goes from three starts until the chosen rows are
those of an earlier step, and the least determinant counts. It covers all rows: each step is an aggregation per group over the whole
table of statistics, combined before it is shuffled. The statistics are rounded to a fixed grid, so all sums are exact
integers, and the outcome doesn't depend on partitions or on the order of rows.

The statistics have even scatter in clean text of a language and source, so that no least width has to be set: the only
ridge is the variance that rounding to the grid itself adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import as_bytes, fits, materialize, sized, text_chunks

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: Transformed statistics are multiples of 1 / GRID; the rounding has variance RIDGE, in these units.
GRID, RIDGE = 4096, 1 / 12
#: Names of the transformed statistics.
STATS = ("word_length", "entropy", "variety", "other_signs", "length")
D = len(STATS)
#: Share of a group's rows that the estimate rests on, and concentration steps at most.
SUPPORT, STEPS = 0.75, 30
#: Rows that a group needs for an estimate of its own, ten for each statistic; a smaller one is judged by the estimate of
#: its whole language, and where that is as small, by that of all rows. With fewer rows in all nothing is rejected.
MIN_ROWS = 10 * D
#: Rows of a group's random start: those with the least seeded hash.
START_ROWS, SEED = 4 * D, 17
#: Squared distance beyond which a row is rejected. For normal vectors chi-square would set it; text has heavier tails.
CUTOFF = 200.0
#: Rows within this chi-square quantile (D degrees of freedom, 97.5 %) of the raw estimate make the final one.
INSIDE = 12.83
#: Bins of a squared distance on a logarithmic scale; the rows nearest to a centre are chosen by whole bins.
BINS_PER_OCTAVE = 64


def chi2_cdf(x: float, dof: int) -> float:
    """The lower incomplete gamma function, by its series."""
    a, z = dof / 2, x / 2
    term = total = 1 / a
    for k in range(1, 400):
        term *= z / (a + k)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def consistency(share: float, dof: int = D) -> float:
    """What makes the scatter of a normal sample's inner `share` unbiased: share / P(chi-square of dof + 2 <= quantile)."""
    low, high = 1e-9, 100.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dof) < share else (low, middle)
    return share / chi2_cdf(low, dof + 2)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of five that occur twice or more in the text. Exact: ranks of pairs, then of pairs of pairs."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = rank(one[:-1], one[1:])
    four, last = rank(two[:-2], two[2:])[:n], one[4:]
    key = four * (int(last.max()) + 1) + last
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[inverse] > 1)
    if not len(start):
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def text_statistics(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words, t = raw.split(), raw.decode()
    return len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), duplicate_lines(raw), repeated_words(words)


LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 or b == 32 for b in range(256)])


def transformed(raw: bytes, n_words: int, chars: int) -> list[int]:
    """The vector that is judged, in multiples of 1 / GRID: logarithms of mean word length, of other signs than letters a
    word and of the number of words, the entropy of the bytes (corrected for short texts), and log(distinct) / log(words)."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    some = count[count > 0]
    share = some / max(len(raw), 1)
    entropy = -float((share * np.log2(share)).sum()) + (len(some) - 1) / (2 * max(len(raw), 1) * math.log(2))
    variety = math.log(len(set(raw.split()))) / math.log(n_words) if n_words > 1 else 1.0
    other = int(count[~LETTERS].sum())
    x = (math.log((chars + 20) / (n_words + 4)), entropy, variety, math.log((other + 1) / (n_words + 3)), math.log(n_words + 1))
    return [round(v * GRID) for v in x]


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, lang, source, the base statistics, base_failed and the vector x (array of long).
    Null text has no words. A null language or source is a value of its own."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 3):
            texts = as_bytes(batch.column(3))
            found = [text_statistics(t) for t in texts]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            x = pa.array([transformed(t, f[0], f[1]) for t, f in zip(texts, found, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, x], names=["doc_id", "lang", "source", *names, "x"])

    out = rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, {', '.join(f'{n} long' for n in names)}, x array<long>")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
MODEL = "g string, k int, n long, s array<long>, q array<long>, centre array<double>, inverse array<double>, log_det double"


def distance() -> Column:
    """Squared Mahalanobis distance of v, from a model row's centre and the upper triangle of its inverse scatter."""
    d = [F.col("v")[i] - F.col("centre")[i] for i in range(D)]
    terms = [F.col("inverse")[k] * d[i] * d[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def moments(v: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.array(*[F.sum(v[i]) for i in range(D)]).alias("s"), F.array(*[F.sum(v[i] * v[j]) for i, j in PAIRS]).alias("q")]


def solve(factor: float = 1.0, widen: float = 0.0):
    """From exact sums of chosen rows (g, k, n, s, q): centre, inverse of scatter * factor, and the logarithm of its
    determinant. A start may be widened by a share of the spread that the sums came with (mad)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            centres, inverses, dets = [], [], []
            for r in b.itertuples():
                n, mu, cov = int(r.n), [int(a) / int(r.n) for a in r.s], np.zeros((D, D))
                for (i, j), x in zip(PAIRS, r.q, strict=True):
                    cov[i, j] = cov[j, i] = (int(x) - int(r.s[i]) * int(r.s[j]) / n) / n
                cov = cov * factor + RIDGE * np.eye(D)
                if widen:
                    cov += widen * np.diag(np.square(np.array(r.mad, dtype=float)))
                inv = np.linalg.inv(cov)
                centres.append(mu)
                inverses.append([float(inv[i, j]) for i, j in PAIRS])
                dets.append(float(np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame({"g": b["g"], "k": b["k"].astype("int32"), "n": b["n"], "s": b["s"], "q": b["q"], "centre": centres, "inverse": inverses, "log_det": dets})

    return run


def middles(rows: DataFrame, x: Column, out: str) -> DataFrame:
    """(g, out: the lower median of each statistic). Values are integers on a grid, so that a group's distinct values are
    few, however many rows it has: their counts are combined first, and the order statistic is a running sum over values."""
    c = rows.select("g", F.posexplode(x).alias("i", "value")).groupBy("g", "i", "value").agg(F.count("*").alias("n"))
    w = W.partitionBy("g", "i")
    c = c.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("all", F.sum("n").over(w))
    m = c.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "i").agg(F.min("value").alias("m"))
    return m.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("ms")).select("g", F.col("ms.m").alias(out))


def starts(rows: DataFrame) -> DataFrame:
    """Three first models of each group of (g, v, mad; the median is at 0): median and median deviations, mean and scatter
    of the vectors clipped at two deviations, and those of a few random rows."""
    clipped = F.zip_with("v", "mad", lambda v, m: F.greatest(F.least(v, 2 * m), -2 * m))
    diagonal = F.array(*[F.col("mad")[i] * F.col("mad")[i] if i == j else F.lit(0).cast("long") for i, j in PAIRS])
    zero = F.array(*[F.lit(0).cast("long")] * D)
    first = rows.select("g", "mad").groupBy("g").agg(F.min("mad").alias("mad")).select("g", F.lit(0).alias("k"), F.lit(1).cast("long").alias("n"), zero.alias("s"), diagonal.alias("q"), "mad")
    second = rows.withColumn("c", clipped).groupBy("g", "mad").agg(*moments(F.col("c"))).select("g", F.lit(1).alias("k"), "n", "s", "q", "mad")
    draw = W.partitionBy("g").orderBy(F.xxhash64(F.lit(SEED), "v"))
    few = rows.withColumn("place", F.row_number().over(draw)).where(F.col("place") <= START_ROWS)
    third = few.groupBy("g", "mad").agg(*moments(F.col("v"))).select("g", F.lit(2).alias("k"), "n", "s", "q", "mad")
    return first.unionByName(second).unionByName(third).mapInPandas(solve(widen=0.01), MODEL)


def concentrate(rows: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step: the SUPPORT of its group's rows that are nearest by a model (whole bins of distance) give
    the sums of the next. (g, k, n, s, q)"""
    bins = F.floor(F.log2(F.least(distance(), F.lit(1e15)) + F.lit(1e-9)) * BINS_PER_OCTAVE)
    near = rows.join(models.select("g", "k", "centre", "inverse"), "g").select("g", "k", "v", bins.alias("bin"))
    c = near.groupBy("g", "k", "bin").agg(F.count("*").alias("n"))
    w = W.partitionBy("g", "k")
    c = c.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    cut = c.where(F.col("upto") >= SUPPORT * F.col("all")).groupBy("g", "k").agg(F.min("bin").alias("cut"))
    return near.join(sized(cut, "mcd-cut"), ["g", "k"]).where("bin <= cut").groupBy("g", "k").agg(*moments(F.col("v")))


def least_determinants(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The model of least determinant of each group, after concentration from all starts until one's chosen rows are the
    same again. As rows are chosen by whole bins, that can be a cycle of a few choices; the least determinant of it counts."""
    state = F.struct("n", "s", "q", "log_det")
    moving = starts(rows).withColumn("path", F.array().cast("array<struct<n:bigint,s:array<bigint>,q:array<bigint>,log_det:double>>"))
    moving = sized(moving, "mcd-start")
    settled: DataFrame | None = None
    for _ in range(steps):
        now = sized(concentrate(rows, moving).mapInPandas(solve(), MODEL), "mcd")
        now = now.join(moving.select("g", "k", "path"), ["g", "k"])
        now = now.withColumn("at", F.array_position(F.transform("path", lambda p: F.struct(p.n, p.s, p.q)), F.struct("n", "s", "q"))).withColumn("path", F.concat("path", F.array(state)))
        now = sized(now, "mcd-moved")
        cycle = F.slice("path", F.col("at").cast("int"), (F.size("path") - F.col("at")).cast("int"))
        best = F.array_min(F.transform(cycle, lambda p: F.struct(p.log_det, p.n, p.s, p.q)))
        done = now.where("at > 0").withColumn("best", best).select("g", "k", "best.*")
        settled = done if settled is None else settled.unionByName(done)
        moving = now.where("at = 0").drop("at")
        moving = F.broadcast(moving) if fits(now) else moving
        if not moving.limit(1).count():
            break
    rest = moving.select("g", "k", "log_det", "n", "s", "q")
    settled = rest if settled is None else settled.unionByName(rest)
    return settled.groupBy("g").agg(F.min_by(F.struct("k", "n", "s", "q"), F.struct("log_det", "k")).alias("x")).select("g", "x.*")


def robust_models(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(g, med, centre, inverse) of every group of `rows` (g: string, x: multiples of 1 / GRID): the estimate of least
    determinant, then one reweighting by the rows within its 97.5 % region. centre is relative to med."""
    med = sized(middles(rows, F.col("x"), "med"), "medians")
    rows = materialize(rows.join(med, "g").select("g", F.zip_with("x", "med", lambda a, b: a - b).alias("v")), "centred")
    mad = middles(rows, F.transform("v", F.abs), "mad").select("g", F.transform("mad", lambda m: F.greatest(F.round(m * 1.4826).cast("long"), F.lit(1).cast("long"))).alias("mad"))
    raw = least_determinants(rows.join(sized(mad, "deviations"), "g"), steps)
    raw = sized(raw.mapInPandas(solve(consistency(SUPPORT)), MODEL), "mcd-raw")
    inside = rows.join(raw, "g").where(distance() <= INSIDE).groupBy("g", "k").agg(*moments(F.col("v")))
    final = materialize(inside.mapInPandas(solve(consistency(0.975)), MODEL), "mcd-final")
    return final.join(med, "g").select("g", "med", "centre", "inverse")


def outlier_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance
    (squared, rounded; null if base_failed) and kept.

    Estimates rest on the rows that pass the base rules. A group (language, source) of fewer than min_rows of these is
    judged by its language's, a language that small by that of all rows; where these are too few, too, nothing is rejected.
    Null text has no words and fails. Null languages and sources form groups. Other columns are ignored.
    """
    stats = materialize(statistics(docs, text, doc_id, lang, source), "statistics")
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    own = name("lang", "source")
    good = stats.where(~F.col("base_failed")).select("lang", own.alias("own"), "x")
    sizes = materialize(good.groupBy("lang", "own").agg(F.count("*").alias("n")), "group-sizes")
    rows_in_all = sizes.agg(F.sum("n")).first()[0] or 0
    by_lang = sizes.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("in_lang"))
    level = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of"))).select(
        "own", F.when(F.col("n") >= min_rows, F.col("own")).when(F.col("in_lang") >= min_rows, name("lang")).when(F.lit(rows_in_all >= min_rows), "*").alias("g"),
    )
    level = sized(level.where("g is not null"), "levels")
    ways = level.select("g").distinct().agg(F.max(F.col("g").startswith('{"lang"') & ~F.col("g").contains('"source"')), F.max(F.col("g") == "*")).first()
    parts = good.join(level, "own").where(F.col("g") == F.col("own")).select("g", "x")
    if ways[0]:
        parts = parts.unionByName(good.select(name("lang").alias("g"), "x"))
    if ways[1]:
        parts = parts.unionByName(good.select(F.lit("*").alias("g"), "x"))
    models = robust_models(materialize(parts, "vectors"))
    models = sized(level.join(models, "g").select("own", "med", "centre", "inverse"), "models")
    judged = stats.withColumn("own", own).join(models, "own", "left").withColumn("v", F.zip_with("x", "med", lambda a, b: a - b))
    d2 = F.when(~F.col("base_failed"), F.round(distance(), 6))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", d2.alias("distance"),
        (~F.col("base_failed") & ~F.coalesce(d2 > cutoff, F.lit(False))).alias("kept"),
    )
