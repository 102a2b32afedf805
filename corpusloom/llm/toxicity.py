"""Toxicity: cumulative-link (proportional odds) ordinal regression on sparse text features.

P(grade > k | x) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_0 < t_1 < ...; the expected severity is
the sum of these over k. Features: presence of hashed words. Fitted on a bounded sample of labelled rows; every document
is then scored over its whole text, map-side.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import as_bytes, materialize, place, schema_with, text_chunks

#: Labelled rows that the model is fitted on, at most: those with the least md5 of seed and id.
SAMPLE_ROWS = 6_000
#: Bytes of their feature hashes, at most: rows in order of their id, until these are reached.
SAMPLE_BYTES = 64 << 20
#: Words in fewer sampled documents are no features.
MIN_DOCS = 5
#: A marker: a word this much more frequent among toxic documents, in this share of them at least.
LIFT, SHARE = 20.0, 0.02
GRADES = 4
#: Documents of at least this chance of a grade above 0 are toxic.
REJECT = 0.4
#: Lengths (bytes) of a word's beginnings that are features; MANY different words with one beginning are another feature.
PREFIX, MANY = (4, 5, 6), 3
#: ASCII punctuation parts words, A-Z is lower-cased; bytes above 127 stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: bytes) -> list[int]:
    """Sorted distinct hashes of the text's words and of their beginnings (PREFIX bytes), so that inflected forms of a word
    share features; a beginning that many different words of the text share counts once more."""
    words = set(text.translate(TABLE).split())
    starts = Counter([w[:n] for w in words for n in PREFIX if len(w) > n])
    found = words | {b"*" + s for s, n in starts.items() if n >= MANY} | {s + b"-" for s in starts}
    return sorted(set(map(zlib.crc32, found)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    """Weights by feature hash, and the thresholds in rising order (none: nothing is toxic)."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def exceed(self, words: list[int]) -> list[float]:
        """P(grade > k) for each k."""
        score = sum(self.weights[f] for f in words if f in self.weights)
        return [float(p) for p in sigmoid(np.array([score - t for t in self.thresholds]))]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 4e-3, refit: float = 2e-4, steps: int = 250, rate: float = 0.1) -> OrdinalModel:
    """Proximal Adam on the mean negative log-likelihood, twice: the l1 penalty chooses few words, and their weights are
    fitted again with hardly any penalty, so that they aren't shrunk. Weights
    aren't negative: a word can be evidence of toxicity, but no amount of harmless text outweighs it. Deterministic.

    rows: sorted distinct feature hashes of each document. Grades that don't occur have no threshold of their own.
    """
    present = sorted(set(grades.tolist()))
    if len(present) < 2:
        return OrdinalModel()
    level = np.searchsorted(present, grades)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    vocabulary, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # weights can't be negative: words that aren't more frequent above the least grade could never enter
    high = np.bincount(column, weights=(level > 0)[doc], minlength=len(vocabulary))
    for penalty, used in ((l1, (high >= MIN_DOCS) & (high * len(rows) > df * (level > 0).sum())), (refit, None)):
        if used is None:
            used = weights > 0
        number = np.cumsum(used) - 1
        doc, column, vocabulary = doc[used[column]], number[column[used[column]]], vocabulary[used]
        weights, thresholds = _proximal_adam(doc, column, len(vocabulary), level, len(present) - 1, penalty, steps, rate)
    return OrdinalModel({int(f): float(x) for f, x in zip(vocabulary, weights, strict=True) if x}, thresholds.tolist())


def _proximal_adam(doc: np.ndarray, column: np.ndarray, d: int, level: np.ndarray, k: int, l1: float, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (d) and thresholds (k) for ones at (doc, column) and levels 0 to k."""
    n, at = len(level), np.arange(len(level))
    above = np.array([(level > j).mean() for j in range(k)])
    logit = -np.log(above / (1 - above))
    p = np.concatenate([np.zeros(d), logit[:1], np.log(np.maximum(np.diff(logit), 1e-2))])
    thresholds = lambda: p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        z = np.bincount(doc, weights=p[column], minlength=n)[:, None] - thresholds()
        up = np.concatenate([np.ones((n, 1)), sigmoid(z), np.zeros((n, 1))], axis=1)
        slope = up * (1 - up)
        chance = np.maximum(up[at, level] - up[at, level + 1], 1e-12)
        by_score = -(slope[at, level] - slope[at, level + 1]) / chance / n
        by_t = np.array([(np.where(level == j + 1, slope[:, j + 1], 0) - np.where(level == j, slope[:, j + 1], 0)) @ (1 / chance) / n for j in range(k)])
        by_gap = [by_t[j + 1 :].sum() * np.exp(p[d + 1 + j]) for j in range(k - 1)]
        g = np.concatenate([np.bincount(column, weights=by_score[doc], minlength=d), [by_t.sum()], by_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        size = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p = p - size * m / (1 - 0.9**step)
        p[:d] = np.maximum(p[:d] - l1 * size[:d], 0)
    return p[:d], thresholds()


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades from yes/no labels: 0 not toxic; 1, 2, 3 for the thirds of the toxic documents by their number of markers,
    which are the features that are far more frequent in the sample's toxic documents."""
    n_toxic, n_clean = int(toxic.sum()), int((1 - toxic).sum())
    if not n_toxic:
        return np.zeros(len(rows), dtype=np.int64)
    words = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    count = lambda of: np.bincount(np.searchsorted(words, np.concatenate(of)) if of else [], minlength=len(words))
    bad, good = count([r for r, t in zip(rows, toxic, strict=True) if t]), count([r for r, t in zip(rows, toxic, strict=True) if not t])
    marker = set(words[(bad >= max(MIN_DOCS, SHARE * n_toxic)) & (bad / n_toxic > LIFT * (good + 0.5) / (n_clean + 1))].tolist())
    hits = np.array([sum(f in marker for f in r.tolist()) for r in rows])
    low, high = np.quantile(hits[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic > 0, 1 + (hits > low) + (hits > high), 0)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", grade: str | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> OrdinalModel:
    """Fit on sample_rows labelled documents and SAMPLE_BYTES of features at most. `grade` names a column of severity grades (0 to 3) in labels; without
    it they are made from `label`. Rows without a label or id are left out; repeated ids count as often as they match."""
    wanted = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).cast("long").alias("y"), *([F.col(grade).cast("long").alias("g")] if grade else []))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string")))
    wanted = materialize(wanted.orderBy(order, "i").limit(sample_rows), "label-sample")
    hashed = _hashes(F.col("text"))
    sample = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("text")).join(F.broadcast(wanted), "i")
    # repeated ids could multiply the rows: the bound holds for what comes to the driver, too
    rows = sample.select("i", "y", *(["g"] if grade else []), hashed.alias("f")).orderBy("i", "f").limit(sample_rows)
    before = W.orderBy("i", "f").rowsBetween(W.unboundedPreceding, 0)  # over sample_rows rows at most
    rows = rows.withColumn("upto", F.sum(F.octet_length("f")).over(before)).where(F.col("upto") <= SAMPLE_BYTES).drop("upto").collect()
    found = [np.frombuffer(r["f"], dtype="<u4").astype(np.int64) for r in rows]
    toxic = np.array([1 if r["y"] else 0 for r in rows], dtype=np.int64)
    grades = np.array([r["g"] for r in rows], dtype=np.int64) if grade else severity_grades(found, toxic)
    return fit_ordinal(found, grades, GRADES)


@F.arrow_udf(returnType=T.BinaryType())
def _hashes(text: pa.Array) -> pa.Array:
    return pa.array([np.array(features(t), dtype="<u4").tobytes() for t in as_bytes(text)], pa.binary())


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", reject: float = REJECT) -> DataFrame:
    """All columns with expected_severity (double, rounded to 6), grade (int: thresholds more likely passed than not) and
    toxic (boolean: P(grade > 0) >= reject) added or replaced. Null and empty text have no features. No rows: no rows."""
    out = ("expected_severity", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())
    schema = schema_with(docs, *out)
    carried = [c for c in docs.columns if c.lower() not in {n for n, _ in out}]
    at = place(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights: features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in text_chunks(batches, at):
            p = [known.exceed(features(t)) for t in as_bytes(batch.column(at))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            columns += [pa.array([round(sum(x), 6) for x in p], pa.float64()), pa.array([sum(y >= 0.5 for y in x) for x in p], pa.int32()), pa.array([bool(x) and x[0] >= reject for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows that score() doesn't call toxic, with their columns and no others."""
    at = place(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights: features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in text_chunks(batches, at):
            p = [known.exceed(features(t)) for t in as_bytes(batch.column(at))]
            yield batch.filter(pa.array([not x or x[0] < reject for x in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
