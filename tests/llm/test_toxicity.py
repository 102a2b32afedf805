import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import toxicity


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = toxicity.train(docs, labels.where(~held))
    assert model.thresholds == sorted(model.thresholds) and all(w > 0 for w in model.weights.values())
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.where(held), "doc_id").select("found", "toxic").collect()
    bad, good = [f for f, t in rows if t], [f for f, t in rows if not t]
    assert sum(bad) >= 0.8 * len(bad) and sum(good) <= 0.03 * len(good)


def test_fit_recovers_an_ordinal_model():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)) < 0.3
    z = x @ [3.0, 1.5, 0, 0] + rng.logistic(size=3000)
    grades = (z > 1).astype(int) + (z > 3) + (z > 5)
    m = toxicity.fit_ordinal([np.flatnonzero(r) + 10 for r in x], grades, 4, l1=1e-4, refit=1e-5)
    assert abs(m.weights[10] - 3) < 0.4 and abs(m.weights[11] - 1.5) < 0.4 and np.allclose(m.thresholds, [1, 3, 5], atol=0.4)


def test_edge_cases(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (203, 1)], "doc_id long, toxic long")
    got = toxicity.score(docs.withColumn("Grade", F.lit("x")), toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows)
    none = toxicity.train(docs, labels.where("false"))
    assert none.thresholds == [] and not any(r["toxic"] for r in toxicity.score(docs, none).collect())
    assert toxicity.score(no_docs, none).count() == 0
