import hashlib
import itertools

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import packing, toxicity
from corpusloom.llm.common import materialize
from corpusloom.llm.queries import OP1_SQL, PATTERN, RANKS


def near_copies_gone(rows):
    """All pairs, all sets: of documents linked by a similarity of 0.8 the one with the smallest id stays."""
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        best[find(i)] = min(best.get(find(i), (key, d)), (key, d), key=lambda x: x[0])
    return sorted((d for _, d in best.values()), key=repr)


def mixed(docs, tmp_path):
    """Ids and times of the mixing stage by DuckDB's SQL over its input."""
    docs.write.parquet(f"file://{tmp_path}/in")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/in/*.parquet'")
    return sorted((r[0] for r in con.sql(f"select doc_id from ({OP1_SQL})").fetchall()), key=repr)


def follow(spark, docs, sf, tmp_path):
    """Run the stages; each one's rows equal the plain version's over the same input."""
    enc, last = packing.encoding(RANKS, PATTERN), corpus_pipeline.STAGES[-1][0]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "stage")
        if name != last:
            assert docs.columns == before.columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        ids = sorted((r["doc_id"] for r in docs.collect()), key=repr)
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            least = model.thresholds[0] if model.thresholds else np.inf
            score = lambda t: sum(model.weights.get(f, 0.0) for f in toxicity.features((t or "").encode()))
            assert ids == sorted((d for d, t in rows if 1 / (1 + np.exp(least - score(t))) < toxicity.REJECT), key=repr)
        elif name == "exact dedup":
            best = {}
            for d, t in rows:
                k = (t or "").encode().lower()
                best[k] = d if k not in best else max(d, best[k], key=lambda x: -1 if x is None else x)
            assert ids == sorted(best.values(), key=repr)
        elif name == "near dedup":
            assert ids == near_copies_gone(rows)
        elif name == "mixing":
            assert ids == mixed(before, tmp_path)
        else:
            got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["token_ids"]), r["decoded_sha256"]) for r in docs.collect()), key=repr)
            want = []
            for d, t in rows:
                tokens = np.array(enc.encode_ordinary(t or ""), dtype="<u4")
                want.append((d, len(tokens), tokens.tobytes(), hashlib.sha256((t or "").encode()).hexdigest()))
            assert got == sorted(want, key=repr)
    return docs


def test_stages_equal_plain_versions(spark, sf, tmp_path):
    done = follow(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, tmp_path)
    whole = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(whole) == key(done)


def test_nulls_repeated_ids_long_texts_and_clashing_columns(spark, docs, sf, tmp_path):
    names = {n: F.lit("mine") for n in ("digest", "copy_rank", "keep_id", "toxic", "mix_row", "own_id", "key", "root")}
    done = follow(spark, docs.withColumns(names), sf, tmp_path).collect()
    assert done and all(r[n] == "mine" for r in done for n in names)


def test_no_rows(spark, sf, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "none")
        assert docs.count() == 0


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]


def test_each_stage_begins_with_a_collected_heap(spark, no_docs):
    beans = lambda: spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    assert corpus_pipeline.prepared(lambda s, docs, d: docs)(spark, no_docs, "") is no_docs
    assert full() > before
