import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing
from corpusloom.llm.queries import OP1_SQL, op1_mixing


def plain_fill(nodes, budget):
    """[(name, capacity, weight)] -> real shares by water-filling, one full node after another."""
    open_, left, share = list(nodes), Fraction(budget), {}
    while open_:
        total = sum(w for _, _, w in open_)
        full = [n for n in open_ if n[1] <= left * n[2] / total]
        if not full:
            return share | {n: left * w / total for n, _, w in open_}
        for n in full:
            share[n[0]] = Fraction(n[1])
            left -= n[1]
            open_.remove(n)
    return share


def test_fill_is_water_filling(spark):
    rng = random.Random(4)
    for _ in range(4):
        nodes = [(f"n{i}", rng.randint(0, 500), rng.randint(1, 6)) for i in range(7)]
        budget = rng.randint(0, 2500)
        got = {r[0]: r[1] for r in mixing.fill(spark.createDataFrame(nodes, "lang string, capacity long, weight long"), [], F.lit(budget).cast("long"), "lang", 60).select("lang", "share").collect()}
        want = plain_fill(nodes, budget)
        assert all(abs(got[n] - want[n]) < 1 and got[n] <= c for n, c, _ in nodes)
        assert sum(got.values()) == min(budget, sum(c for _, c, _ in nodes))


@pytest.mark.parametrize("digits,target", [(3, None), (1, 5000), (3, 0), (3, 10**9)])
def test_prefix_of_epochs(docs, rows, digits, target):
    got = mixing.mix(docs.withColumn("H", F.lit(1)).withColumn("mix_epoch", F.lit("x")), {"lang": {"en": 3}}, mixing.source_domain(), target=target, block_digits=digits).collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[2], r[3]] += len((r[1] or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (r[1] or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    total = sum(tokens.values())
    taken = sum(r["mix_tokens"] for r in got)
    if target == 0:
        assert taken == 0
    elif target == 10**9:
        assert taken == 2 * total  # two epochs of all
    else:
        assert taken >= min(target or total, 2 * total) > 0
    counts = Counter((r["doc_id"], r["text"], r["mix_epoch"]) for r in got)
    assert all(counts[i, t, 0] >= counts[i, t, e] for i, t, e in counts)


def test_query_equals_sql(spark, sf, no_docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(OP1_SQL).fetchall()
    cols = [d[0] for d in con.sql(OP1_SQL).description]
    assert sorted(map(tuple, op1_mixing(spark, sf).select(cols).collect())) == sorted(want)
    assert mixing.mix(no_docs, {}, F.col("lang")).count() == 0
