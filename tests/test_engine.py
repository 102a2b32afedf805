import os
import random

import duckdb
import pytest

from corpusloom import queries as Q
from corpusloom.operators import corpus as C
from corpusloom.operators import metrics as M
from corpusloom.operators.order import order_table, permutation
from corpusloom.operators.prefix import blocked
from corpusloom.operators.tokenize import token_fault, tokenize
from corpusloom.plans import budget as B


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def same(row):
    return repr(tuple(round(x, 6) if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(name, spark, sf, con):
    got = Q.QUERIES[name](spark, sf)
    rel = con.sql(Q.SQL[name])
    assert sorted(rel.columns) == sorted(got.columns)
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(map(same, map(tuple, got.collect()))) == sorted(same([r[i] for i in at]) for r in rel.fetchall())


def test_queries_without_sql(spark, sf):
    assert set(Q.QUERIES) - set(Q.SQL) == {"buffered_order"}
    ids = [r["doc_id"] for r in Q.selected(spark, sf).orderBy("ord").collect()]
    got = {r["place"]: r["doc_id"] for r in Q.buffered_order(spark, sf).collect()}
    assert [got[i] for i in range(len(ids))] == [ids[i] for i in plain_order(len(ids), 31, 16)]


def plain_order(n, seed, size):
    rng, held, out = random.Random(seed), [], []
    for i in range(n):
        if len(held) < size:
            held.append(i)
        else:
            slot = rng.randrange(size)
            out.append(held[slot])
            held[slot] = i
    rng.shuffle(held)
    return out + held


def literal(docs, cap, registered):
    """The accept loop, one document after another."""
    contents, tokens, total, out = {c: "other" for c in registered}, set(), 0, {}
    for i, (c, t, n) in enumerate(docs):
        if c in contents:
            out[i] = "overlap_registry" if contents[c] == "other" else "duplicate_within_stage"
        elif t in tokens:
            out[i] = "token_sequence_overlap"
        elif cap - total <= 1:
            out[i] = "insufficient_token_budget"
            break
        else:
            total += min(n, cap - total - 1) + 1
            contents[c] = "own"
            tokens.add(t)
            out[i] = None
            if total >= cap:
                break
    return out


def test_closed_form_equals_the_loop(spark):
    rng = random.Random(9)
    for _ in range(3):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)]
        d = spark.createDataFrame([(t, f"c{t}", f"{i:064x}") for i, t in enumerate(texts)], "text string, content string, ord string")
        registered = [f"c{t}" for t in texts[:3]]
        cap = rng.randint(20, 120)
        reasons = C.accept_reasons(d, spark.createDataFrame([(c,) for c in registered], "content string"))
        found = {int(r["ord"], 16): r["reason"] for r in reasons.collect()}
        packed = {int(r["ord"], 16): r["token_end"] for r in C.pack_to_budget(reasons.where("reason is null"), cap).collect()}
        want = literal([(f"c{t}", t, len(t)) for t in texts], cap, registered)
        assert sorted(packed) == [i for i, r in want.items() if r is None]
        assert all(found[i] == r for i, r in want.items() if r not in (None, "insufficient_token_budget"))
        assert {int(r["ord"], 16): r["reason"] for r in C.budget_outcome(reasons, cap).collect()} == want


def test_goldens(spark):
    r = B.token_budget(spark.createDataFrame([(5_000_000_000, 2048)], "requested long, length long")).first()
    assert (r["sequences"], r["effective_tokens"], r["valid_targets"], r["remainder"]) == (2_441_406, 4_999_999_488, 4_997_558_082, 512)
    assert [x["seq_start"] for x in B.cycle_windows(spark, 5, 488281, 2441406).orderBy("cycle").collect()] == [0, 488281, 976562, 1464843, 1953124]
    t = spark.createDataFrame([("en", 0, 2.0), ("en", 1, 1.5), ("en", 2, 1.8), ("zh", 1, 3.0), ("zh", 2, 3.2)], "language string, boundary long, ce double")
    f = {(r["language"], r["boundary"]): (round(r["from_first"], 6), round(r["from_best"], 6)) for r in M.forgetting(t).collect()}
    assert f["en", 2] == (-0.2, 0.3) and f["zh", 2] == (0.2, 0.2)
    s = spark.createDataFrame([(0, "t", 1, 1.0), (1, "t", 1, 9.0), (2, "t", 2, 0.5)], "at long, tag string, step long, v double")
    assert [r["v"] for r in M.monotone(s, "tag", "at", "step").orderBy("at").collect()] == [1.0, 0.5]


def test_permutation(spark):
    for n, seed, size in ((100, 31, 16), (300, 31, 16), (0, 1, 4), (3, 1, 8), (16, 2, 16)):
        assert list(permutation(n, seed, size)) == plain_order(n, seed, size)
    got = order_table(spark, 1000, 5, 32, piece=64).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1000)) and [r["ordinal"] for r in got] == plain_order(1000, 5, 32)


def test_every_outcome_of_the_budget(spark):
    d = spark.createDataFrame([("ab", "c1", "1"), ("abcd", "c2", "2"), ("x", "c3", "3")], "text string, content string, ord string")
    run = lambda cap: {r["ord"]: r["reason"] for r in C.budget_outcome(C.accept_reasons(d), cap).collect()}
    assert run(100) == {"1": None, "2": None, "3": None}  # never full
    assert run(8) == {"1": None, "2": None}  # exactly full
    assert run(6) == {"1": None, "2": None}  # truncated
    assert run(4) == {"1": None, "2": "insufficient_token_budget"}  # one token's room
    assert run(9) == {"1": None, "2": None, "3": "insufficient_token_budget"}


def test_tokenizer_falls_back_document_by_document(spark):
    class Fails:
        eos_token_id = 9

        def encode(self, text):
            if "bad" in text:
                raise ValueError(text)
            return [True] if text == "bool" else list(text.encode())

        def encode_batch(self, texts):
            return [self.encode(t) for t in texts]

    d = spark.createDataFrame([(i, t) for i, t in enumerate(["fine", "bad one", "", None, "bool", "é"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n"], r["least"], r["most"], r["fault"]) for r in tokenize(d.repartition(1), Fails()).withColumn("fault", token_fault(200)).collect()}
    assert got == {0: (4, 101, 110, None), 1: (None, None, None, "tokenization_error"), 2: (0, None, None, "empty_tokenization"), 3: (None, None, None, "tokenization_error"), 4: (None, None, None, "tokenization_error"), 5: (2, 169, 195, None)}
    assert tokenize(d.where("false"), Fails()).count() == 0


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc") if rng.random() < 0.9 else None, i * 3 + rng.randint(0, 2), rng.choice([None, 1, 5, -2])) for i in range(300)]
    got = blocked(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], "k", sums={"s": "v"}, highs={"h": "v"}, lags={"l": "v"}, block=32).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["k"]):
        before = seen.setdefault(r["g"], [])
        some = [v for v in before if v is not None]
        assert (r["s"], r["h"], r["l"]) == (sum(some), max(some, default=None), before[-1] if before else None)
        before.append(r["v"])
    none = spark.createDataFrame([], "g string, k long, v long")
    assert blocked(none, [], "k", sums={"s": "v"}).count() == 0


def test_cap_counts_rows_not_ordinals(spark):
    d = spark.createDataFrame([(i,) for i in (30, 10, 20, 1 << 40)], "id long")
    assert [sorted(r[0] for r in C.capped(d, "id", n).collect()) for n in (0, 2, 3, 9)] == [[], [10, 20], [10, 20, 30], [10, 20, 30, 1 << 40]]


def test_plans(spark):
    assert B.resolve(5_000_000_000, 2048)["sequences"] == 2_441_406
    for bad in ((15, 16), (100, 1)):
        with pytest.raises(ValueError):
            B.resolve(*bad)
    assert B.slots([2, 4], 1, 1) == [(0, [2]), (1, [4])] and B.slots([0], 1, 2) == [(0, [0]), (1, [0])] and B.slots([0, 1, 2, 3], 2, 1) == [(0, [0, 1]), (1, [2, 3])]
    for bad in (([0, 1, 2], 2, 1), ([], 1, 1), ([0, 0], 1, 1)):
        with pytest.raises(ValueError):
            B.slots(*bad)
    jobs = B.job_matrix(spark, [11, 12], ["small", "base"])
    with pytest.raises(ValueError):
        B.assigned(jobs, [0], 1, 1, 65500, 5)
    with pytest.raises(ValueError):
        B.admitted(10, 12, 5)
    src = spark.createDataFrame([(c, x, i, 10, f"{x}{c}") for c in range(2) for i, x in enumerate(("en", "fr"))], "cycle long, language string, place long, available long, ordered_data_sha256 string")
    assert B.contract_faults(B.contract(src, 2, 5), 2, 2).count() == 0 and B.contract_faults(B.contract(src, 2, 5, windowed=False), 2, 2).count() == 0
    assert {r["rule"] for r in B.contract_faults(B.contract(src, 3, 5), 2, 3).collect()} == {"beyond_source"}
    assert {r["rule"] for r in B.contract_faults(B.contract(src, 3, 5, windowed=False), 2, 3).collect()} == {"tasks_missing"}
    with pytest.raises(ValueError):
        M.paired(src, src, {}, {})
    with pytest.raises(ValueError, match="probe_seed"):
        M.paired(src, src, dict.fromkeys(M.PAIRING, 1), dict.fromkeys(M.PAIRING, 1) | {"probe_seed": 2})
    assert B.attention_mask(spark, 2, 4).where("allowed").count() == 2 * 2 + (3 + 4 + 5 + 6) + 2 * 8


def test_curve_with_faults_is_refused(spark):
    rows = [("a", 0, 0, 2.0), ("a", 1, 10, 1.0), ("a", 3, 40, 0.5)]
    curve = lambda r: spark.createDataFrame(r, "mode string, step long, tokens long, ce double")
    r = M.curve_report(curve(rows), ["mode"], [1]).first()
    assert (r["step_auc"], r["token_auc"], r["auc"], r["step_0_ce"], r["final_ce"], r["ce_1"]) == (3.0, 37.5, 0.9375, 2.0, 0.5, 1.0)
    for bad in (rows + [("a", 1, 50, 1.0)], rows + [("a", 4, 40, 1.0)], rows[1:], rows + [("a", 4, 50, float("inf"))], [r for r in rows if r[1] != 1]):
        with pytest.raises(ValueError):
            M.curve_report(curve(bad), ["mode"], [1])
