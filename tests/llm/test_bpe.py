import base64
import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.llm import bpe, packing
from corpusloom.llm.queries import PATTERN, RANKS, op4_bpe


@pytest.fixture(scope="module")
def reference():
    return packing.encoding(RANKS, PATTERN)


def digest(ids):
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_round_trip(docs, reference):
    got = bpe.bpe_round_trip(docs.withColumn("N_Tokens", F.lit(0)).withColumnRenamed("text", "Text"), RANKS, PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r["Text"] or ""
        ids = reference.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(ids), hashlib.sha256(t.encode()).hexdigest())
        assert np.frombuffer(r["token_ids"], dtype="<u4").tolist() == ids


def pieces_of(reference, words):
    return [np.array(reference._encode_single_piece(w), dtype="<u4").tobytes() for w in words]


def test_words_of_all_lengths(reference):
    c = bpe.codec(RANKS, PATTERN)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcehinorst '!0é日🙂") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    pieces = sorted({w.encode() for x in words for w in regex.findall(PATTERN, x.decode())} - set(c.ranks))
    pieces += ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(80)).encode() for _ in range(60)]
    pieces += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)).encode() for n in (100, 257, 5000, 100_000)]
    pieces += [b"-" * 100_000, b"x" * 30_001, b"=-" * 9000, b" " * 50_000, b"7" * 4097]
    assert c.merge_words(pieces) == pieces_of(reference, pieces)


def test_any_merge_table(tmp_path, monkeypatch):
    """Tables that no training gives, in which a merge can make a pair of lower rank; words of many stretches."""
    rng = random.Random(3)
    for n in range(12):
        multi = list({bytes(rng.choice(b"aab") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 40))})
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(multi)}
        path = tmp_path / f"{n}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
        monkeypatch.setattr(bpe, "QUERY_ROWS", rng.choice([1, 9000, 6_000_000]))
        words = [bytes(rng.choice(b"ababac") for _ in range(rng.randint(1, 150))) for _ in range(40)] + [b"a" * 97, b"ab" * 60, b"aab" * 30]

        def plain(w):
            parts = [w[i : i + 1] for i in range(len(w))]
            while best := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None):
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            return np.array([ranks[x] for x in parts], dtype="<u4").tobytes()

        assert bpe.Codec(str(path), PATTERN).merge_words(words) == [plain(w) for w in words]


def test_fuzz_against_library(reference):
    rng = random.Random(2)
    alphabet = "aàé zZ09\t\n\r\x0b\x1c\x85\xa0 ​'slre.,#_-ßΩ中🙂́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    c = bpe.codec(RANKS, PATTERN)
    ids = c.encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert c.decode(ids) == [t.encode() for t in texts]


def test_words_outlive_the_cache(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    c = bpe.Codec(RANKS, PATTERN)
    for t in ["one two three four", "four fiver sixer", "one two sixer", "nothing old", "four one nothing"] * 2:
        assert np.frombuffer(c.encode([t])[0], dtype="<u4").tolist() == reference.encode_ordinary(t)
    assert len(c.young) + len(c.old) < 20


def test_faster_pattern_is_the_same():
    assert PATTERN in bpe.FASTER
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("ab1 \t\n'stredvml.,é²\u2028_") for _ in range(rng.randint(0, 25)))
        assert regex.findall(PATTERN, t) == regex.findall(bpe.FASTER[PATTERN], t)


def test_decode_column(docs):
    done = bpe.decode_column(bpe.bpe_round_trip(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in done)


def test_query_and_empty(spark, sf, no_docs, reference):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in op4_bpe(spark, sf).collect()}
    assert got.keys() == texts.keys() and all(got[i]["ids_sha256"] == digest(reference.encode_ordinary(t)) for i, t in texts.items())
    assert bpe.bpe_round_trip(no_docs, RANKS, PATTERN).count() == 0
