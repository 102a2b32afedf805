"""Selection, rejection, token budget and packing of documents ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import EOS, content_hash, order_key, split_of, token_bytes, token_hash, token_slice
from .prefix import blocked, running
from .tokenize import ByteTokenizer, Tokenizer, token_fault, tokenize


def validity(text: Column) -> Column:
    """The first reason to refuse a raw row, or null. White space alone is text."""
    return F.when(text.isNull(), "missing_or_non_string_text").when(text == "", "empty_text")


def capped(rows: DataFrame, ordinal: str, cap: int) -> DataFrame:
    """The first `cap` rows by a stable, distinct ordinal (integers with any gaps), invalid ones included: whole blocks of
    the ordinal are counted first, and only the block in which the cap falls is ordered."""
    found = blocked(rows, [], ordinal, sums={"_place": "1"})
    return found.where(F.col("_place") < cap).drop("_place")


def select_documents(rows: DataFrame, text: str = "text", identity: str = "doc_id", order_seed: int = 31, split_seed: int = 41001, permyriad: int = 100, split: str | None = "train") -> DataFrame:
    """Valid rows with content, split and ord (hash order); `split` None keeps both splits (inspection)."""
    out = rows.where(validity(F.col(text)).isNull()).withColumn("content", content_hash(F.col(text)))
    out = out.withColumn("split", split_of(split_seed, F.col("content"), permyriad)).withColumn("ord", order_key(order_seed, F.col("content"), F.col(identity)))
    return out if split is None else out.where(F.col("split") == split)


def purpose_counts(selected: DataFrame, wanted: str | None) -> DataFrame:
    """(reason, n): valid documents that another purpose's split takes; selected has both splits."""
    if wanted is None:
        return selected.sparkSession.createDataFrame([], "reason string, n long")
    other = selected.where(F.col("split") != wanted)
    return other.groupBy(F.concat(F.lit("assigned_to_"), "split").alias("reason")).agg(F.count("*").alias("n"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Counters (reason, n) added up reason by reason."""
    all_ = counts[0]
    for c in counts[1:]:
        all_ = all_.unionByName(c)
    return all_.groupBy("reason").agg(F.sum("n").alias("n"))


def accept_reasons(docs: DataFrame, registered: DataFrame | None = None, max_id: int | None = None, registered_tokens: DataFrame | None = None, tokenizer: Tokenizer | None = None, embedding_rows: int | None = None) -> DataFrame:
    """Add tok_sha, n and reason (null: candidate) to documents with content and ord (distinct).

    The sequential accept loop in closed form. registered: (content) of other stages; registered_tokens: (tok_sha) of
    them; max_id: the largest token id that may occur; tokenizer: the byte tokenizer unless given. The first document of
    each token sequence is found by an aggregation that combines before the shuffle, over hashes only.
    """
    if tokenizer is None and max_id is None:
        d = docs.withColumn("tok_sha", token_hash(F.col("text"))).withColumn("n", F.octet_length("text").cast("long"))
        fault = F.when(F.col("n") == 0, "empty_tokenization")
    else:
        d = tokenize(docs, tokenizer or ByteTokenizer(), keep_ids=False)
        fault = token_fault((1 << 32) - 1 if max_id is None else max_id, embedding_rows)
    d = d.withColumn("_early", fault).drop("least", "most")
    if registered is not None:
        known = registered.select("content").distinct().withColumn("_known", F.lit(True))
        d = d.join(known, "content", "left").withColumn("_early", F.when(F.col("_known"), "overlap_registry").otherwise(F.col("_early"))).drop("_known")
    if registered_tokens is not None:
        known = registered_tokens.select("tok_sha").distinct().withColumn("_known", F.lit(True))
        d = d.join(known, "tok_sha", "left").withColumn("_early", F.coalesce("_early", F.when(F.col("_known"), "token_sequence_overlap"))).drop("_known")
    first = d.where("_early is null").groupBy("tok_sha").agg(F.min(F.struct("ord", "content")).alias("_first"))
    d = d.join(first, "tok_sha", "left")
    later = F.when(F.col("content") == F.col("_first.content"), "duplicate_within_stage").otherwise("token_sequence_overlap")
    reason = F.coalesce("_early", F.when(F.col("ord") != F.col("_first.ord"), later))
    return d.withColumn("reason", reason).select(*docs.columns, "tok_sha", "n", "reason")


def budget_outcome(reasons: DataFrame, cap: int) -> DataFrame:
    """(ord, reason) of the rows that the loop reaches before it stops: at the first document that fills the budget, or at
    the first that finds a single token's room, whose reason is insufficient_token_budget."""
    c = running(reasons.where("reason is null"), "ord", {"token_start": "n + 1"})
    full = c.where((F.col("token_start") <= cap - 2) & (F.col("token_start") + F.col("n") + 1 >= cap)).agg(F.min("ord").alias("o"), F.lit(None).cast("string").alias("why"))
    dead = c.where(F.col("token_start") == cap - 1).agg(F.min("ord").alias("o"), F.lit("insufficient_token_budget").alias("why"))
    stop = full.unionByName(dead).where("o is not null").agg(F.min(F.struct("o", "why")).alias("stop"))
    out = reasons.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("ord") <= F.col("stop.o")))
    why = F.when(F.col("stop").isNotNull() & (F.col("ord") == F.col("stop.o")) & F.col("reason").isNull(), F.col("stop.why")).otherwise(F.col("reason"))
    return out.withColumn("reason", why).drop("stop")


def pack_to_budget(candidates: DataFrame, cap: int) -> DataFrame:
    """Accepted candidates with document_index, token_start, content_token_count, token_end, truncated for a budget of
    `cap` tokens; each document is followed by one end-of-text token."""
    c = running(candidates, "ord", {"token_start": "n + 1", "document_index": "1"}).where(F.col("token_start") <= cap - 2)
    k = F.least(F.col("n"), cap - F.col("token_start") - 1)
    return c.withColumn("content_token_count", k).withColumn("token_end", F.col("token_start") + k + 1).withColumn("truncated", k < F.col("n"))


def shard_table(boundaries: DataFrame, shard_tokens: int) -> DataFrame:
    """(shard_index, token_count, document_parts) of fixed-size shards."""
    part = boundaries.select("token_start", "token_end", F.explode(F.sequence(F.expr(f"token_start div {shard_tokens}"), F.expr(f"(token_end - 1) div {shard_tokens}"))).alias("shard_index"))
    size = F.least("token_end", (F.col("shard_index") + 1) * shard_tokens) - F.greatest("token_start", F.col("shard_index") * shard_tokens)
    return part.groupBy("shard_index").agg(F.sum(size).alias("token_count"), F.count("*").alias("document_parts"))


def fragments(packed: DataFrame, length: int, ids: Column) -> DataFrame:
    """(part, p, body): the stream of accepted documents cut at every `length` tokens; ids holds a document's tokens
    (binary), of which content_token_count are taken and one end-of-text token is added. p: place in the stream."""
    body = F.concat(token_slice(ids, F.lit(0), F.col("content_token_count")), F.lit(EOS.to_bytes(4, "little")))
    p = packed.select("token_start", "token_end", body.alias("ids"))
    p = p.select("*", F.explode(F.sequence(F.expr(f"token_start div {length}"), F.expr(f"(token_end - 1) div {length}"))).alias("part"))
    a = F.greatest(F.col("token_start"), F.col("part") * length)
    b = F.least(F.col("token_end"), (F.col("part") + 1) * length)
    return p.select("part", a.alias("p"), token_slice(F.col("ids"), a - F.col("token_start"), b - a).alias("body"))


def sequences(packed: DataFrame, length: int, text: str = "text") -> DataFrame:
    """(seq_id, ids: binary uint32) of complete sequences of a packed stream; a document gives one slice to each it touches."""
    p = fragments(packed, length, token_bytes(F.col(text)))
    joined = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("p", "body"))), lambda x: x["body"]), F.lit(b""), lambda acc, x: F.concat(acc, x))
    out = p.groupBy(F.col("part").alias("seq_id")).agg(joined.alias("ids"))
    return out.where(F.octet_length("ids") == 4 * length)


def token_array(ids: Column) -> Column:
    """A binary token column of bounded length (a sequence) as an array of integers."""
    h = F.hex(ids)
    at = lambda i, k: F.substring(h, 8 * i + 2 * k + 1, F.lit(2))
    return F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("long"))


def boundary_violations(b: DataFrame) -> DataFrame:
    """(rule, document_index) of boundaries that aren't dense, contiguous, non-empty or of the right length."""
    d = blocked(b, [], "document_index", lags={"_end": "token_end", "_i": "document_index"})
    rules = {
        "index_not_dense": F.col("document_index") != F.coalesce("_i", F.lit(-1)) + 1, "not_contiguous": F.col("token_start") != F.coalesce("_end", F.lit(0)),
        "empty_document": F.col("content_token_count") <= 0, "wrong_length": F.col("token_end") - F.col("token_start") != F.col("content_token_count") + 1,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())
    return d.select(F.explode(found).alias("rule"), "document_index")
