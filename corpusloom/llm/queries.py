"""Queries of this subpackage's operators over the driver's tables, and their DuckDB SQL where there is any."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, mixing, packing, quality, secrets, sharding, simhash, suffix, toxicity
from .common import shared_dir, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Target weights: web half of all tokens; within a domain English twice as much as German and French, and so on.
WEIGHTS = {"domain": {"web": 4, "books": 2, "code": 1, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
MULTIPLE = math.lcm(*(w for given in WEIGHTS.values() for w in given.values()))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, WEIGHTS, mixing.source_domain()).select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outlier_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id matrices are written; a row for each packed row that is read back: its documents' parts, cumulative lengths
    and digests of the id and position rows."""
    path = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    packing.write_packed(packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN, eos=50256, pad=50256), path)
    return spark.read.schema(packing.PACKED).parquet(path).select(
        F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.start").alias("starts"), "cu_seqlens", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_round_trip(docs, RANKS, PATTERN, ids=False, keep_text=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "expected_severity", "grade", (~F.col("toxic")).alias("kept"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written, whole rows, and what is returned is read from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(sharding.two_pass_shuffle(docs), path)
    written = spark.read.schema("doc_id long, text string, size long, slot long, shard int").parquet(path)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return written.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs).drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality, op3_packing, op4_bpe, op5_toxicity, op6_sharding, op7_exact_dedup, op8_secrets, op9_simhash, op10_suffix)}


def _weight(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[level].items()) + " else 1 end"


def _fill(level: str, above: str | None) -> str:
    """CTEs that divide each parent's budget among its nodes as mixing.fill does."""
    path = list(mixing.LEVELS[: mixing.LEVELS.index(level) + 1])
    up = ", ".join(path[:-1])
    by = f"partition by {up}" if up else ""
    given = f"(select {', '.join(path)}, cap, w, p.share as budget from {level}_n join {above}_s p using ({up}))" if above else f"(select *, (select sum(tokens) from leaves)::bigint as budget from {level}_n)"
    order = f"{by} order by cap::hugeint * ({MULTIPLE} // w), {level}"
    return f"""
{level}_n as (select {", ".join(path)}, sum(2 * tokens)::bigint as cap, {_weight(level)} as w from leaves group by {", ".join(path)}),
{level}_a as (select *, budget - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0) as over_,
    sum(w) over ({order} rows between current row and unbounded following) as open_w from {given}),
{level}_b as (select *, cap::hugeint * open_w <= over_ * w as full_ from {level}_a),
{level}_c as (select *, (budget - sum(case when full_ then cap else 0 end) over ({by}))::hugeint as rest, greatest(sum(case when full_ then 0 else w end) over ({by}), 1) as rest_w,
    coalesce(sum(case when full_ then 0 else w end) over ({order} rows between unbounded preceding and current row), 0) as w1 from {level}_b),
{level}_s as (select {", ".join(path)}, case when full_ then cap else (rest * w1) // rest_w - (rest * (w1 - w)) // rest_w end::bigint as share from {level}_c)"""


OP1_SQL = f"""
with base as (
    select doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as tokens, md5(coalesce(text, '')) as digest,
        ['web', 'books', 'code', 'forum'][coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as bigint), 0) % 4 + 1] as domain
    from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens from base group by all),
{_fill("domain", None)},{_fill("lang", "domain")},{_fill("source", "lang")},
plan as (select l.*, s.share, case when l.tokens > 0 then s.share // l.tokens else 0 end as whole from leaves l join source_s s using (domain, lang, source)),
places as (select b.*, whole, share - whole * p.tokens as want, md5('11:' || whole || ':' || coalesce(doc_id::varchar, '') || ':' || digest) as h
    from base b join plan p using (domain, lang, source)),
starts as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by h groups between unbounded preceding and 1 preceding), 0) as ahead from places),
chosen as (select *, whole + case when ahead < want then 1 else 0 end as n from starts)
select doc_id, domain, lang, source, unnest(range(n::bigint))::int as epoch, tokens as n_tokens from chosen
"""

OP7_SQL = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
    row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from t window w as (partition by text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op7_exact_dedup": OP7_SQL}
