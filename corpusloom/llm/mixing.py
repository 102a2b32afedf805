"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree domain > language > source by weight. A node that cannot use its share (its tokens times
the most epochs) leaves the rest to its siblings; only what a whole subtree cannot use goes to the siblings of an
ancestor. Each leaf then takes whole seeded epochs and a token-prefix of one more. Integers throughout, so any engine
gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, materialize, sized

LEVELS = ("domain", "lang", "source")
#: Hex digits of the hash that name a block of an epoch's order; blocks are summed before any row is looked at singly.
BLOCK_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.expr(f"regexp_extract_all(`{text}`, '[^ \\\\t-\\\\r]+', 0)")), F.lit(0)).cast("long")


def source_domain(source: str = "source", domains: tuple[str, ...] = ("web", "books", "code", "forum")) -> Column:
    """The domain of sources named with a number: by its remainder; other names and null: the first."""
    number = F.expr(f"coalesce(try_cast(regexp_extract(coalesce(`{source}`, ''), '([0-9]{{1,9}})$', 1) as bigint), 0)")
    return F.element_at(F.array(*[F.lit(d) for d in domains]), (number % len(domains) + 1).cast("int"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """The node's weight, 1 unless given. Weights are positive integers."""
    given = weights.get(level, {})
    out = F.lit(1).cast("long")
    for name, w in given.items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str], budget: Column, level: str, multiple: int) -> DataFrame:
    """Add `share` to nodes (parents, level, weight, capacity): the parent's budget by weight, where nobody gets more than
    its capacity and what it leaves goes to its siblings. In order of capacity / weight, a node is full if its capacity is
    no more than its part of what the earlier ones left; the others divide the rest by cumulative rounding."""
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    # capacity / weight, in integers: times the least common multiple of all weights
    order = by.orderBy(F.col("capacity").cast("decimal(19,0)") * F.expr(f"{multiple} div weight").cast("decimal(18,0)"), level)
    past, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    d = lambda c: c.cast("decimal(19,0)")
    n = nodes.withColumn("budget", budget).withColumn("left_over", F.col("budget") - F.coalesce(F.sum("capacity").over(past), F.lit(0))).withColumn("open_weight", F.sum("weight").over(after))
    n = n.withColumn("full", d(F.col("capacity")) * d(F.col("open_weight")) <= d(F.col("left_over")) * d(F.col("weight")))
    # full nodes come first in this order; the sums below are over the others
    n = n.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(by)).withColumn("rest_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(by))
    n = n.withColumn("w1", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("w0", F.col("w1") - F.when(F.col("full"), 0).otherwise(F.col("weight")))
    part = lambda w: F.expr(f"cast(cast(rest as decimal(19,0)) * cast({w} as decimal(19,0)) div greatest(rest_weight, 1) as long)")
    return n.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(part("w1") - part("w0"))).drop("budget", "left_over", "open_weight", "full", "rest", "rest_weight", "w1", "w0")


def leaf_budgets(leaves: DataFrame, target: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, share) for leaves (domain, lang, source, tokens)."""
    multiple = math.lcm(1, *(w for given in weights.values() for w in given.values()))
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    shares: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(level, weights))
        if shares is None:
            shares = fill(nodes, [], F.lit(target).cast("long"), level, multiple)
        else:
            above = shares.select(*[F.col(c).alias(f"p_{c}") for c in path[:-1]], F.col("share").alias("given"))
            nodes = nodes.join(above, [nodes[c].eqNullSafe(above[f"p_{c}"]) for c in path[:-1]]).drop(*[f"p_{c}" for c in path[:-1]])
            shares = fill(nodes, path[:-1], F.col("given"), level, multiple).drop("given")
    shares = shares.select(*[F.col(c).alias(f"s_{c}") for c in LEVELS], "share")
    return leaves.join(shares, [leaves[c].eqNullSafe(shares[f"s_{c}"]) for c in LEVELS]).select(*LEVELS, "tokens", "share")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], domain: Column, target: int | None = None, max_epochs: int = 2, seed: int = 11, tokens: Column | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", block_digits: int = BLOCK_DIGITS) -> DataFrame:
    """The chosen rows with all their columns, a row once for each epoch that chose it, and mix_domain, mix_epoch (from 0)
    and mix_tokens added or replaced.

    domain: the column or expression that names a row's domain. target: tokens in all (default: as many as there are). A leaf takes the rows of an epoch, in the order of the md5 of seed, epoch,
    id and text, that start below its share; rows that are alike in id and text share a place and are taken together. Null language,
    source and domain are nodes of their own; null text has no tokens, and is taken by every epoch that passes its place.
    No rows: no rows.
    """
    names = {"mix_domain", "mix_epoch", "mix_tokens"}
    row, h = fresh(docs, "mix_row"), "h"
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]).alias(row), domain.cast("string").alias("domain"),
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), (tokens if tokens is not None else word_count(text)).alias("tokens"),
        F.col(f"`{doc_id}`").alias("id"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"),
    )
    # the places are worked out on a narrow table; the texts are read once more at the end, and never shuffled
    narrow = materialize(base.drop(row), "mix-rows")
    leaves = materialize(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    if target is None:
        target = int(leaves.agg(F.sum("tokens")).first()[0] or 0)
    budgets = leaf_budgets(leaves, target, max_epochs, weights)
    # whole epochs, and what the next one has to give
    plan = budgets.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(0).cast("long")).withColumn("want", F.col("share") - F.col("whole") * F.col("tokens"))
    plan = sized(plan.select(*[F.col(c).alias(f"l_{c}") for c in LEVELS], "whole", "want"), "mix-plan")
    on = lambda d, p: [d[c].eqNullSafe(p[f"l_{c}"]) for c in LEVELS]
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest")))
    leaf = [f"l_{c}" for c in LEVELS]
    part = narrow.join(plan, on(narrow, plan)).where("want > 0").select(*leaf, "want", "tokens", place.alias(h))
    blocks = part.groupBy(*leaf, "want", F.substring(h, 1, block_digits).alias("block")).agg(F.sum("tokens").alias("t"))
    before = W.partitionBy(*leaf).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0)))
    # the block in which the prefix ends: the last that starts below the share
    last = W.partitionBy(*leaf)
    edge = blocks.where("base < want").withColumn("at", F.max("block").over(last)).where("block = at").select(*[F.col(c).alias(f"e_{c}") for c in leaf], "block", "base")
    edge = sized(edge, "mix-edges")
    inside = part.join(edge, [part[c].eqNullSafe(edge[f"e_{c}"]) for c in leaf] + [F.substring(part[h], 1, block_digits) == edge["block"]]).groupBy(*leaf, "want", "base", h).agg(F.sum("tokens").alias("t"))
    start = F.col("base") + F.coalesce(F.sum("t").over(W.partitionBy(*leaf).orderBy(h).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("start", start).where("start < want").groupBy(*leaf).agg(F.max(h).alias("cut"))
    cut = cut.select(*[F.col(c).alias(f"c_{c}") for c in leaf], "cut")
    full = plan.join(cut, [plan[c].eqNullSafe(cut[f"c_{c}"]) for c in leaf], "left").select(*leaf, "whole", "cut")
    full = sized(full, "mix-cuts")
    rows = base.join(full, on(base, full)).withColumn("n", F.col("whole") + F.when(F.col("cut").isNotNull() & (place <= F.col("cut")), 1).otherwise(0)).where("n > 0")
    return rows.select(row, F.col("domain").alias("mix_domain"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("mix_epoch"), F.col("tokens").alias("mix_tokens")).select(f"{row}.*", "mix_domain", "mix_epoch", "mix_tokens")
