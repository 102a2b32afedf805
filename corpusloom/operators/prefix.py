"""Prefix sums over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def running(df: DataFrame, key: str, sums: dict[str, str], digits: int = 3) -> DataFrame:
    """Add exclusive running sums {out: value expression} in the order of `key`, a distinct hex hash.

    Two levels: totals of the 16^digits ranges of the key (their number bounds the broadcast and the only global window),
    then windows inside each range.
    """
    block = F.substring(key, 1, digits)
    rows = df.withColumn("_block", block)
    totals = rows.groupBy("_block").agg(*[F.sum(F.expr(v)).alias(f"_t_{o}") for o, v in sums.items()])
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("_block", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    inner = W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(base), "_block")
    for o, v in sums.items():
        rows = rows.withColumn(o, (F.col(f"_b_{o}") + F.coalesce(F.sum(F.expr(v)).over(inner), F.lit(0))).cast("long"))
    return rows.drop("_block", *[f"_b_{o}" for o in sums])


#: Widths of the blocks of an integer order; a window holds one block of one group.
BLOCK = 1 << 16


def blocked(df: DataFrame, by: list[str], order: str, sums: dict[str, str] | None = None, highs: dict[str, str] | None = None, lags: dict[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Add, over the rows before each one in its group (`by`; none: the whole table) in the order of a distinct integer
    column: sums {out: expression} (0 at first), highs (running maxima; null at first) and lags (the value just before).

    Two levels, so that few groups don't make few tasks: windows over one block of one group, and over the blocks' totals."""
    sums, highs, lags = sums or {}, highs or {}, lags or {}
    b = "_block"
    rows = df.withColumn(b, F.floor(F.col(order) / block))
    for o, v in {**sums, **highs, **lags}.items():
        rows = rows.withColumn(f"_v_{o}", F.expr(v))
    totals = rows.groupBy(*by, b).agg(
        *[F.sum(f"_v_{o}").alias(f"_t_{o}") for o in sums], *[F.max(f"_v_{o}").alias(f"_t_{o}") for o in highs],
        *[F.max_by(F.struct(F.col(f"_v_{o}").alias("v")), order).alias(f"_t_{o}") for o in lags],
    )
    outer = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        *by, b, *[F.coalesce(F.sum(f"_t_{o}").over(outer), F.lit(0)).alias(f"_b_{o}") for o in sums], *[F.max(f"_t_{o}").over(outer).alias(f"_b_{o}") for o in highs],
        *[F.last(f"_t_{o}").over(outer).alias(f"_b_{o}") for o in lags],
    )
    inner = W.partitionBy(*by, b).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    on = [c for c in by] + [b]
    renamed = base.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in base.columns if c not in on])
    rows = rows.join(renamed, [rows[c].eqNullSafe(renamed[f"_k_{c}"]) for c in on])
    for o in sums:
        rows = rows.withColumn(o, F.col(f"_b_{o}") + F.coalesce(F.sum(f"_v_{o}").over(inner), F.lit(0)))
    for o in highs:
        rows = rows.withColumn(o, F.greatest(F.col(f"_b_{o}"), F.max(f"_v_{o}").over(inner)))
    for o in lags:
        rows = rows.withColumn(o, F.coalesce(F.last(F.struct(F.col(f"_v_{o}").alias("v"))).over(inner), F.col(f"_b_{o}"))["v"])
    return rows.select(*df.columns, *sums, *highs, *lags)
