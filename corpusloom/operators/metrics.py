"""Run metrics over event tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .prefix import blocked


def weighted_mean(loss_sum: Column, targets: Column) -> Column:
    """Never a mean of means."""
    return F.sum(loss_sum) / F.sum(targets)


def percent_change(first: Column, second: Column) -> Column:
    """100 * (second / first - 1); an error where the first is zero."""
    return F.when(first == 0, F.raise_error(F.lit("percent change from zero")).cast("double")).otherwise(100 * (second / F.nullif(first, F.lit(0)) - 1))


def forgetting(table: DataFrame, group: str = "language", order: str = "boundary", ce: str = "ce") -> DataFrame:
    """Add forgetting against the first and against the best value so far."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return table.withColumn("from_first", F.col(ce) - F.first(ce).over(w)).withColumn("from_best", F.col(ce) - F.min(ce).over(w))


def trapezoid(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """auc: area under the curve, normalised by the width; points: their number. x: distinct integers in each group."""
    p = blocked(points, by, x, lags={"_x": x, "_y": y})
    area = F.sum((F.col(x) - F.col("_x")) * (F.col(y) + F.col("_y")) / 2.0)
    width = F.max(x) - F.min(x)
    return p.groupBy(*by).agg((area / F.nullif(width, F.lit(0))).alias("auc"), F.count("*").alias("points"))


def curve_faults(curve: DataFrame, by: list[str], milestones: list[int], step: str = "step", tokens: str = "tokens", ce: str = "ce") -> DataFrame:
    """(by, fault) of curves that can't be summarised: a step or token count twice, tokens that don't grow, a loss that is
    no number, an early milestone or step 0 that lacks."""
    finite = ~F.isnan(ce) & (F.abs(ce) != F.lit(float("inf")))
    c = curve.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct(step).alias("steps"), F.countDistinct(tokens).alias("sums"), (F.max(tokens) - F.min(tokens)).alias("span"),
        F.count_if(F.coalesce(finite, F.lit(False))).alias("numbers"), *[F.max((F.col(step) == m).cast("int")).alias(f"has_{m}") for m in [0, *milestones]],
    )
    rules = {"duplicate_step": "steps < n", "duplicate_tokens": "sums < n", "no_token_span": "span <= 0", "not_finite": "numbers < n"} | {f"no_step_{m}": f"has_{m} = 0" for m in [0, *milestones]}
    found = F.filter(F.array(*[F.when(F.expr(e), F.lit(r)) for r, e in rules.items()]), lambda x: x.isNotNull())
    return c.select(*by, F.explode(found).alias("fault"))


def curve_report(curve: DataFrame, by: list[str], milestones: list[int], step: str = "step", tokens: str = "tokens", ce: str = "ce") -> DataFrame:
    """A row for each curve: points, area over steps, over tokens and over tokens brought to 0..1 (the one that counts),
    mean, step 0, last and milestone losses. Curves with faults are an error."""
    if bad := curve_faults(curve, by, milestones, step, tokens, ce).first():
        raise ValueError(f"curve can't be summarised: {bad}")
    p = blocked(curve, by, step, lags={"_s": step, "_t": tokens, "_c": ce})
    mid = (F.col(ce) + F.col("_c")) / 2.0
    at = lambda m: F.max(F.when(F.col(step) == m, F.col(ce)))
    return p.groupBy(*by).agg(
        F.count("*").alias("points"), F.sum((F.col(step) - F.col("_s")) * mid).alias("step_auc"), F.sum((F.col(tokens) - F.col("_t")) * mid).alias("token_auc"),
        (F.sum((F.col(tokens) - F.col("_t")) * mid) / (F.max(tokens) - F.min(tokens))).alias("auc"), F.avg(ce).alias("mean_ce"), at(0).alias("step_0_ce"),
        F.max_by(ce, step).alias("final_ce"), F.max(step).alias("final_step"), F.max(tokens).alias("final_tokens"), *[at(m).alias(f"ce_{m}") for m in milestones],
    )


# fixed values
PAIRING = ("training_manifest", "validation_manifest", "source_boundary_class", "probe_seed", "evaluation_schedule", "token_budget")


def paired(left: DataFrame, right: DataFrame, left_identity: dict, right_identity: dict, by: str = "mode") -> DataFrame:
    """(by, left_auc, right_auc, change in percent) of two runs' reports; all six fields of their identities must agree."""
    if set(left_identity) != set(PAIRING) or set(right_identity) != set(PAIRING):
        raise ValueError(f"a pairing identity has the fields {PAIRING}")
    if differ := [k for k in PAIRING if left_identity[k] != right_identity[k]]:
        raise ValueError(f"the runs aren't paired: {differ}")
    l, r = left.select(by, F.col("auc").alias("left_auc")), right.select(by, F.col("auc").alias("right_auc"))
    return l.join(r, by).withColumn("change", percent_change(F.col("left_auc"), F.col("right_auc")))


def coverage_faults(curve: DataFrame, scheduled: DataFrame, step: str = "step") -> DataFrame:
    """(step, fault): evaluated steps that weren't scheduled, and scheduled ones that weren't evaluated."""
    have, want = curve.select(step).distinct(), scheduled.select(step).distinct()
    extra = have.join(want, step, "left_anti").select(step, F.lit("not_scheduled").alias("fault"))
    return extra.unionByName(want.join(have, step, "left_anti").select(step, F.lit("not_evaluated").alias("fault")))


def forgetting_means(table: DataFrame, order: str = "boundary", group: str = "language", trained: str = "trained") -> DataFrame:
    """(order, mean_all, mean_prior) of a table with from_first: over all languages, and over those but the one that was
    just trained at the boundary (column `trained`); null where there is no other."""
    prior = F.when(~F.col(group).eqNullSafe(F.col(trained)), F.col("from_first"))
    return table.groupBy(order).agg(F.avg("from_first").alias("mean_all"), F.avg(prior).alias("mean_prior"))


def monotone(events: DataFrame, tag: str, arrival: str, step: str) -> DataFrame:
    """Events whose step is larger than all earlier ones of the tag, in order of arrival (distinct integers)."""
    return blocked(events, [tag], arrival, highs={"_m": step}).where(F.col(step) > F.coalesce("_m", F.lit(-1))).drop("_m")


def count_windows(events: DataFrame, task: str, order: str, size: int, sums: dict[str, str]) -> DataFrame:
    """Sums over every `size` rows of a task, in order; a task's last window may be shorter. (task, window_id, n, sums)"""
    w = blocked(events, [task], order, sums={"_n": "1"}).withColumn("window_id", F.expr(f"_n div {size}"))
    return w.groupBy(task, "window_id").agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(o) for o, e in sums.items()])


def tasks_of(events: DataFrame, order: str = "event_id", kind: str = "event_type", starts: str = "click") -> DataFrame:
    """The state machine of a run's log: an event of kind `starts` begins a task. Adds task (0: before the first) and
    task_step, the events of the task so far, this one included."""
    n = blocked(events, [], order, sums={"_t": f"case when {kind} = '{starts}' then 1 else 0 end"})
    n = n.withColumn("task", F.col("_t") + (F.col(kind) == starts).cast("long")).drop("_t")
    return blocked(n, ["task"], order, sums={"_s": "1"}).withColumn("task_step", F.col("_s") + 1).drop("_s")


def latest(rows: DataFrame, by: list[str], progress: list[str], path: str, identity: str) -> DataFrame:
    """The row of most progress: (by, progress, chosen: the least path, ambiguous: its ties have several identities)."""
    p = F.struct(*progress)
    top = rows.groupBy(*by).agg(F.max(p).alias("_top"))
    hit = rows.join(top, by).where(p == F.col("_top"))
    return hit.groupBy(*by).agg(*[F.max(c).alias(c) for c in progress], F.min(path).alias("chosen"), (F.count_distinct(identity) > 1).alias("ambiguous"))


def across_ranks(parts: DataFrame, by: list[str], sums: list[str], highs: list[str], equal: list[str]) -> DataFrame:
    """Ranks' partial values made one: sums added, highs maxima, and `equal` columns, which must agree on all ranks (agree)."""
    same = F.lit(True)
    for c in equal:
        same = same & (F.count_distinct(c) <= 1)
    return parts.groupBy(*by).agg(F.count("*").alias("ranks"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in highs], *[F.min(c).alias(c) for c in equal], same.alias("agree"))


def throughput(events: DataFrame, by: list[str], at: str, amount: str) -> DataFrame:
    """(by, seconds, total, per_second) between the first and the last event; null where they are at one time."""
    seconds = F.unix_micros(F.max(at).cast("timestamp")) / 1e6 - F.unix_micros(F.min(at).cast("timestamp")) / 1e6
    return events.groupBy(*by).agg(seconds.alias("seconds"), F.sum(amount).alias("total"), (F.sum(amount) / F.nullif(seconds, F.lit(0.0))).alias("per_second"))


def event_rows(events: DataFrame, kind: str, base: list[str], fields: dict[str, str]) -> DataFrame:
    """The records of one kind: base columns, and fields of its own (name: expression)."""
    return events.where(F.col("event_type") == kind).select(*base, *[F.expr(e).alias(n) for n, e in fields.items()])


def scalars(events: DataFrame, step: str, every: int, tags: dict[str, str], kind: str = "event_type", primary: str | None = None) -> DataFrame:
    """(step, tag, v): events routed to tags `kind/name`, every `every`-th step; those of the primary kind also to `name`."""
    e = events.where(F.col(step) % every == 0)
    pairs = F.map_concat(*[F.create_map(F.concat(F.col(kind), F.lit(f"/{n}")), F.expr(x).cast("double")) for n, x in tags.items()])
    if primary is not None:
        alias = F.map_concat(*[F.create_map(F.lit(n), F.expr(x).cast("double")) for n, x in tags.items()])
        pairs = F.when(F.col(kind) == primary, F.map_concat(pairs, alias)).otherwise(pairs)
    return e.select(F.col(step).alias("step"), F.explode(pairs).alias("tag", "v"))


def ordered_digest(rows: DataFrame, by: list[str], order: str, value: str, sep: str = ",") -> DataFrame:
    """sha256 of the values joined in order; a group's values pass one task in order and are hashed as they come."""
    from collections.abc import Iterator

    import pyarrow as pa

    k, kind = len(by), rows.select(*by).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(by, now, strict=True)}, "digest": [h.hexdigest()]})

        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(k)], strict=True))
            for key, v in zip(keys, b.column(k + 1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now, h = key, hashlib.sha256()
                else:
                    h.update(sep.encode())
                h.update(v.encode())
        if now is not None:
            yield done()

    dealt = rows.select(*by, F.col(order).alias("_o"), F.col(value).cast("string").alias("_v")).repartition(*by).sortWithinPartitions(*by, "_o")
    return dealt.mapInArrow(run, T.StructType([*kind.fields, T.StructField("digest", T.StringType())]))


def two_level_digest(rows: DataFrame, order: str, value: str, block: int = 4096) -> DataFrame:
    """One digest of a whole table in an integer order, in parallel: sha256 of the blocks' sha256, joined in order."""
    b = rows.groupBy(F.expr(f"{order} div {block}").alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), "\n"), 256).alias("h"))
    upper = b.groupBy(F.expr(f"b div {block}").alias("c")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return upper.groupBy().agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def l2_norm(values: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The norm of all vectors of a group as one."""
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return values.groupBy(*by).agg(F.sqrt(F.sum(square)).alias("norm"))


def repeated(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(k, n): how many rows are one too many for each of several keys (name: expression)."""
    return rows.agg(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.count("*") - F.count_distinct(F.expr(e)) for e in keys.values()])).alias("m")).select(F.explode("m").alias("k", "n"))
