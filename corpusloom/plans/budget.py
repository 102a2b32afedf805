"""Token budgets, windows, batches, slots and schedules, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def token_budget(df: DataFrame, requested: str = "requested", length: str = "length") -> DataFrame:
    """complete sequences, effective tokens, valid targets and remainder of a requested number of tokens."""
    seqs = F.expr(f"{requested} div {length}")
    return df.select(requested, length, seqs.alias("sequences"), (seqs * F.col(length)).alias("effective_tokens"), (seqs * (F.col(length) - 1)).alias("valid_targets"), (F.col(requested) - seqs * F.col(length)).alias("remainder"))


def rank_ranges(spark: SparkSession, batch: int, world: int) -> DataFrame:
    """(rank, first, last): the half-open part of a logical batch that each rank takes; it may be empty."""
    return spark.range(world).select(F.col("id").alias("rank"), F.expr(f"{batch} * id div {world}").alias("first"), F.expr(f"{batch} * (id + 1) div {world}").alias("last"))


def cycle_windows(spark: SparkSession, cycles: int, sequences: int, available: int) -> DataFrame:
    """Disjoint windows [c * n, (c + 1) * n) of one source; in_range is false where the source is too short."""
    return spark.range(cycles).select(F.col("id").alias("cycle"), (F.col("id") * sequences).alias("seq_start"), ((F.col("id") + 1) * sequences).alias("seq_end"), ((F.col("id") + 1) * sequences <= available).alias("in_range"))


def learning_rate(step: Column, peak: float, warmup: int) -> Column:
    return F.lit(peak) * F.least(step / warmup, F.lit(1.0))


def evaluates(step: Column, last: int, milestones: list[int], every: int) -> Column:
    return (step == 0) | (step == last) | step.isin(milestones) | (step % every == 0)


def job_matrix(spark: SparkSession, seeds: list[int], models: list[str]) -> DataFrame:
    """Jobs, seed by seed, then model by model."""
    s = spark.createDataFrame(list(enumerate(seeds)), "si long, seed long")
    m = spark.createDataFrame(list(enumerate(models)), "mi long, model string")
    return s.crossJoin(m).select((F.col("si") * len(models) + F.col("mi")).alias("job"), "seed", "model")


def slots(gpus: list[int], per_job: int, replicas: int) -> list[tuple[int, list[int]]]:
    """(slot, gpus): groups of per_job neighbours; all groups of one replica come before the next replica's."""
    groups = [gpus[i : i + per_job] for i in range(0, len(gpus), per_job)]
    if per_job <= 0 or replicas <= 0 or not groups or len(groups[-1]) != per_job or len(set(gpus)) != len(gpus):
        raise ValueError("gpus must be distinct and divide into whole groups")
    return [(r * len(groups) + g, group) for r in range(replicas) for g, group in enumerate(groups)]


def assigned(jobs: DataFrame, gpus: list[int], per_job: int, replicas: int, port: int, cycles: int) -> DataFrame:
    """Jobs dealt to slots in turn, each with ports of its own: 4 a cycle and 4 more."""
    known, stride = slots(gpus, per_job, replicas), 4 * cycles + 4
    n = jobs.count()
    if port + (n - 1) * stride + 4 * cycles + 1 > 65535:
        raise ValueError("ports end at 65535")
    s = jobs.sparkSession.createDataFrame(known, "slot long, gpus array<long>")
    return jobs.withColumn("slot", F.col("job") % len(known)).join(F.broadcast(s), "slot").withColumn("port", port + F.col("job") * stride)


def resolve(requested: int, length: int) -> dict[str, int]:
    """The budget in whole sequences; one that holds none is an error."""
    if length <= 1 or requested < length:
        raise ValueError(f"{requested} tokens hold no sequence of {length}")
    n = requested // length
    return {"requested": requested, "sequences": n, "effective_tokens": n * length, "valid_targets": n * (length - 1), "remainder": requested - n * length}


def batches(sequences: Column, batch: int) -> Column:
    """Logical batches of a task; the last may be short."""
    return F.ceil(sequences / batch).cast("long")


def schedule(tasks: DataFrame, batch: int, window: int, share: float = 0.05, sequences: str = "sequences") -> DataFrame:
    """Adds batches, planned (optimizer steps: a window of batches each) and warmup (a share of them, at least 1)."""
    t = tasks.withColumn("batches", batches(F.col(sequences), batch)).withColumn("planned", F.ceil(F.col("batches") / window).cast("long"))
    return t.withColumn("warmup", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("planned") * share).cast("long")))


def contract(sources: DataFrame, cycles: int, sequences: int, windowed: bool = True) -> DataFrame:
    """What each (cycle, language) reads, of sources (cycle, language, place, available, ordered_data_sha256): task_index, its window
    of sequences and that view's identity. Windowed: cycle 0's source serves all cycles, in disjoint windows; otherwise
    every cycle has a source of its own, read from 0."""
    n = sources.agg(F.max("place")).first()[0] + 1
    if windowed:
        c = sources.where("cycle = 0").drop("cycle").crossJoin(sources.sparkSession.range(cycles).withColumnRenamed("id", "cycle"))
        c = c.withColumn("seq_start", F.col("cycle") * sequences)
    else:
        c = sources.where(F.col("cycle") < cycles).withColumn("seq_start", F.lit(0).cast("long"))
    c = c.withColumn("seq_end", F.col("seq_start") + sequences).withColumn("task_index", F.col("cycle") * n + F.col("place"))
    view = F.sha2(F.concat_ws(":", "ordered_data_sha256", F.col("seq_start").cast("string"), F.col("seq_end").cast("string")), 256)
    return c.withColumn("view_sha256", view if windowed else F.col("ordered_data_sha256")).withColumn("in_range", F.col("seq_end") <= F.col("available"))


def contract_faults(plan: DataFrame, languages: int, cycles: int) -> DataFrame:
    """(rule, detail): windows beyond their source, views that come twice, tasks that lack."""
    beyond = plan.where("not in_range").select(F.lit("beyond_source").alias("rule"), F.col("task_index").cast("string").alias("detail"))
    twice = plan.groupBy("view_sha256").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("view_replayed").alias("rule"), F.col("view_sha256").alias("detail"))
    lacking = plan.agg(F.count_distinct("task_index").alias("n")).where(F.col("n") != languages * cycles).select(F.lit("tasks_missing").alias("rule"), F.col("n").cast("string").alias("detail"))
    return beyond.unionByName(twice).unionByName(lacking)


def missing_stages(wanted: DataFrame, ready: DataFrame) -> DataFrame:
    """Stages (language, stage_id) that are still to be prepared, with lane (their language) and turn in it: in a lane one follows the other."""
    todo = wanted.join(ready.select("stage_id"), "stage_id", "left_anti")
    return todo.withColumn("turn", F.row_number().over(W.partitionBy("language").orderBy("stage_id")).cast("long") - 1)


def changed_prefix(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Tasks of the old plan that a longer one changes or drops."""
    o, n = old.select(key, F.struct(*columns).alias("o")), new.select(key, F.struct(*columns).alias("n"))
    return o.join(n, key, "left").where(~F.col("o").eqNullSafe(F.col("n"))).select(key)


def checkpoint_bytes(parameters: Column, bytes_each: int, overhead: int, cycles: Column, languages: int, probes: bool, jobs: int) -> dict[str, Column]:
    """Of a run: bytes of a checkpoint, checkpoints of a job (one a language and one a cycle, and one for its probe), and all jobs' bytes."""
    each = parameters * bytes_each + overhead
    n = cycles * (languages + 1) + (cycles if probes else 0)
    return {"bytes_each": each, "checkpoints": n, "total": each * n * jobs}


def admitted(needed: int, free: int, reserve: int) -> None:
    if needed + reserve > free:
        raise ValueError(f"{needed} bytes and a reserve of {reserve} don't fit into {free}")


def stage_bytes(tokens: Column, docs: Column) -> Column:
    """4 bytes a token, 320 a document's boundary, 256 a document (1 MiB at least) for manifest and registry, and as much
    again for temporary files, up to 2 GiB."""
    registry = F.greatest(F.lit(1 << 20).cast("long"), 256 * docs)
    return 4 * tokens + 320 * docs + registry + F.least(registry, F.lit(2 << 30).cast("long"))


def stage_bytes_of(tokens: int, docs: int) -> int:
    registry = max(1 << 20, 256 * docs)
    return 4 * tokens + 320 * docs + registry + min(registry, 2 << 30)


def parameters(layers: Column, hidden: Column, vocabulary: Column, positions: Column) -> Column:
    return layers * (12 * hidden * hidden + 13 * hidden) + 2 * hidden + (vocabulary + positions) * hidden


def attention_mask(spark: SparkSession, memory: int, text: int) -> DataFrame:
    """(row, col, allowed) of blocks read memory, text, write memory: read memory sees itself, text sees read memory and
    text up to itself, write memory sees everything."""
    n = 2 * memory + text
    r, c = F.col("row"), F.col("col")
    allowed = F.when(r < memory, c < memory).when(r < memory + text, (c < memory) | ((c < memory + text) & (c <= r))).otherwise(F.lit(True))
    return spark.range(n).select(F.col("id").alias("row")).crossJoin(spark.range(n).select(F.col("id").alias("col"))).select("row", "col", allowed.alias("allowed"))


def masked_targets(labels: Column, ignore: int = -100) -> Column:
    """Valid targets of a sequence: labels after the first that aren't to be ignored."""
    return F.size(F.filter(F.slice(labels, 2, 1 << 30), lambda x: x != ignore)).cast("long")


def segments(ids: Column, parts: int, length: int) -> Column:
    """A sequence cut into equal parts."""
    if length % parts:
        raise ValueError(f"{length} doesn't divide into {parts}")
    n = length // parts
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(ids, i * n + 1, F.lit(n)))
