"""The bounded-buffer order: data-oblivious, so it is a table of indices that is joined on a dense ordinal."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .prefix import running


def permutation(n: int, seed: int, buffer_size: int) -> Iterator[int]:
    """Input index of each output place: a full buffer gives up a random slot for every further row, and what remains at
    the end is shuffled (Python's Mersenne Twister). Only the buffer is held."""
    rng, held = random.Random(seed), list(range(min(n, buffer_size)))
    for i in range(len(held), n):
        slot = rng.randrange(buffer_size)
        yield held[slot]
        held[slot] = i
    rng.shuffle(held)
    yield from held


def order_table(spark: SparkSession, n: int, seed: int, buffer_size: int, piece: int = 1 << 16) -> DataFrame:
    """(place, ordinal), generated by one task in pieces: neither the driver nor the task holds the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        found, at = permutation(n, seed, buffer_size), 0
        while part := list(itertools.islice(found, piece)):
            yield pa.record_batch({"place": pa.array(range(at, at + len(part)), pa.int64()), "ordinal": pa.array(part, pa.int64())})
            at += len(part)

    return spark.range(0, 1, 1, 1).mapInArrow(run, "place long, ordinal long")


def buffered(rows: DataFrame, key: str, seed: int, buffer_size: int) -> DataFrame:
    """Rows with place, their output position; input order is that of `key`, a distinct hex hash."""
    order = order_table(rows.sparkSession, rows.count(), seed, buffer_size)
    return running(rows, key, {"ordinal": "1"}).join(order, "ordinal").drop("ordinal", key)
