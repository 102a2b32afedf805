"""Tokenizers as an extension point: any object with encode_batch and an end-of-text id."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tokenizer(Protocol):
    """What the engine needs. It is sent to the executors, so it can be pickled; encode may raise for a document."""

    eos_token_id: int

    def encode(self, text: str) -> list[int]: ...

    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...


class ByteTokenizer:
    """UTF-8 bytes as ids; 255 never occurs in UTF-8 and ends a document."""

    eos_token_id = 255

    def encode(self, text: str) -> list[int]:
        return list(text.encode())

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(t) for t in texts]


def normalised(ids: object) -> np.ndarray:
    """Ids as int64; nothing but integers is accepted, and a boolean isn't one."""
    if ids is None or any(isinstance(i, bool) or not isinstance(i, (int, np.integer)) for i in ids):
        raise TypeError("token ids must be integers")
    return np.array(ids, dtype=np.int64)


def encoded(tokenizer: Tokenizer, texts: list[str | None]) -> list[np.ndarray | None]:
    """Ids of each text, null where the tokenizer fails: the whole batch at once, and where that fails one by one."""
    some = [t for t in texts if t is not None]
    try:
        found = [normalised(x) for x in tokenizer.encode_batch(some)]
        if len(found) != len(some):
            raise ValueError("a batch must give one result for each text")
    except Exception:
        found = []
        for t in some:
            try:
                found.append(normalised(tokenizer.encode(t)))
            except Exception:
                found.append(None)
    rest = iter(found)
    return [None if t is None else next(rest) for t in texts]


def tokenize(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", batch: int = 1024, keep_ids: bool = True) -> DataFrame:
    """All columns with tok (binary: uint32, little-endian; null: the tokenizer failed, or an id isn't 32 bits), n (long),
    least and most (the smallest and largest id) and tok_sha added."""
    fields = [*([("tok", T.BinaryType())] if keep_ids else []), ("n", T.LongType()), ("least", T.LongType()), ("most", T.LongType()), ("tok_sha", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                b = whole.slice(a, batch)
                ids = encoded(tokenizer, b.column(at).to_pylist())
                raw = [None if x is None or (len(x) and (x.min() < 0 or x.max() >= 1 << 32)) else x.astype("<u4").tobytes() for x in ids]
                columns = [*b.columns, *([pa.array(raw, pa.binary())] if keep_ids else []), pa.array([None if x is None else len(x) for x in ids], pa.int64())]
                columns += [pa.array([int(f(x)) if x is not None and len(x) else None for x in ids], pa.int64()) for f in (np.min, np.max)]
                columns.append(pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in raw], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def token_fault(max_id: int, rows: int | None = None) -> Column:
    """tokenization_error, empty_tokenization or token_id_out_of_range of tokenized rows, or null. rows: the embedding's."""
    high = F.col("most") > max_id
    if rows is not None:
        high = high | (F.col("most") >= rows)
    return F.when(F.col("n").isNull(), "tokenization_error").when(F.col("n") == 0, "empty_tokenization").when((F.col("least") < 0) | high, "token_id_out_of_range")


def vocabulary(ids: DataFrame, rows: int, id_column: str = "id") -> DataFrame:
    """least, most, ids, unused_tail and valid: an embedding of `rows` rows holds every id of a vocabulary."""
    i = F.col(id_column)
    return ids.agg(F.min(i).alias("least"), F.max(i).alias("most"), F.countDistinct(i).alias("ids"), (F.lit(rows) - F.max(i) - 1).alias("unused_tail"), ((F.min(i) >= 0) & (F.max(i) < rows)).alias("valid"))
