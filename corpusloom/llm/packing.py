"""Token-ID output: best-fit-decreasing packing into rows of fixed length.

Documents are packed in groups of about GROUP_TOKENS tokens, inside the task that reads them: no shuffle. In a group,
pieces go from long to short into the fullest row that still has room, which a segment tree over free capacities finds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, text_chunks

LENGTH = 2048
GROUP_TOKENS = 1 << 20


class CapacityTree:
    """A segment tree over capacities 0..most: the least capacity >= n of which there is a row, in O(log most) steps."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _change(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the best fit for n, or None."""
        i = self.size + n
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each row, in order of placement. Pieces are no longer than capacity; longest first, ties
    in the given order."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := tree.take(lengths[i])) is None:
            found = (capacity, len(rows))
            rows.append([])
        left, row = found
        rows[row].append(i)
        if left > lengths[i]:
            tree.add(left - lengths[i], row)
    return rows


_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


#: ids, positions: little-endian uint32, `length` of each; positions start anew at 0 with every piece and in the padding.
#: cu_seqlens: 0, then the end of each piece. pieces: the documents' parts in order, with the token each part starts at.
PACKED = T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("positions", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType())]))),
])


def pack_group(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> Iterator[dict]:
    """Rows of one group of (doc_id, ids). Longer documents are cut into parts of `length`, and nothing is lost."""
    pieces = [(d, at, ids[at : at + length]) for d, ids in docs for at in range(0, len(ids), length)]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        chosen = [pieces[i] for i in row]
        ids = np.full(length, pad, dtype="<u4")
        ends = np.cumsum([len(p[2]) for p in chosen])
        ids[: ends[-1]] = np.concatenate([p[2] for p in chosen])
        positions = np.concatenate([np.arange(len(p[2]), dtype="<u4") for p in chosen] + [np.arange(length - ends[-1], dtype="<u4")])
        yield {"ids": ids.tobytes(), "positions": positions.astype("<u4").tobytes(), "cu_seqlens": [0, *ends.tolist()], "n_tokens": int(ends[-1]), "pieces": [{"doc_id": d, "start": at, "n": len(x)} for d, at, x in chosen]}


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, eos: int | None = None, pad: int = 0, text: str = "text", doc_id: str = "doc_id", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows (PACKED) of all texts, encoded by a tiktoken rank file, each followed by `eos` if given.

    Null and empty texts without eos have no tokens and appear in no row; null ids are kept as null; repeated rows are
    packed like others; texts of any length are cut into parts. No rows: no rows. Which documents share a group follows
    the input's files and splits.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, n = encoding(ranks_path, pattern), [], 0
        out = lambda: pa.RecordBatch.from_pylist(list(pack_group(held, length, pad)), schema=arrow)
        for batch in text_chunks(batches, 1, 1 << 20):
            for d, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = enc.encode_ordinary(t.decode())
                ids = np.array([*ids, eos] if eos is not None else ids, dtype="<u4")
                if len(ids):
                    held.append((d, ids))
                    n += len(ids)
                if n >= group_tokens:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(PACKED)
    return rows.mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: binary matrix rows, cumulative lengths and positions side by side."""
    packed.write.parquet(path)
