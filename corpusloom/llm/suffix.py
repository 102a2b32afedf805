"""Suffix dedup by a depth-limited radix sort of the suffixes of all texts, most significant digit first.

Windows are the suffixes' first DEPTH bytes. The first digit deals them: a window's anchor, which is, of its ANCHOR-byte
strings, the leftmost of the least hash, so that equal windows have equal anchors at the same place. Windows one after
another that share an anchor's place are a run. Runs whose anchor stands in one document only are done after this pass.
The bytes of the others go, each distinct run once for a block, to the anchor's radix bucket, and there the windows are
sorted by their bytes, 8 at a time from the first to DEPTH; windows that are alone in their group drop out of each pass.
Groups that are left are equal in every byte: exactly the repeated windows. Hashes only deal and save work; no verdict rests on one.

Anchors with very many runs (a passage in a third of all documents has as many as documents at its edges) are dealt once
more, by their single windows, so that no bucket holds a whole hot group. Blocks and buckets grow with the input.
The texts are put into blocks once, and the blocks are stored by bucket, so that later passes join them without moving them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, materialize, place, shared_dir, text_chunks

#: Bytes of a window, and of an anchor; a window holds DEPTH - ANCHOR + 1 strings of that length.
DEPTH, ANCHOR = 50, 25
#: A run's bytes lie around its anchor in a row: LEFT bytes at most before it, as many after it. Then come the run's first
#: column and its number of windows, and zeros up to a multiple of 8.
LEFT = DEPTH - ANCHOR
WIDTH = DEPTH + LEFT
ROW = -(-(WIDTH + 2) // 8) * 8
#: Bytes of text in a block, and in one step of the array work. A block grows with the input, up to MOST_BLOCK.
BLOCK_BYTES, MOST_BLOCK, STEP_BYTES = 4 << 20, 32 << 20, 1 << 20
#: Anchors in a radix bucket on average, which grows with the input up to MOST_ROWS; a text has about 2 / 27 of its bytes as anchors.
BUCKET_ROWS, MOST_ROWS = 1 << 20, 8 << 20
#: Blocks and buckets that an input is divided into before they grow.
PARTS = 4096
#: An anchor with more runs in one block, or in all, is hot.
HOT_BLOCK, HOT_ALL = 256, 1 << 16
#: Bits of an anchor's hash that are sent with the first digit.
CODE = 29
#: Bytes of text in a storage bucket.
STORE_BYTES = 32 << 20

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: A null id stands after all others, and is not smaller than anything.
NO_ID = np.iinfo(np.int64).max


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def rolling(data: np.ndarray, k: int, base: int) -> np.ndarray:
    """A polynomial hash (mod 2^64) of every k bytes, by doubling."""
    part, n, total, have = data.astype(U) + U(1), 1, None, 0
    while True:
        if k & n:
            if total is None:
                total = part
            else:
                m = len(data) - have - n + 1
                total = total[:m] * U(pow(base, n, 1 << 64)) + part[have : have + m]
            have += n
        if 2 * n > k:
            return total
        part = part[: len(part) - n] * U(pow(base, n, 1 << 64)) + part[n:]
        n *= 2


def sliding(a: np.ndarray, w: int, f: Callable) -> np.ndarray:
    """f (minimum or maximum) over every w neighbours."""
    n = 1
    while 2 * n <= w:
        a = f(a[: len(a) - n], a[n:])
        n *= 2
    return f(a[: len(a) - (w - n)], a[w - n :]) if w > n else a


class Runs:
    """The runs of some texts end to end: windows lo..hi (starts) of one document with one anchor place."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(self.data) - DEPTH + 1
        of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        start = np.flatnonzero(of[:n] == of[DEPTH - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(start):
            self.lo = self.hi = self.place = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, U)
            return
        w = DEPTH - ANCHOR + 1
        h = mixed(rolling(self.data, ANCHOR, BASE))
        least = sliding(h, w, np.minimum)
        edge = np.zeros(w - 1, U)
        # a place is the minimum of some window that holds it if the largest of these windows' minima is its hash
        chosen = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)
        at = np.searchsorted(chosen, start)
        todo = np.flatnonzero(h[chosen[at]] != least[start])
        while len(todo):  # an earlier place may be the minimum of earlier windows only
            at[todo] += 1
            todo = todo[h[chosen[at[todo]]] != least[start[todo]]]
        place = chosen[at]
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1)) + 1
        first = np.concatenate([[0], cut])
        self.lo, self.hi, self.place = start[first], start[np.concatenate([cut, [len(start)]]) - 1], place[first]
        self.key = mixed(h[self.place] * U(BASE))  # mixed once more: least hashes aren't spread evenly over the buckets
        self.doc = of[self.lo].astype(np.int64)

    def sketch(self, at: np.ndarray) -> np.ndarray:
        """A hash of each run's bounds and first and last bytes, to count different runs with."""
        out = mixed((self.place[at] - self.lo[at]).astype(U) << U(8) | (self.hi[at] - self.lo[at]).astype(U))
        for start in (self.lo[at], self.hi[at] + DEPTH - 8):
            part = np.zeros(len(at), U)
            for k in range(8):
                part = part << U(8) | self.data[start + k].astype(U)
            out = mixed(out * U(BASE) + part)
        return out

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The bytes of each run lo .. hi + DEPTH as a row of ROW bytes."""
        first, n = LEFT - (self.place[at] - self.lo[at]), self.hi[at] - self.lo[at] + 1
        column = np.arange(WIDTH)
        source = np.clip((self.place[at] - LEFT)[:, None] + column, 0, max(len(self.data) - 1, 0))
        out = np.zeros((len(at), ROW), np.uint8)
        out[:, :WIDTH] = np.where(held(first, n), self.data[source], 0)
        out[:, WIDTH], out[:, WIDTH + 1] = first, n
        return out


def held(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of a row's WIDTH columns hold bytes."""
    column = np.arange(WIDTH)
    return (column >= first[:, None]) & (column < (first + n + DEPTH - 1)[:, None])


def radix(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a 64-bit hash by its upper bits, so that the order of keys is the order of buckets, too."""
    return (((key >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), U)
    for column in np.ascontiguousarray(rows).view(U).T:
        out = mixed(out * U(BASE) + column)
    return out


def collapse(rows: np.ndarray, ids: np.ndarray, deal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows made one, in the order of `deal`, a hash of (part of) them: (rows, least ids, deal, each row's place).
    Rows are compared by their bytes; if hashes of unequal rows agree, some equal ones may stay apart."""
    order = np.lexsort((row_hash(rows), deal))
    new = np.ones(len(rows), bool)
    new[1:] = deal[order][1:] != deal[order][:-1]
    for column in np.ascontiguousarray(rows).view(U).T:
        x = column[order]
        new[1:] |= x[1:] != x[:-1]
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(rows) else ids
    return rows[order[new]], least, deal[order][new], place


def least_equal(rows: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row (whole digits long) the least id among the rows of its group with the same bytes: radix passes, most
    significant digit first; a row that is alone in its group is done."""
    least, live, g = ids.copy(), np.arange(len(rows)), group
    for column in np.ascontiguousarray(rows).view(">u8").T:  # 8 bytes as a number in the order of the bytes
        if not len(live):
            break
        x = column[live].astype(U)
        order = np.lexsort((x, g))
        live, x, g = live[order], x[order], g[order]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        number = np.cumsum(new) - 1
        alike = (np.bincount(number) > 1)[number]
        live, g = live[alike], number[alike]
    if len(live):
        new = np.concatenate([[True], g[1:] != g[:-1]])
        least[live] = np.minimum.reduceat(ids[live], np.flatnonzero(new))[np.cumsum(new) - 1]
    return least


def windows_of(rows: np.ndarray, column: int) -> np.ndarray:
    """The windows that start in a column, with zeros up to whole digits; the last byte is the column."""
    out = np.zeros((len(rows), -(-(DEPTH + 1) // 8) * 8), np.uint8)
    out[:, :DEPTH], out[:, -1] = rows[:, column : column + DEPTH], column
    return out


class Block:
    """One stored block."""

    def __init__(self, ids: list[int | None], sizes: list[int], body: bytes, buckets: int):
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=sum(sizes)) if sum(sizes) else b""
        ends = np.cumsum(sizes).tolist()
        self.texts = [raw[b - n : b] for b, n in zip(ends, sizes, strict=True)]
        self.data = np.frombuffer(raw, np.uint8)
        self.starts = np.cumsum(np.array(sizes, dtype=np.int64)) - np.array(sizes, dtype=np.int64)
        self.ids = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.raw_ids, self.buckets = ids, buckets

    def steps(self) -> Iterator[tuple[int, Runs]]:
        """(first document, runs), the same each time."""
        at = 0
        while at < len(self.texts):
            end, total = at, 0
            while end < len(self.texts) and (end == at or total + len(self.texts[end]) <= STEP_BYTES):
                total += len(self.texts[end])
                end += 1
            yield at, Runs(self.texts[at:end])
            at = end

    def code(self, key: np.ndarray) -> np.ndarray:
        """A run's place in the first pass: radix bucket, then CODE bits. Keys that share it are told apart later."""
        return radix(key, self.buckets) << CODE | (key & U((1 << CODE) - 1)).astype(np.int64)

    def first_digits(self, steps: list[tuple[int, Runs]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes in order, whether several documents of this block have them, and how many different runs: 0 to 2
        for 4, 32, HOT_BLOCK at most, 3 for more."""
        codes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, runs in steps:
            codes.append(self.code(runs.key))
            ids.append(self.ids[at + runs.doc])
        c, d = np.concatenate(codes), np.concatenate(ids)
        order = np.argsort(c)
        c, d = c[order], d[order]
        if not len(c):
            return c, c > 0, c
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(first, len(c)))
        found = c[first]
        often = np.flatnonzero(count > 4)  # copies of one run are one run
        pairs = [np.zeros((0, 2), np.int64)]
        for (_, runs), mine in zip(steps, codes[1:], strict=True):
            at = np.searchsorted(found[often], mine)
            at[at == len(often)] = 0
            hit = np.flatnonzero(found[often][at] == mine) if len(often) else np.zeros(0, np.int64)
            pairs.append(np.unique(np.stack([at[hit], runs.sketch(hit).view(np.int64)], axis=1), axis=0))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        count[often] = np.bincount(pairs[:, 0], minlength=len(often))
        return found, np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.searchsorted([4, 32, HOT_BLOCK], count)


def cut_by(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of an ascending array."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cuts.tolist(), len(bucket)]
    return [(int(bucket[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def bits(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes()


def unbits(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, count=(n + 7) // 8, offset=at * ((n + 7) // 8)), count=n).astype(bool)


def packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def first_pass(block: Block) -> Iterator[tuple[int, bytes]]:
    codes, several, size = block.first_digits(list(block.steps()))
    sent = (((codes & ((1 << CODE) - 1)) << 3) | several << 2 | size).astype("<u4")
    for x, a, b in cut_by(codes >> CODE):
        yield x, sent[a:b].tobytes()


def reduce_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whether each code is in several blocks, or in several documents of one (live), and whether it is hot: bits, in the order sent."""
    parts = [np.frombuffer(p, dtype="<u4") for p in pdf["payload"]]
    flat = np.concatenate(parts)
    order = np.argsort(flat)
    code = flat[order] >> 3
    group = np.cumsum(np.concatenate([[True], code[1:] != code[:-1]])) - 1
    several, size = (flat[order] & 4) > 0, flat[order] & 3
    live = np.bincount(group) > 1
    live[group[several]] = True
    hot = np.bincount(group, weights=np.array([4, 32, HOT_BLOCK, HOT_ALL + 1])[size]) > HOT_ALL
    answers = []
    for of in (live, hot):
        a = np.empty(len(flat), bool)
        a[order] = of[group]
        answers.append(np.split(a, np.cumsum([len(p) for p in parts])[:-1]))
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "answer": [bits(x) + bits(y) for x, y in zip(*answers, strict=True)]})


class Live:
    """The live runs of a block: their distinct rows, and the distinct windows of hot ones; the same each time."""

    def __init__(self, block: Block, answers: list[bytes]):
        self.block = block
        steps = list(block.steps())
        codes, _, _ = block.first_digits(steps)
        live, hot = (np.concatenate([np.zeros(0, bool), *(unbits(x, b - a, k) for (_, a, b), x in zip(cut_by(codes >> CODE), answers, strict=True))]) for k in (0, 1))
        lo, ids, keys, is_hot, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, bool)], [np.zeros((0, ROW), np.uint8)]
        for at, runs in steps:
            found = np.searchsorted(codes, block.code(runs.key))
            hit = np.flatnonzero(live[found])
            if len(hit):
                lo.append(block.starts[at] + runs.lo[hit])
                ids.append(block.ids[at + runs.doc[hit]])
                keys.append(runs.key[hit])
                is_hot.append(hot[found[hit]])
                rows.append(runs.rows(hit))
        del steps
        lo, ids, keys, is_hot, rows = map(np.concatenate, (lo, ids, keys, is_hot, rows))
        cold = ~is_hot
        self.lo, self.ids = lo[cold], ids[cold]
        self.rows, self.least, self.keys, self.place = collapse(rows[cold], self.ids, keys[cold])
        lo, ids, rows = lo[is_hot], ids[is_hot], rows[is_hot]
        first, n = rows[:, WIDTH].astype(np.int64), rows[:, WIDTH + 1].astype(np.int64)
        at = [np.flatnonzero((first <= c) & (c < first + n)) for c in range(LEFT + 1)]
        single = np.concatenate([windows_of(rows[i], c) for c, i in enumerate(at)])
        self.start = np.concatenate([lo[i] + c - first[i] for c, i in enumerate(at)])
        self.start_ids = ids[np.concatenate(at)]
        self.windows, self.window_least, self.window_keys, self.window_place = collapse(single, self.start_ids, row_hash(single))

    def cuts(self) -> Iterator[tuple[int, int, int]]:
        yield from cut_by(radix(self.keys, self.block.buckets))

    def window_cuts(self) -> Iterator[tuple[int, int, int]]:
        yield from cut_by(radix(self.window_keys, self.block.buckets))

    def sent(self) -> Iterator[tuple[int, bytes]]:
        """Distinct runs by their anchors' buckets, then distinct windows of hot anchors by buckets of their own."""
        for x, a, b in self.cuts():
            r = self.rows[a:b]
            first, n = r[:, WIDTH], r[:, WIDTH + 1]
            yield x, (b - a).to_bytes(4, "little") + packed(first.tobytes(), n.tobytes(), self.least[a:b].astype("<i8").tobytes(), r[:, :WIDTH][held(first.astype(int), n.astype(int))].tobytes())
        for x, a, b in self.window_cuts():
            yield self.block.buckets + x, (b - a).to_bytes(4, "little") + packed(self.least_of(a, b), self.windows[a:b].tobytes())

    def least_of(self, a: int, b: int) -> bytes:
        return self.window_least[a:b].astype("<i8").tobytes()

    def repeats(self, answers: list[bytes]) -> np.ndarray:
        """Starts, in the block, of the windows that a smaller document has, too."""
        n_runs = len(list(self.cuts()))
        masks = np.frombuffer(b"".join(answers[:n_runs]), "<u4").astype(np.int64)
        later = np.concatenate([np.zeros(0, bool), *(unbits(x, b - a) for (_, a, b), x in zip(self.window_cuts(), answers[n_runs:], strict=True))])
        first, n = (self.rows[self.place][:, k].astype(np.int64) for k in (WIDTH, WIDTH + 1))
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        again = (masks[self.place][of] >> (first[of] + within) & 1 > 0) | (self.least[self.place] < self.ids)[of]
        return np.concatenate([(self.lo[of] + within)[again], self.start[later[self.window_place] | (self.window_least[self.window_place] < self.start_ids)]])


def reduce_runs(sent: list[tuple[int, bytes]]) -> list[bytes]:
    """For each run sent, a bit for each first column of a window that a smaller document has."""
    rows, ids = [], []
    for m, raw in sent:
        first, n = (np.frombuffer(raw, np.uint8, count=m, offset=k * m) for k in (0, 1))
        r = np.zeros((m, ROW), np.uint8)
        body = np.zeros((m, WIDTH), np.uint8)
        body[held(first.astype(int), n.astype(int))] = np.frombuffer(raw, np.uint8, offset=10 * m)
        r[:, :WIDTH], r[:, WIDTH], r[:, WIDTH + 1] = body, first, n
        rows.append(r)
        ids.append(np.frombuffer(raw, "<i8", count=m, offset=2 * m))
    rows, ids = np.concatenate(rows), np.concatenate(ids)
    anchor = np.zeros((len(rows), -(-ANCHOR // 8) * 8), np.uint8)
    anchor[:, :ANCHOR] = rows[:, LEFT:DEPTH]
    rows, least, key, place = collapse(rows, ids, row_hash(anchor))
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    open_ = np.flatnonzero((np.bincount(group) > 1)[group])
    first, n = rows[open_, WIDTH].astype(np.int64), rows[open_, WIDTH + 1].astype(np.int64)
    mask = np.zeros(len(rows), np.int64)
    for c in range(LEFT + 1):
        at = open_[(first <= c) & (c < first + n)]
        mask[at] |= (least_equal(windows_of(rows[at], c), group[at], least[at]) < least[at]).astype(np.int64) << c
    # a run with a larger id than another of the same bytes is a repeat in full
    answer = np.where(least[place] < ids, (1 << LEFT + 1) - 1, mask[place]).astype("<u4")
    return [a.tobytes() for a in np.split(answer, np.cumsum([m for m, _ in sent])[:-1])]


def reduce_windows(sent: list[tuple[int, bytes]]) -> list[bytes]:
    """For each window sent, a bit: whether a smaller document has it."""
    width = -(-(DEPTH + 1) // 8) * 8
    ids = np.concatenate([np.frombuffer(raw, "<i8", count=m) for m, raw in sent])
    rows = np.concatenate([np.frombuffer(raw, np.uint8, offset=8 * m).reshape(m, width) for m, raw in sent])
    rows, least, key, place = collapse(rows, ids, row_hash(rows))
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    least = least_equal(rows, group, least)
    return [bits(a) for a in np.split(least[place] < ids, np.cumsum([m for m, _ in sent])[:-1])]


def reduce_bytes(buckets: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Buckets below `buckets` hold runs, the others windows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [(int.from_bytes(p[:4], "little"), unpacked(p[4:])) for p in pdf["payload"]]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "answer": (reduce_runs if pdf["bucket"].iloc[0] < buckets else reduce_windows)(sent)})

    return run


def removed_bytes(block: Block, first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Whether each byte of the block goes."""
    start = Live(block, first).repeats(second)
    size = len(block.data) + 1
    return np.cumsum(np.bincount(start, minlength=size) - np.bincount(start + DEPTH, minlength=size))[:-1] > 0


def store_blocks(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, int, int]:
    """The block table (block, ids, sizes, body), its storage buckets, and the bytes of all texts."""
    if not isinstance(docs.schema.fields[place(docs, doc_id)].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must hold integers")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    block_bytes = max(BLOCK_BYTES, min(MOST_BLOCK, total // PARTS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 1, block_bytes):
            if (pc.max(batch.column(0)).as_py() or 0) >= NO_ID:
                raise ValueError("ids must be below 2^63 - 1")
            texts = as_bytes(batch.column(1))
            body = zstandard.ZstdCompressor(level=5).compress(b"".join(texts))
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "body": pa.array([body], pa.binary()),
            })

    n = max(4, -(-total // STORE_BYTES))
    name = f"corpusloom_blocks_{uuid.uuid4().hex}"
    blocks = rows.mapInArrow(build, "ids array<long>, sizes array<long>, body binary").withColumn("block", F.monotonically_increasing_id())
    blocks.write.bucketBy(n, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay in the shared folder, and `stored` reads them
    return stored, n, total


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, on request,
    kept (binary: the bytes that remain).

    A byte goes if it is inside a DEPTH-byte string of the UTF-8 text that also starts in a document with a smaller id, as
    the texts came in. Ids are integers below 2^63 - 1. Null text is empty; texts shorter than DEPTH lose nothing; rows of the same id don't count as
    smaller than each other; a null id is larger than any. Other columns are ignored. No rows: no rows.
    """
    blocks, stores, total = store_blocks(docs, text, doc_id)
    anchors = total * 2 // (DEPTH - ANCHOR + 2)
    buckets = max(1, -(-anchors // max(BUCKET_ROWS, min(MOST_ROWS, anchors // PARTS))))

    def load(b: pa.RecordBatch, i: int) -> Block:
        return Block(b.column("ids")[i].as_py(), b.column("sizes")[i].as_py(), b.column("body")[i].as_py(), buckets)

    def given(b: pa.RecordBatch, i: int, name: str) -> list[bytes]:
        return b.column(name)[i].as_py() or []

    def exchange(frame: DataFrame, name: str, what: Callable, reducer: Callable) -> DataFrame:
        """What each block sends, reduced by radix bucket: (block, name: the answers in bucket order)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    number = b.column("block")[i].as_py()
                    found = list(what(b, i))
                    yield pa.record_batch({"block": pa.array([number] * len(found), pa.int64()), "bucket": pa.array([x for x, _ in found], pa.int64()), "payload": pa.array([x for _, x in found], pa.binary())})

        sent = frame.mapInArrow(run, "block long, bucket long, payload binary")
        answers = materialize(sent.groupBy("bucket").applyInPandas(reducer, "block long, bucket long, answer binary"), f"radix-{name}")
        by_block = answers.repartition(stores, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("x"))
        return by_block.select("block", F.col("x.answer").alias(name)).hint("shuffle_hash")

    first = exchange(blocks, "first", lambda b, i: first_pass(load(b, i)), reduce_first)
    known = blocks.join(first, "block", "left")
    second = exchange(known, "second", lambda b, i: Live(load(b, i), given(b, i, "first")).sent(), reduce_bytes(buckets))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = load(b, i)
                gone_all = removed_bytes(block, given(b, i, "first"), given(b, i, "second"))
                out: list[list] = [[] for _ in range(6)]
                for d, (at, text_bytes) in enumerate(zip(block.starts.tolist(), block.texts, strict=True)):
                    gone = gone_all[at : at + len(text_bytes)]
                    kept = np.frombuffer(text_bytes, np.uint8)[~gone].tobytes()
                    n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    for column, v in zip(out, (block.raw_ids[d], len(gone), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()), *([pa.array(out[5], pa.binary())] if keep_bytes else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])])

    return known.join(second, "block", "left").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
