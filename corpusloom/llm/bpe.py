"""Byte-level BPE by DuckDB recursive queries, one in-process database per Python worker.

Encoding: a chunk's distinct pre-tokens become rows (word, position, id). A recursive query joins neighbouring ids with
the merge table, and contracts each stretch's pairs of the least rank, from the left, until no pair merges. A word is one
stretch unless it is long: no merge can reach further than the longest token that holds one of its bytes, so stretches of
twice that length go on side by side, each waiting only for the two beside it, and the work grows with the word's length,
not with its square. Decoding: an ordered aggregation of the bytes of each document's ids.
Texts are never shuffled; memory is bounded by the chunk, the longest pre-token and the word cache.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CHUNK_BYTES, as_bytes, give_back, place, schema_with, text_chunks

#: Distinct words that a worker remembers: twice this many, in two generations; the older one is dropped.
CACHE_WORDS = 250_000
#: Patterns with the same matches as the key, which search faster: no alternative begins where an earlier one could, and
#: possessive repeats give the same as greedy ones where nothing follows them.
FASTER = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": r""" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+""",
}
#: Words, and bytes of them, in one recursive query (at least one word), and rows that its steps may add up to: a query
#: that would give more stops, and what is not finished starts the next one.
QUERY_WORDS, QUERY_BYTES, QUERY_ROWS = 32_768, 1 << 19, 6_000_000

#: What the database may hold; a single pre-token needs about 0.5 kB for each of its bytes.
MEMORY = "2GB"

#: t: tokens that start at g in stretch tile (below 0: a word's only one), followed by nid at q. first: a stretch's
#: leftmost pair of the least rank r. A word of one stretch contracts that. Of longer words, stretches contract all their
#: ties, where no neighbour has a lower rank and none to the left can still change them. turn: a tie whose merge makes a
#: pair of lower rank, which goes first then. run: ties one after another, of which every second one merges.
MERGE_SQL = """
with recursive t(step, w, g, tile, id, q, nid) as (
    select 0::int, w, g, tile, id, q, nid from start
    union all
    (with pair as (
        select w, g, q, tile, m.id as r from t join merges m on m.pair = ((t.id::bigint << 20) | t.nid) where step < $steps
    ), first as (
        select tile, min((r::bigint << 32) | g) as best, min(w) as w from pair group by tile
    ), spot as (
        select f.w, (best >> 32)::int as r, (best & 4294967295)::int as g from first f where tile < 0
    ), single as (
        select spot.w, spot.r, spot.g, a.q, b.q as q2, b.nid as y from spot join t a on a.g = spot.g join t b on b.g = a.q
    ), least as (
        select tile, (best >> 32)::int as r from first where tile >= 0
    ), tie as (
        select c.w, c.g, c.q, c.tile, c.r from pair c join least l on l.tile = c.tile and l.r = c.r
    ), crowd as (
        select tie.*, b.q as q2, b.nid as y, u.pair is not null or v.pair is not null or z.pair is not null as turn
        from tie join t b on b.g = tie.q left join t a on a.q = tie.g
            left join turns u on u.pair = ((tie.r::bigint << 20) | b.nid) left join turns v on v.pair = ((a.id::bigint << 20) | tie.r) left join turns z on z.pair = ((tie.r::bigint << 20) | tie.r)
    ), area as (
        select tile, r, bool_or(turn) as turn from crowd group by tile, r
    ), ready as (
        select o.tile, coalesce(l.r > o.r or l.r = o.r and not l.turn, true) and coalesce(n.r >= o.r, true) as ok, coalesce(l.r > o.r, true) as first_of
        from area o left join area l on l.tile = o.tile - 1 left join area n on n.tile = o.tile + 1
    ), run as (
        select c.*, ok, first_of, sum(case when turn then 1 else 0 end) over (partition by c.tile order by g rows between unbounded preceding and 1 preceding) as turns_before,
            sum(case when g = before and r = rank_before then 0 else 1 end) over (order by g) as run
        from (select *, lag(q) over (order by g) as before, lag(r) over (order by g) as rank_before from crowd) c join ready on ready.tile = c.tile
    ), taken as (
        select w, g, q, r, q2, y from (select *, row_number() over (partition by run order by g) as place, first_value(ok) over (partition by run order by g) as begun from run)
        where ok and begun and (first_of or not turn) and place % 2 = 1 and coalesce(turns_before, 0) = 0
    )
    select step + 1, t.w, t.g, t.tile, case when t.g = s.g then s.r else t.id end, case when t.g = s.g then s.q2 else t.q end,
        case when t.g = s.g then s.y when t.q = s.g then s.r else t.nid end
    from t join single s on s.w = t.w where t.g <> s.q
    union all
    select step + 1, t.w, t.g, t.tile, coalesce(c.r, t.id), case when c.g is null then t.q else c.q2 end, coalesce(n.r, case when c.g is null then t.nid else c.y end)
    from t semi join taken s on s.w = t.w anti join taken d on d.q = t.g left join taken c on c.g = t.g left join taken n on n.g = case when c.g is null then t.q else c.q2 end)
)
select t.w, t.g, t.tile, t.id, t.q, t.nid, step from t join (select w, max(step) as last from t group by w) e on e.w = t.w and e.last = t.step
"""

DECODE_SQL = "select doc, string_agg(s, '' order by pos) as s from ids join vocab using (id) group by doc"


class Codec:
    """Encoder and decoder of one rank file (lines: base64 token, space, rank), as a tiktoken encoding without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(FASTER.get(pattern, pattern))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.cache_words, self.query_bytes = CACHE_WORDS, QUERY_BYTES
        self.young: dict[str, bytes] = {}  # word: its ids
        self.old: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})  # never spills to a local disk
        flat = (x for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks for x in (self.ranks[t[:k]], self.ranks[t[k:]], i))
        left, right, whole = np.fromiter(flat, dtype=np.int64).reshape(-1, 3).T
        pairs = left << 20 | right
        self._load("merges", pa.table({"pair": pairs, "id": whole.astype(np.int32)}))
        self._load("turns", pa.table({"pair": pairs[whole < np.maximum(left, right)]}))
        self.reach = np.ones(256, dtype=np.int64)  # the longest token with each byte
        for t in self.ranks:
            at = list(set(t))
            self.reach[at] = np.maximum(self.reach[at], len(t))
        give_back()
        # a byte is written as the character 256 + byte, so that any bytes make a string
        self._load("vocab", pa.table({"id": pa.array(self.tokens, pa.int32()), "s": ["".join(chr(256 + b) for b in t) for t in self.tokens.values()]}))

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("arriving", rows)
        self.db.execute(f"create table {name} as select * from arriving")
        self.db.unregister("arriving")

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian uint32 bytes, by the recursive query."""
        out: list[bytes] = []
        ends = np.cumsum([len(w) for w in words])
        while (at := len(out)) < len(words):
            limit = self.query_bytes + (ends[at - 1] if at else 0)
            out += self._merge(words[at : min(at + QUERY_WORDS, max(at + 1, int(np.searchsorted(ends, limit, side="right"))))])
        return out

    def _merge(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(lengths) - lengths
        w, g = np.repeat(np.arange(len(words), dtype=np.int32), lengths), np.arange(len(data), dtype=np.int32)
        size = 2 * np.maximum.reduceat(self.reach[data], first)
        tiles = -(-lengths // size) + 1  # one number is left out, so that words aren't neighbours
        ids, last = self.byte_ids[data], np.zeros(len(data), dtype=bool)
        last[first + lengths - 1] = True
        now = pa.table({
            "w": w, "g": g, "tile": np.where((lengths <= size)[w], -1 - w, (np.cumsum(tiles) - tiles)[w] + (g - first[w]) // size[w]).astype(np.int32), "id": ids,
            "q": pa.array(g + 1, pa.int32(), mask=last), "nid": pa.array(np.append(ids[1:], 0), pa.int32(), mask=last),
        })
        done: list[pa.Table] = []
        while now.num_rows:
            steps = max(1, min(24, QUERY_ROWS // now.num_rows))
            self.db.register("start", now)
            found = self.db.sql(MERGE_SQL, params={"steps": steps}).to_arrow_table()
            self.db.unregister("start")
            more = pc.equal(found.column("step"), steps)
            done.append(found.filter(pc.invert(more)).select(["w", "g", "id"]))
            now = found.filter(more).drop_columns(["step"])
        w, g, ids = (np.concatenate([d.column(c).to_numpy() for d in done]) for c in ("w", "g", "id"))
        order = np.argsort(g)
        flat, ends = ids[order].astype("<u4").tobytes(), (4 * np.searchsorted(w[order], np.arange(len(words) + 1))).tolist()
        return [flat[a:b] for a, b in itertools.pairwise(ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes. A pre-token that is itself a token is taken whole."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.young) > self.cache_words:
            self.young, self.old = {}, self.young
        new = set(itertools.chain.from_iterable(split)) - self.young.keys()
        if self.old:
            known = new & self.old.keys()
            self.young.update((w, self.old[w]) for w in known)
            new -= known
        whole, rest = [], []
        for w in sorted(new):
            (whole if w.encode() in self.ranks else rest).append(w)
        self.young.update((w, self.ranks[w.encode()].to_bytes(4, "little")) for w in whole)
        self.young.update(zip(rest, self.merge_words([w.encode() for w in rest]), strict=True))
        get = self.young.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each text's ids stand for, by ordered aggregation."""
        lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        out = [b""] * len(ids)
        if len(flat):
            self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
            found = self.db.sql(DECODE_SQL).to_arrow_table()
            self.db.unregister("ids")
            for doc, s in zip(found.column("doc").to_pylist(), found.column("s").to_pylist(), strict=True):
                out[doc] = s.encode("utf-16-le")[::2]
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, file and pattern."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = True, cache_words: int | None = None, chunk_bytes: int = CHUNK_BYTES, query_bytes: int = QUERY_BYTES, keep_text: bool = True) -> DataFrame:
    """All columns of `docs` with token_ids (binary: little-endian uint32; only if `ids`), n_tokens (long), ids_sha256 and
    decoded_sha256 (lowercase hex; the latter of the bytes decoded from the ids) added or replaced.

    Null and empty text have no ids. Texts of any length are encoded whole. No rows: no rows. The rank file must exist
    under the same path on every executor. cache_words, chunk_bytes and query_bytes trade a worker's memory for time, not results.
    Without keep_text the texts are not sent back.
    """
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    added = [*([("token_ids", T.BinaryType())] if ids else []), *fields]
    schema = T.StructType([f for f in schema_with(docs, *added).fields if keep_text or f.name != docs.columns[place(docs, text)]])
    carried = schema.names[: len(schema.names) - len(added)]
    at = place(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        c.cache_words, c.query_bytes = CACHE_WORDS if cache_words is None else cache_words, query_bytes
        for batch in text_chunks(batches, at, chunk_bytes):
            found = c.encode([b.decode() for b in as_bytes(batch.column(at))])
            back = c.decode(found)
            columns = [batch.column(batch.schema.get_field_index(x)) for x in carried]
            columns += [pa.array(found, pa.binary())] if ids else []
            columns += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_column(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """All columns with decoded (binary) added or replaced: the bytes of the ids (binary, little-endian uint32; null: none)."""
    schema = schema_with(docs, ("decoded", T.BinaryType()))
    carried = [c for c in docs.columns if c.lower() != "decoded"]
    at = place(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in text_chunks(batches, at):
            back = c.decode([x or b"" for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in carried), pa.array(back, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)
