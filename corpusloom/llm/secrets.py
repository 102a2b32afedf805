"""Secret scans: known formats, and sliding-window Shannon entropy per character class over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, place, schema_with, text_chunks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A run of hex digits of 32 or more is the same as such a maximal run; the long form is quicker to search for.
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings, and for each character class its members and the least entropy (bits a character) of a window.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.9),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 3.9),
)
WINDOW = 20
#: Strings that are never secrets by entropy alone: words and names without digits, plain numbers, UUIDs, dates, rules.
ALLOW = (
    re.compile(r"[A-Za-z_=/+-]+"), re.compile(r"[0-9_=/+-]+"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:[A-Za-z]+[_/-])*[A-Za-z]+[0-9]{0,4}"),
)


def entropy_runs(s: str, members: frozenset, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged ranges of windows of `window` characters, all in the class, whose Shannon entropy is `least` or more.

    One pass: when the window moves, only the counts of the character that leaves and of the one that enters change, and
    with them the sum of c * log2(c).
    """
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    top = math.log2(window)
    found: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, held = 0.0, 0
    for i, ch in enumerate(s):
        if ch not in members:
            counts, total, held = {}, 0.0, 0
            continue
        if held == window:
            out = s[i - window]
            c = counts[out]
            total += part[c - 1] - part[c]
            counts[out] = c - 1
        else:
            held += 1
        c = counts.get(ch, 0)
        total += part[c + 1] - part[c]
        counts[ch] = c + 1
        if held == window and top - total / window >= least - 1e-9:
            a = i + 1 - window
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((a, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known formats, leftmost and non-overlapping for each kind; code points, end exclusive."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans + [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[str, int]]:
    """Candidate strings and their places; of one that base spans overlap, the parts of WINDOW characters or more between
    them. A candidate that a rule allows whole has none."""
    taken = merged((a, b) for a, _, b in taken)
    first = 0
    for m in CANDIDATE.finditer(text):
        while first < len(taken) and taken[first][1] <= m.start():
            first += 1
        if any(a.fullmatch(m[0]) for a in ALLOW):
            continue
        at, i = m.start(), first
        while i < len(taken) and taken[i][0] < m.end():
            a, b = taken[i]
            if a - at >= WINDOW:
                yield text[at:a], at
            at = max(at, b)
            i += 1
        if m.end() - at >= WINDOW:
            yield text[at : m.end()], at


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of high-entropy ranges in candidate strings, without the base spans in them, that no rule allows."""
    spans = []
    for s, at in candidates(text, taken):
        if any(a.fullmatch(s) for a in ALLOW):
            continue
        runs = merged(r for _, members, least in CLASSES for r in entropy_runs(s, members, least) if not any(a.fullmatch(s[r[0] : r[1]]) for a in ALLOW))
        spans += [(at + a, 3, at + b) for a, b in runs]
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns with n_assign, n_access, n_hex, n_entropy (long), base_sha256, spans (string: kind:start:end, by start,
    then kind) added or replaced. Null text counts as empty; whole texts of any length are scanned; no rows: no rows."""
    fields = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    schema = schema_with(docs, *fields)
    names = {n for n, _ in fields}
    carried = [c for c in docs.columns if c.lower() not in names]
    at = place(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, at):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for raw in as_bytes(batch.column(at)):
                t = raw.decode()
                base = base_spans(t)
                more = entropy_spans(t, base)
                for k, n in enumerate(counts):
                    n.append(sum(x[1] == k for x in (*base, *more)))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined([*base, *more]))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def mask_secrets(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span replaced."""
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted([*base, *entropy_spans(text, base)]):
        if b > at:
            out += [text[at : max(a, at)], mask if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])
