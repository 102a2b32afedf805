"""Small files of the driver: atomic JSON, owned folders, logs, summaries, pointers, disk limits."""

from __future__ import annotations

import csv
import fcntl
import json
import os
import shutil
import time
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path, PurePosixPath
from typing import Any

from ..config.values import SHA256, ConfigError, canonical, plain

MARKER = ".corpusloom-owned"


def atomic_write(path: str | Path, text: str) -> None:
    """Readers see the old file or the new one, also after a crash."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    with part.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def atomic_write_json(path: str | Path, value: Any) -> None:
    atomic_write(path, json.dumps(plain(value), sort_keys=True, indent=2) + "\n")


def own(root: str | Path) -> Path:
    """Make a folder ours: it is new, empty or marked already."""
    root = Path(root).resolve()
    if len(root.parts) < 3 or root == Path.home():
        raise ConfigError(f"unsafe folder: {root}")
    root.mkdir(parents=True, exist_ok=True)
    if not (root / MARKER).exists():
        if any(root.iterdir()):
            raise ConfigError(f"folder isn't empty and isn't ours: {root}")
        (root / MARKER).write_text("", encoding="utf-8")
    return root


def clean(root: str | Path) -> None:
    """Delete what is in a folder that carries the mark, and nothing else."""
    root = Path(root).resolve()
    if not (root / MARKER).is_file():
        raise ConfigError(f"folder isn't ours: {root}")
    for x in root.iterdir():
        if x.name != MARKER:
            shutil.rmtree(x) if x.is_dir() and not x.is_symlink() else x.unlink()


@contextmanager
def locked(path: str | Path) -> Iterator[None]:
    """One writer at a time on this host; a second one fails at once."""
    with Path(path).open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RuntimeError(f"in use: {path}") from e
        yield


def folder_bytes(root: str | Path) -> int:
    return sum(p.stat().st_size for p in Path(root).rglob("*") if p.is_file() and not p.is_symlink())


class DiskLimit:
    """Fails once the folder is over its limit; looks every `seconds` at most."""

    def __init__(self, root: str | Path, most: int, seconds: float = 5.0, clock=time.monotonic):
        self.root, self.most, self.seconds, self.clock = root, most, seconds, clock
        self.next = -float("inf")

    def check(self, force: bool = False) -> None:
        if not force and self.clock() < self.next:
            return
        self.next = self.clock() + self.seconds
        if (n := folder_bytes(self.root)) > self.most:
            raise RuntimeError(f"{self.root} holds {n} bytes of {self.most}")


class EventLog:
    """One JSON object a line, flushed line by line."""

    def __init__(self, path: str | Path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.file = Path(path).open("a", encoding="utf-8")

    def log(self, event: str, **values: Any) -> None:
        self.file.write(canonical({"event": event, **values}, ascii_only=False) + "\n")
        self.file.flush()

    def close(self) -> None:
        self.file.close()


class ScalarLog:
    """(tag, step, value) lines; a step that isn't beyond the tag's last one is dropped, also after a restart."""

    def __init__(self, path: str | Path):
        self.path, self.last = Path(path), {}
        if self.path.exists():
            for line in self.path.read_text(encoding="utf-8").splitlines():
                r = json.loads(line)
                self.last[r["tag"]] = max(r["step"], self.last.get(r["tag"], -1))

    def scalar(self, tag: str, value: float, step: int) -> bool:
        if step <= self.last.get(tag, -1):
            return False
        line = canonical({"tag": tag, "step": step, "value": value})
        with self.path.open("a", encoding="utf-8") as f:
            f.write(line + "\n")
        self.last[tag] = step
        return True


def write_summaries(folder: str | Path, results: Iterable[Mapping[str, Any]], columns: list[str]) -> None:
    """summary.json with everything, summary.csv with the named columns only; each appears whole."""
    rows = [plain(r) for r in results]
    atomic_write_json(Path(folder) / "summary.json", rows)
    part = Path(folder) / ".summary.csv.tmp"
    with part.open("w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore", restval="")
        out.writeheader()
        out.writerows(rows)
    os.replace(part, Path(folder) / "summary.csv")


POINTER = ("path", "sha256", "completed_tasks", "completed_cycles", "batches", "input_tokens", "targets", "identity", "horizon_cycles")


def write_pointer(file: str | Path, **values: Any) -> None:
    """The committed state: exactly POINTER's fields."""
    if set(values) != set(POINTER):
        raise ConfigError(f"a pointer has the fields {sorted(POINTER)}")
    atomic_write_json(file, values)


def read_pointer(path: str | Path, identity: str | None = None, previous: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A pointer whose fields are complete, whose path stays inside, that belongs to `identity` and hasn't gone back
    behind `previous`."""
    p = json.loads(Path(path).read_text(encoding="utf-8"))
    if set(p) != set(POINTER) or not SHA256.fullmatch(str(p["sha256"])):
        raise ConfigError("pointer has a wrong field set or hash")
    inner = PurePosixPath(p["path"])
    if inner.is_absolute() or ".." in inner.parts:
        raise ConfigError("pointer leaves its folder")
    if identity is not None and p["identity"] != identity:
        raise ConfigError("pointer belongs to another experiment")
    counts = ("completed_tasks", "completed_cycles", "batches", "input_tokens", "targets")
    if any(not isinstance(p[c], int) or p[c] < 0 or (previous and p[c] < previous[c]) for c in counts):
        raise ConfigError("pointer's progress is not valid")
    return p


def extended_horizon(old: list[Any], new: list[Any], completed: int) -> None:
    """A plan may only grow: its old tasks stay as they were, and what is done lies inside."""
    if len(new) < len(old) or [canonical(t) for t in new[: len(old)]] != [canonical(t) for t in old]:
        raise ConfigError("the new plan doesn't begin with the old one")
    if not 0 <= completed <= len(old):
        raise ConfigError("more tasks are done than were planned")


def files_of(root: str | Path, forbidden: Iterable[str] = ()) -> list[dict[str, Any]]:
    """Path, size and SHA-256 of every file below a folder, in order, without those whose parts are forbidden names."""
    import hashlib

    out, bad = [], set(forbidden)
    for p in sorted(Path(root).rglob("*")):
        inner = p.relative_to(root)
        if p.is_file() and not p.is_symlink() and not bad & set(inner.parts):
            h = hashlib.sha256()
            with p.open("rb") as f:
                while piece := f.read(1 << 20):
                    h.update(piece)
            out.append({"path": inner.as_posix(), "bytes": p.stat().st_size, "sha256": h.hexdigest()})
    return out
