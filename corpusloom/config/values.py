"""Checks and conversions of single configuration values."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from pathlib import PurePosixPath
from typing import Any

SHA256, REVISION, NAME = re.compile(r"[0-9a-f]{64}"), re.compile(r"[0-9a-f]{40}"), re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
# fixed values
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


class ConfigError(ValueError):
    """A configuration that can't be used."""


def finite(x: float) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise ConfigError(f"not a finite number: {x!r}")
    return float(x)


def flag(text: str) -> bool:
    word = text.strip().casefold()
    if word not in TRUE | FALSE:
        raise ConfigError(f"not a boolean: {text!r}")
    return word in TRUE


def whole(text: str, least: int, most: int) -> int:
    try:
        n = int(text.strip())
    except ValueError as e:
        raise ConfigError(f"not an integer: {text!r}") from e
    if not least <= n <= most:
        raise ConfigError(f"{n} is not in {least}..{most}")
    return n


def canonical(value: Any, ascii_only: bool = True) -> str:
    """JSON with sorted keys and no blanks; NaN and infinity are refused."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def plain(value: Any) -> Any:
    """What JSON can hold, recursively: paths become text, sets sorted lists, numpy scalars numbers."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value))
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        if isinstance(value, float) and not math.isfinite(value):
            raise ConfigError("NaN and infinity can't be logged")
        return value
    return plain(value.item()) if hasattr(value, "item") else str(value)


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def namespace(language: str) -> str:
    return "language-" + language.replace("_", "-")


def matching_names(names: Iterable[str], wanted: str) -> list[str]:
    """Names equal to the wanted one in any case, sorted."""
    return sorted(n for n in names if n.casefold() == wanted.casefold())


def rendered_path(template: str, root: str, **fields: Any) -> str:
    """The template with {cycle}, {language}, {task_index:04d} and so on put in; it may not leave the root."""
    try:
        path = PurePosixPath(template.format(**fields))
    except (KeyError, IndexError) as e:
        raise ConfigError(f"unknown field in template: {e}") from e
    if path.is_absolute() or ".." in path.parts:
        raise ConfigError(f"path leaves its root: {path}")
    return str(PurePosixPath(root) / path)


def reference_targets(multiple: int, window: int, batch: int, length: int) -> int:
    """Valid targets of `multiple` windows of full batches: a sequence has one target less than tokens."""
    return multiple * window * batch * (length - 1)
