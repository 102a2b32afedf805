"""Layered YAML: a base, overrides, other files by reference, environment variables; strict about field names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import MISSING, fields
from pathlib import Path
from typing import Any

import yaml

from .values import ConfigError

VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Maps are merged key by key, anything else is replaced. Neither side is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(out.get(k), Mapping) and isinstance(v, Mapping) else v
    return out


def interpolated(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """${NAME} in every text replaced; an unset variable is an error."""
    known = os.environ if env is None else env

    def put(m: re.Match) -> str:
        if m[1] not in known:
            raise ConfigError(f"environment variable is not set: {m[1]}")
        return known[m[1]]

    if isinstance(value, str):
        return VARIABLE.sub(put, value)
    if isinstance(value, Mapping):
        return {k: interpolated(v, known) for k, v in value.items()}
    return [interpolated(v, known) for v in value] if isinstance(value, list) else value


def load(path: str | Path, sections: Iterable[str] = (), env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """A YAML map. With `base` (a file beside it) and `overrides` it is their deep merge; a section among `sections` may be
    the name of a file that holds it."""
    here = Path(path)
    data = yaml.safe_load(here.read_text(encoding="utf-8")) or {}
    if not isinstance(data, Mapping):
        raise ConfigError(f"not a map: {here}")
    if "base" in data:
        strict(data, ["base", "overrides"], optional=["overrides"])
        data = deep_merge(load(here.parent / data["base"], sections, env), data.get("overrides") or {})
    out = dict(data)
    for s in sections:
        if isinstance(out.get(s), str):
            out[s] = load(here.parent / out[s], (), env)
    return interpolated(out, env)


def strict(data: Mapping[str, Any], allowed: Iterable[str], optional: Iterable[str] = ()) -> None:
    """Fields that aren't known, and fields that lack."""
    known = set(allowed)
    unknown, missing = sorted(set(data) - known), sorted(known - set(optional) - set(data))
    if unknown or missing:
        raise ConfigError(f"unknown fields {unknown}, missing fields {missing}")


def build(kind: type, data: Mapping[str, Any]) -> Any:
    """A dataclass from a map; names strict, and no integer or boolean where the other, or a float, is declared."""
    strict(data, [f.name for f in fields(kind)], [f.name for f in fields(kind) if f.default is not MISSING or f.default_factory is not MISSING])
    for f in fields(kind):
        want = {"int": int, "float": float, "bool": bool, "str": str}.get(f.type if isinstance(f.type, str) else f.type.__name__)
        if f.name in data and want and type(data[f.name]) is not want:
            raise ConfigError(f"{f.name} must be {want.__name__}")
    return kind(**data)


def overridden(root: Mapping[str, Any], overrides: Mapping[str, Any], allowed: Iterable[str]) -> dict[str, Any]:
    """Dotted keys put into a nested map; only those on the list."""
    refused = sorted(set(overrides) - set(allowed))
    if refused:
        raise ConfigError(f"can't be overridden: {refused}")
    out: dict[str, Any] = dict(root)
    for key, v in overrides.items():
        for part in reversed(key.split(".")):
            v = {part: v}
        out = deep_merge(out, v)
    return out
