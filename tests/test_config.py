import dataclasses
import json
import math

import pytest

from corpusloom.config import layers as L
from corpusloom.config import values as V
from corpusloom.sources import files as S


def test_values():
    assert V.finite(1) == 1.0 and V.flag(" Yes ") is True and V.flag("off") is False and V.whole(" 7 ", 1, 9) == 7
    for f, args in ((V.finite, (math.nan,)), (V.finite, (True,)), (V.flag, ("maybe",)), (V.whole, ("x", 0, 1)), (V.whole, ("9", 0, 1)), (V.canonical, ({"a": math.inf},))):
        with pytest.raises(ValueError):
            f(*args)
    assert V.canonical({"b": [1, {"z": None}], "a": "é"}, ascii_only=False) == '{"a":"é","b":[1,{"z":null}]}'
    assert V.fingerprint({"a": 1, "b": 2}) == V.fingerprint({"b": 2, "a": 1}) != V.fingerprint({"a": 1})
    assert V.namespace("zh_written") == "language-zh-written" and V.matching_names(["EN", "fr", "en"], "En") == ["EN", "en"]
    assert V.rendered_path("{language}/{task_index:04d}", "/data", language="en", task_index=7) == "/data/en/0007"
    for bad in ("../{language}", "/x", "{unknown}"):
        with pytest.raises(V.ConfigError):
            V.rendered_path(bad, "/data", language="en")
    assert V.SHA256.fullmatch("a" * 64) and not V.SHA256.fullmatch("A" * 64) and V.utc_now().endswith("+00:00") and V.reference_targets(2, 3, 4, 9) == 192


@dataclasses.dataclass
class Stage:
    name: str
    tokens: int
    share: float = 0.5


def test_layers(tmp_path):
    (tmp_path / "base.yaml").write_text("stage: {name: a, tokens: 5}\nreader: reader.yaml\nlist: [1, 2]\n")
    (tmp_path / "reader.yaml").write_text("length: 8\nroot: ${ROOT}/x\n")
    (tmp_path / "top.yaml").write_text("base: base.yaml\noverrides: {stage: {tokens: 6}, list: [3]}\n")
    assert L.load(tmp_path / "top.yaml", ["reader"], {"ROOT": "/r"}) == {"stage": {"name": "a", "tokens": 6}, "reader": {"length": 8, "root": "/r/x"}, "list": [3]}
    with pytest.raises(V.ConfigError):
        L.load(tmp_path / "top.yaml", ["reader"], {})
    assert L.build(Stage, {"name": "a", "tokens": 5}) == Stage("a", 5)
    for bad in ({"name": "a"}, {"name": "a", "tokens": 5, "x": 1}, {"name": "a", "tokens": True}, {"name": "a", "tokens": 5, "share": 1}):
        with pytest.raises(V.ConfigError):
            L.build(Stage, bad)
    assert L.overridden({"a": {"b": 1, "c": 2}}, {"a.b": 9}, ["a.b"]) == {"a": {"b": 9, "c": 2}}
    with pytest.raises(V.ConfigError):
        L.overridden({}, {"a.z": 9}, ["a.b"])


def test_files(tmp_path):
    S.atomic_write_json(tmp_path / "x/y.json", {"b": 1, "a": {2, 1}})
    assert json.loads((tmp_path / "x/y.json").read_text()) == {"a": [1, 2], "b": 1} and [p.name for p in (tmp_path / "x").iterdir()] == ["y.json"]
    root = S.own(tmp_path / "own")
    (root / "f").write_text("12345")
    assert S.folder_bytes(root) == 5 and [f["path"] for f in S.files_of(root, [S.MARKER])] == ["f"]
    S.clean(S.own(root))
    assert [p.name for p in root.iterdir()] == [S.MARKER]
    for f, arg in ((S.own, tmp_path / "x"), (S.clean, tmp_path / "x"), (S.own, "/")):
        with pytest.raises(V.ConfigError):
            f(arg)
    with S.locked(tmp_path / "lock"), pytest.raises(RuntimeError), S.locked(tmp_path / "lock"):
        pass
    now = [0.0]
    guard = S.DiskLimit(tmp_path / "x", 5, clock=lambda: now[0])
    with pytest.raises(RuntimeError):
        guard.check()
    guard.check()  # not yet time to look again
    with pytest.raises(RuntimeError):
        guard.check(force=True)


def test_logs_and_summaries(tmp_path):
    log = S.EventLog(tmp_path / "events.jsonl")
    log.log("step", loss=1.5, path=tmp_path)
    with pytest.raises(V.ConfigError):
        log.log("step", loss=math.nan)
    log.close()
    assert [json.loads(x)["event"] for x in (tmp_path / "events.jsonl").read_text().splitlines()] == ["step"]
    s = S.ScalarLog(tmp_path / "scalars")
    assert [s.scalar("t", v, i) for i, v in ((1, 1.0), (1, 9.0), (2, 0.5))] == [True, False, True]
    assert not S.ScalarLog(tmp_path / "scalars").scalar("t", 3.0, 2)  # after a restart
    S.write_summaries(tmp_path, [{"a": 1, "b": 2, "z": 3}, {"a": 4}], ["a", "b"])
    assert (tmp_path / "summary.csv").read_text().split() == ["a,b", "1,2", "4,"] and json.loads((tmp_path / "summary.json").read_text())[0]["z"] == 3


def test_pointer_and_horizon(tmp_path):
    ok = {"path": "c/1", "sha256": "a" * 64, "completed_tasks": 3, "completed_cycles": 1, "batches": 9, "input_tokens": 99, "targets": 90, "identity": "e", "horizon_cycles": 2}
    p = tmp_path / "latest.json"
    S.write_pointer(p, **ok)
    assert S.read_pointer(p, "e", ok) == ok
    with pytest.raises(V.ConfigError):
        S.read_pointer(p, "other")
    with pytest.raises(V.ConfigError):
        S.read_pointer(p, "e", ok | {"batches": 10})
    for bad in (ok | {"path": "../c"}, ok | {"path": "/c"}, ok | {"sha256": "x"}, ok | {"batches": -1}):
        S.write_pointer(p, **bad)
        with pytest.raises(V.ConfigError):
            S.read_pointer(p)
    with pytest.raises(V.ConfigError):
        S.write_pointer(p, path="c")
    S.extended_horizon([{"a": 1}], [{"a": 1}, {"a": 2}], 1)
    for bad in (([1, 2], [1], 0), ([1], [2, 3], 0), ([1], [1, 2], 2)):
        with pytest.raises(V.ConfigError):
            S.extended_horizon(*bad)
