"""The persisted state: a JSON record with a checksum, and its baselines as tables. Missing is not corrupt."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import tempfile
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The record's fields and which side and kind of baseline each holds.
SETS = {"known_sessions": ("session", "hub"), "local_sessions": ("session", "local"), "known_memory": ("memory", "hub"), "local_memory": ("memory", "local")}
MAPS = ("bindings", "local_dir_bindings")


class CorruptState(ValueError):
    pass


def checksum(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def empty() -> dict:
    return {"schema_version": 1, "hub_fingerprint": None, **{k: {} for k in SETS}, **{k: {} for k in MAPS}, "asserted_dirs": []}


def load(path: str) -> dict | None:
    """The record, None where there is none; raises where it isn't what was saved."""
    try:
        with open(path, "rb") as f:
            value = json.loads(f.read().decode())
    except FileNotFoundError:
        return None
    except ValueError as e:
        raise CorruptState(str(e)) from e
    if not isinstance(value, dict):
        raise CorruptState("not an object")
    found = value.pop("_checksum", None)
    texts = lambda x: isinstance(x, list) and all(isinstance(v, str) for v in x)
    sound = found == checksum(value) and type(value.get("schema_version")) is int and value["schema_version"] == 1
    sound = sound and all(isinstance(value.get(k), dict) and all(map(texts, value[k].values())) for k in SETS)
    if not sound:
        raise CorruptState("checksum or fields")
    return empty() | value


def save(path: str, state: dict) -> None:
    """Through a temporary file, so that a reader sees one state or the other."""
    payload = {k: ({p: sorted(v) for p, v in state[k].items()} if k in SETS else state[k]) for k in empty()}
    payload["asserted_dirs"] = sorted(payload["asserted_dirs"])
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        json.dump(payload | {"_checksum": checksum(payload)}, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


class Locked(TimeoutError):
    pass


@contextmanager
def locked(path: str, timeout: float = 5.0, poll: float = 0.05):
    """Holds path's lock file; gives up after ``timeout`` seconds."""
    until = time.monotonic() + timeout
    with open(f"{path}.lock", "a") as f:
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.monotonic() > until:
                    raise Locked(path) from None
                time.sleep(poll)
        yield


def update(path: str, change, timeout: float = 5.0) -> dict:
    """Reads the record under its lock, lets ``change`` alter it and saves it: two who commit at once lose nothing."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with locked(path, timeout):
        state = load(path) or empty()
        change(state)
        save(path, state)
        return state


def commit(path: str, kind: str, project: str, name: str, cwd: str | None = None, fingerprint: str | None = None) -> dict:
    """Adds one session or document to what the hub is known to hold; a working folder's binding and the fingerprint if given."""

    def change(state):
        known = state[next(f for f, x in SETS.items() if x == (kind, "hub"))]
        known[project] = sorted({*known.get(project, []), name})
        state["bindings"] |= {cwd: project} if cwd is not None else {}
        state["hub_fingerprint"] = fingerprint if fingerprint is not None else state["hub_fingerprint"]

    return update(path, change)


def reconcile(path: str, kind: str, project: str, present, tombstoned, require: bool = False) -> dict:
    """Sets a project's local names to what is there, and keeps those that are gone without a marker; with ``require`` only where it has any."""

    def change(state):
        local = state[next(f for f, x in SETS.items() if x == (kind, "local"))]
        if project in local or not require:
            pending = set(local.get(project, [])) - set(present) - set(tombstoned)
            local[project] = sorted(pending | set(present))

    return update(path, change)


def tables(spark: SparkSession, state: dict | None) -> tuple[DataFrame, DataFrame]:
    """baseline(kind, side, project_key, name) and baselines(kind, side, project_key): an empty set has a row in the second only."""
    rows = [(*SETS[k], p, n) for k in SETS for p, names in (state or empty())[k].items() for n in names]
    present = [(*SETS[k], p) for k in SETS for p in (state or empty())[k]]
    return spark.createDataFrame(rows, "kind string, side string, project_key string, name string"), spark.createDataFrame(present, "kind string, side string, project_key string")


def updated(state: dict, baseline: DataFrame) -> dict:
    """state with the sets of the projects that baseline(kind, side, project_key, name) has."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in state.items()}
    of = {v: k for k, v in SETS.items()}
    touched: dict = {}
    for r in baseline.collect():  # a state file holds all names anyway
        touched.setdefault((of[r.kind, r.side], r.project_key), set()).add(r.name)
    for (field, project), names in touched.items():
        out[field][project] = sorted(names)
    return out
