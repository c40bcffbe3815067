"""Replica folders as DataFrames: listed paths, bytes, lines, memory documents, tombstones, coverage and state.

Spark's own file sources leave out empty files and names that begin with an underscore, both of which mean something
here. So paths are listed on the driver and bytes read on the executors: each path gives a row, checked by count.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T

PATHS = "side string, project_key string, name string, path string"
FILES = "side string, project_key string, name string, path string, content binary, raw_sha256 string"
LINES = "side string, project_key string, sid string, idx int, ok boolean, uuid string, parent string, ts string, type string, is_sidechain boolean, is_tool_fanout boolean, leaf_uuid string, cwd string, session_id string, canon_hash string, raw string, state string"
DOCS = "side string, project_key string, filename string, state string, fm_ok boolean, name string, description string, content_hash string, body string, text string"
TOMBSTONES = "project_key string, kind string, target string, base_hash string, identity string, machine string, time string, valid boolean"
SIDECARS = "project_key string, git_remote string, first_commit string, repo_root string, observed_cwds array<string>"
METAS = "side string, project_key string, sid string, content_hash string, tail_hash string, line_count long, uuid_count long, non_uuid_count long"
ACKS = "project_key string, kind string, identity string, fingerprint string"
COVERAGE = "project_key string, initialized boolean, epoch long"


def _entries(folder: str, keep) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted((e for e in found if keep(e)), key=lambda e: e.name)
    except FileNotFoundError:
        return []


def list_projects(root: str) -> tuple[list[str], list[str]]:
    """Project folders, and those that are links or bear unsafe names and are only reported."""
    safe, unsafe = [], []
    for e in _entries(root, lambda e: e.is_dir() and not e.name.startswith(".")):
        (safe if not e.is_symlink() and T.safe_leaf(e.name) else unsafe).append(e.name)
    return safe, unsafe


def list_paths(spark: SparkSession, roots: dict[str, str], kind: str) -> DataFrame:
    """side, project_key, name, path of all session, memory, tombstone or record files (a project's own, sessions' meta) below each side's root."""
    below = {"session": "", "record": "", "memory": "memory", "tombstone": ".tombstones"}[kind]

    def keep(e: os.DirEntry) -> bool:
        if e.is_symlink() or not e.is_file():
            return False
        if kind == "session":
            return e.name.endswith(".jsonl") and not e.name.startswith(".")
        if kind == "memory":
            return e.name.casefold().endswith(".md") and e.name.casefold() != "memory.md" and not e.name.startswith(".")
        if kind == "record":
            return e.name == "_project.json" or e.name.endswith(".meta.json")
        return e.name.endswith(".json")

    rows = [(side, project, e.name, e.path) for side, root in roots.items() for project in list_projects(root)[0] for e in _entries(os.path.join(root, project, below), keep)]
    return spark.createDataFrame(rows, PATHS)


def _mapped(df: DataFrame, schema: str, rows_of) -> DataFrame:
    """rows_of turns each row, a dict, into rows of schema; batch by batch over Arrow."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = [r for given in batch.to_pylist() for r in rows_of(given)]
            yield from pa.Table.from_pylist(rows, arrow).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def read_files(paths: DataFrame) -> DataFrame:
    """Each path's bytes; fails rather than lose one."""

    def read(row):
        with open(row["path"], "rb") as f:
            data = f.read()
        yield row | {"content": data, "raw_sha256": hashlib.sha256(data).hexdigest()}

    return _mapped(paths, FILES, read)


def session_files(files: DataFrame) -> DataFrame:
    """side, project_key, sid, state, raw_sha256: a row for each file, also where it has no line."""

    def states(row):
        yield row | {"sid": row["name"].removesuffix(".jsonl"), "state": T.file_state(row["content"], T.decoded(row["content"]))}

    return _mapped(files, "side string, project_key string, sid string, state string, raw_sha256 string", states)


def session_lines(files: DataFrame) -> DataFrame:
    """The non-blank lines of all session files."""

    def lines(row):
        state, found = T.parsed_lines(row["content"])
        head = {"side": row["side"], "project_key": row["project_key"], "sid": row["name"].removesuffix(".jsonl"), "state": state}
        return (head | r for r in found)

    return _mapped(files, LINES, lines)


def memory_docs(files: DataFrame) -> DataFrame:
    return _mapped(files, DOCS, lambda r: [{"side": r["side"], "project_key": r["project_key"], "filename": r["name"]} | T.memory_document(r["content"])])


def linked_documents(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """side, project_key of memory folders that hold documents which are links: their indexes are left alone."""
    is_link = lambda e: e.is_symlink() and e.name.casefold().endswith(".md") and e.name.casefold() != "memory.md" and not e.name.startswith(".")
    rows = [(side, project) for side, root in roots.items() for project in list_projects(root)[0] if _entries(os.path.join(root, project, "memory"), is_link)]
    return spark.createDataFrame(rows, "side string, project_key string")


def _object(raw: bytes) -> dict:
    try:
        value = json.loads(raw.decode())
    except (ValueError, UnicodeError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def _fits(value: dict, **kinds) -> bool:
    """Whether each named field is null, missing or of its type; a truth value is no number."""
    return all(value.get(k) is None or type(value[k]) is kind for k, kind in kinds.items())


def tombstone(name: str, raw: bytes) -> dict | None:
    """The record a tombstone file stands for; its name says what it is about, its content must agree to be valid."""
    stem = name.removesuffix(".deleted.json")
    if not stem:
        return None
    kind, target = ("memory", stem.removeprefix("memory-")) if stem.startswith("memory-") else ("session", stem)
    value = _object(raw)
    valid = bool(target) and value.get("kind") == kind and value.get("target") == target and _fits(value, base_hash=str, machine=str, time=str)
    text = lambda k: value.get(k) if valid else None
    told = text("identity") if kind == "memory" else None
    identity = told if isinstance(told, str) and told.strip() else None
    return {"kind": kind, "target": target, "base_hash": text("base_hash"), "identity": identity, "machine": text("machine"), "time": text("time"), "valid": valid}


def tombstones(files: DataFrame) -> DataFrame:
    """Valid and corrupt tombstones; corrupt ones block what they name."""
    named = files.where(F.col("name").endswith(".deleted.json"))
    return _mapped(named, TOMBSTONES, lambda r: [{"project_key": r["project_key"]} | t for t in [tombstone(r["name"], r["content"])] if t])


def coverage(files: DataFrame) -> DataFrame:
    """A row for each project whose coverage record is sound."""

    def read(row):
        value = _object(row["content"])
        if type(value.get("initialized")) is bool and type(value.get("epoch")) is int and value["epoch"] >= 0 and _fits(value, bootstrap_time=str, machine=str):
            yield {"project_key": row["project_key"], "initialized": value["initialized"], "epoch": value["epoch"]}

    return _mapped(files.where(F.col("name") == "_coverage.json"), COVERAGE, read)


def project_sidecars(files: DataFrame) -> DataFrame:
    """A row for each project whose own record is sound: its git identity and the working folders seen."""

    def read(row):
        value = _object(row["content"])
        cwds = value.get("observed_cwds", [])
        sound = bool(value) and _fits(value, git_remote=str, first_commit=str, repo_root=str) and type(value.get("schema_version", 1)) is int
        if sound and isinstance(cwds, list) and all(isinstance(x, str) for x in cwds):
            yield {"project_key": row["project_key"], "observed_cwds": cwds} | {k: value.get(k) for k in ("git_remote", "first_commit", "repo_root")}

    return _mapped(files.where(F.col("name") == "_project.json"), SIDECARS, read)


def session_metas(files: DataFrame) -> DataFrame:
    """A row for each stored session record that is sound: two digests and three counts."""
    digests, counts = ("content_hash", "tail_hash"), ("line_count", "uuid_count", "non_uuid_count")

    def read(row):
        value = _object(row["content"])
        sound = all(isinstance(value.get(k), str) and re.fullmatch(r"[0-9a-f]{64}", value[k]) for k in digests)
        if sound and all(type(value.get(k)) is int and value[k] >= 0 for k in counts) and type(value.get("schema_version", 1)) is int:
            yield {"side": row["side"], "project_key": row["project_key"], "sid": row["name"].removesuffix(".meta.json")} | {k: value[k] for k in (*digests, *counts)}

    return _mapped(files.where(F.col("name").endswith(".meta.json")), METAS, read)


def acks(files: DataFrame, kinds=("casefold-collision", "damaged", "identity-collision")) -> DataFrame:
    """(kind, identity, fingerprint) records of acks.json; unsound records and ledgers count for nothing."""

    def read(row):
        try:
            value = json.loads(row["content"].decode())
            records = value["acks"] if type(value["version"]) is int and value["version"] == 1 else []
        except (ValueError, KeyError, TypeError):
            records = []
        for r in records if isinstance(records, list) else ():
            if isinstance(r, dict) and r.get("kind") in kinds and isinstance(r.get("identity"), str) and isinstance(r.get("fingerprint"), str):
                yield {"project_key": row["project_key"]} | {k: r[k] for k in ("kind", "identity", "fingerprint")}

    return _mapped(files.where(F.col("name") == "acks.json"), ACKS, read).distinct()


def first_cwds(lines: DataFrame) -> DataFrame:
    """project_key, side and the sorted first working folders of its sessions."""
    first = lines.where(F.col("ok") & (F.coalesce("cwd", F.lit("")) != "")).groupBy("side", "project_key", "sid").agg(F.min_by("cwd", "idx").alias("cwd"))
    return first.groupBy("side", "project_key").agg(F.array_sort(F.collect_set("cwd")).alias("cwds"))
