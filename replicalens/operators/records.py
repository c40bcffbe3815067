"""Digests that tell whether anything a decision rests on has moved, and the records that decisions leave behind.

Texts that are digested are JSON as Python writes it: ", " and ": " between parts, keys in order, only quotes, backslashes
and control characters escaped.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The fields of a snapshot, what a marker folder's digest leaves out, the records' version.
SNAPSHOT = ("local_data", "hub_data", "local_meta", "hub_meta", "project_sidecar", "config_hash", "tomb_dir_digest", "state_entry")
UNCOUNTED, VERSION = ("acks.json",), 1


@F.pandas_udf(StringType())
def _quoted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: json.dumps(x, ensure_ascii=False), na_action="ignore")


def quoted(text: Column) -> Column:
    """A JSON string, null for null; plain ASCII needs no Python."""
    plain = text.rlike(r'\A[ !#-\[\]-~]*\z')
    return F.when(text.isNull(), "null").when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(_quoted(text))


def listed(texts: Column) -> Column:
    """A JSON list of texts that are JSON already."""
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def known_set_hash(baseline: DataFrame) -> DataFrame:
    """One row: the digest of baseline(project_key, name), each project with its names in order; projects without names are left out."""
    names = baseline.distinct().groupBy("project_key").agg(F.array_sort(F.collect_list(F.struct("name", quoted(F.col("name")).alias("q")))).alias("names"))
    entry = F.concat(quoted(F.col("project_key")), F.lit(": "), listed(F.transform("names", lambda x: x["q"])))
    every = names.agg(F.array_sort(F.collect_list(F.struct("project_key", entry.alias("e")))).alias("all"))
    return every.select(F.sha2(F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["e"]), ", "), F.lit("}")), 256).alias("known_hash"))


def marker_digests(files: DataFrame) -> DataFrame:
    """project_key, tomb_dir_digest of each folder's files(project_key, name, raw_sha256), acknowledgements and unfinished ones aside."""
    kept = files.where(~F.col("name").isin(*UNCOUNTED) & ~F.col("name").rlike(r"\.(tmp|lock)\z"))
    pair = listed(F.array(quoted(F.col("name")), quoted(F.col("raw_sha256"))))
    every = kept.groupBy("project_key").agg(F.array_sort(F.collect_list(F.struct("name", pair.alias("p")))).alias("all"))
    return every.select("project_key", F.sha2(listed(F.transform("all", lambda x: x["p"])), 256).alias("tomb_dir_digest"))


def state_entries(sessions: DataFrame, known: DataFrame, bindings: DataFrame, dir_bindings: DataFrame, asserted: DataFrame) -> DataFrame:
    """project_key, sid, state_entry: what the state says of one session alone, so that others' commits don't change it.

    sessions(project_key, sid, cwd, local_dir), known(side, project_key, name), bindings(cwd, bound),
    dir_bindings(local_dir, bound), asserted(local_dir).
    """
    has = lambda s: known.where(F.col("side") == s).select("project_key", F.col("name").alias("sid"), F.lit(True).alias(f"on_{s}")).distinct()
    rows = sessions.join(has("hub"), ["project_key", "sid"], "left").join(has("local"), ["project_key", "sid"], "left")
    rows = rows.join(bindings.select("cwd", F.col("bound").alias("binding")), "cwd", "left").join(dir_bindings.select("local_dir", F.col("bound").alias("dir_binding")), "local_dir", "left")
    rows = rows.join(asserted.select("local_dir", F.lit(True).alias("claimed")).distinct(), "local_dir", "left")
    truth = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("string")
    fields = [("binding", quoted(F.col("binding"))), ("dir_asserted", truth("claimed")), ("dir_binding", quoted(F.col("dir_binding"))), ("known", truth("on_hub")), ("local_known", truth("on_local")), ("pk", quoted(F.col("project_key"))), ("sid", quoted(F.col("sid")))]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in fields]), F.lit("}"))
    return rows.select("project_key", "sid", F.sha2(text, 256).alias("state_entry"))


def config_hash(own_hub: str | None, remotes: dict[str, str], force_unsafe_lock: bool) -> str:
    import hashlib

    return hashlib.sha256(json.dumps({"force_unsafe_lock": force_unsafe_lock, "own_hub": own_hub, "remotes": remotes}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def snapshots(sessions: DataFrame, files: DataFrame, markers: DataFrame, states: DataFrame, config: str) -> DataFrame:
    """project_key, sid and SNAPSHOT's fields for sessions(project_key, sid).

    files(side, project_key, name, raw_sha256) holds all files of a project's folder; one that is absent is told as such,
    one that can't be read (a null digest) as an error, so that neither passes for the other.
    """
    mark = F.when(F.col("raw_sha256").isNull(), "err").otherwise(F.concat(F.lit("sha:"), F.col("raw_sha256")))
    told = files.select("side", "project_key", "name", mark.alias("mark"))
    rows = sessions.select("project_key", "sid").distinct()
    for field, side, suffix in (("local_data", "local", ".jsonl"), ("hub_data", "hub", ".jsonl"), ("local_meta", "local", ".meta.json"), ("hub_meta", "hub", ".meta.json")):
        mine = told.where((F.col("side") == side) & F.col("name").endswith(suffix)).select("project_key", F.expr(f"left(name, length(name) - {len(suffix)})").alias("sid"), F.col("mark").alias(field))
        rows = rows.join(mine, ["project_key", "sid"], "left")
    sidecar = told.where("side = 'hub' AND name = '_project.json'").select("project_key", F.col("mark").alias("project_sidecar"))
    rows = rows.join(sidecar, "project_key", "left").join(marker_digests(markers), "project_key", "left").join(states, ["project_key", "sid"], "left")
    rows = rows.fillna("absent", list(SNAPSHOT[:5])).withColumn("tomb_dir_digest", F.coalesce("tomb_dir_digest", F.lit(""))).withColumn("config_hash", F.lit(config))
    return rows.select("project_key", "sid", *SNAPSHOT)


def marker_name(kind: Column, target: Column) -> Column:
    """The file that marks a deletion; path separators in a document's name become underscores."""
    return F.concat(F.when(kind == "memory", F.concat(F.lit("memory-"), F.regexp_replace(target, r"[/\\]", "_"))).otherwise(target), F.lit(".deleted.json"))


def marker_files(deleted: DataFrame, machine: str, time: str) -> DataFrame:
    """project_key, name, content of the markers for deleted(project_key, kind, target, base_hash, identity)."""
    head = [("schema_version", F.lit(str(VERSION))), ("kind", quoted(F.col("kind"))), ("target", quoted(F.col("target"))), ("base_hash", quoted(F.col("base_hash"))), ("machine", quoted(F.lit(machine))), ("time", quoted(F.lit(time)))]
    lines = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{k}": '), v) for k, v in head])
    identity = F.when(F.col("kind") == "memory", F.concat(F.lit(',\n  "identity": '), quoted(F.col("identity")))).otherwise(F.lit(""))
    return deleted.select("project_key", marker_name(F.col("kind"), F.col("target")).alias("name"), F.concat(F.lit("{\n"), lines, identity, F.lit("\n}")).alias("content"))


def coverage_files(projects: DataFrame, machine: str, time: str, epoch: int = 1) -> DataFrame:
    """project_key, name, content of the coverage record of each of projects(project_key)."""
    text = json.dumps({"schema_version": VERSION, "initialized": True, "epoch": epoch, "bootstrap_time": time, "machine": machine}, ensure_ascii=False, indent=2)
    return projects.select("project_key", F.lit("_coverage.json").alias("name"), F.lit(text).alias("content")).distinct()
