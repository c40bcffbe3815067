"""Writers: canonical JSONL, create-only and overwriting tables, versions kept side by side."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jsonl(lines: DataFrame) -> DataFrame:
    """project_key, sid and the text of each session: its canonical lines in order of pos, each ended by LF."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "raw")))
    return lines.groupBy("project_key", "sid").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n"), F.lit("\n")).alias("content"))


def create_only(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What may be written without replacing anything."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def keep_both(new: DataFrame, existing: DataFrame, keys: list[str], host: str, stamp: str) -> DataFrame:
    """new with ``target``: its name, or where that exists a name of its own made from host, stamp and, if needed, a number."""
    taken = existing.select(*keys, F.lit(True).alias("taken")).distinct()
    name = keys[-1]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or [name]))
    other = F.concat(F.regexp_replace(name, r"(\.[^.]*)?$", ""), F.lit(f".synced-{host}-{stamp}"), F.when(rank > 1, F.concat(F.lit("."), (rank - 1).cast("string"))).otherwise(F.lit("")), F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return new.join(taken, keys, "left").withColumn("target", F.when(F.col("taken"), other).otherwise(F.col(name))).drop("taken")


def write_texts(files: DataFrame, root: str, below: str = "", replace: bool = True) -> int:
    """Writes files(project_key, name, content) under root's project folders, on the driver, where the folders are; how many.

    Each goes through a temporary file beside it. Folders that are links, and with ``replace`` false files that are there,
    are left alone.
    """
    done = 0
    for r in files.select("project_key", "name", "content").toLocalIterator():
        folder = os.path.join(root, r.project_key, below)
        target = os.path.join(folder, r.name)
        if os.path.islink(os.path.join(root, r.project_key)) or os.path.islink(folder) or os.path.islink(target) or (not replace and os.path.exists(target)):
            continue
        os.makedirs(folder, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8", newline="", suffix=".tmp") as f:
            f.write(r.content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, target)
        done += 1
    return done
