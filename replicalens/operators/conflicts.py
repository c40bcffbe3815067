"""Conflicting versions of memory documents, grouped where files share identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, replaced


def versions(docs: DataFrame) -> DataFrame:
    """project_key, filename, content_hash, sides: a version for each content; damaged ones stay apart by side."""
    mark = F.coalesce("content_hash", F.concat(F.lit("damaged:"), F.col("side")))
    return docs.groupBy("project_key", "filename", mark.alias("version")).agg(F.array_join(F.array_sort(F.collect_set("side")), ",").alias("sides"))


def components(docs: DataFrame) -> DataFrame:
    """project_key, filename, component: files connected by shared identities, named by the least of them.

    Labels of files and of identities take each other's least, and each file then the label of the file it is labelled by,
    until nothing moves: a chain of n files takes about log2 n rounds.
    """
    links = cut(docs.where(F.col("name").isNotNull()).select("project_key", "name", "filename").distinct())
    label = cut(links.select("project_key", "filename").distinct().withColumn("component", F.col("filename")))
    while True:
        best = links.join(label, ["project_key", "filename"]).groupBy("project_key", "name").agg(F.min("component").alias("least"))
        least = links.join(best, ["project_key", "name"]).groupBy("project_key", "filename").agg(F.min("least").alias("least"))
        step = label.join(least, ["project_key", "filename"]).select("project_key", "filename", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        further = step.select("project_key", F.col("filename").alias("component"), F.col("component").alias("further"))
        step = step.join(further, ["project_key", "component"]).select("project_key", "filename", "before", F.least("component", "further").alias("component"))
        step = replaced(label, step)
        changed = not step.where("component <> before").isEmpty()
        label = step.drop("before")
        if not changed:
            return label


def tombstone_versions(docs: DataFrame, tombs: DataFrame) -> DataFrame:
    """project_key, filename, target: a file's own tombstone and those of its identity, each target once."""
    valid = tombs.where("valid")
    own = docs.select("project_key", "filename").distinct().join(valid.select("project_key", F.col("target").alias("filename"), "target"), ["project_key", "filename"])
    same = docs.where(F.col("name").isNotNull()).select("project_key", "filename", "name").distinct().join(valid.select("project_key", F.col("identity").alias("name"), "target"), ["project_key", "name"]).drop("name")
    return own.unionByName(same.select(own.columns)).distinct()


def fingerprints(found: DataFrame) -> DataFrame:
    """project_key, filename, fingerprint of a conflict: its versions in order, one digest."""
    part = F.concat_ws("|", "version", "sides")
    return found.groupBy("project_key", "filename").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("fingerprint"))


def staging(found: DataFrame, stored: DataFrame) -> DataFrame:
    """status of each conflict against what has been staged: would-stage, already-staged or stale."""
    now = fingerprints(found).join(stored.withColumnRenamed("fingerprint", "before"), ["project_key", "filename"], "left")
    return now.withColumn("status", F.when(F.col("before").isNull(), "would-stage").when(F.col("before") == F.col("fingerprint"), "already-staged").otherwise("stale")).drop("before")
