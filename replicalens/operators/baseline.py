"""Baselines: what each side is known to have held; their bootstrap, reconciliation, rebuild and disappearance checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["project_key", "name"]


def bootstrap_split(local: DataFrame, hub: DataFrame) -> DataFrame:
    """project_key, name, part: both, local_only or hub_only."""
    joined = local.select(*KEY, F.lit(1).alias("l")).distinct().join(hub.select(*KEY, F.lit(1).alias("h")).distinct(), KEY, "full_outer")
    return joined.select(*KEY, F.when(F.col("h").isNull(), "local_only").when(F.col("l").isNull(), "hub_only").otherwise("both").alias("part"))


def bootstrap_baseline(split: DataFrame, ignored: DataFrame) -> DataFrame:
    """side, project_key, name of the first baselines: what a side has, without what is ignored."""
    kept = split.join(ignored.select(*KEY).distinct(), KEY, "left_anti")
    side = lambda s, parts: kept.where(F.col("part").isin(*parts)).select(F.lit(s).alias("side"), *KEY)
    return side("hub", ("both", "hub_only")).unionByName(side("local", ("both", "local_only")))


def reconciled(previous: DataFrame, present: DataFrame, tombstoned: DataFrame) -> DataFrame:
    """All that is present, and what was known, is gone and has no tombstone: it stays known."""
    gone = previous.select(*KEY).join(present.select(*KEY), KEY, "left_anti").join(tombstoned.select(*KEY), KEY, "left_anti")
    return present.select(*KEY).unionByName(gone).distinct()


def live_stems(files: DataFrame, tombstoned: DataFrame, initialized: DataFrame) -> DataFrame:
    """Names of initialized projects that have no tombstone."""
    inside = files.select(*KEY).distinct().join(initialized.select("project_key").distinct(), "project_key", "left_semi")
    return inside.join(tombstoned.select(*KEY), KEY, "left_anti")


def disappearance(known: DataFrame, present: DataFrame, least: int = 8, share: float = 0.6, project_least: int = 4) -> DataFrame:
    """project_key (null: all), known, missing and flagged: whether so much vanished that everything halts."""
    here = present.select(*KEY, F.lit(1).alias("here")).distinct()
    rows = known.select(*KEY).distinct().join(here, KEY, "left")
    n = rows.rollup("project_key").agg(F.count("*").alias("known"), F.count_if(F.col("here").isNull()).alias("missing"), F.grouping("project_key").alias("every"))
    enough = F.when(F.col("every") == 1, F.lit(least)).otherwise(F.lit(project_least))
    flagged = (F.col("known") >= enough) & (F.col("missing").cast("double") / F.col("known") >= F.lit(share))
    return n.where("known > 0").select("project_key", "known", "missing", flagged.alias("flagged"))


def anomalies(mounted: bool, stored: str | None, current: str | None, vanished: DataFrame) -> DataFrame:
    """code, severity of what must halt a plan; a missing mount is told alone."""
    spark = vanished.sparkSession
    schema = "code string, severity string"
    if not mounted:
        return spark.createDataFrame([("mount-missing", "halt")], schema)
    rows = [("hub-fingerprint-changed", "halt")] if stored and stored != current else []
    lost = vanished.where("flagged").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("known-sessions-vanished").alias("code"), F.lit("halt").alias("severity"))
    return spark.createDataFrame(rows, schema).unionByName(lost)


def fingerprint(names: DataFrame) -> DataFrame:
    """One row: the hub's fingerprint from its folder names, as a digest of their sorted JSON list."""
    quoted = F.transform(F.array_sort(F.collect_set("name")), lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"')))
    return names.agg(F.sha2(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), 256).alias("fingerprint"))
