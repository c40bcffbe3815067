"""Health of a hub as tables: a row for each project, and the state of lock records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import collisions


def projects(sessions: DataFrame, covered: DataFrame, tombs: DataFrame, ledger: DataFrame) -> DataFrame:
    """project_key, sessions, initialized, tombstones, collisions, acks, problems for sessions(project_key, name)."""
    base = sessions.groupBy("project_key").agg(F.countDistinct("name").alias("sessions"))
    same = collisions(sessions, F.lower("name")).groupBy("project_key").agg(F.count("*").alias("collisions"))
    dead = tombs.where("valid").groupBy("project_key").agg(F.count("*").alias("tombstones"))
    acked = ledger.groupBy("project_key").agg(F.count("*").alias("acks"))
    flag = covered.select("project_key", F.lit(True).alias("initialized")).distinct()
    rows = base
    for t in (flag, dead, same, acked):
        rows = rows.join(t, "project_key", "left")
    rows = rows.fillna(False, ["initialized"]).fillna(0, ["tombstones", "collisions", "acks"])
    return rows.select("project_key", "sessions", "initialized", "tombstones", "collisions", "acks", (F.col("collisions") > 0).cast("int").alias("problems"))


def locks(records: DataFrame, host: str, live_pids: DataFrame) -> DataFrame:
    """path, status of lock records(path, host, pid): held, stale, foreign or unparseable."""
    alive = live_pids.select("pid", F.lit(True).alias("alive")).distinct()
    status = F.when(F.col("host").isNull() & F.col("pid").isNull(), "unparseable").when(~F.col("host").eqNullSafe(host), "foreign").when(F.col("alive"), "held").otherwise("stale")
    return records.join(alive, "pid", "left").select("path", status.alias("status"))


def map_targets(maps: DataFrame, safe: DataFrame, unsafe: DataFrame, fold) -> DataFrame:
    """local_dir, hub_dir, status for maps(local_dir, target): an exact folder, the only one of that name key, or a new one.

    safe and unsafe hold folder names; fold makes a name key of a column.
    """
    by = lambda t, c: t.withColumn("fold", fold(F.col("name"))).groupBy("fold").agg(F.count("*").alias(f"n_{c}"), F.min("name").alias(c))
    m = maps.withColumn("fold", fold(F.col("target"))).join(by(safe, "alias"), "fold", "left").join(by(unsafe, "shut"), "fold", "left")
    m = m.join(safe.select(F.col("name").alias("target"), F.lit(True).alias("exact")).distinct(), "target", "left")
    bad = ~F.col("target").rlike(r'\A[^<>:"/\\|?*\x00-\x1f]*[^<>:"/\\|?*\x00-\x1f. ]\z')
    status = F.when(bad, "skipped-bad-map").when(F.col("n_shut") > 0, "skipped-unsafe").when(F.col("exact"), "mapped").when(F.col("n_alias") > 1, "skipped-map-collision").otherwise("mapped")
    hub = F.when(status == "mapped", F.when(F.col("exact"), F.col("target")).otherwise(F.coalesce("alias", "target")))
    return m.select("local_dir", hub.alias("hub_dir"), status.alias("status"))
