"""One-way plans between two replicas: no baselines, only what a source can give a destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import collisions, sided

AUTO = ("transfer-copy", "transfer-ff")


def transfer_plan(presence: DataFrame, klass: DataFrame, tombs: DataFrame, source: str, sessions: DataFrame | None = None) -> DataFrame:
    """project_key, sid, action for what the source side has or a given list of sessions asks for."""
    dest = "hub" if source == "local" else "local"
    if sessions is not None:
        presence = presence.join(sessions.select(F.col("sid").alias("name")), "name", "left_semi")
    keys = ["project_key", "name"]
    p = sided(presence, keys, ["raw_sha256", "usable"]).withColumn("fold", F.lower("name"))
    p = p.join(collisions(presence, F.lower("name")), ["project_key", "fold"], "left").join(klass.withColumnRenamed("sid", "name"), keys, "left")
    t = tombs.groupBy("project_key", F.col("target").alias("name")).agg(F.bool_or("valid").alias("dead"), F.bool_or(~F.col("valid")).alias("unclear"), F.max(F.when(F.col("valid"), F.col("base_hash"))).alias("base_hash"))
    p = p.join(t, keys, "left").fillna(False, ["dead", "unclear"])
    forward = "local->hub" if source == "local" else "hub->local"
    action = F.expr(
        f"""CASE WHEN spellings > 1 THEN 'blocked-casefold-collision'
        WHEN dead AND base_hash IS NOT NULL AND (NOT on_local OR coalesce(raw_sha256_local = base_hash, false)) AND (NOT on_hub OR coalesce(raw_sha256_hub = base_hash, false)) THEN 'suppressed-deleted'
        WHEN dead THEN 'conflict-delete-vs-update'
        WHEN unclear THEN 'blocked-tombstone-corrupt'
        WHEN NOT on_{source} THEN 'source-absent'
        WHEN NOT on_{dest} THEN CASE WHEN coalesce(usable_{source}, false) THEN 'transfer-copy' ELSE 'blocked-damaged-source' END
        WHEN klass = 'identical' THEN 'identical'
        WHEN klass = 'fast-forward' AND direction = '{forward}' THEN 'transfer-ff'
        WHEN klass = 'fast-forward' THEN 'dest-newer'
        WHEN klass IN ('damaged', 'identity-collision') THEN concat('blocked-', klass)
        ELSE 'needs-decision' END"""
    )
    return p.select("project_key", F.col("name").alias("sid"), action.alias("action"))
