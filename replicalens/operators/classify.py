"""Class of each session that both replicas have: one ordered CASE over features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shape
from .graph import classify_supersets
from .lineage import cut

S = shape.SESSION


def pair_features(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per session that is on both sides, with what the decision needs."""
    return shape.features(lines, files).where("here_local AND here_hub")


def classify(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """project_key, sid, klass, direction, metadata_differs."""
    f = cut(pair_features(lines, files))
    # The first rules; what they leave to the graph is marked by the direction it would take.
    early = (
        F.when(F.expr("has_bad_local OR has_bad_hub OR coalesce(torn_local, false) OR coalesce(torn_hub, false)"), "damaged")
        .when(F.expr("n_uuid_local = 0 OR n_uuid_hub = 0"), "needs-decision")
        .when(F.expr("coalesce(n_common, 0) = 0"), "identity-collision")
        .when(F.col("rewritten"), "damaged")
        .when(F.expr("n_roots_local > 1 OR n_roots_hub > 1"), "needs-decision")
        .when(F.expr("same AND active_tip_local <=> active_tip_hub"), "identical")
        .when(F.col("same"), "needs-decision")
        .when(F.expr("NOT local_in_hub AND NOT hub_in_local"), "fork")
    )
    f = f.withColumn("early", early).withColumn("to_hub", F.col("hub_in_local"))
    late = classify_supersets(lines, f.where(F.col("early").isNull()).select(*S, "to_hub"))
    done = f.join(late, S, "left").withColumn("klass", F.coalesce("early", "superset_class"))
    # Only what is a superset has a direction.
    direction = F.when(F.col("early").isNull(), F.when(F.col("to_hub"), "local->hub").otherwise("hub->local"))
    return done.select(*S, "klass", direction.alias("direction"), ((F.col("klass") == "identical") & ~F.col("same_full")).alias("metadata_differs"))
