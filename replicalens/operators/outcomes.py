"""What comes of a plan when it is made again at the time of writing: an outcome for every planned key.

Nothing is written here. A plan made before is joined with one made now and with both times' snapshots; only what hasn't
changed may be published, by whoever owns the folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import snapshot_drift

# What an unchanged action results in.
RESULTS = {"identical": "identical", "copy-to-hub": "copied-to-hub", "copy-to-local": "copied-to-local", "local-deleted": "tombstoned-local-deletion"}
WROTE = ("applied-ff-hub", "copied-to-hub", "copied-to-local", "kept-both-local", "tombstoned-local-deletion")


def apply_outcomes(before: DataFrame, now: DataFrame, snapshot_before: DataFrame, snapshot_now: DataFrame, authorized: DataFrame | None = None) -> DataFrame:
    """project_key, sid, action, result. authorized(project_key, allowed): false forbids writing, null leaves it to the plan."""
    keys = ["project_key", "sid"]
    current = now.select(*keys, F.col("action").alias("now_action"), F.col("direction").alias("now_direction"))
    drift = snapshot_drift(snapshot_before, snapshot_now, keys)
    rows = before.join(current, keys, "left").join(drift, keys, "left")
    rows = rows.join(authorized, "project_key", "left") if authorized is not None else rows.withColumn("allowed", F.lit(None).cast("boolean"))
    plain = F.create_map(*[F.lit(x) for pair in RESULTS.items() for x in pair])
    done = F.when(F.col("action") == "fast-forward", F.when(F.col("direction") == "local->hub", "applied-ff-hub").otherwise("kept-both-local")).otherwise(plain[F.col("action")])
    result = (
        F.when(done.isNull(), "reported")
        .when(F.expr("now_action = 'suppressed-deleted' AND action <> 'suppressed-deleted'"), "suppressed")
        .when(F.expr("now_action = 'conflict-delete-vs-update'"), "reported")
        .when(F.expr("coalesce(drifted, true) OR NOT (now_action <=> action) OR NOT (now_direction <=> direction)"), "skipped-changed")
        .when(F.expr("allowed = false"), "skipped-changed")
        .otherwise(done)
    )
    return rows.select(*keys, "action", result.alias("result"))


def _as_planned(rows: DataFrame, result) -> DataFrame:
    """result where now_action is still action; else what has come up: a deletion holds, a conflict over one is told."""
    return rows.withColumn("result", F.when(F.col("now_action").eqNullSafe(F.col("action")), result).when(F.col("now_action") == "suppressed-deleted", "suppressed").when(F.col("now_action") == "conflict-delete-vs-update", "reported").otherwise("skipped-changed"))


def memory_outcomes(plan: DataFrame, now: DataFrame, after: DataFrame, projects: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """project_key, name, action, result of a memory plan, in two phases.

    Deletions are judged by the plan made now; all else by the one made after their markers were written, as a marker can
    turn a copy into a return of what was deleted. projects(project_key, initialized, allowed); links(project_key, name)
    are documents that are links on either side, of which nothing is taken for granted.
    """
    keys = ["project_key", "name"]
    first = plan.where("action = 'local-deleted'").join(now.select(*keys, F.col("action").alias("now_action")), keys, "left")
    second = plan.where("action <> 'local-deleted'").join(after.select(*keys, F.col("action").alias("now_action")), keys, "left")
    rows = first.unionByName(second).select(*keys, "action", "now_action")
    rows = rows.join(projects.select("project_key", "initialized", "allowed"), "project_key", "left")
    linked = links.select(*keys, F.lit(True).alias("linked")).distinct() if links is not None else rows.select(*keys, F.lit(True).alias("linked")).limit(0)
    rows = rows.join(linked, keys, "left")
    done = F.create_map(*[F.lit(x) for pair in RESULTS.items() for x in pair])[F.col("action")]
    rows = _as_planned(rows, done)
    result = F.when(done.isNull(), "reported").when(~F.coalesce("initialized", F.lit(False)), "blocked-uninitialized").when(F.expr("allowed = false OR linked"), "skipped-changed").otherwise(F.col("result"))
    return rows.select(*keys, "action", result.alias("result"))


def transfer_outcomes(plan: DataFrame, now: DataFrame, source: str, arrived: DataFrame | None = None) -> DataFrame:
    """project_key, sid, action, result of a transfer from the source side; arrived(project_key, sid) came up at the destination meanwhile.

    What goes to the local side never replaces a file; what goes to a hub may.
    """
    keys = ["project_key", "sid"]
    rows = plan.join(now.select(*keys, F.col("action").alias("now_action")), keys, "left")
    here = arrived.select(*keys, F.lit(True).alias("there")).distinct() if arrived is not None else rows.select(*keys, F.lit(True).alias("there")).limit(0)
    rows = rows.join(here, keys, "left")
    if source == "hub":
        done = F.when((F.col("action") == "transfer-copy") & F.col("there").isNull(), "copied-to-local").otherwise("kept-both-local")
    else:
        done = F.when(F.col("action") == "transfer-copy", "copied-to-remote").otherwise("applied-ff-remote")
    result = F.when(~F.col("action").isin("transfer-copy", "transfer-ff"), "reported").when(F.col("now_action").eqNullSafe(F.col("action")), done).otherwise("skipped-changed")
    return rows.select(*keys, "action", result.alias("result"))


def flags(outcomes: DataFrame) -> DataFrame:
    """wrote_anything, had_error of a run."""
    return outcomes.agg(F.coalesce(F.bool_or(F.col("result").isin(*WROTE)), F.lit(False)).alias("wrote_anything"), F.coalesce(F.bool_or(F.col("result") == "error"), F.lit(False)).alias("had_error"))


def authorized(dirs: DataFrame, asserted: DataFrame, bindings: DataFrame, dir_bindings: DataFrame) -> DataFrame:
    """local_dir, project_key, allowed: whether what is recorded now still pairs them; null where nothing is recorded.

    dirs(local_dir, project_key, cwds, n_files); asserted(local_dir); bindings(cwd, bound); dir_bindings(local_dir, bound).
    """
    d = dirs.join(asserted.select("local_dir", F.lit(True).alias("claimed")).distinct(), "local_dir", "left")
    d = d.withColumn("cwd", F.when(F.size("cwds") == 1, F.col("cwds")[0]))
    d = d.join(bindings.select("cwd", F.col("bound").alias("by_cwd")), "cwd", "left").join(dir_bindings.select("local_dir", F.col("bound").alias("by_dir")), "local_dir", "left")
    allowed = (
        F.when(F.col("claimed") & (F.coalesce("by_dir", F.lit("")) != ""), F.col("by_dir") == F.col("project_key"))
        .when(F.size("cwds") == 1, F.col("by_cwd") == F.col("project_key"))
        .when((F.size("cwds") == 0) & (F.col("n_files") == 0), F.col("by_dir") == F.col("project_key"))
        .when(F.coalesce("by_dir", F.lit("")) != "", F.lit(False))
    )
    return d.select("local_dir", "project_key", allowed.alias("allowed"))


def resolved(decisions: DataFrame, unions: DataFrame) -> DataFrame:
    """project_key, sid, result for decisions(project_key, sid, choice) on forks, by the outcomes of their unions."""
    rows = decisions.join(unions, ["project_key", "sid"], "left")
    result = F.when(F.col("choice") == "skip", "skipped").when(F.col("choice") == "keep-both", "kept-both-local").when(F.col("outcome") == "merged", "merged").when(F.col("outcome") == "needs-decision", "needs-decision").otherwise("fallback")
    return rows.select("project_key", "sid", result.alias("result"))
