"""Lossless ordered union of two branches of a session: windows and joins, no code of ours per row.

The result does not depend on which side is called local: the parts after the common prefix are ordered by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shape
from .lineage import cut

S = shape.SESSION


def content(lines: DataFrame) -> DataFrame:
    """Rows that a union carries over, numbered from 0 on their side; bookkeeping is left out even with a uuid."""
    rows = lines.where(F.col("ok") & ~shape.volatile()).withColumn("uuid", F.nullif(F.col("uuid"), F.lit("")))
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(*shape.SIDED).orderBy("idx")) - 1)


def common_prefix(lines: DataFrame) -> DataFrame:
    """project_key, sid, k: how many rows from the start are the same on both sides."""
    c = content(lines)
    side = lambda s: c.where(F.col("side") == s).select(*S, "pos", shape.identity().alias(f"id_{s}"))
    both = side("local").join(side("hub"), [*S, "pos"], "full_outer")
    differ = F.min(F.when(~F.col("id_local").eqNullSafe(F.col("id_hub")), F.col("pos")))
    return both.groupBy(*S).agg(F.coalesce(differ, F.count("*")).cast("int").alias("k"))


def ordered(lines: DataFrame) -> DataFrame:
    """project_key, sid, pos and the rows of each session's union.

    The prefix once, then both rests, the smaller list of identities first; a uuid stays where it first stands, rows
    without one always stay.
    """
    c = content(lines).join(common_prefix(lines), S)
    rest = c.where("pos >= k")
    keyed = F.struct("pos", F.coalesce("uuid", F.lit("")).alias("u"), F.coalesce("canon_hash", F.lit("")).alias("h"))
    lists = rest.groupBy(*shape.SIDED).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: F.struct(x["u"], x["h"])).alias("ids"))
    # Two rests that are equal would both be empty, so the order of sides never decides.
    places = lists.withColumn("seg", F.row_number().over(W.partitionBy(*S).orderBy("ids", "side"))).select(*shape.SIDED, "seg")
    prefix = c.where("pos < k AND side = 'local'").withColumn("seg", F.lit(0))
    every = prefix.unionByName(rest.join(places, shape.SIDED))
    first = F.row_number().over(W.partitionBy(*S, "uuid").orderBy("seg", "pos"))
    kept = every.withColumn("nth", F.when(F.col("uuid").isNull(), 1).otherwise(first)).where("nth = 1")
    return kept.withColumn("pos", F.row_number().over(W.partitionBy(*S).orderBy("seg", "pos")) - 1).drop("seg", "nth", "k", "side")


def union_features(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Per session of a union's rows: orphan, n_roots, n_leaves, tip, winds, from groupings by uuid and by session.

    orphan: a row's parent is a bookkeeping row that the union leaves out. winds: a row stands before its parent, without
    which no path can come back.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    leaf = ~F.col("is_sidechain") & ~F.col("is_tool_fanout")
    own = rows.where(F.col("uuid").isNotNull()).select(*S, "uuid", F.col("pos").alias("at"), F.when(leaf, F.struct(F.col("ts").isNotNull().alias("timed"), "ts")).alias("leaf"), nothing("int").alias("child_at"), F.lit(0).alias("child"), F.lit(False).alias("left_out"))
    top = (F.col("uuid").isNotNull() & ~F.col("type").eqNullSafe("system")).cast("int")
    told = rows.select(*S, F.col("parent").alias("uuid"), nothing("int").alias("at"), nothing(own.schema["leaf"].dataType).alias("leaf"), F.when(F.col("uuid").isNotNull(), F.col("pos")).alias("child_at"), top.alias("child"), F.lit(False).alias("left_out"))
    out = lines.where(F.col("ok") & shape.volatile() & shape.has_uuid()).select(*S, "uuid", nothing("int").alias("at"), nothing(own.schema["leaf"].dataType).alias("leaf"), nothing("int").alias("child_at"), F.lit(0).alias("child"), F.lit(True).alias("left_out"))
    # A row that only tells of its parent counts as a use of it, whether or not it has a uuid.
    told = told.withColumn("used", F.lit(True))
    every = told.unionByName(own.withColumn("used", F.lit(False))).unionByName(out.withColumn("used", F.lit(False)))
    by_uuid = every.groupBy(*S, "uuid").agg(F.max("at").alias("at"), F.max("leaf").alias("leaf"), F.min("child_at").alias("child_at"), F.sum("child").alias("child"), F.bool_or("left_out").alias("left_out"), F.bool_or("used").alias("used"))
    there = F.col("uuid").isNotNull() & F.col("at").isNotNull()
    is_leaf = there & F.col("leaf").isNotNull() & ~F.col("used")
    # By time first, so that the newest leaves and their number come out of sums.
    by_time = by_uuid.groupBy(*S, F.when(is_leaf, F.col("leaf")).alias("leaf")).agg(
        F.count_if(is_leaf).alias("n"), F.min(F.when(is_leaf, F.col("uuid"))).alias("first"), F.sum(F.when(there, 0).otherwise(F.col("child"))).alias("n_roots"),
        F.bool_or(~there & F.col("uuid").isNotNull() & F.col("left_out") & F.col("used")).alias("orphan"), F.bool_or(there & F.coalesce(F.col("child_at") <= F.col("at"), F.lit(False))).alias("winds"),
    )
    newest = F.max(F.when(F.col("leaf").isNotNull(), F.struct("leaf", "n", "first")))
    found = by_time.groupBy(*S).agg(F.sum("n").alias("n_leaves"), F.sum("n_roots").alias("n_roots"), F.bool_or("orphan").alias("orphan"), F.bool_or("winds").alias("winds"), newest.alias("top"), F.count_if(F.col("leaf.timed") == False).alias("untimed"))  # noqa: E712
    alone = (F.col("untimed") == 0) & (F.col("top.n") == 1)
    return found.select(*S, "orphan", "n_roots", "n_leaves", F.when(alone, F.col("top.first")).alias("tip"), "winds")


def outcomes(lines: DataFrame, chosen: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """project_key, sid, outcome (merged, fallback or needs-decision) and tip of each session that both sides have.

    A session whose side has a file without lines is only known by files(side, project_key, sid, state).
    """
    pair = shape.features(lines, files).where("here_local AND here_hub").select(*S, F.expr("has_bad_local OR has_bad_hub OR n_uuid_local = 0 OR n_uuid_hub = 0 OR n_common = 0 OR rewritten OR torn_local OR torn_hub").alias("apart"))
    rows = cut(ordered(lines))
    f = pair.join(cut(union_features(rows, lines)), S, "left")
    f = f.join(_cyclic(rows, f.where("winds AND NOT apart")), S, "left")
    if chosen is not None:
        leaves = shape.genuine_leaves(rows.withColumn("side", F.lit("union")).withColumn("idx", F.col("pos")))
        picked = chosen.join(leaves.select(*S, F.col("uuid").alias("chosen_tip")).distinct(), [*S, "chosen_tip"], "left_semi").select(*S, F.col("chosen_tip").alias("picked"))
        f = f.join(chosen.select(*S, F.lit(True).alias("asked")), S, "left").join(picked, S, "left").withColumn("tip", F.when(F.col("asked"), F.col("picked")).otherwise(F.col("tip")))
    unable = F.expr("apart OR coalesce(orphan, false) OR coalesce(n_roots, 0) > 1 OR coalesce(n_leaves, 0) = 0 OR coalesce(cyclic, false)")
    outcome = F.when(unable, "fallback").when(F.col("tip").isNull(), "needs-decision").otherwise("merged")
    return f.select(*S, outcome.alias("outcome"), F.when(outcome == "merged", F.col("tip")).alias("tip"))


def _cyclic(rows: DataFrame, which: DataFrame) -> DataFrame:
    """Of which(project_key, sid), the sessions whose parents lead back to where they started."""
    import pandas as pd

    from .graph import Side

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        side = Side([])
        side.parent = {u: None if pd.isna(p) else p for u, p in zip(frame["uuid"], frame["parent"], strict=True)}
        return pd.DataFrame({"project_key": frame["project_key"][:1], "sid": frame["sid"][:1], "cyclic": [side.cyclic()]})

    edges = rows.where(F.col("uuid").isNotNull()).select(*S, "uuid", "parent").join(which.select(*S), S, "left_semi")
    return edges.groupBy(*S).applyInPandas(walk, "project_key string, sid string, cyclic boolean")


def with_cursor(rows: DataFrame, tips: DataFrame, cursor_json) -> DataFrame:
    """Union rows and a fresh cursor row at the end of each merged session; cursor_json makes its text from tip and session_id."""
    end = rows.groupBy(*S).agg((F.max("pos") + 1).alias("pos"))
    leaf = rows.select(*S, F.col("uuid").alias("tip"), "session_id")
    cursor = tips.where("outcome = 'merged'").join(end, S).join(leaf, [*S, "tip"]).select(*S, "pos", cursor_json(F.col("tip"), F.col("session_id")).alias("raw"))
    return rows.select(*S, "pos", "raw").unionByName(cursor)
