"""Session profiles from lines(side, project_key, sid, idx, ok, uuid, parent, ts, type, ...).

All of it is set and group logic over one partitioning, (project_key, sid); the DataFrames stay lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import TITLE_TYPES, VOLATILE_TYPES
from .lineage import cut, replaced

SESSION = ["project_key", "sid"]
SIDED = ["side", *SESSION]


def volatile() -> Column:
    """Bookkeeping rows; a null type is none."""
    return F.coalesce(F.col("type").isin(*VOLATILE_TYPES), F.lit(False))


def has_uuid() -> Column:
    return F.coalesce(F.col("uuid"), F.lit("")) != ""


def title() -> Column:
    return F.coalesce(F.col("type").isin(*TITLE_TYPES), F.lit(False))


def conversation() -> Column:
    return has_uuid() & ~volatile()


def counts_for_compare() -> Column:
    return has_uuid() | ~volatile()


def identity() -> Column:
    """Two lines are the same if their uuid (null where empty) and their canonical hash are."""
    return F.struct(F.nullif(F.col("uuid"), F.lit("")).alias("uuid"), F.col("canon_hash").alias("hash"))


def multisets(lines: DataFrame) -> DataFrame:
    """project_key, sid, uuid, canon_hash with their number on either side, of all lines and of those that compare."""
    ok = lines.where("ok").withColumn("uuid", F.nullif(F.col("uuid"), F.lit(""))).withColumn("compares", counts_for_compare())
    on = lambda side, more=F.lit(True): F.count_if((F.col("side") == side) & more)
    return ok.groupBy(*SESSION, "uuid", "canon_hash").agg(
        on("local").alias("n_local"), on("hub").alias("n_hub"), on("local", F.col("compares")).alias("c_local"), on("hub", F.col("compares")).alias("c_hub")
    )


def inclusion(lines: DataFrame) -> DataFrame:
    """Per session: whether the compared multisets are equal or include one another, and whether the full ones are equal."""
    return multisets(lines).groupBy(*SESSION).agg(
        F.bool_and(F.expr("c_local = c_hub")).alias("same"), F.bool_and(F.expr("c_local <= c_hub")).alias("local_in_hub"),
        F.bool_and(F.expr("c_hub <= c_local")).alias("hub_in_local"), F.bool_and(F.expr("n_local = n_hub")).alias("same_full"),
    )


def uuid_hashes(lines: DataFrame) -> DataFrame:
    """Per uuid of a session: its hashes on either side."""
    of = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("canon_hash")))
    return lines.where(F.col("ok") & has_uuid()).groupBy(*SESSION, "uuid").agg(of("local").alias("h_local"), of("hub").alias("h_hub"))


def uuid_relations(lines: DataFrame) -> DataFrame:
    """Per session: common uuids, whether one was rewritten, and sides on which a uuid has two contents."""
    both = (F.size("h_local") > 0) & (F.size("h_hub") > 0)
    return uuid_hashes(lines).groupBy(*SESSION).agg(
        F.count_if(both).alias("n_common"), F.coalesce(F.bool_or(both & ~F.arrays_overlap("h_local", "h_hub")), F.lit(False)).alias("rewritten"),
        F.bool_or(F.size("h_local") > 1).alias("torn_local"), F.bool_or(F.size("h_hub") > 1).alias("torn_hub"),
    )


def roots(lines: DataFrame) -> DataFrame:
    """Rows with a uuid whose parent is null or not in their file; rows, not uuids, so a repeated one counts again."""
    ok = lines.where("ok")
    known = ok.where(has_uuid()).select(*SIDED, F.col("uuid").alias("parent")).distinct()
    return ok.where(has_uuid()).join(known, [*SIDED, "parent"], "left_anti").select(ok.columns)


def genuine_leaves(lines: DataFrame) -> DataFrame:
    """Conversation rows that no row names as parent, apart from side chains and tool results."""
    ok = lines.where("ok")
    used = ok.where(F.coalesce("parent", F.lit("")) != "").select(*SIDED, F.col("parent").alias("uuid")).distinct()
    return ok.where(conversation() & ~F.col("is_sidechain") & ~F.col("is_tool_fanout")).join(used, [*SIDED, "uuid"], "left_anti").select(ok.columns)


def active_tips(lines: DataFrame) -> DataFrame:
    """The leaf that the last cursor row of a file names."""
    cursors = lines.where(F.col("ok") & (F.col("type") == "last-prompt") & (F.coalesce("leaf_uuid", F.lit("")) != ""))
    return cursors.groupBy(*SIDED).agg(F.max_by("leaf_uuid", "idx").alias("active_tip"))


def newest_leaves(lines: DataFrame) -> DataFrame:
    """The genuine leaf with the greatest time, the first of equals; the last leaf where none has one."""
    order = W.partitionBy(*SIDED).orderBy(F.col("ts").desc_nulls_last(), F.when(F.col("ts").isNull(), -F.col("idx")).otherwise(F.col("idx")))
    return genuine_leaves(lines).withColumn("rank", F.row_number().over(order)).where("rank = 1").select(*SIDED, F.col("uuid").alias("newest_leaf"))


def unique_newest(leaves: DataFrame) -> DataFrame:
    """Per session: the leaf with the greatest time if all have one and it is the only one, else null."""
    top = leaves.groupBy(*SESSION).agg(F.count_if(F.col("ts").isNull()).alias("untimed"), F.max("ts").alias("ts"))
    at = leaves.join(top, [*SESSION, "ts"]).groupBy(*SESSION).agg(F.count("*").alias("n"), F.min("uuid").alias("uuid"))
    return top.join(at, SESSION, "left").select(*SESSION, F.when((F.col("untimed") == 0) & (F.col("n") == 1), F.col("uuid")).alias("tip"))


def session_meta(lines: DataFrame, files: DataFrame | None = None, tail: int = 20) -> DataFrame:
    """Per side and session: digests of all hashes and of the last ones in order, each followed by LF, and row counts.

    Digests are null where a line can't be read, a uuid has two contents or the file itself is damaged; files without
    lines have a row too.
    """
    named = F.col("ok") & has_uuid()
    row = F.struct("idx", "canon_hash", F.when(has_uuid(), F.col("uuid")).alias("uuid"))
    grouped = lines.groupBy(*SIDED).agg(F.array_sort(F.collect_list(F.when(F.col("ok"), row))).alias("rows"), F.bool_or(~F.col("ok")).alias("bad"), F.count_if("ok").alias("line_count"), F.count_if(named).alias("uuid_count"))
    if files is not None:
        grouped = files.select(*SIDED, (F.col("state") != "ok").alias("unread")).join(grouped, SIDED, "left")
        grouped = grouped.withColumn("bad", F.col("unread") | F.coalesce("bad", F.lit(False))).withColumn("rows", F.coalesce("rows", F.slice("rows", 1, 0), F.from_json(F.lit("[]"), lines.sparkSession.createDataFrame([], "rows array<struct<idx:int,canon_hash:string,uuid:string>>").schema["rows"].dataType)))
        grouped = grouped.fillna(0, ["line_count", "uuid_count"])
    of_uuid = lambda get: F.size(F.array_distinct(F.transform(F.filter("rows", lambda r: r["uuid"].isNotNull()), get)))
    torn = of_uuid(lambda r: r["uuid"]) < of_uuid(lambda r: F.struct(r["uuid"], r["canon_hash"]))
    digest = lambda x: F.sha2(F.array_join(F.transform(x, lambda r: F.concat(r["canon_hash"], F.lit("\n"))), ""), 256)
    last = F.slice("rows", F.greatest(F.size("rows") - tail + 1, F.lit(1)), F.lit(tail))
    whole = ~F.col("bad") & ~torn
    return grouped.select(*SIDED, F.when(whole, digest(F.col("rows"))).alias("content_hash"), F.when(whole, digest(last)).alias("tail_hash"), "line_count", "uuid_count", (F.col("line_count") - F.col("uuid_count")).alias("non_uuid_count"))


SIDES = ("local", "hub")


def features(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per session with all that the rules for pairs ask of it, from three groupings, each of the one before.

    For each side: here, has_bad, n_uuid, torn, n_roots (non-system roots) and active_tip; n_common, rewritten; same,
    local_in_hub, hub_in_local and same_full of the multisets. By line content first, then by uuid, where rows meet the
    rows that name them as parent, then by session.
    """
    key = [*SESSION, "uuid", "canon_hash"]
    rows = lines.withColumn("uuid", F.when(F.col("ok"), F.nullif(F.col("uuid"), F.lit("")))).withColumn("canon_hash", F.when(F.col("ok"), F.col("canon_hash")))
    rows = rows.withColumn("compares", F.col("ok") & counts_for_compare())
    cursor = F.col("ok") & (F.col("type") == "last-prompt") & (F.coalesce("leaf_uuid", F.lit("")) != "")
    at = lambda s, more: (F.col("side") == s) & more
    by_line = rows.groupBy(*key).agg(
        *[F.count_if(at(s, F.col("ok"))).alias(f"n_{s}") for s in SIDES], *[F.count_if(at(s, F.col("compares"))).alias(f"c_{s}") for s in SIDES],
        *[F.count_if(at(s, ~F.col("ok"))).alias(f"bad_{s}") for s in SIDES], *[F.max(F.when(at(s, cursor), F.struct("idx", "leaf_uuid"))).alias(f"tip_{s}") for s in SIDES],
        *[F.count_if(F.col("side") == s).alias(f"here_{s}") for s in SIDES],
    )
    counted = [f"{x}_{s}" for x in ("n", "c", "bad", "here") for s in SIDES]
    zero = F.lit(0).cast("long")
    none = lambda x: [F.lit(None).cast(x.schema[f"tip_{s}"].dataType).alias(f"tip_{s}") for s in SIDES]
    by_line = by_line.withColumns({f"child_{s}": zero for s in SIDES})
    # Rows that would be roots if their parent had no row: they are told to the parent.
    named = lines.where(F.col("ok") & has_uuid() & ~F.col("type").eqNullSafe("system"))
    told = named.select(*SESSION, F.col("parent").alias("uuid"), F.lit(None).cast("string").alias("canon_hash"), *[zero.alias(c) for c in counted], *none(by_line), *[(F.col("side") == s).cast("long").alias(f"child_{s}") for s in SIDES])
    every = by_line.unionByName(told)
    if files is not None:
        own = files.select(*SESSION, F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("string").alias("canon_hash"), *[zero.alias(c) for c in counted if c[:3] in ("n_l", "n_h", "c_l", "c_h")], *none(by_line), *[zero.alias(f"child_{s}") for s in SIDES], *[((F.col("side") == s) & (F.col("state") != "ok")).cast("long").alias(f"bad_{s}") for s in SIDES], *[(F.col("side") == s).cast("long").alias(f"here_{s}") for s in SIDES])
        every = every.unionByName(own)
    both = (F.col("n_local") > 0) & (F.col("n_hub") > 0)
    by_uuid = every.groupBy(*SESSION, "uuid").agg(
        *[F.sum(f"{x}_{s}").alias(f"{x}_{s}") for x in ("bad", "here", "child", "n") for s in SIDES], *[F.max(f"tip_{s}").alias(f"tip_{s}") for s in SIDES], *[F.count_if(F.col(f"n_{s}") > 0).alias(f"hashes_{s}") for s in SIDES],
        F.bool_or(both).alias("shared"), F.bool_and(F.expr("c_local = c_hub")).alias("same"), F.bool_and(F.expr("c_local <= c_hub")).alias("local_in_hub"), F.bool_and(F.expr("c_hub <= c_local")).alias("hub_in_local"), F.bool_and(F.expr("n_local = n_hub")).alias("same_full"),
    )
    named = F.col("uuid").isNotNull()
    known = {s: named & (F.col(f"n_{s}") > 0) for s in SIDES}
    return by_uuid.groupBy(*SESSION).agg(
        *[(F.sum(f"here_{s}") > 0).alias(f"here_{s}") for s in SIDES], *[(F.sum(f"bad_{s}") > 0).alias(f"has_bad_{s}") for s in SIDES], *[F.sum(F.when(named, F.col(f"n_{s}")).otherwise(0)).alias(f"n_uuid_{s}") for s in SIDES],
        *[F.bool_or(named & (F.col(f"hashes_{s}") > 1)).alias(f"torn_{s}") for s in SIDES], *[F.sum(F.when(known[s], 0).otherwise(F.col(f"child_{s}"))).alias(f"n_roots_{s}") for s in SIDES],
        *[F.max(f"tip_{s}")["leaf_uuid"].alias(f"active_tip_{s}") for s in SIDES], F.count_if(known["local"] & known["hub"]).alias("n_common"), F.bool_or(known["local"] & known["hub"] & ~F.col("shared")).alias("rewritten"),
        *[F.bool_and(x).alias(x) for x in ("same", "local_in_hub", "hub_in_local", "same_full")],
    )


def ancestors(lines: DataFrame, of: DataFrame) -> DataFrame:
    """(side, project_key, sid, uuid, ancestor) for the rows that of(side, project_key, sid, uuid) names, each its own ancestor first.

    Parents that no row has are reached and not left; of rows that share a uuid the last one's parent counts. Jumps double
    in each round, so a chain of n rows takes about log2 n joins, and only what is asked for is spread out.
    """
    named = lines.where(F.col("ok") & has_uuid())
    edges = named.groupBy(*SIDED, "uuid").agg(F.max_by("parent", "idx").alias("parent")).where(F.col("parent").isNotNull())
    jumps = cut(edges.select(*SIDED, F.col("uuid").alias("ancestor"), F.col("parent").alias("farther")))
    out = cut(of.select(*SIDED, "uuid", F.col("uuid").alias("ancestor")).distinct())
    n = out.count()
    while True:
        longer = out.join(jumps, [*SIDED, "ancestor"]).select(*SIDED, "uuid", F.col("farther").alias("ancestor"))
        out = replaced(out, out.unionByName(longer).distinct())
        before, n = n, out.count()
        if n == before:
            return out
        twice = jumps.select(*SIDED, F.col("ancestor").alias("farther"), F.col("farther").alias("next"))
        jumps = replaced(jumps, jumps.join(twice, [*SIDED, "farther"]).select(*SIDED, "ancestor", F.col("next").alias("farther")))
