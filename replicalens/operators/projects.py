"""Which hub project a local folder belongs to: given maps first, then bound folders, then shared git remotes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T


@F.pandas_udf(StringType())
def normalized_remote(urls: pd.Series) -> pd.Series:
    return urls.map(T.remote, na_action="ignore")


def remote_matches(local: DataFrame, hub: DataFrame, local_commits: DataFrame | None = None, hub_commits: DataFrame | None = None) -> DataFrame:
    """local_dir, status, hub_dir by dirs' remotes(dir, url): exactly one hub folder with a common remote matches.

    Without one, a hub folder with another remote but the same first commit, by commits(dir, first_commit), is a fork or a
    renamed repository: ambiguous.
    """
    side = lambda t, n: t.select(F.col("dir").alias(n), normalized_remote("url").alias("remote")).where(F.col("remote").isNotNull()).distinct()
    met = side(local, "local_dir").join(side(hub, "hub_dir"), "remote").groupBy("local_dir").agg(F.countDistinct("hub_dir").alias("n"), F.min("hub_dir").alias("hub_dir"))
    rows = local.select(F.col("dir").alias("local_dir")).distinct().join(met, "local_dir", "left").withColumn("kin", F.lit(False))
    if local_commits is not None and hub_commits is not None:
        root = lambda t, n: t.where("first_commit IS NOT NULL").select(F.col("dir").alias(n), "first_commit").distinct()
        with_remote = hub_commits.join(side(hub, "dir").select("dir").distinct(), "dir", "left_semi")
        kin = root(local_commits, "local_dir").join(root(with_remote, "other"), "first_commit").select("local_dir", F.lit(True).alias("kin")).distinct()
        rows = rows.drop("kin").join(kin, "local_dir", "left")
    status = F.when(F.col("n") == 1, "match").when((F.col("n") > 1) | F.col("kin"), "ambiguous").otherwise("needs-map")
    return rows.select("local_dir", status.alias("status"), F.when(F.col("n") == 1, F.col("hub_dir")).alias("hub_dir"))


def statuses(local: DataFrame, hub: DataFrame, matches: DataFrame, other: str = "hub-only") -> DataFrame:
    """local_dir, hub_dir, status of every folder of either side: local(dir, safe), hub(dir, safe), matches of the safe ones.

    Unsafe folders are told, not read; folders of the other side that nothing matches are told by ``other`` (hub-only, or
    remote-only of a transfer).
    """
    none = F.lit(None).cast("string")
    unsafe = lambda t, mine: t.where("NOT safe").select(*[(F.col("dir") if k == mine else none).alias(k) for k in ("local_dir", "hub_dir")], F.lit("skipped-unsafe").alias("status"))
    found = local.where("safe").select(F.col("dir").alias("local_dir")).join(matches, "local_dir", "left").select("local_dir", F.when(F.col("status") == "match", F.col("hub_dir")).alias("hub_dir"), F.coalesce("status", F.lit("needs-map")).alias("status"))
    alone = hub.where("safe").select(F.col("dir").alias("hub_dir")).join(matches.where("hub_dir IS NOT NULL"), "hub_dir", "left_anti").select(none.alias("local_dir"), "hub_dir", F.lit(other).alias("status"))
    return unsafe(local, "local_dir").unionByName(unsafe(hub, "hub_dir")).unionByName(found).unionByName(alone)


def distinct_targets(pairs: DataFrame) -> DataFrame:
    """pairs(local_dir, hub_key, cwd, status) with the status of mapped ones that share a real hub folder, or else a working folder."""
    mapped = pairs.where("status = 'mapped'")
    twice = lambda k: mapped.where(F.col(k).isNotNull()).groupBy(k).agg((F.count("*") > 1).alias(f"twice_{k}"))
    rows = pairs.join(twice("hub_key"), "hub_key", "left").join(twice("cwd"), "cwd", "left")
    status = F.when(F.col("status") != "mapped", F.col("status")).when(F.col("twice_hub_key"), "skipped-dup-key").when(F.col("twice_cwd"), "skipped-dup-cwd").otherwise(F.col("status"))
    return rows.select("local_dir", "hub_key", "cwd", status.alias("status"))


def bootstrap_statuses(dirs: DataFrame) -> DataFrame:
    """local_dir, hub_key, cwd, status of dirs(local_dir, hub_key, cwds, asserted, map_status, match_status, safe, readable).

    A given map counts before a match; a folder with several working folders needs one that was asserted.
    """
    by_match = F.when(F.col("match_status") == "match", "mapped").otherwise(F.concat(F.lit("skipped-"), F.coalesce("match_status", F.lit("needs-map"))))
    found = F.coalesce("map_status", by_match)
    several = (F.size("cwds") > 1) & ~F.col("asserted")
    status = F.when(~F.col("safe"), "skipped-unsafe").when((found == "mapped") & several, "skipped-multi-cwd").when(~F.col("readable"), "skipped-unreadable").otherwise(found)
    rows = dirs.select("local_dir", "hub_key", F.when(F.size("cwds") == 1, F.col("cwds")[0]).alias("cwd"), status.alias("status"))
    return distinct_targets(rows)


def bound_first(dirs: DataFrame, asserted: DataFrame, by_cwd: DataFrame, empty_bound: DataFrame, fallback: DataFrame) -> DataFrame:
    """local_dir, status, hub_dir: asserted folders, then the binding of a folder's only cwd, then that of an empty folder, then the rest.

    dirs(local_dir, cwds); asserted and empty_bound(local_dir, hub_dir); by_cwd(cwd, hub_dir); fallback from remote_matches.
    """
    rename = lambda t, n, k: t.select(k, F.col("hub_dir").alias(n))
    d = dirs.withColumn("cwd", F.when(F.size("cwds") == 1, F.col("cwds")[0]))
    d = d.join(rename(asserted, "h1", "local_dir"), "local_dir", "left").join(rename(by_cwd, "h2", "cwd"), "cwd", "left").join(rename(empty_bound, "h3", "local_dir"), "local_dir", "left")
    d = d.join(fallback.select("local_dir", F.col("status").alias("s4"), F.col("hub_dir").alias("h4")), "local_dir", "left")
    bound = F.coalesce("h1", "h2", F.when(F.size("cwds") == 0, F.col("h3")))
    status = F.when(F.col("h1").isNotNull(), "match").when(F.size("cwds") > 1, "blocked-multi-cwd").when(bound.isNotNull(), "match").otherwise(F.coalesce("s4", F.lit("needs-map")))
    d = d.withColumn("status", status).withColumn("hub_dir", F.when(F.col("status") == "match", F.coalesce(bound, F.col("h4"))))
    twice = d.where(F.col("hub_dir").isNotNull()).groupBy("hub_dir").agg(F.count("*").alias("times"))
    d = d.join(twice, "hub_dir", "left")
    return d.select("local_dir", F.when(F.col("times") > 1, "blocked-dup-local").otherwise(F.col("status")).alias("status"), "hub_dir")
