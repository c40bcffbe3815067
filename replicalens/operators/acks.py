"""What has been seen and set aside: acknowledgeable items of a plan, their fingerprints, and the view without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"blocked-casefold-collision": "casefold-collision", "damaged": "damaged", "blocked-damaged-source": "damaged", "identity-collision": "identity-collision"}


def items(plan: DataFrame, presence: DataFrame) -> DataFrame:
    """project_key, sid, kind, identity, fingerprint: colliding names are one item, others one each.

    A fingerprint covers both sides' raw digests, "-" for an absent file; it is null where a file couldn't be read, and
    such an item is never taken for acknowledged.
    """
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    p = plan.withColumn("kind", kinds[F.col("action")]).where(F.col("kind").isNotNull())
    one = lambda s: presence.where(F.col("side") == s).select("project_key", F.col("name").alias("sid"), F.lit(True).alias(f"on_{s}"), F.col("raw_sha256").alias(s))
    p = p.join(one("local"), ["project_key", "sid"], "left").join(one("hub"), ["project_key", "sid"], "left")
    part = lambda s: F.when(F.col(f"on_{s}").isNull(), "-").otherwise(F.col(s))
    p = p.withColumn("print", F.concat(F.lit("fs:"), F.sha2(F.concat(part("local"), F.lit("|"), part("hub")), 256)))
    p = p.withColumn("identity", F.when(F.col("kind") == "casefold-collision", F.lower("sid")).otherwise(F.col("sid")))
    group = p.groupBy("project_key", "kind", "identity").agg(F.array_sort(F.collect_list(F.struct("sid", "print"))).alias("all"), F.bool_or(F.col("print").isNull()).alias("unbound"))
    names, prints = F.array_join(F.transform("all", lambda x: x["sid"]), "\n"), F.array_join(F.transform("all", lambda x: x["print"]), "|")
    collided = F.concat(F.lit("cf:"), F.sha2(F.concat(names, F.lit("|"), prints), 256))
    mark = F.when(F.col("unbound"), None).when(F.col("kind") == "casefold-collision", collided).otherwise(F.col("all")[0]["print"])
    return group.select("project_key", "kind", "identity", mark.alias("fingerprint"), F.explode("all").alias("x")).select("project_key", "x.sid", "kind", "identity", "fingerprint")


def view(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """project_key, sid, hidden: a session is hidden only if every item that covers it is acknowledged as it is now."""
    known = ledger.select("project_key", "kind", "identity", "fingerprint").distinct().withColumn("acked", F.lit(True))
    joined = found.join(known, ["project_key", "kind", "identity", "fingerprint"], "left")  # a null fingerprint joins nothing
    return joined.groupBy("project_key", "sid").agg(F.bool_and(F.coalesce("acked", F.lit(False))).alias("hidden"))


def updated(ledger: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    keys = ["project_key", "kind", "identity", "fingerprint"]
    return ledger.select(*keys).unionByName(add.where(F.col("fingerprint").isNotNull()).select(*keys)).distinct().join(remove.select(*keys), keys, "left_anti")
