"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Each source's weight sets a target of words; the targets share ``share`` times all words, stop at ``most`` times the
source's words, and what is cut goes to the others by weight until none is above. Within a source the expected copies of a
document grow with its length: they are in proportion to the number of binary digits of its word count, at most ``most``,
and such that the expected words are the target. Their whole part is certain. The rest of the target is drawn: documents
rank by the odds of a uniform number made from their key and text, divided by the odds of their inclusion (what their
expected copies have beyond the whole ones), and the first of them whose words fill the rest are taken (a document counts
if its middle lies within). Odds depend on the source and on the number of digits only, so they come from a table with at
most 64 rows for each source.

The rank q lies near 1 where the limit falls, whatever the odds. Ranks are counted in BINS bins of q / (1 + q); bins before
the limit are taken whole, and only the bin in which it falls, about one in BINS of a source's rows, is ordered. Rows that
are equal in every column are one group there, cut by arithmetic. A source at its cap has no rest and is not ordered at all.

Defined cases: a null text has size 0 and takes 0; a null source is a source, last in order; a null key draws like any
other; rows that repeat a key draw by their texts, rows that repeat both by all their columns, and of equal rows as many are
taken as fit, so that reruns agree whatever the layout; sources without words have target 0; an empty table gives an empty
result; columns of the caller's table keep their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED, BINS, STEP = 1.5, 2.0, "mix-1", 1 << 16, 1 << 8
#: Equal rows of a cut group that are written as one row before they are repeated.
CHUNK = 4096


def word_count(column) -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(common.WORD)), F.lit(0)).cast("long")


def length_weight(size) -> F.Column:
    """The number of binary digits of a word count."""
    return F.length(F.bin(size)).cast("long")


def targets(sizes: DataFrame, folder: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for each source of sizes(source, size): shares by weight, filled up to the caps."""
    per = common.stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), f"{folder}/sources")
    by_name = F.col("source").asc_nulls_last()
    numbered = common.running(per, [by_name], f"{folder}/by-name", place=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight"))
    filled = common.running(ranked, [F.col("fill"), by_name], f"{folder}/by-fill", cap_before=F.col("cap"), weight_before=F.col("weight"))
    filled = common.stage(filled, f"{folder}/filled")
    whole = filled.agg((F.sum("source_size") * F.lit(float(share))).alias("total"), F.sum("weight").alias("weights")).first()
    # With every source before this one at its cap, this one and those after it share what is left at this level.
    level = (F.lit(whole["total"]).cast("double") - F.col("cap_before")) / (F.lit(whole["weights"]).cast("double") - F.col("weight_before"))
    # Levels rise along the order up to the first that fits and fall after it: the largest that fits is the common one.
    fit = filled.withColumn("level", level).where(F.col("level") <= F.col("fill")).agg(F.max("level")).first()[0]
    aim = F.coalesce(F.least(F.col("cap"), F.lit(fit).cast("double") * F.col("weight")), F.col("cap"))
    return filled.select("source", "source_size", aim.alias("target"))


def null_safe(source) -> F.Column:
    """A key that joins null sources too."""
    return F.struct(source.isNull().alias("n"), F.coalesce(source.cast("string"), F.lit("")).alias("s"))


def described(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc (all columns of docs(doc_id, source, text, ...)), size, digits, source_key, draw (a SHA-256) and row (of all columns)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text), 256)
    size = word_count(F.col("text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("doc"), size.alias("size"), length_weight(size).alias("digits"), null_safe(F.col("source")).alias("source_key"), draw.alias("draw"), F.xxhash64(*columns).alias("row"))


def odds(sizes: DataFrame, per: DataFrame, most: float = MOST) -> DataFrame:
    """source_key, digits, source_size, target, rest, whole and chance for each source and number of digits that occur.

    Expected copies are level x digits, at most ``most``; with all longer documents at that, the others share at one level.
    """
    strata = sizes.groupBy("source_key", "digits").agg(F.sum("size").alias("words"))
    per = per.select(null_safe(F.col("source")).alias("source_key"), "source_size", "target")
    longer = W.partitionBy("source_key").orderBy(F.desc("digits")).rowsBetween(W.unboundedPreceding, -1)
    shorter = W.partitionBy("source_key").orderBy(F.desc("digits")).rowsBetween(W.currentRow, W.unboundedFollowing)
    found = strata.join(per, "source_key").withColumn("capped", F.coalesce(F.sum("words").over(longer), F.lit(0))).withColumn("open", F.sum(F.col("words") * F.col("digits")).over(shorter))
    level = F.when(F.col("open") > 0, (F.col("target") - F.col("capped") * F.lit(float(most))) / F.col("open"))
    found = found.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("digits") <= F.lit(float(most)), F.col("level"))
    found = found.withColumn("fit", F.max(fits).over(W.partitionBy("source_key")))
    # A source at its cap takes every document as often as it may.
    full = (F.col("target") >= F.col("source_size") * F.lit(float(most))) | F.col("fit").isNull()
    expected = F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.greatest(F.col("fit"), F.lit(0.0)) * F.col("digits")))
    found = found.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("chance", F.col("expected") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source_key"))
    return found.withColumn("rest", rest).select("source_key", "digits", "source_size", "target", "rest", "whole", "chance")


def uniform(draw) -> F.Column:
    """A number in (0, 1) from the first 52 bits of a SHA-256 in hexadecimal digits."""
    return (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def ranked(rows: DataFrame, table: DataFrame, bins: int = BINS) -> DataFrame:
    """rows of described() with odds()'s columns, rank (q / (1 + q)) and bin; both are null where nothing is drawn."""
    u, p = uniform(F.col("draw")), F.col("chance")
    inside = u * (1 - p)
    found = common.joined(rows, table, ["source_key", "digits"], "left")
    found = found.withColumn("rank", F.when(p > 0, inside / (inside + (1 - u) * p)))
    return found.withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)).cast("int"))


def limits(found: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """source_key and cut_bin; and for each group of equal rows in that bin: times, how often it occurs, and drawn, of how many it is taken."""
    drawn = found.where(F.col("rank").isNotNull() & (F.col("rest") > 0))
    filled = common.stage(drawn.groupBy("source_key", "bin").agg(F.sum("size").alias("part"), F.first("rest").alias("rest")), f"{folder}/bins")

    def where_it_falls(parts: DataFrame, place: str) -> DataFrame:
        """source_key, and place and start of the part in which the limit falls; parts before it are taken whole, those after it not at all."""
        end = F.sum("part").over(W.partitionBy("source_key").orderBy(place))
        found = parts.withColumn("end", F.col("start") + end).withColumn("start", F.col("end") - F.col("part"))
        return found.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("end"))).groupBy("source_key").agg(F.min(place).alias(f"cut_{place}"), F.min_by("start", place).alias("cut_start"))

    # First among groups of STEP bins, then in the one found: few rows are ordered whatever the number of bins.
    coarse = filled.groupBy("source_key", F.floor(F.col("bin") / F.lit(STEP)).alias("group")).agg(F.sum("part").alias("part"), F.first("rest").alias("rest")).withColumn("start", F.lit(0).cast("long"))
    inside = common.joined(filled, where_it_falls(coarse, "group"), ["source_key"], "inner").where(F.floor(F.col("bin") / F.lit(STEP)) == F.col("cut_group"))
    cut = common.stage(where_it_falls(inside.withColumn("start", F.col("cut_start")).drop("cut_start"), "bin"), f"{folder}/cut")
    edge = common.joined(drawn, cut, ["source_key"], "inner").where(F.col("bin") == F.col("cut_bin"))
    edge = edge.groupBy("source_key", "rank", "draw", "size", "row").agg(F.count("*").alias("times"), F.first("rest").alias("rest"), F.first("cut_start").alias("cut_start"))
    before = W.partitionBy("source_key").orderBy("rank", "draw", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("cut_start") + F.coalesce(F.sum(F.col("times") * F.col("size")).over(before), F.lit(0))
    # Of a group's copies the first n are taken whose middles lie within.
    n = F.when(F.col("size") > 0, F.floor((2 * F.col("rest") - F.col("size") - 2 * before) / (2 * F.greatest(F.col("size"), F.lit(1)))) + 1).when(before <= F.col("rest"), F.col("times")).otherwise(F.lit(0))
    edge = edge.withColumn("drawn", F.least(F.greatest(n, F.lit(0)), F.col("times")).cast("long")).select("source_key", "draw", "row", "times", "drawn")
    return cut.select("source_key", "cut_bin"), common.stage(edge, f"{folder}/edge")


def sampled(found: DataFrame, cut: DataFrame, edge: DataFrame) -> DataFrame:
    """found's columns and copies, row by row; a group of equal rows of which some are drawn and some not is made anew."""
    rows = common.joined(found, cut, ["source_key"], "left")
    rows = common.joined(rows, edge, ["source_key", "draw", "row"], "left")
    within = F.col("rank").isNotNull() & (F.col("rest") > 0)
    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    whole_bin = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))
    taken = F.when(~within, 0).when(at_cut, (F.col("drawn") > 0).cast("int")).otherwise(whole_bin.cast("int"))
    parts = (F.col("drawn") > 0) & (F.col("drawn") < F.col("times"))
    split = within & at_cut & parts
    names = [c for c in found.columns if c != "copies"]
    if edge.where(parts).isEmpty():
        return rows.select(*names, (F.col("whole") + taken).cast("long").alias("copies"))
    alike = rows.where(~F.coalesce(split, F.lit(False))).select(*names, (F.col("whole") + taken).cast("long").alias("copies"))
    group = rows.where(split).groupBy("source_key", "draw", "row").agg(F.first(F.struct(*names, "drawn", "times")).alias("x")).select("x.*")
    kinds = F.array(F.struct(F.col("drawn").alias("n"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("times") - F.col("drawn")).alias("n"), F.col("whole").alias("copies")))
    chunks = group.withColumn("k", F.explode(kinds)).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k.n") - 1, F.lit(CHUNK).cast("long"))))
    chunks = chunks.repartition(F.col("first"))
    again = chunks.withColumn("one", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("k.n")) - 1)))
    return alike.unionByName(again.select(*names, F.col("k.copies").cast("long").alias("copies")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """doc, size, source_size, target, whole, chance and copies for each row of docs(doc_id, source, text, ...)."""
    folder = common.new_folder(docs.sparkSession, "mixing")
    rows = described(docs, seed)
    sizes = common.stage(rows.select(F.col("doc.source").alias("source"), "source_key", "size", "digits", "draw", "row"), f"{folder}/sizes")
    table = common.stage(odds(sizes, targets(sizes, folder, weights, share, most), most), f"{folder}/odds")
    cut, edge = limits(ranked(sizes, table, bins), folder)
    return sampled(ranked(rows, table, bins), cut, edge).select("doc", "size", "source_size", "target", "whole", "chance", "copies")


def op7(spark, sf_dir: str) -> DataFrame:
    mixed = mix(common.in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM per),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM levels WHERE level <= cap / weight) * weight), cap) AS target FROM levels),
classed AS (SELECT *, length(bin(size)) AS digits FROM sized),
strata AS (SELECT source, digits, sum(size)::BIGINT AS words FROM classed GROUP BY source, digits),
open AS (
  SELECT s.source, s.digits, s.words, a.source_size, a.target, coalesce(sum(s.words) OVER b, 0)::DOUBLE AS capped, (sum(s.words * s.digits) OVER r)::DOUBLE AS open
  FROM strata s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
  WINDOW b AS (PARTITION BY s.source ORDER BY s.digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (PARTITION BY s.source ORDER BY s.digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fitted AS (
  SELECT *, max(CASE WHEN level * digits <= 2.0 THEN level END) OVER (PARTITION BY source) AS fit
  FROM (SELECT *, CASE WHEN open > 0 THEN (target - capped * 2.0::DOUBLE) / open END AS level FROM open)),
expected AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN target >= source_size * 2.0::DOUBLE OR fit IS NULL THEN 2.0::DOUBLE
            ELSE least(2.0::DOUBLE, greatest(fit, 0.0::DOUBLE) * digits) END AS expected FROM fitted),
odds AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS chance, target - sum(floor(expected)::BIGINT * words) OVER (PARTITION BY source) AS rest FROM expected),
drawn AS (
  SELECT c.doc_id, c.source, c.size, c.text, o.source_size, o.target, o.whole, o.chance, o.rest, sha256('mix-1:' || coalesce(c.doc_id::VARCHAR, 'null') || ':' || coalesce(c.text, '')) AS draw
  FROM classed c JOIN odds o ON c.source IS NOT DISTINCT FROM o.source AND c.digits = o.digits),
numbers AS (SELECT *, (('0x' || substr(draw, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM drawn),
ranks AS (
  SELECT *, CASE WHEN chance > 0 AND rest > 0 THEN (u * (1.0::DOUBLE - chance)) / (u * (1.0::DOUBLE - chance) + (1.0::DOUBLE - u) * chance) END AS rank FROM numbers),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranks)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
"""


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    times = mix(docs, weights, share, most, seed).where(F.col("copies") > 0)
    return times.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*").select(*[F.col(f"`{c}`") for c in docs.columns])
