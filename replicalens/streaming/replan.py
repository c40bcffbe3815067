"""Re-plans sessions as their lines arrive. An extension of ours: the tool this engine follows works in batches only.

Lines are appended to a table; each micro-batch reads back the touched sessions whole and replaces their classes, so a
batch that runs again gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import classify

KEY = ["side", "project_key", "sid", "idx"]


def start(lines: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """lines is a stream with shape's columns; <folder>/classes/batch=<n> gets the classes that batch n touched."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/lines/batch={n}")
        known = spark.read.parquet(f"{folder}/lines").where(F.col("batch") <= n)
        touched = batch.select("project_key", "sid").distinct()
        rows = known.drop("batch").join(touched, ["project_key", "sid"], "left_semi").dropDuplicates(KEY)
        classify(rows).write.mode("overwrite").parquet(f"{folder}/classes/batch={n}")

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark, folder: str) -> DataFrame:
    """project_key, sid and the class of each session's last batch."""
    rows = spark.read.parquet(f"{folder}/classes")
    return rows.groupBy("project_key", "sid").agg(F.max_by(F.struct("klass", "direction", "metadata_differs"), "batch").alias("x")).select("project_key", "sid", "x.*")
