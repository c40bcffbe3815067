"""Where iterative operators end their lineage: a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session on one machine may leave that unset."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints/replicalens"


def cut(df: DataFrame) -> DataFrame:
    """df, written below the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, cut; the table of old, a round's result that only new is made of, goes."""
    made = cut(new)
    for path in {f.rpartition("/")[0] for f in old.inputFiles()}:
        drop(old.sparkSession, path)
    return made


def drop(spark: SparkSession, path: str) -> None:
    """Through Spark's own file systems, as long as there is a session."""
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001 - at the end of the process the session may be gone; the folder then stays
        pass
