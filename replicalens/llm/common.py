"""Shared storage, tokens and small numeric helpers of the operators in this subpackage."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words in every contract of this subpackage; Java and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast below this many bytes, judged by its weighed rows; above it the join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; only a session on one machine may leave that unset."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints/replicalens"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root; it goes when the driver's Python ends, or by drop_folder."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, path)
    return path


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """Python workers have no Hadoop file systems; Arrow's have other names for some of the same stores."""
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def drop_folder(uri: str) -> None:
    try:
        system, path = open_fs(uri)
        system.delete_dir(path)
    except (OSError, ValueError):
        pass


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet below the shared root and reads it again: its lineage ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(uri: str, data: bytes) -> None:
    """All or nothing, under a temporary name first. A repeated attempt puts the same bytes there."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temp, compression=None) as out:
        out.write(data)
    system.move(temp, path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts can weigh; only ever lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def running(rows: DataFrame, order: list, path: str, **sums) -> DataFrame:
    """rows with the sums over all rows before each in a total order; parts of the order are added up side by side."""
    parted = stage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), path)
    before = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # A row for each part: as many as there are shuffle partitions.
    whole = parted.groupBy("__part").agg(*[F.sum(x).alias(f"__{n}") for n, x in sums.items()])
    parts = whole.select("__part", *[F.coalesce(F.sum(f"__{n}").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__{n}") for n in sums])
    found = parted.join(F.broadcast(parts), "__part")
    return found.select(*rows.columns, *[(F.col(f"__{n}") + F.coalesce(F.sum(x).over(before), F.lit(0))).alias(n) for n, x in sums.items()])


def _weight(value, kind: T.DataType):
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 24
    if isinstance(kind, T.StructType):
        return sum((_weight(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda total, x: total + _weight(x, kind.elementType)), F.lit(24).cast("long"))
    return F.lit(8).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, weighed one by one, are below the limit."""
    total = df.select(sum((_weight(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long")).alias("w")).agg(F.sum("w")).first()[0]
    return (total or 0) < limit


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """left join right, with right broadcast if its weighed rows are small; else Spark shuffles both sides."""
    return left.join(broadcast_if_small(right), on, how)


def blocks(batches, limit: int, column: str = "text"):
    """Regroups Arrow batches into tables of about ``limit`` bytes of text, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches([x for x in held if x.num_rows])
                held, size, begin = [], 0, i
            size += int(n)
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words of all texts in order, the distinct words, and each text's number of words.

    A null text has no words. Only A-Z are lower-cased.
    """
    text = pc.fill_null(text.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # a text that begins or ends with white space has empty parts there
        flat = flat.filter(pa.array(full))
    running = np.concatenate(([0], np.cumsum(full)))
    counts = np.diff(running[ends - ends[0]]) if len(ends) else np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts.astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_hash(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of an Arrow array without nulls."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), kind)


def in_order(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others in the caller's table can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])
