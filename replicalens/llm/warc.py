"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page and digest, written as one gzip member each, and files roll at a compressed size. The
ranges' boundaries come from exact running sums of the records' bytes in that order, one boundary for about PART_BYTES, so
they depend on the rows alone: neither Spark's sampling nor the number of partitions, tasks or machines changes a file.
All headers, identifiers and digests are made anew from the page; nothing depends on the time. A task writes each file
under a temporary name and moves it to its final one, which only its range and number determine, so a repeated attempt
replaces its own files by equal ones. The manifest, a table that Spark commits when all tasks are through, says which files
belong to the archive, with their digests, ranges and first and last pages; the reader takes the files from it and checks
them. The boundaries, a page and the start of a digest for each range, stay beside it.

Records whose payload of at least LEAST bytes equals that of a record with a smaller page_id are revisits of it.

Defined cases: a null html is an empty payload; a null url is written as urn:page; a null page_id sorts last and is
never referred to while others exist; rows that repeat page_id and payload are all responses if theirs is the smallest
page_id; an empty table gives an empty manifest and result; other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 100
#: A file is closed when it has grown beyond this many compressed bytes.
ROLL_BYTES = 32 << 20
#: Bytes of records, uncompressed, in a range; what a record takes beside its payload, about.
PART_BYTES, HEAD_BYTES = 64 << 20, 640
DATE = "2000-01-01T00:00:00Z"
SALTS = 32
MANIFEST = "file string, part int, number int, first_page long, last_page long, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"


def prepared(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to for each row of pages(page_id, url, html)."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    firsts = rows.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A digest that many pages share is dealt over SALTS tasks where the join shuffles.
    salt = (F.xxhash64("page_id") % SALTS + SALTS) % SALTS
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    if common.small(firsts):
        rows = rows.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        rows = rows.withColumn("salt", salt).join(spread, ["payload_digest", "salt"], "left").drop("salt")
    older = F.col("first_page").isNotNull() & F.coalesce(F.col("page_id") > F.col("first_page"), F.lit(True))
    rows = rows.withColumn("refers_to", F.when(older, F.col("first_page")))
    # What a revisit refers to is stored there: its own copy need not travel.
    return rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).drop("first_page")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def record(page_id, url: str | None, payload: bytes | None, digest: str, n: int, refers_to) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head + (payload or b"") if refers_to is None else head
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def boundaries(rows: DataFrame, folder: str, part_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first (page is null, page_id, start of the digest) of each range of about part_bytes of prepared() rows, in order."""
    none, page, digest = F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), F.conv(F.substring("payload_digest", 1, 15), 16, 10).cast("long")
    weight = F.lit(HEAD_BYTES) + F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    keys = rows.select(none.alias("none"), page.alias("page"), digest.alias("digest"), weight.alias("weight"))
    # Rows of equal keys weigh the same, so that sums do not depend on their order.
    order = [F.col(c) for c in ("none", "page", "digest", "weight")]
    summed = common.running(keys, order, f"{folder}/keys", before=F.col("weight"))
    part = F.floor(F.col("before") / F.lit(int(part_bytes)))
    firsts = summed.groupBy(part.alias("part")).agg(F.min(F.struct("none", "page", "digest")).alias("x")).select("x.*")
    firsts = common.stage(firsts, f"{folder}/boundaries")
    found = firsts.orderBy("none", "page", "digest").collect()  # three numbers for each PART_BYTES
    return tuple(np.array([r[c] for r in found], np.int64) for c in ("none", "page", "digest"))


def part_of(none: np.ndarray, page: np.ndarray, digest: np.ndarray, limits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each key the last range that begins at or before it."""
    every = [np.concatenate([x, y]).astype(np.int64) for x, y in zip(limits, (none, page, digest), strict=True)]
    n, limit = len(limits[0]), np.zeros(len(every[0]), np.int64)
    limit[:n] = 1
    order = np.lexsort((1 - limit, *reversed(every)))  # of equal keys the boundary comes first
    part = np.empty(len(order), np.int64)
    part[order] = np.cumsum(limit[order]) - 1
    return np.maximum(part[n:], 0)


def write(pages: DataFrame, root: str, part_bytes: int = PART_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archive below root; its manifest, read from there."""
    spark = pages.sparkSession
    common.small_batches(spark)
    columns = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")

    def put(batches):
        held, size, part, number, done = [], 0, None, 0, []

        def close():
            nonlocal held, size, number
            if held:
                data = b"".join(x for x, _ in held)
                name = f"{root}/part-{part:07d}-{number:04d}.warc.gz"
                common.write_file(name, data)
                done.append((name, part, number, held[0][1], held[-1][1], len(held), len(data), hashlib.sha256(data).hexdigest()))
                held, size, number = [], 0, number + 1

        for batch in batches:
            for mine, *row in zip(*(batch.column(c).to_pylist() for c in ("part", *columns)), strict=True):
                if mine != part:
                    close()
                    part, number = mine, 0
                held.append((member(record(*row)), row[0]))
                size += len(held[-1][0])
                if size >= roll_bytes:
                    close()
        close()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*done, strict=True)) or [[]] * 8, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = prepared(pages)
    limits = boundaries(rows, root, part_bytes)
    shared = spark.sparkContext.broadcast(limits)

    @F.pandas_udf("int")
    def place(none: pd.Series, page: pd.Series, digest: pd.Series) -> pd.Series:
        start = np.array([int(x[:15], 16) for x in digest], np.int64)
        return pd.Series(part_of(none.to_numpy(), page.to_numpy(np.int64), start, shared.value).astype(np.int32))

    # A null page_id travels as a flag: pandas would hold its neighbours as doubles.
    part = place(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0).cast("long")), "payload_digest")
    dealt = rows.select(part.alias("part"), *columns).repartition(max(1, len(limits[0])), "part")
    ordered = dealt.sortWithinPartitions("part", F.col("page_id").asc_nulls_last(), "payload_digest", "url")
    return common.stage(ordered.mapInArrow(put, MANIFEST), f"{root}/manifest")


def members(data: bytes):
    """The uncompressed records of a .warc.gz, one by one."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, out, step = zlib.decompressobj(31), [], 1 << 16
        while not unpack.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            out.append(unpack.decompress(piece))
            at += len(piece)
        at -= len(unpack.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """What RECORDS lists, from one record's bytes; its digests are checked against what is stored."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-Id"]), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page")), "url": fields["WARC-Target-URI"], "record_id": fields["WARC-Record-ID"]}


def read(manifest: DataFrame) -> DataFrame:
    """The records of the files that the manifest lists."""

    def get(frames):
        for x in frames:
            for name, digest in zip(x["file"], x["sha256"], strict=True):
                system, path = common.open_fs(name)
                with system.open_input_file(path) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} differs from its manifest")
                out = []
                for raw in members(data):
                    out.append(parse(raw))
                    if len(out) == 2000:
                        yield _frame(out)
                        out = []
                yield _frame(out)

    files = manifest.count()  # a stated number keeps them apart: one file a task
    return manifest.select("file", "sha256").repartition(max(1, min(files, 4096)), "file").mapInPandas(get, RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def op5(spark, sf_dir: str) -> DataFrame:
    root = common.new_folder(spark, "warc")
    manifest = write(common.in_order(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html"), root)
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to FROM f
"""
