"""Media columns: payloads in tar shards, addressed by content; rows carry digest, offset and length.

``store`` turns each text into a payload (UTF-8, zero bytes up to a positive multiple of 64), encodes it as a greyscale
PNG, 64 samples of 8 bits a row, and appends it to a tar shard below the shared folder, named by the SHA-256 of the
stored form. A shard holds each payload once, whatever the number of rows that point to it. ``header`` reads only the
first bytes of a stored member and fills the metadata columns; ``features`` reads it whole, decodes it and computes
digests and sample statistics. Payloads are not shuffled: only the catalogue's rows are, by shard and offset, so that a
task reads neighbouring members and there are as many tasks as shards. A payload that a third of all rows share is stored
in each shard they come from, and is no group anywhere.

Defined cases: a null text counts as empty (one row of 64 zero samples); equal texts have equal values, wherever they
are stored; rows repeat as given; an empty table gives an empty result; other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WIDTH = 64
#: A shard is closed before it would grow beyond this; a task holds one in memory.
SHARD_BYTES = 32 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, IHDR with its length and checksum.
HEADER_BYTES = 33
CATALOG = "doc_id long, n_bytes long, shard string, offset long, length long, digest string"
HEADER = "width long, height long, bit_depth int, colour_type int"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode(payload: bytes) -> bytes:
    """PNG of the payload; its length is a multiple of WIDTH."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 5)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES of a stored form."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", data[16:26])


def decode(data: bytes) -> np.ndarray:
    """The samples of what encode() made, as rows."""
    width, height, depth, colour = header(data)
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not 8-bit greyscale of the known width")
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return rows[:, 1:]


class _Shards:
    """Tar files of one task. Names are fixed by the task's place, so a repeated attempt replaces its own files."""

    def __init__(self, root: str, part: int, limit: int):
        self.root, self.part, self.limit, self.number = root, part, limit, 0
        self._open()

    def _open(self):
        self.name, self.raw, self.at = f"{self.root}/shard-{self.part:06d}-{self.number:04d}.tar", io.BytesIO(), {}
        self.tar = tarfile.open(fileobj=self.raw, mode="w", format=tarfile.USTAR_FORMAT)

    def put(self, data: bytes, digest: str) -> tuple[str, int, int]:
        if digest not in self.at:
            if self.at and self.raw.tell() + len(data) > self.limit:
                self.close()
                self.number += 1
                self._open()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            self.at[digest] = self.raw.tell() + 512
            self.tar.addfile(info, io.BytesIO(data))
        return self.name, self.at[digest], len(data)

    def close(self):
        self.tar.close()
        if self.at:
            common.write_file(self.name, self.raw.getvalue())


def store(docs: DataFrame, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards below root and returns the catalogue, itself a table there: a row for each document."""

    def write(batches):
        from pyspark import TaskContext

        shards = _Shards(root, TaskContext.get().partitionId(), shard_bytes)
        last: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = payload_of(text)
                name = hashlib.sha256(payload).hexdigest()
                if name not in last:  # saves encoding the copies that come close together
                    if len(last) >= 4096:
                        last.clear()
                    data = encode(payload)
                    last[name] = (data, hashlib.sha256(data).hexdigest())
                n = len((text or "").encode("utf-8", "surrogatepass"))
                out.append((key, n, *shards.put(*last[name]), last[name][1]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "n_bytes", "shard", "offset", "length", "digest"]).astype({"doc_id": "Int64"}), preserve_index=False)
        shards.close()

    spark = docs.sparkSession
    common.small_batches(spark)
    return common.stage(common.in_order(docs, "doc_id", "text").mapInArrow(write, CATALOG), f"{root}/catalog")


class _Reader:
    """Range reads from shards; keeps one open file."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            system, path = common.open_fs(name)
            self.name, self.file = name, system.open_input_file(path)
        return self.file.read_at(length, offset)


def with_header(catalog: DataFrame) -> DataFrame:
    """The catalogue with metadata columns, from header-only range reads."""

    def read(frames):
        reader = _Reader()
        for x in frames:
            known: dict = {}
            heads = []
            for name, offset in zip(x["shard"], x["offset"], strict=True):
                if (name, offset) not in known:
                    known[name, offset] = header(reader.read(name, offset, HEADER_BYTES))
                heads.append(known[name, offset])
            x[["width", "height", "bit_depth", "colour_type"]] = pd.DataFrame(heads, index=x.index, columns=["width", "height", "bit_depth", "colour_type"], dtype="int64")
            yield x

    return catalog.mapInPandas(read, f"{CATALOG}, {HEADER}")


def feature_of(samples: np.ndarray) -> str:
    """Statistics of the samples: mean and spread in thousandths, distinct values, and 16 histogram bins."""
    bins = np.bincount(samples.ravel(), minlength=256)
    n, values = bins.sum(), np.arange(256)
    total, squares = int(bins @ values), int(bins @ values**2)
    mean = total * 1000 // int(n)
    spread = (squares * int(n) - total * total) * 1000 // int(n) ** 2
    return f"mean={mean};variance={spread};distinct={int((bins > 0).sum())};bins=" + ",".join(map(str, bins.reshape(16, 16).sum(1)))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def features(catalog: DataFrame) -> DataFrame:
    """Digests and statistics of the stored payloads, by whole range reads; expects with_header()'s columns."""

    def read(frames):
        reader = _Reader()
        for x in frames:
            known: dict = {}
            out = []
            for key, n, name, offset, length, digest, width, height in zip(*(x[c] for c in ("doc_id", "n_bytes", "shard", "offset", "length", "digest", "width", "height")), strict=True):
                if digest not in known:
                    data = reader.read(name, offset, length)
                    if (found := hashlib.sha256(data).hexdigest()) != digest:
                        raise ValueError(f"{name} holds other bytes at {offset}")
                    samples = decode(data)
                    payload = samples.tobytes()
                    known[digest] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), found, feature_of(samples))
                out.append((key, n, *known[digest], width, height))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")]).astype({"doc_id": "Int64"})

    return catalog.mapInPandas(read, FEATURES)


def run(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """store(), then header and features of what was stored."""
    root = common.new_folder(docs.sparkSession, "media")
    catalog = store(docs, root, shard_bytes)
    shards = catalog.select("shard").distinct().count()
    return features(with_header(catalog.repartitionByRange(max(shards, 1), "shard", "offset")))


def op1(spark, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"))

