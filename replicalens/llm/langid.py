"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, runs of anything but letters become one space, and every window of 1 to ORDER characters is
hashed into BUCKETS columns. ``fit`` counts them for each language over all training rows (sums are made on the
executors, array by array), adds one to each count, and keeps logarithms: a row of BUCKETS float32 for each language. As
long as these rows take at most MATRIX_BYTES, they are one matrix that is broadcast; of more languages the rows stay in
files below the shared folder, LANGS at a time, which every block of texts is scored against in turn. ``predict`` scores
blocks of texts at once: the hashed windows of a block are the column indices, text by text, of a sparse matrix of ones,
which numpy multiplies with the dense matrix, by gathering its columns and adding them up for each text.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without training rows every text is; ties
go to the first language in order; a null lang is no training row; there may be any number of languages; repeated rows
each count and are each predicted; texts of any length are read whole. The score is the posterior probability of the
language given.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER, BUCKETS, CHUNK = 3, 1 << 16, 1 << 12
BLOCK_BYTES = 2 << 20
#: What is broadcast at most; languages whose rows a task holds at a time, and those it counts at a time.
MATRIX_BYTES, LANGS = 64 << 20, 128
#: Numbers that are gathered at a time.
GATHERED = 4 << 20
UNKNOWN = "und"


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def ngrams(text: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Row limits of the block's cleaned characters; for each n its hashed windows by place (-1: none); letters a row."""
    # The mark cannot be in a text: it stands between rows, so that no window crosses them.
    rows = [(x or "").lower().replace("\0", " ") for x in text.to_pylist()]
    raw = np.frombuffer("\0".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    mark = raw == 0
    space = ~letter & ~mark
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # one of each run
    if len(keep):
        keep[0] = True
    chars = np.where(space, np.uint32(32), raw)[keep].astype(np.uint64)
    ends = np.append(np.flatnonzero(chars == 0), len(chars))
    starts = np.append(0, ends[:-1] + 1)
    limits = np.stack([starts, ends], 1)
    letters = np.add.reduceat(np.append((chars != 32) & (chars != 0), 0).astype(np.int64), starts) if len(rows) else np.zeros(0, np.int64)
    found, code = [], np.zeros(len(chars), np.uint64)
    for n in range(1, ORDER + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x1F35D) + chars[n - 1 :] + np.uint64(n)
        hashed = (common.mix64(code) % np.uint64(BUCKETS)).astype(np.int32)
        bad = np.zeros(m, bool)
        for k in range(n):
            bad |= chars[k : k + m] == 0
        found.append(np.where(bad, np.int32(-1), hashed))
    return limits, found, letters


@dataclass(frozen=True)
class Model:
    """Languages in order with their log-probabilities (languages x BUCKETS + 1; the last column is the prior), or files of such."""

    langs: list[str]
    matrix: np.ndarray
    files: list[str]

    def parts(self):
        """(languages, matrix) one after the other."""
        if self.langs:
            yield self.langs, self.matrix
        for name in self.files:
            system, path = common.open_fs(name)
            with system.open_input_file(path) as f:
                yield _loaded(f.read())


def _stored(langs: list[str], matrix: np.ndarray) -> bytes:
    names = "\0".join(langs).encode("utf-8", "surrogatepass")
    return len(langs).to_bytes(4, "little") + matrix.astype(np.float32).tobytes() + names


def _loaded(data: bytes) -> tuple[list[str], np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    matrix = np.frombuffer(data, np.float32, n * (BUCKETS + 1), 4).reshape(n, BUCKETS + 1)
    return data[4 + matrix.nbytes :].decode("utf-8", "surrogatepass").split("\0"), matrix


def _counted(batches):
    """(lang, chunk, counts) of training rows; the chunk behind the windows' has the number of rows."""
    sums: dict[str, np.ndarray] = {}

    def out():
        rows = [(x, k, common.packed(part)) for x, v in sums.items() for k, part in enumerate(v.reshape(-1, CHUNK)) if part.any()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "chunk", "counts"])

    for block in common.blocks(batches, BLOCK_BYTES):
        limits, found, _ = ngrams(common.column(block, "text"))
        langs = block.column("lang").to_pylist()
        order = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        lang_at = np.zeros(int(limits[-1, 1]) + 1 if len(limits) else 1, np.int64)
        for (a, b), x in zip(limits, langs, strict=True):
            lang_at[a:b] = order[x]
        names = list(order)
        for first in range(0, len(names), LANGS):  # the arrays of few languages at a time
            n = min(LANGS, len(names) - first)
            counts = np.zeros((n, BUCKETS + CHUNK), np.int64)
            for hashed in found:
                lang = lang_at[: len(hashed)] - first
                ok = (hashed >= 0) & (lang >= 0) & (lang < n)
                counts[:, :BUCKETS] += np.bincount(lang[ok] * BUCKETS + hashed[ok], minlength=n * BUCKETS).reshape(n, BUCKETS)
            counts[:, BUCKETS] = np.bincount([order[x] for x in langs], minlength=len(names))[first : first + n]
            for x, mine in zip(names[first : first + n], counts, strict=True):
                sums[x] = sums[x] + mine if x in sums else mine.copy()
            if len(sums) > LANGS:
                yield out()
    yield out()


def fit(rows: DataFrame, matrix_bytes: int = MATRIX_BYTES, langs_a_file: int = LANGS) -> Model:
    """Learns from all rows of rows(text, lang) that have a lang."""
    spark = rows.sparkSession
    common.small_batches(spark)
    root = common.new_folder(spark, "langid")
    parts = rows.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(_counted, "lang string, chunk int, counts binary")
    total = common.stage(sum_arrays(parts), f"{root}/counts")
    langs = total.select("lang").distinct().count()
    if not langs:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), [])
    docs = total.where(F.col("chunk") == BUCKETS // CHUNK).select("counts").mapInPandas(_row_counts, "n long").agg(F.sum("n")).first()[0]

    def rows_of_languages(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        names = sorted(frame["lang"].unique(), key=str)
        place, counts = {x: i for i, x in enumerate(names)}, np.zeros((len(names), BUCKETS + CHUNK))
        for x, k, data in zip(frame["lang"], frame["chunk"], frame["counts"], strict=True):
            counts[place[x], k * CHUNK : (k + 1) * CHUNK] = common.unpacked(data, np.int64)
        grams = counts[:, :BUCKETS] + 1
        return names, np.concatenate([np.log(grams / grams.sum(1, keepdims=True)), np.log(counts[:, BUCKETS] / docs)[:, None]], 1).astype(np.float32)

    if langs * (BUCKETS + 1) * 4 <= matrix_bytes:  # as many rows come to the driver, packed
        return Model(*rows_of_languages(total.toPandas()), [])
    files = -(-langs // langs_a_file)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        name = f"{root}/matrix/{int(frame['part'].iloc[0]):06d}"
        common.write_file(name, _stored(*rows_of_languages(frame)))
        return pd.DataFrame({"file": [name]})

    parted = total.withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(files)))
    made = parted.groupBy("part").applyInPandas(write, "file string")
    return Model([], np.zeros((0, BUCKETS + 1), np.float32), sorted(r["file"] for r in made.collect()))


def _row_counts(frames):
    for x in frames:
        yield pd.DataFrame({"n": [int(common.unpacked(v, np.int64)[0]) for v in x["counts"]]}).astype("int64")


def sum_arrays(parts: DataFrame) -> DataFrame:
    """Adds packed integer arrays by (lang, chunk), first in groups by a salt, so no group grows with the input alone."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(common.unpacked(x, np.int64) for x in frame["counts"])
        return pd.DataFrame({"lang": frame["lang"][:1], "chunk": frame["chunk"][:1], "counts": [common.packed(total)]})

    schema = "lang string, chunk int, counts binary"
    salted = parts.withColumn("salt", F.spark_partition_id() % 256)
    return salted.groupBy("lang", "chunk", "salt").applyInPandas(add, schema).groupBy("lang", "chunk").applyInPandas(add, schema)


def log_scores(limits: np.ndarray, found: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Log-probability of each text under each row of the matrix."""
    starts, logs = limits[:, 0], np.zeros((len(limits), len(matrix)))
    table = np.ascontiguousarray(np.append(matrix[:, :BUCKETS], np.zeros((len(matrix), 1), np.float32), 1).T)  # index -1: nothing
    step = max(1, GATHERED // max(len(matrix), 1))
    for hashed in found:
        for a in range(0, len(hashed), step):
            piece = table[hashed[a : a + step]]
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, a + len(piece))
            logs[first:last] += np.add.reduceat(piece, np.maximum(starts[first:last] - a, 0), axis=0, dtype=np.float64)
    return logs + matrix[:, BUCKETS]


def score_block(text: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Best language of each text, its posterior, and whether the text has a letter."""
    limits, found, letters = ngrams(text)
    best, top, total = np.full(len(limits), None, object), np.full(len(limits), -np.inf), np.full(len(limits), -np.inf)
    for langs, matrix in model.parts():
        logs, names = log_scores(limits, found, matrix), np.array(langs, object)
        mine = logs.argmax(1)
        high = logs[np.arange(len(logs)), mine]
        names = names[mine]
        better = (high > top) | ((high == top) & np.array([b is None or x < b for x, b in zip(names, best, strict=True)], bool))
        best[better], top[better] = names[better], high[better]
        total = np.logaddexp(total, high + np.log(np.exp(logs - high[:, None]).sum(1)))
    return best, np.exp(top - total), letters > 0


def predict(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep's columns with lang_pred and score for each row; rows has text and those columns."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most MATRIX_BYTES, or file names
    fields = [rows.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])

    def score(batches):
        model = shared.value
        for block in common.blocks(batches, BLOCK_BYTES):
            n = block.num_rows
            pred, values = np.full(n, UNKNOWN, object), np.zeros(n)
            if model.langs or model.files:
                best, posterior, known = score_block(common.column(block, "text"), model)
                pred[known] = best[known]
                values[known] = np.minimum(posterior[known], 1.0)
            for batch in block.select(keep).append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(values)).combine_chunks().to_batches():
                yield batch

    common.small_batches(rows.sparkSession)
    return rows.select("text", *keep).mapInArrow(score, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = common.in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    return predict(docs, fit(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
