"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` computes the NAMES of a block of texts with numpy. ``fit`` learns from at most TRAIN_ROWS labelled rows,
those with the smallest hashes of their doc_id: features are cut into BINS quantile bins, each tree grows level by level
on gradient and hessian histograms (logistic loss, Newton steps). A model is flat arrays of complete trees: feature and
threshold of each inner node, value of each leaf. ``predict`` walks all trees for a whole block at once: a row at node i
goes on to 2 i + 1 or 2 i + 2. The model's size is fixed by TREES and DEPTH, whatever the data.

Scores depend on the text alone. Defined cases: a null text counts as empty and is scored; a label that is null is no
label, one that repeats counts by its mean; without labels, or with one class only, the score is (n1 + 1) / (n + 2) for
every text; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, LEAST_HESSIAN = 50_000, 60, 4, 64, 0.2, 5.0
BLOCK_BYTES = 2 << 20
#: Byte classes that are counted, the rest being 0.
CLASSES = {" ": 1, "\n": 2, "!": 3, "|": 4, "#": 5, "*": 6, "$": 7, "%": 8, "&": 9, ".": 10, ",": 11}
UPPER, LOWER, DIGIT, HIGH = 12, 13, 14, 15
NAMES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "adjacent_repeats", "lines", "repeated_lines",
    "spaces", "newlines", "exclamations", "bars", "hashes", "stars", "dollars", "percents", "ampersands", "stops", "commas", "uppers", "lowers", "digits", "highs", "others",
)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for char, k in CLASSES.items():
        table[ord(char)] = k
    table[65:91], table[97:123], table[48:58], table[128:] = UPPER, LOWER, DIGIT, HIGH
    return table


_TABLE = _class_table()


def _repeats(codes: np.ndarray, counts: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many different codes it has and how often it has its most frequent one."""
    rows = np.repeat(np.arange(len(counts)), counts)
    found, times = np.unique(rows * max(kinds, 1) + codes, return_counts=True)
    row = found // max(kinds, 1)
    most = np.zeros(len(counts), np.int64)
    np.maximum.at(most, row, times)
    return np.bincount(row, minlength=len(counts)), most


def statistics(text: pa.Array) -> np.ndarray:
    """A row of len(NAMES) numbers for each text."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return np.zeros((0, len(NAMES)))
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(text.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
    rows = np.repeat(np.arange(n) * 16, size)
    classes = np.bincount(rows + _TABLE[raw], minlength=16 * n).reshape(n, 16).astype(float)
    codes, distinct, counts = common.words(text)
    lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    different, top = _repeats(codes, counts, len(distinct))
    word_rows = np.repeat(np.arange(n), counts)
    letters = np.bincount(word_rows, weights=lengths[codes] if len(codes) else None, minlength=n)
    again = np.bincount(word_rows[1:], weights=(codes[1:] == codes[:-1]) & (word_rows[1:] == word_rows[:-1]), minlength=n) if len(codes) else np.zeros(n)
    lines = pc.split_pattern(text, "\n")
    coded = lines.flatten().dictionary_encode()
    line_counts = np.diff(lines.offsets.to_numpy())
    line_kinds, _ = _repeats(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), line_counts, len(coded.dictionary))
    per_word, per_byte = np.maximum(counts, 1), np.maximum(size, 1)[:, None]
    first = np.stack([np.log1p(size), np.log1p(counts), letters / per_word, different / per_word, top / per_word, again / per_word, np.log1p(line_counts), 1 - line_kinds / np.maximum(line_counts, 1)], 1)
    return np.concatenate([first, classes[:, 1:] / per_byte, classes[:, :1] / per_byte], 1)


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes: above it, the right child
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of statistics."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Trees for rows of statistics and 0/1 labels."""
    inner = (1 << DEPTH) - 1
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin <= b means x <= cuts[b]
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    total = np.full(len(y), base)
    out = []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-total))
        g, h = y - chance, chance * (1 - chance)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            node = at - first
            sums = np.bincount(node, g, n), np.bincount(node, h, n)
            best = np.full(n, 1e-6)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                key = node * BINS + binned[:, f]
                left_g, left_h = (np.bincount(key, w, n * BINS).reshape(n, BINS).cumsum(1)[:, : len(cuts[f])] for w in (g, h))
                right_g, right_h = sums[0][:, None] - left_g, sums[1][:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (sums[0] ** 2 / (sums[1] + 1))[:, None]
                gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = 0
                b = gain.argmax(1)
                better = gain[np.arange(n), b] > best
                best[better] = gain[np.arange(n), b][better]
                feature[first : first + n][better], limit[first : first + n][better] = f, cuts[f][b[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        total += value[leaf]
        out.append((feature, limit, value))
    return Trees(*(np.stack(v) for v in zip(*out, strict=True)), base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """Learns from labels(doc_id, label), all of which may be used, and the texts of docs(doc_id, text)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows

    def count(batches):
        for block in common.blocks(batches, BLOCK_BYTES):
            x = statistics(common.column(block, "text")).astype(np.float64)
            yield pa.RecordBatch.from_arrays([common.column(block, "doc_id"), common.column(block, "y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    common.small_batches(docs.sparkSession)
    # Copies of a doc_id could make more rows than were chosen.
    got = rows.mapInArrow(count, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(train_rows).toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(len(got), len(NAMES))
    return grow(x, got["y"].to_numpy(np.int64))


def predict(docs: DataFrame, model: Trees, keep: list[str], name: str = "score") -> DataFrame:
    """keep's columns and the score of each row of docs(text, ...), in a column called name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").alias("__text"), *keep)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` double"])

    def score(batches):
        for block in common.blocks(batches, BLOCK_BYTES, "__text"):
            found = shared.value.score(statistics(common.column(block, "__text")))
            yield from block.select(keep).append_column(name, pa.array(found)).combine_chunks().to_batches()

    common.small_batches(docs.sparkSession)
    return rows.mapInArrow(score, schema)


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = common.in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = common.in_order(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality").where(~held_out(F.col("doc_id")))
    model = fit(docs, labels)
    scored = predict(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a model of their own labels, held-out ones left aside, does not reject."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    names = docs.columns
    return predict(docs, model, names, "__quality").where(F.col("__quality") >= 0.5).select(*names)
