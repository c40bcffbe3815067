"""SentencePiece segmentation by forward filtering and backward sampling, and its lossless inverse.

The lattice of a text has an edge for every piece of the vocabulary that matches at a byte, with the piece mark standing
for a space, and one for every single byte (the model's byte pieces), much less likely. Text is cut into units before
runs of spaces and around line ends only; pieces don't cross units. A unit beyond PART bytes is filtered in windows that
begin the longest piece's length before the last one's end, so that no edge is lost. The forward pass sums, for every
boundary in a unit, the weights of all segmentations up to it; the backward pass draws from the end: among the edges
into a boundary, each in proportion to the weight that passes through it. The numbers drawn come from the row's key, the
unit's place and the step alone, so a segmentation is the same wherever and however often it is made.

A block's distinct units share one lattice; numpy walks all units, edges and draws of a block at once. A piece of rank r
weighs (r + 2) ** -ALPHA, as the vocabulary has ranks rather than probabilities. Decoding joins the pieces' bytes. A
block holds BLOCK_BYTES of text, or one text; nothing else is kept. The vocabulary, a file of fixed size, is read on the driver
and broadcast.

Defined cases: a null text counts as empty, has no pieces and decodes to ""; a null key draws like key 0; rows of equal
key and text have equal pieces; white space of any kind, the mark itself and unknown characters all round-trip.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, BYTE_WEIGHT, SEED, BLOCK_BYTES = 1.0, -40.0, 1, 2 << 20
MARK = "▁"


class Vocabulary:
    """Pieces as bytes, their log weights, and a trie as sorted transitions."""

    def __init__(self, data: bytes, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        self.text = [b""] * n
        self.weight = np.full(n, -np.inf)
        self.byte = np.zeros(256, np.int32)
        plain = []
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.text[i], self.byte[value], self.weight[i] = bytes([value]), i, BYTE_WEIGHT
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = model.id_to_piece(i).replace(MARK, " ").encode()
                plain.append(i)
        for rank, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i))):
            self.weight[i] = -alpha * np.log(rank + 2)
        if len(set(self.byte.tolist())) < 256:
            raise ValueError("the model lacks byte pieces: its segmentations could not be lossless")
        nodes: dict[tuple[int, int], int] = {}
        at_end: dict[int, int] = {}
        for i in plain:
            node = 0
            for b in self.text[i]:
                node = nodes.setdefault((node, b), len(nodes) + 1)
            if self.text[i]:
                at_end.setdefault(node, i)
        keys = np.array([node * 256 + b for node, b in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece_at = np.full(len(nodes) + 1, -1, np.int32)
        self.piece_at[list(at_end)] = list(at_end.values())
        self.length = np.array([len(x) for x in self.text], np.int64)
        self.longest = int(self.length.max())
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.first = np.full(256, -1, np.int64)
        root = self.keys < 256
        self.first[self.keys[root]] = self.next[root]
        self.second = np.full((256, 256), -1, np.int64)  # by the first two bytes
        for byte, node in zip(self.keys[root], self.next[root], strict=True):
            a, b = np.searchsorted(self.keys, [node * 256, node * 256 + 256])
            self.second[byte, self.keys[a:b] % 256] = self.next[a:b]


@functools.lru_cache(2)
def loaded(data: bytes, alpha: float = ALPHA) -> Vocabulary:
    """The vocabulary that a model file's bytes hold, made once in a process."""
    return Vocabulary(data, alpha)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return loaded(read_model(path), alpha)


#: Bytes of units whose edges are made together: few enough for the processor's cache.
PART = 32 << 10
#: Units that are walked together though they exceed PART, as each step along them is one call.
WIDE = 64


class Lattice:
    """Forward-filtered edges of many units; boundaries of unit u are start[u] .. start[u] + its length."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, v: Vocabulary):
        n = len(offsets) - 1
        self.start = offsets[:-1] + np.arange(n)
        self.end = self.start + np.diff(offsets)
        parts, a, edges = [], 0, 0
        few = n if not n or np.diff(offsets).max() <= PART else int(np.argmax(np.diff(offsets) > PART))
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1, min(a + WIDE, few))
            for first, (source, piece, key, last) in _windows(raw, offsets[a : b + 1], v):
                first += int(self.start[a])
                parts.append((source + np.int32(first), piece, key + first, last + edges))
                edges += len(source)
            a = b
        self.source, self.piece, self.key, self.last = (np.concatenate(x) for x in zip(*parts, strict=True))

    def draw(self, codes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the units that codes name, in order, and how many each has; seeds: a 64-bit number for each."""
        state, goal = self.end[codes], self.start[codes]
        rows, steps = np.argsort(codes), 0  # neighbours search near each other
        rows = rows[state[rows] != goal[rows]]
        taken, counts = [], np.zeros(len(codes), np.int64)
        while len(rows):
            number = common.mix64(seeds[rows] + np.uint64(steps * 0x9E3779B97F4A7C15 % (1 << 64)))
            u = (number >> np.uint64(11)).astype(np.float64) * 2.0**-53
            here = state[rows]
            edge = np.minimum(np.searchsorted(self.key, here + u, "right"), self.last[here])
            taken.append((rows, self.piece[edge]))
            counts[rows] += 1
            state[rows] = self.source[edge]
            rows = rows[state[rows] != goal[rows]]
            steps += 1
        out, last = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - 1
        for k, (rows, piece) in enumerate(taken):
            out[last[rows] - k] = piece
        return out, counts


def _windows(raw: np.ndarray, offsets: np.ndarray, v: Vocabulary):
    """The first boundary and the edges of some units at once, or of the windows of one long unit in order."""
    low, high, known = int(offsets[0]), int(offsets[-1]), np.zeros(1)
    if len(offsets) > 2 or high - low <= PART:
        yield 0, _edges(raw[low:high], (offsets - low).astype(np.int32), v, known)[:4]
        return
    for end in [*range(low + PART, high, PART), high]:
        *found, alpha = _edges(raw[low:end], np.array([0, end - low], np.int32), v, known)
        yield low - int(offsets[0]), found
        known = alpha[-min(v.longest, end - low) - 1 :]
        low = end - len(known) + 1


def _edges(raw: np.ndarray, offsets: np.ndarray, v: Vocabulary, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges into each boundary in order: their sources, pieces and keys; the last edge of each boundary; the boundaries' sums.

    A key is the boundary plus the share, among the weights of all segmentations up to it, of this edge and those before.
    known has the sums of the first boundaries; more than one are those of a window before, whose edges are left out.
    """
    length = np.diff(offsets)
    n, total = len(length), len(raw)
    unit = np.repeat(np.arange(n, dtype=np.int32), length)
    left = np.repeat(offsets[1:], length) - np.arange(total, dtype=np.int32)  # bytes from here to the unit's end
    at = np.arange(total, dtype=np.int32)
    begins, spans, pieces = [at], [np.zeros(total, np.int32)], [v.byte[raw]]
    node, depth = v.first[raw], 1
    while True:
        on = node >= 0
        at, node = at[on], node[on]
        piece = v.piece_at[node]
        found = piece >= 0
        begins.append(at[found])
        spans.append(np.full(len(begins[-1]), depth, np.int32))
        pieces.append(piece[found])
        on = left[at] > depth
        at, node = at[on], node[on]
        if not len(at):
            break
        if depth == 1:
            node = v.second[raw[at], raw[at + 1]]
        else:
            key = node * 256 + raw[at + depth]
            place = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            node = np.where(v.keys[place] == key, v.next[place], -1)
        depth += 1
    begin, span, piece = (np.concatenate(x) for x in (begins, spans, pieces))
    if len(known) > 1:
        new = begin + np.maximum(span, 1) >= len(known)
        begin, span, piece = begin[new], span[new], piece[new]
    source = begin + unit[begin]
    # Span 0 marks the byte edge, so that edges into a boundary have one order whatever else is in the block.
    by_target = np.argsort((source + np.maximum(span, 1)).astype(np.int64) * 4096 + span)
    source, span, piece = source[by_target], span[by_target], piece[by_target]
    target = source + np.maximum(span, 1)
    head = np.flatnonzero(np.append(True, target[1:] != target[:-1])).astype(np.int32)
    last = np.append(head[1:], len(target)) - 1
    weight = v.weight[piece]
    alpha = np.full(total + n, -np.inf)
    starts = offsets[:-1] + np.arange(n, dtype=np.int32)
    alpha[starts] = 0
    alpha[: len(known)] = known
    mass = np.empty(len(source))
    # Boundaries by their distance from the unit's start; head and last follow the boundaries in order.
    inner = np.ones(total + n, bool)
    inner[starts] = False
    inner[: len(known)] = False
    boundary = np.flatnonzero(inner)
    distance = boundary - np.repeat(starts, length)[len(known) - 1 :]
    order = np.argsort(distance, kind="stable")
    limits = np.searchsorted(distance[order], np.arange(len(known), int(length.max()) + 2))
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        mine = order[a:b]
        counts = last[mine] - head[mine] + 1
        first = np.cumsum(counts) - counts
        edges = np.arange(int(counts.sum())) + np.repeat(head[mine] - first, counts)
        mass[edges] = values = alpha[source[edges]] + weight[edges]
        alpha[boundary[mine]] = np.logaddexp.reduceat(values, first)
    chance = np.exp(mass - alpha[target])
    running = np.cumsum(chance)
    before = np.concatenate(([0.0], running))[np.repeat(head, last - head + 1)]
    every = np.full(total + n, -1, np.int64)
    every[boundary] = last
    return source, piece, target + np.minimum(running - before, 1.0), every if len(known) == 1 else every[len(known) :], alpha


def units(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the units of concatenated texts, and how many each text has."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n:
        line, space = raw == 10, raw == 32
        cut[:n] |= line
        cut[1:] |= line
        cut[1:n] |= space[1:] & ~space[:-1]
    ends = np.cumsum(size)
    cut[ends] = True
    cut[0] = True
    limits = np.flatnonzero(cut)
    at = np.searchsorted(limits, np.concatenate(([0], ends)))
    return limits, np.diff(at)


def encode_block(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all texts in order, how many each text has, and the texts' bytes."""
    data = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    size = np.array([len(x) for x in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), raw
    limits, per_text = units(raw, size)
    coded = pa.Array.from_buffers(pa.large_binary(), len(limits) - 1, [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    size_of = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
    if size_of.max() * WIDE > PART:  # long units are walked side by side with others as long
        by_size = np.argsort(size_of, kind="stable")
        distinct, codes = distinct.take(pa.array(by_size)), np.argsort(by_size)[codes]
    buffers = distinct.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    lattice = Lattice(np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], v)
    row = np.repeat(np.arange(len(texts)), per_text)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    keys = common.mix64(keys.astype(np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64)))
    pieces, counts = lattice.draw(codes, common.mix64(keys[row] + place.astype(np.uint64)))
    return pieces, np.bincount(row, counts, len(texts)).astype(np.int64), raw


def decode(pieces: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The bytes that pieces stand for."""
    length = v.length[pieces]
    total = int(length.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    return v.bytes[np.repeat(v.start[pieces], length) + inner]


def _encoded(block: pa.Table, model: bytes, alpha: float, seed: int):
    v = loaded(model, alpha)
    keys = pc.fill_null(common.column(block, "__key"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    pieces, counts, raw = encode_block(common.column(block, "__text").to_pylist(), keys, v, seed)
    return v, pieces, counts, raw


def encode(docs: DataFrame, keep: list[str], key: str = "doc_id", path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """keep's columns and ``pieces``, the sampled segmentation of text, for each row of docs."""
    rows = docs.select(F.col("text").alias("__text"), F.col(key).cast("long").alias("__key"), *keep)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "pieces array<int>"])
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))  # a file of fixed size, read on the driver alone

    def run(batches):
        for block in common.blocks(batches, BLOCK_BYTES, "__text"):
            _, pieces, counts, _ = _encoded(block, model.value, alpha, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(pieces))
            yield from block.select(keep).append_column("pieces", lists).combine_chunks().to_batches()

    common.small_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def decoded(encoded: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """keep's columns and ``text`` from ``pieces``."""
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep), "text string"])
    model = encoded.sparkSession.sparkContext.broadcast(read_model(path))  # a file of fixed size, read on the driver alone

    def run(batches):
        for batch in batches:
            v = loaded(model.value)
            texts = [None if x is None else decode(np.asarray(x, np.int64), v).tobytes().decode("utf-8") for x in batch.column("pieces").to_pylist()]
            yield pa.Table.from_batches([batch]).select(keep).append_column("text", pa.array(texts, pa.string())).combine_chunks().to_batches()[0]

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces_sha256 (32-bit little-endian ids), decoded_sha256 and lossless for each row."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches):
        for block in common.blocks(batches, BLOCK_BYTES, "__text"):
            v, pieces, counts, raw = _encoded(block, model.value, alpha, seed)
            back = decode(pieces, v)
            limits = np.concatenate(([0], np.cumsum(counts)))
            ends = np.concatenate(([0], np.cumsum(v.length[pieces])))[limits]
            size = pc.binary_length(common.column(block, "__text").cast(pa.large_string()))
            size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(size)))
            out = []
            for i in range(block.num_rows):
                mine, given = back[ends[i] : ends[i + 1]].tobytes(), raw[starts[i] : starts[i + 1]].tobytes()
                out.append((int(size[i]), int(counts[i]), hashlib.sha256(pieces[limits[i] : limits[i + 1]].tobytes()).hexdigest(), hashlib.sha256(mine).hexdigest(), mine == given))
            names = ["n_bytes", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"]
            yield pa.RecordBatch.from_arrays([common.column(block, "__key"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", *names])

    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").alias("__text"), F.col("doc_id").cast("long").alias("__key"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")


def op9(spark, sf_dir: str) -> DataFrame:
    return digests(common.in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
