"""Exact top-k search by a Voronoi join.

Components become floor(256 x); the score is the integer inner product. One more coordinate turns the largest score into
the smallest distance: with M the largest squared length of a vector, data x go to (x, sqrt(M - |x|^2)) and queries q to
(q, 0), and |q' - x'|^2 = |q|^2 + M - 2 q.x. Rows with the smallest hashes, about the square root of all but LEAST_PIVOTS
at least and MOST_PIVOTS at most, are pivots; queries and data belong to the cell of the nearest. From each cell's summary
(its radius, and its k + 1 smallest distances, as a query may meet itself) follows a distance within which every query of
a cell has its k results; by the triangle inequality a row of data at distance d from its pivot p_j can matter to cell i
only if | |p_i p_j| - d | is at most that distance plus the cell's radius. Cells with few queries are grouped with near
ones, cells with many are cut, into at most MOST_BLOCKS blocks; each row of data goes to the blocks that need it, dealt by
a salt into parts of about PART_ROWS rows; every pair of block and part is solved by a matrix product, and the parts'
results are merged. Pivots, summaries and the blocks' limits are all the driver sees; none of it grows beyond its constant.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do those with a component
whose floor(256 x) is beyond 2**62, nor rows without vec_id. Shorter vectors count as filled up with zeros, but are stored
and multiplied at their own length. Rows that repeat a vec_id are rows of their own: each is a query with its own results
and a candidate for all but itself. Ties go to the smaller vec_id, however many there are. Scores are exact integers; what
is beyond a long counts as its nearest end. An empty table gives an empty result; other
columns of the table are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SCALE, LEAST_PIVOTS, MOST_PIVOTS, QUERY_ROWS, PART_ROWS, MOST_BLOCKS = 256, 64, 512, 1024, 32768, 8192
#: Share of a distance, and of the largest length, that rounding may cost.
SLACK = 1e-6
#: Rows of a frame that is sent on, about.
BATCH_ROWS = 8192
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(rows: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and vec (64-bit integers up to the last that is not 0) of each usable row of rows(vec_id, embedding)."""
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", "embedding")

    def convert(batches):
        for batch in batches:
            lists = batch.column("embedding")
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            values = np.floor(SCALE * pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
            good = np.abs(values) <= 2.0**62  # not for NaN
            bad = np.concatenate(([0], np.cumsum(~good)))
            keep = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
            whole = np.where(good, values, 0).astype(np.int64)
            vec = [np.trim_zeros(whole[ends[i] : ends[i + 1]], "b").tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), pa.array(vec, pa.binary())], names=["vec_id", "vec"])

    common.small_batches(rows.sparkSession)
    return ok.mapInArrow(convert, "vec_id long, vec binary").select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")


def _grouped(vectors) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of about one length, for each: none is filled up to more than twice its own."""
    size = np.array([len(v) // 8 for v in vectors], np.int64)
    kind = np.ceil(np.log2(np.maximum(size, 8))).astype(np.int64)
    out = []
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        width = int(size[at].max())
        full = np.zeros((len(at), width), np.int64)
        full[np.arange(width) < size[at][:, None]] = np.frombuffer(b"".join(vectors[i] for i in at), np.int64)
        out.append((at, full))
    return out


def _squares(vectors) -> np.ndarray:
    out = np.zeros(len(vectors))
    for at, m in _grouped(vectors):
        out[at] = (m.astype(np.float64) ** 2).sum(1)
    return out


def _distances(vectors, pivots: list[bytes], most: float, query: bool) -> np.ndarray:
    """Distances of vectors, as queries or as data, from pivots, which are data; all with the coordinate described above."""
    theirs = [np.frombuffer(p, np.int64).astype(np.float64) for p in pivots]
    lift = np.sqrt(np.maximum(most - np.array([(p**2).sum() for p in theirs]), 0))
    out = np.zeros((len(vectors), len(pivots)))
    for at, m in _grouped(vectors):
        p, m = np.zeros((len(pivots), m.shape[1])), m.astype(np.float64)
        for i, x in enumerate(theirs):
            p[i, : min(len(x), p.shape[1])] = x[: p.shape[1]]
        squares = (m**2).sum(1)
        product = m @ p.T if query else m @ p.T + np.sqrt(np.maximum(most - squares, 0))[:, None] * lift
        out[at] = np.sqrt(np.maximum((squares if query else np.full(len(at), most))[:, None] + most - 2 * product, 0))
    return out


def _nearest(rows: DataFrame, pivots: list[bytes], most: float, query: bool) -> DataFrame:
    """rows with cell, the nearest pivot, and dist, the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def assign(frames):
        for x in frames:
            if len(x):
                d = _distances(x["vec"].to_numpy(), shared.value, most, query)
                x["cell"], x["dist"] = d.argmin(1).astype(np.int32), d.min(1)
                yield x

    return rows.mapInPandas(assign, "row long, vec_id long, vec binary, cell int, dist double")


def _smallest(rows: DataFrame, k: int) -> list:
    """cell, n, and the least k distances of each cell."""

    def few(frames):
        best: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for x in frames:
            for cell, d in x.groupby("cell")["dist"]:
                best[cell] = np.sort(np.append(best.get(cell, []), d))[:k]
                n[cell] = n.get(cell, 0) + len(d)
        yield pd.DataFrame({"cell": list(best), "n": [n[c] for c in best], "few": [v.tolist() for v in best.values()]}).astype({"cell": "int32", "n": "int64"})

    parts = rows.select("cell", "dist").mapInPandas(few, "cell int, n long, few array<double>")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, k).alias("few")).collect()


def _blocks(counts: dict[int, int], gaps: np.ndarray, rows: int) -> list[tuple[list[int], int]]:
    """(cells, parts): cells with more than ``rows`` queries alone and in parts, others with near ones up to that many."""
    out, left = [], {}
    for cell, n in sorted(counts.items()):
        if n >= rows:
            out.append(([cell], -(-n // rows)))
        else:
            left[cell] = n
    while left:
        first = max(left, key=lambda c: (left[c], -c))
        group, total = [], 0
        for cell in sorted(left, key=lambda c: (gaps[first, c], c)):
            if not group or total + left[cell] <= rows:
                group.append(cell)
                total += left[cell]
        for cell in group:
            del left[cell]
        out.append((group, 1))
    return out


def _best(line: np.ndarray, error: np.ndarray | None, own: int, k: int) -> np.ndarray:
    """Places of the rows that may be among the k best: the better ones, and the first k of those at the edge.

    Rows stand by id; own, if not negative, is left out. With error (how far each score may be off) all that may reach it.
    """
    low, high = (line, line) if error is None else (np.clip(line - error, -(2.0**63), 2.0**63), np.clip(line + error, -(2.0**63), 2.0**63))
    if own >= 0:
        low = low.copy()
        low[own] = -np.inf if low.dtype.kind == "f" else np.iinfo(low.dtype).min
    if len(line) - (own >= 0) <= k:
        near = np.arange(len(line))
    else:
        edge = np.partition(low, len(low) - k)[len(low) - k]
        if error is None:
            at = np.flatnonzero(line == edge)
            near = np.concatenate([np.flatnonzero(line > edge), at[at != own][:k]])
        else:
            near = np.flatnonzero(high >= edge)
    return near[near != own]


def solve(queries: list[bytes], query_rows: np.ndarray, data: list[bytes], data_rows: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place of the query, vec_id, score) of the k best rows of data for each query; ties to the smaller id, its own row left out."""
    order = np.lexsort((data_rows, data_ids))
    data, data_rows, data_ids = [data[i] for i in order], data_rows[order], data_ids[order]
    own = {int(r): i for i, r in enumerate(data_rows)}
    asks, gives = _grouped(queries), _grouped(data)
    most = lambda groups: max((float(np.abs(m).max(initial=0)) for _, m in groups), default=0.0)
    width = max((m.shape[1] for _, m in asks), default=0)
    top = most(asks) * most(gives) * max(width, 1)
    kind = np.float64 if top < 2**53 or top >= 2**62 else np.int64
    length = np.sqrt(_squares(data)) if top >= 2**62 else None
    right = [(at, m.T.astype(kind)) for at, m in gives]
    out = []
    step = max(1, (4 << 20) // max(len(data), 1))
    for places, m in asks:
        for a in range(0, len(m), step):
            part = m[a : a + step].astype(kind)
            lines = np.zeros((len(part), len(data)), kind)
            for at, d in right:
                common_width = min(part.shape[1], len(d))
                lines[:, at] = part[:, :common_width] @ d[:common_width]
            for place, vector, line in zip(places[a : a + step], m[a : a + step], lines, strict=True):
                mine = own.get(int(query_rows[place]), -1)
                if length is None:
                    near = _best(line, None, mine, k)
                    score = [int(x) for x in line[near]]
                else:  # beyond what 64 bits hold: the few that may be among the best are multiplied exactly
                    error = length * float(np.sqrt((vector.astype(np.float64) ** 2).sum())) * (len(vector) + 4) * 2.0**-52
                    near = _best(line, error, mine, k)
                    score = [math.sumprod([int(x) for x in vector], [int(x) for x in np.frombuffer(data[i], np.int64)[: len(vector)]] + [0] * max(0, len(vector) - len(data[i]) // 8)) for i in near]
                    score = [min(max(x, LONG[0]), LONG[1]) for x in score]
                best = sorted(range(len(near)), key=lambda j: (-score[j], near[j]))[:k]
                out += [(int(place), int(data_ids[near[j]]), score[j]) for j in best]
    return out


def top_k(data: DataFrame, is_query, k: int = 5, n_pivots: int | None = None, query_rows: int = QUERY_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of data(vec_id, embedding) that is_query picks, its k best others."""
    spark = data.sparkSession
    folder = common.new_folder(spark, "knn")
    vectors = common.stage(quantised(data), f"{folder}/vectors")

    def squares(frames):
        for x in frames:
            if len(x):
                yield pd.DataFrame({"m": [_squares(x["vec"].to_numpy()).max()], "n": [len(x)]})

    known = vectors.select("vec").mapInPandas(squares, "m double, n long").agg(F.max("m").alias("m"), F.sum("n").alias("n")).first()
    if known["m"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most, n_pivots = known["m"], n_pivots or min(max(LEAST_PIVOTS, math.isqrt(known["n"])), MOST_PIVOTS)
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(n_pivots).collect()
    pivots = [bytes(r["vec"]) for r in picked]
    cells = common.stage(_nearest(vectors, pivots, most, False), f"{folder}/cells")
    asked = common.stage(_nearest(vectors.where(is_query), pivots, most, True), f"{folder}/queries")
    summary = {r["cell"]: r for r in _smallest(cells, k + 1)}
    ends = cells.groupBy("cell").agg(F.min("dist"), F.max("dist")).collect()
    per_query = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()
    gaps = _distances(pivots, pivots, most, False)
    # A query stands at its own distance from its pivot, which lies off the queries' plane: gaps between pivots, as data.
    rounding = SLACK * (1 + math.sqrt(most))
    reach = {}
    for r in per_query:
        known = np.sort(np.concatenate([r["radius"] + gaps[r["cell"], j] + np.array(s["few"]) for j, s in summary.items()]))
        reach[r["cell"]] = r["radius"] + (known[k] if len(known) > k else np.inf)
    counts = {r["cell"]: r["n"] for r in per_query}
    rows = max(query_rows, -(-sum(counts.values()) // MOST_BLOCKS))
    shares = [(group, part, parts) for group, parts in _blocks(counts, gaps, rows) for part in range(parts)]
    # For each block and cell of data: between which distances from its pivot a row can matter.
    low, high = np.full((len(shares), len(pivots)), np.inf), np.full((len(shares), len(pivots)), -np.inf)
    for b, (group, _, _) in enumerate(shares):
        for i in group:
            margin = reach[i] * (1 + SLACK) + SLACK * gaps[i] + 4 * rounding
            low[b], high[b] = np.minimum(low[b], gaps[i] - margin), np.maximum(high[b], gaps[i] + margin)
    load = np.zeros(len(shares))
    for cell, least, largest in ends:
        load += np.where((low[:, cell] <= largest) & (high[:, cell] >= least), summary[cell]["n"], 0)
    parts = np.maximum(1, np.ceil(load / part_rows)).astype(np.int64)
    place = {i: (b, n) for b, (group, part, n) in enumerate(shares) if part == 0 for i in group}
    plan = spark.sparkContext.broadcast((low, high, parts, place))
    packed = "block int, part int, row long, vec_id long, vec binary"
    names = [c.split()[0] for c in packed.split(", ")]

    def several(pieces):
        """Frames of some size from many small ones: (rows, block, part) each."""
        held, n = [], 0
        for x, b, part in pieces:
            held.append(x[["row", "vec_id", "vec"]].assign(block=b, part=part)[names])
            n += len(x)
            if n >= BATCH_ROWS:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    def deal(frames):
        low, high, parts, _ = plan.value

        def pieces():
            for x in frames:
                cell, dist = x["cell"].to_numpy(), x["dist"].to_numpy()
                mixed = common.mix64(x["row"].to_numpy().astype(np.uint64))
                for b in range(len(parts)):
                    need = np.flatnonzero((dist >= low[b][cell]) & (dist <= high[b][cell]))
                    if len(need):
                        yield x.iloc[need], b, (mixed[need] % np.uint64(parts[b])).astype(np.int32)

        yield from several(pieces())

    def ask(frames):
        _, _, parts, place = plan.value

        def pieces():
            for x in frames:
                first, n = (np.array([place[c][i] for c in x["cell"]], np.int64) for i in (0, 1))
                block = first + (common.mix64(x["row"].to_numpy().astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
                for b in np.unique(block):
                    for p in range(parts[b]):
                        yield x[block == b], int(b), p

        yield from several(pieces())

    def local(key, asks: pd.DataFrame, gives: pd.DataFrame) -> pd.DataFrame:
        found = solve(list(asks["vec"]), asks["row"].to_numpy(), list(gives["vec"]), gives["row"].to_numpy(), gives["vec_id"].to_numpy(), k)
        at = np.array([f[0] for f in found], np.int64)
        return pd.DataFrame({"query": asks["row"].to_numpy()[at], "query_id": asks["vec_id"].to_numpy()[at], "vec_id": np.array([f[1] for f in found], np.int64), "score": np.array([f[2] for f in found], np.int64), "place": np.arange(len(found))})

    given = cells.mapInPandas(deal, packed).groupBy("block", "part")
    found = asked.mapInPandas(ask, packed).groupBy("block", "part").cogroup(given).applyInPandas(local, "query long, query_id long, vec_id long, score long, place long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    rows = common.in_order(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS query, q.vec_id AS query_id, d.vec_id, list_inner_product(q.vec::DOUBLE[], d.vec::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.r <> q.r)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5
"""
