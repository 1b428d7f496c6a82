"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are quantised to int8 with a scale of their own. The product of two codes
differs from the true inner product by no more than a bound made of the norms of
the two quantisation errors, so a tile (a block of queries times a block of
candidates) is one matrix product that gives every pair a lower and an upper
bound. Only codes, scales and norms travel to tiles: an eighth of the vectors'
bytes. Pairs whose upper bound does not reach the query's k-th best lower bound, of
the tile and then of all tiles, cannot be among its k nearest; for the others the
vectors are fetched and recomputed in double precision, and merged by a heap for
each query. The result is exact.

Queries are a stated set; a tile's size is fixed, so memory does not grow with
the table, and each code moves once per block of the other side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CHUNK = 1024


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not zero, every component finite."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~broken & F.exists(v, lambda x: x != 0), F.lit(False))


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the vector, of its code and of the code's error) of some vectors."""
    scale = np.abs(vectors).max(1) / 127.0
    # a vector of subnormal numbers may have scale 0: its whole value is then the error
    safe = np.where(scale > 0, scale, 1.0)
    code = np.where(scale[:, None] > 0, np.rint(vectors / safe[:, None]), 0)
    value = code * scale[:, None]
    return code.astype(np.int8), scale, np.stack([np.linalg.norm(x, axis=1) for x in (vectors, value, vectors - value)], 1)


class Codes:
    """The codes of some rows of a tile, as numbers for the product, with their scales and norms."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table["id"].to_numpy()
        self.code = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(self.ids), -1)
        self.scale, self.norm, self.coded, self.error = (table[c].to_numpy() for c in ("scale", "norm", "coded", "error"))

    def part(self, rows) -> Codes:
        out = object.__new__(Codes)
        for name, value in vars(self).items():
            setattr(out, name, value[rows])
        return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def few_of_each(table: pa.Table, k: int) -> pa.Table:
    """Of rows with equal vectors the k + 1 of smallest ids: no query needs more, its own row aside."""
    table = table.sort_by("id")
    _, group = np.unique(np.array([bytes(c) + v.to_bytes(8, "big", signed=True) for c, v in zip(table["code"].to_pylist(), table["same"].to_pylist())], object), return_inverse=True)
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    rank[order] = np.arange(len(group)) - np.searchsorted(group[order], group[order])
    return table.filter(pa.array(rank <= k))


def tile_survivors(queries: Codes, whole: Codes, k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, lower and upper bound) of the pairs of a tile that may be among the query's k nearest."""
    found = []
    exact = np.float32 if whole.code.shape[1] <= 1000 else np.float64  # products of codes stay whole numbers
    for at in range(0, len(queries.ids), CHUNK):
        q = queries.part(slice(at, at + CHUNK))
        floor, kept = np.full(len(q.ids), -np.inf), []
        best = np.zeros((len(q.ids), 0))
        for start in range(0, len(whole.ids), 4 * CHUNK):
            c = whole.part(slice(start, start + 4 * CHUNK))
            near = (q.code.astype(exact) @ c.code.astype(exact).T).astype(np.float64)
            near *= q.scale[:, None]
            near *= c.scale[None]
            slack = q.error[:, None] * c.coded[None] + q.norm[:, None] * c.error[None]
            slack = slack * (1 + 1e-9) + 1e-12 * q.norm[:, None] * c.norm[None]
            near[q.ids[:, None] == c.ids[None]] = -np.inf
            best = np.concatenate([best, near - slack], 1)
            if best.shape[1] > k:
                best = np.partition(best, -k, axis=1)[:, -k:]
                floor = best.min(1)
            row, column = np.nonzero((near + slack >= floor[:, None]) & (near > -np.inf))
            kept.append((row, column + start, near[row, column] - slack[row, column], near[row, column] + slack[row, column]))
        row, column, low, high = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 4
        good = high >= floor[row]
        found.append((q.ids[row[good]], whole.ids[column[good]], low[good], high[good]))
    return tuple(np.concatenate(x) for x in zip(*found))


CODED = "id long, query boolean, dims int, same long, code binary, scale double, norm double, coded double, error double"
BOUNDS = "query_id long, id long, low double, high double"


def codes_of(rows: DataFrame) -> DataFrame:
    """The codes of rows (id, query, v, dims, same); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims):
                part = batch.filter(pa.array(dims == size))
                code, scale, norms = coded(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                columns = [*(part.column(c) for c in ("id", "query", "dims", "same")), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale), *map(pa.array, norms.T)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "query", "dims", "same", "code", "scale", "norm", "coded", "error"])

    return rows.select("id", "query", "v", "dims", "same").mapInArrow(run, CODED)


def recomputed(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of each query of pairs (query_id, id, q, v), by heaps; ties to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("q", "v"))
            for query, other, score in zip(batch.column("query_id").to_pylist(), batch.column("id").to_pylist(), inner(a, b).tolist()):
                entry, heap = (score, -other), heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        rows = [(q, -other, score) for q, heap in heaps.items() for score, other in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "id", "score"])

    # a task's batches hold few pairs of many queries; what is left of each query's heaps is merged below
    return pairs.select("query_id", "id", "q", "v").mapInArrow(run, "query_id long, id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest by inner product, exact.

    ``queries`` picks the queries among the rows; candidates are all other rows (by
    id). Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows with a null id; vectors of another length are never a
    query's neighbours. Rows that repeat an id and vector count once; of unlike vectors
    under one id the greatest, component by component, stands for it. An empty table
    gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("query")).where(F.col("id").isNotNull() & usable("v"))
    # one row for each id: copies of a row would all be in one tile
    rows = rows.groupBy("id").agg(F.max("v").alias("v"), F.max("query").alias("query")).withColumn("dims", F.size("v")).withColumn("same", F.xxhash64("v"))
    rows = stored(rows, "vectors")
    counted = {r["query"]: r["n"] for r in rows.groupBy("query").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    q_blocks, c_blocks = max(1, -(-counted.get(True, 0) // query_block)), max(1, -(-total // candidate_block))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    tile = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    asked = F.transform(F.when(F.col("query"), every(c_blocks)).otherwise(F.array().cast("array<int>")), lambda j: tile(1, spread(q_blocks, 1), j))
    given = F.transform(every(q_blocks), lambda i: tile(0, i, spread(c_blocks, 2)))
    dealt = codes_of(rows).select("*", F.inline(F.concat(asked, given)))

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        if (side == 1).any() and (side == 0).any():
            found = tile_survivors(Codes(table.filter(pa.array(side == 1))), Codes(few_of_each(table.filter(pa.array(side == 0)), k)), k)
        return pa.table([pa.array(x) for x in found], ["query_id", "id", "low", "high"])

    bounds = dealt.groupBy("dims", "i", "j").applyInArrow(run, BOUNDS)
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floor = F.min(F.when(F.col("nth") == k, F.col("low"))).over(Window.partitionBy("query_id"))
    pairs = bounds.withColumn("nth", F.row_number().over(by_low)).withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    pairs = pairs.select("query_id", "id").join(rows.select("id", "v"), "id").join(rows.where("query").select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = recomputed(pairs, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
