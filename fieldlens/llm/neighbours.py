"""Exact nearest neighbours by inner product: int8 product tiles, error bounds, float recomputation, heaps.

Vectors are quantised to int8 with one scale each, once; only bytes, scale and three norms travel to tiles. Queries and candidates are dealt into blocks, and every query block meets every
candidate block once, as a tile. The tile's product of int8 matrices estimates each inner product; the
residuals' norms bound the error (|x.y - est| <= |ex||y| + |x~||ey|, x~ being x as quantised). A pair whose upper bound lies below the
k-th largest lower bound of its query, in the tile and then over all tiles, can't be among the k nearest. Survivors fetch both vectors and are recomputed in double precision, and heaps keep
the k best of each query.

Defined cases: vectors null, empty, zero or with null or non-finite components take no part; vectors of another length
never meet; a row with the query's own id is no candidate of it; rows that repeat an id are candidates each; ties go to the smaller id;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 20
#: Vectors of a query block and of a candidate block.
QUERIES, CANDIDATES = 2048, 16384
#: Query rows multiplied at a time.
ROWS = 256


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as float32 for the product), scales, norms of the quantised vectors and of the residuals."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


PREPARED = "id long, dims int, x array<double>, q binary, scale double, near double, rest double, full double"


def _prepared(vectors: DataFrame) -> DataFrame:
    """Rows with a key of their own, their int8 values as bytes, and scale and norms of what was quantised, its residual and the whole."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = part.column("x").flatten().to_numpy().reshape(-1, d)
                q, scale, near, rest = _quantised(x)
                full = np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("dims"), part.column("x"), pa.array([r.tobytes() for r in q], pa.binary()), *(pa.array(c) for c in (scale, near, rest, full))],
                    ["id", "dims", "x", "q", "scale", "near", "rest", "full"],
                )

    return stored(vectors.mapInArrow(run, PREPARED).withColumn("key", F.monotonically_increasing_id()))


def _tile(group: pa.Table, k: int):
    """(query, candidate, lower, upper bound) by key of the pairs of one tile that may be among the k nearest of their query."""
    is_query = group.column("is_query").to_numpy()
    dims = group.column("dims")[0].as_py()
    ids, keys, scale, near, rest, full = (group.column(c).to_numpy() for c in ("id", "key", "scale", "near", "rest", "full"))
    q = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int8).reshape(-1, dims)
    mine, other = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    if not len(mine) or not len(other):
        return
    # Products of int8 sum exactly in float32 up to 1040 components, in float64 beyond.
    kind = np.float32 if dims * 127 * 127 < 1 << 24 else np.float64
    right = q[other].astype(kind).T
    for at in range(0, len(mine), ROWS):
        rows = mine[at : at + ROWS]
        est = (q[rows].astype(kind) @ right).astype(np.float64) * scale[rows, None] * scale[None, other]
        slack = (rest[rows, None] * full[None, other] + near[rows, None] * rest[None, other]) * (1 + 1e-9) + 1e-12 * np.abs(est)
        own = ids[rows, None] == ids[None, other]
        low = np.where(own, -np.inf, est - slack)
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((est + slack >= floor[:, None]) & ~own)
        yield keys[rows][i], keys[other][j], low[i, j], (est + slack)[i, j]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` to each row of ``queries``."""
    usable = lambda df: df.where(
        F.col(id_column).isNotNull()
        & F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))
        & F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)), F.lit(False))
    ).select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("x"), F.size(column).alias("dims"))
    left, right = _prepared(usable(queries)), _prepared(usable(vectors))
    m, n = left.count(), right.count()
    qb, cb = math.ceil(m / QUERIES) or 1, math.ceil(n / CANDIDATES) or 1
    spot = lambda blocks: F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = ("key", "id", "dims", "q", "scale", "near", "rest", "full")
    tiles = left.select(*sent, F.lit(True).alias("is_query"), spot(qb).alias("i"), every(cb).alias("j")).unionAll(
        right.select(*sent, F.lit(False).alias("is_query"), every(qb).alias("i"), spot(cb).alias("j"))
    )

    def run(group: pa.Table) -> pa.Table:
        parts = list(_tile(group, k))
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.table([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, kind)) for c, kind in enumerate(kinds)], names=["a", "b", "low", "high"])

    pairs = stored(tiles.groupBy("dims", "i", "j").applyInArrow(run, "a long, b long, low double, high double"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("low")))
    floors = pairs.select("a", "low", nth.alias("nth")).where(F.col("nth") == k).select("a", F.col("low").alias("floor"))
    survivors = pairs.join(floors, "a", "left").where("floor is null or high >= floor").select("a", "b")
    both = survivors.join(left.select(F.col("key").alias("a"), F.col("id").alias("query_id"), F.col("x").alias("qx"), "dims"), "a").join(
        right.select(F.col("key").alias("b"), F.col("id").alias("vec_id"), F.col("x").alias("cx")), "b"
    )

    def recompute(batches):
        for batch in batches:
            dims, score = batch.column("dims").to_numpy(), np.zeros(batch.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                a, b = (batch.column(c).take(pa.array(at)).flatten().to_numpy().reshape(-1, d) for c in ("qx", "cx"))
                score[at] = _exact(a, b)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], ["query_id", "vec_id", "score"])

    best = both.select("query_id", "vec_id", "dims", "qx", "cx").mapInArrow(recompute, "query_id long, vec_id long, score double")
    laid = best.repartition("query_id").sortWithinPartitions("query_id")

    def merge(batches):
        now, heap = None, []

        def ranked():
            rows = sorted(((s, -v) for s, v in heap), key=lambda r: (-r[0], r[1]))
            return [(now, r, v, s) for r, (s, v) in enumerate(rows, 1)]

        def out(rows):
            q, r, v, s = zip(*rows, strict=True) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            rows = []
            for q, v, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != now:
                    rows += ranked()
                    now, heap = q, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -v))
            yield out(rows)
        yield out(ranked())

    return laid.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e <> 0)) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
