"""Whitening of embeddings: exact cross-products by bit planes, centred as integers, then one eigendecomposition.

An entry c becomes the integer x = floor(256 * c). The fit list is every distinct integer vector once.

1. Tasks read the fit list in blocks. Within a block each dimension is shifted by its least value, and each bit of the shifted values makes a
   plane: one bit per row, packed into 64-bit words. The ones in the AND of two planes, weighted by both bits' values, sum up to the
   cross-product of two dimensions, exactly; the shifts are put back in integers. A dimension of ones gives sums and the number of rows as well.
   A task sends one row per pair of dimensions.
2. n * cross-product - sum * sum is the centred matrix, still in integers. Its eigenvectors give the components (``eigh`` in a task; the matrix's
   size is that of a vector squared, whatever the number of rows).
3. Rows are projected in tasks; the model is one matrix of ``COMPONENTS`` vectors. The covariance of what comes out is measured
   over the fit list.

Defined cases: null vectors and those with null or non-finite entries are left out, as are empty ones, which have no component; vectors of another length make a
fit list and a model of their own; rows that repeat an id or a vector get a row each per component; null ids stay; a component without variance (below a 1e-13th of the trace, what double precision can tell)
has whitened null, explained 0, and is not counted in identity_error (null if there is no other); entries beyond a long are cut to it; a deviation
beyond a long is null, and deviation_text holds its digits in any case. Other columns are ignored, whatever their names. Signs make the largest entry of each component positive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

COMPONENTS = 4
SCALE = 256
#: Rows packed at a time: words per plane times 64.
BLOCK = 8192
#: Eigenvalues below this share of the trace count as no variance.
NOTHING = 1e-13


@dataclass
class Model:
    """What the rows of one vector length are projected with."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, dims and the integers x of every usable row."""
    whole = F.coalesce(F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)), F.lit(False))
    return vectors.where(whole & (F.size(column) > 0)).select(
        F.col(id_column).alias("vec_id"), F.size(column).alias("dims"), F.transform(column, lambda c: F.floor(c.cast("double") * SCALE)).alias("x")
    )


def _vectors(batch: pa.RecordBatch):
    """(dims, row numbers, matrix of x) for each length in a batch."""
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield int(d), rows, batch.column("x").take(pa.array(rows)).flatten().to_numpy().reshape(-1, d)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of ``x`` and a column of ones, as Python integers."""
    rows, dims = x.shape
    least = [int(v) for v in x.min(axis=0)]
    spread = [int(v) - low for v, low in zip(x.max(axis=0), least, strict=True)]
    # Subtraction modulo 2^64 is right, as the differences fit.
    shifted = x.astype(np.int64).view(np.uint64) - np.array(least, np.int64).view(np.uint64)
    owner, bit, planes = [], [], []
    for j, most in enumerate(spread):
        for b in range(most.bit_length()):
            owner.append(j), bit.append(b)
            planes.append(np.packbits((shifted[:, j] >> np.uint64(b) & np.uint64(1)).astype(np.uint8)))
    owner.append(dims), bit.append(0), planes.append(np.packbits(np.ones(rows, np.uint8)))
    words = np.zeros((len(planes), -(-rows // 64) * 8), np.uint8)
    words[:, : len(planes[0])] = planes
    words = words.view(np.uint64)
    ones = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        ones[p, p:] = ones[p:, p] = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
    # Weights beyond what a long holds are summed as Python integers.
    kind = np.int64 if 2 * (max(bit) + 1) + rows.bit_length() + 2 * len(owner).bit_length() < 62 else object
    weights = np.zeros((dims + 1, len(planes)), kind)
    weights[owner, range(len(planes))] = [1 << b for b in bit]
    out = ((weights @ ones.astype(kind)) @ weights.T).astype(object)
    back = np.array([*least, 0], object)
    sums = out[:, dims].copy()
    return out + np.multiply.outer(back, sums) + np.multiply.outer(sums, back) + rows * np.multiply.outer(back, back)


def scatter(fit: DataFrame) -> DataFrame:
    """dims, j, k (j <= k) and the exact sum of x_j * x_k over the fit list; index dims stands for a column of ones."""
    schema = pa.schema([("dims", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("product", pa.string())])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _vectors(batch):
                for at in range(0, len(x), BLOCK):
                    total[d] = total.get(d, 0) + cross_products(x[at : at + BLOCK])
        for d, sums in total.items():
            j, k = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), d, np.int32)), pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array([str(v) for v in sums[j, k]])], schema=schema)

    parts = fit.mapInArrow(run, "dims int, j int, k int, product string")
    return parts.groupBy("dims", "j", "k").agg(F.sum(F.col("product").cast("decimal(38,0)")).alias("product"))


def centred(products: np.ndarray) -> np.ndarray:
    """n * cross-products - sums * sums, in integers; ``products`` has the column of ones last."""
    n, sums = products[-1, -1], products[:-1, -1]
    return n * products[:-1, :-1] - np.multiply.outer(sums, sums)


def decomposed(matrix: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first components as columns, their eigenvalues and the trace of the covariance."""
    square = n * n
    covariance = np.array([[v / square for v in row] for row in matrix], np.float64)
    trace = sum(matrix.diagonal()) / square
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > NOTHING * trace, values, 0.0)
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, range(vectors.shape[1])] < 0, -1.0, 1.0), values, trace


def models(products: DataFrame, most: int = COMPONENTS) -> dict[int, Model]:
    """The model of each vector length; decomposed in tasks, of a size that doesn't depend on the rows."""

    def solve(group: pa.Table) -> pa.Table:
        d = group.column("dims")[0].as_py()
        full = np.zeros((d + 1, d + 1), object)
        for j, k, v in zip(*(group.column(c).to_pylist() for c in ("j", "k", "product")), strict=True):
            full[j, k] = full[k, j] = int(v)
        vectors, values, trace = decomposed(centred(full), full[d, d], most)
        return pa.table({"dims": pa.array([d], pa.int32()), "n": [full[d, d]], "sums": [[str(v) for v in full[:d, d]]], "vectors": [vectors.ravel().tolist()], "eigenvalues": [values.tolist()], "trace": [trace]})

    found = products.groupBy("dims").applyInArrow(solve, "dims int, n long, sums array<string>, vectors array<double>, eigenvalues array<double>, trace double").collect()
    return {r.dims: Model(r.n, [int(s) for s in r.sums], np.array(r.vectors).reshape(r.dims, -1), np.array(r.eigenvalues), r.trace) for r in found}


def _offsets(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """x minus the mean, and the exact sum of squares of n * x - sums."""
    top = max(abs(int(x.max())), abs(int(x.min()))) * model.n + max(map(abs, model.sums))
    kind = np.int64 if top.bit_length() * 2 + x.shape[1].bit_length() < 63 else object
    wide = x.astype(kind) * kind(model.n) - np.array(model.sums, kind) if kind is np.int64 else x.astype(object) * model.n - np.array(model.sums, object)
    return (wide / model.n).astype(np.float64), (wide * wide).sum(axis=1)


def _whitened(centre: np.ndarray, model: Model) -> np.ndarray:
    spread = np.where(model.values > 0, model.values, np.nan)
    return centre @ model.vectors / np.sqrt(spread)


def identity_errors(fit: DataFrame, known: dict[int, Model]) -> dict[int, float]:
    """By length, how far the covariance of the whitened fit list is from the identity."""

    def run(batches):
        total = {}
        for batch in batches:
            for d, _, x in _vectors(batch):
                z = _whitened(_offsets(x, known[d])[0], known[d])
                sums, squares = total.get(d, (0, 0))
                total[d] = sums + z.sum(axis=0), squares + z.T @ z
        for d, (sums, squares) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([sums.tolist()]), pa.array([squares.ravel().tolist()])], ["dims", "sums", "squares"])

    parts = fit.mapInArrow(run, "dims int, sums array<double>, squares array<double>")
    at = parts.select("dims", F.posexplode(F.concat("sums", "squares")).alias("i", "v")).groupBy("dims", "i").agg(F.sum("v").alias("v"))
    out = {}
    for row in at.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all")).collect():
        n, c = known[row.dims].n, len(known[row.dims].values)
        v = np.array([s.v for s in row["all"]])
        mean = v[:c] / n
        gap = np.abs(v[c:].reshape(c, c) / n - np.outer(mean, mean) - np.eye(c))
        out[row.dims] = float(np.nanmax(gap)) if not np.isnan(gap).all() else None
    return out


def whitened(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text for each usable row and component."""
    rows = quantised(vectors, id_column, column)
    fit = stored(rows.select("dims", "x").distinct())
    known = models(scatter(fit), most)
    for d, error in identity_errors(fit, known).items():
        known[d].error = error
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        for batch in batches:
            for d, at, x in _vectors(batch):
                model = known[d]
                centre, deviation = _offsets(x, model)
                z = _whitened(centre, model)
                m, c = z.shape
                each = lambda v: np.repeat(np.asarray(v), c)
                exact = [int(v) for v in deviation]
                long = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                by_row = pa.array(np.repeat(np.arange(m), c))
                flat = z.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each(at))),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * c, model.n, np.int64)),
                        long.take(by_row),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(np.tile(model.values / model.trace if model.trace else np.zeros(c), m)),
                        pa.array([model.error] * (m * c), pa.float64()),
                        pa.array([str(v) for v in exact], pa.string()).take(by_row),
                    ],
                    schema=schema,
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))
