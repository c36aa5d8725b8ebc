"""Operator 11: whitening of embeddings, with exact cross-products from bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom.llm.common import discard, map_batches, slices, table

#: Rows whose bit planes are packed at once (64 to a word); cells of a result array that are filled at once.
AT_ONCE, CELLS_AT_ONCE = 8192, 1 << 18
#: Integers beyond this have no exact double: vectors with such parts are not fitted, and have no result.
EXACT = 2**53


@dataclass
class Model:
    """Exact sums of the fit list of vectors of one length, and the components found from them."""

    n: int
    sums: list[int]
    components: np.ndarray  # a unit eigenvector in each row
    eigenvalues: np.ndarray
    explained: np.ndarray


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its parts are finite."""
    return F.coalesce(~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf")))), F.lit(False))


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Words [dimension, plane, word] of whole numbers [row, dimension] from 0 on: bit r of the words is that of row r."""
    planes = max(1, int(x.max(initial=0)).bit_length())
    bits = (x.T[:, None, :] >> np.arange(planes, dtype=np.uint64)[None, :, None] & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits, axis=2)
    return np.pad(packed, ((0, 0), (0, 0), (0, -packed.shape[2] % 8))).view(np.uint64)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Sums over the rows of x[:, i] * x[:, j] as exact whole numbers (upper triangle), of int64 x [row, dimension].

    Each dimension is shifted by its least value; the AND of two bit planes has as many ones as rows have both
    bits, which count 2 ** (both places). The shifts are put back by the sums of the dimensions, which are those
    counts against a plane of ones.
    """
    low = x.min(axis=0)
    dims, n = x.shape[1], len(x)
    shifted = np.concatenate([np.ones((n, 1), np.uint64), (x - low).astype(np.uint64)], axis=1)
    words = bit_planes(shifted)
    planes = words.shape[1]
    most = (2 * planes + n.bit_length()) < 63
    weights = np.array([[1 << a + b for b in range(planes)] for a in range(planes)], np.int64 if most else object)
    out = np.zeros((dims + 1, dims + 1), object)
    few = max(1, CELLS_AT_ONCE // (planes * planes * words.shape[2]))
    for i in range(dims + 1):
        for j in range(i, dims + 1, few):
            both = words[i][None, :, None, :] & words[j : j + few][:, None, :, :]
            ones = np.bitwise_count(both).sum(axis=3, dtype=np.int64)
            out[i, j : j + few] = [int(v) for v in (ones.astype(weights.dtype) * weights).reshape(len(ones), -1).sum(axis=1)]
    sums, shift = out[0, 1:], np.array([int(v) for v in low], object)
    back = sums[:, None] * shift[None, :] + shift[:, None] * sums[None, :] + n * shift[:, None] * shift[None, :]
    out[1:, 1:] += back
    out[0, 1:] = sums + n * shift
    return out


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, i, j, total) of a task: exact sums of products of all its rows, i or j 0 standing for ones."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, None, AT_ONCE):
            for dims, x, _ in by_length(part, "x"):
                found = cross_products(x)
                total[dims] = total[dims] + found if dims in total else found
    for dims, found in total.items():
        i, j = np.triu_indices(dims + 1)
        value = pa.array([str(v) for v in found[i, j]]).cast(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), value], ["dims", "i", "j", "total"])


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows as a matrix, their places in the batch) for each length of the lists in a column; null and empty lists are passed over."""
    lists = batch.column(column)
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dims)
        values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(dims), values.reshape(-1, dims), at


def model_of(n: int, sums: list[int], products: dict[tuple[int, int], int], most: int) -> Model:
    """The components of exact sums: n * n times the covariance is a matrix of whole numbers, divided once each."""
    dims = len(sums)
    v = np.empty((dims, dims))
    for (i, j), total in products.items():
        v[i, j] = v[j, i] = (n * total - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    trace = sum(n * products[i, i] - sums[i] * sums[i] for i in range(dims)) / (n * n)
    rest = np.maximum(values[order], 0.0)
    rest[rest <= dims * np.finfo(float).eps * max(values.max(), 0.0)] = 0.0  # no variance but for rounding
    return Model(n, sums, vectors[:, order].T.copy(), rest, rest / trace if trace else np.zeros(len(order)))


def project(model: Model, x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """For whole rows x: the sums of (n * x - sums) ** 2, exactly, and (x - sums / n) on the components over the root of their eigenvalue (NaN without variance)."""
    small = model.n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in model.sums) < 2**63
    kind = np.int64 if small else object
    off = model.n * x.astype(kind) - np.array(model.sums, kind)
    if small and int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2**63:
        deviation = (off * off).sum(axis=1).tolist()
    else:
        deviation = [sum(v * v for v in row) for row in off.tolist()]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (off / model.n).astype(float) @ model.components.T / np.sqrt(model.eigenvalues)
    z[:, model.eigenvalues == 0] = np.nan
    return deviation, z


def whiten(spark: SparkSession, vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, components: int = 16) -> DataFrame:
    """(vec_id, n, deviation decimal(38, 0), whitened array<double>, explained array<double>, identity_error) for vectors (vec_id, embedding).

    Each part c becomes the whole number x = floor(scale * c) + offset. The fit list has each different vector once:
    n vectors with sums S. whitened holds x - S / n on the first `components` eigenvectors of the fit list's
    covariance (divisor n) by falling eigenvalue, over the root of the eigenvalue; explained the eigenvalues over the
    trace; deviation the exact sum of (n * x - S) ** 2. identity_error is measured on the whitened fit list: the
    largest absolute entry of its covariance minus the identity.

    Vectors that are null or hold null or non-finite parts give no row. Vectors of different lengths are whitened
    each by themselves; empty ones give empty arrays, n and deviation 0. Vectors with a part beyond 2 ** 53 after
    scaling are not fitted and have nulls. A component without variance (fewer different vectors than
    dimensions) has whitened null and explained 0, and takes no part in identity_error. Rows that repeat a vec_id,
    or have none, each give a row. An empty table gives no rows. Other columns are not read.

    Cross-products are sums of whole numbers from bit planes: each task sends one matrix for each length, and the order of
    sums does not matter. What comes to the driver is one matrix for each length of vectors.
    """
    grid = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + offset)
    rows = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    small = F.forall("embedding", lambda c: F.abs(c.cast("double") * scale) < EXACT)
    rows = rows.withColumn("x", F.when(small, grid)).select("vec_id", "x")
    fit = table(rows.where("size(x) > 0").select("x").distinct(), "whitening-fit")
    totals: dict[int, dict[tuple[int, int], int]] = {}
    sums = fit.mapInArrow(_scatter, "dims int, i int, j int, total decimal(38,0)").groupBy("dims", "i", "j").agg(F.sum("total").alias("total"))
    for r in sums.toLocalIterator():
        totals.setdefault(r["dims"], {})[r["i"], r["j"]] = int(r["total"])
    models = {}
    for dims, found in totals.items():
        products = {(i - 1, j - 1): v for (i, j), v in found.items() if i}
        models[dims] = model_of(found[0, 0], [found[0, k] for k in range(1, dims + 1)], products, components)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Sums of products of whitened parts, whose means are 0 but for rounding; j -1 has the sums themselves."""
        out = []
        for dims, x, _ in by_length(batch, "x"):
            z = project(models[dims], x)[1]
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            i, j = np.triu_indices(z.shape[1])
            total = z.T @ z
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["dims", "i", "j", "total"]))
        return pa.concat_batches(out)

    errors = dict.fromkeys(models, 0.0)
    spreads: dict[int, dict[tuple[int, int], float]] = {}
    for r in map_batches(fit, spread, "dims int, i int, j int, total double", most=AT_ONCE).groupBy("dims", "i", "j").agg(F.sum("total").alias("total")).toLocalIterator():
        spreads.setdefault(r["dims"], {})[r["i"], r["j"]] = r["total"]
    for dims, found in spreads.items():
        model = models[dims]
        k = len(model.eigenvalues)
        live = np.flatnonzero(model.eigenvalues > 0)
        mean = np.array([found[i, k] / model.n for i in range(k)])
        cov = np.array([[found[min(i, j), max(i, j)] / model.n - mean[i] * mean[j] for j in live] for i in live]).reshape(len(live), len(live))
        errors[dims] = float(np.abs(cov - np.eye(len(live))).max(initial=0.0))
    discard(fit)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        n, deviation, error = [None] * rows, [None] * rows, [None] * rows
        white, explained = [None] * rows, [None] * rows
        for k, size in enumerate(batch.column("x").value_lengths().to_pylist()):
            if size == 0:
                n[k], deviation[k], error[k], white[k], explained[k] = 0, "0", 0.0, [], []
        for dims, x, at in by_length(batch, "x"):
            model = models[dims]
            d, z = project(model, x)
            share = model.explained.tolist()
            for k, dev, row in zip(at.tolist(), d, z.tolist(), strict=True):
                n[k], deviation[k], error[k], explained[k] = model.n, str(dev), errors[dims], share
                white[k] = [None if v != v else v for v in row]
        arrays = [batch.column("vec_id"), pa.array(n, pa.int64()), pa.array(deviation, pa.string()).cast(pa.decimal128(38, 0)), pa.array(white, pa.list_(pa.float64())), pa.array(explained, pa.list_(pa.float64())), pa.array(error, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows, each, "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double", most=AT_ONCE)
