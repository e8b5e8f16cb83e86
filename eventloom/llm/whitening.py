"""Whitening of embeddings by their leading principal components (operator 13).

Each entry c becomes a whole number, floor(SCALE * c) + SHIFT. Sums by dimension are exact. The covariance is summed
where the rows are: every value is centred on the mean first (whole part and fraction apart, so nothing
cancels), batches give products, a partition passes one d x d table, and those are added by a grouped sum. The d x d
result is all that the driver sees; it is bounded by ``MOST_DIMENSIONS``, not by rows.

There, Householder reflections make it tridiagonal, Sturm counts bisect the ``components`` largest eigenvalues,
inverse iteration finds each one's vector, orthogonalised against the vectors before it whose eigenvalues lie
close by (a cluster), and the reflections turn the vectors back. The projection, d x ``components`` numbers, goes
to the tasks, where the rows stream through it; a second pass over what they gave measures how far its covariance is
from the identity.

Shuffles: partial tables of sums only, at most d rows of d numbers a partition; no row moves, so hot keys and repeated
vectors cost nothing. Memory: a batch, and d x d numbers a task.

Defined results: a row whose vector is null, or holds a null, an infinity, a NaN or an entry of ``MOST`` or more in size
(its whole number would not fit a long), is left out. The dimension is that of the most rows, of ties the larger; vectors of another
length, empty ones too, are left out. Components whose eigenvalue is no more than rounding (d ulps of the largest) have no unit variance and
are left out, so equal vectors, or a table of one row, give none. Repeated rows count once each. An empty table gives an empty
result. Equal eigenvalues give some orthonormal basis of their space, the same one for all rows. Extra columns stay, whatever their names;
``whitened`` and ``deviation`` are replaced. A deviation of over 38 digits is null.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm._shared import kept, packed

SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more count as not finite.
MOST = 2.0**52
MOST_DIMENSIONS = 4096
#: Eigenvalues closer than this share of the matrix's norm are a cluster.
CLUSTER = 1e-3
#: Rows worked on at once.
BATCH = 4096


# --- symmetric eigenproblem -------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors (for rows k + 1 on) of a symmetric matrix."""
    a, n, reflectors = a.astype(float).copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        norm = size * np.sqrt(((x / size) ** 2).sum()) if size else 0.0
        if norm == 0 or not x[1:].any():
            reflectors.append(np.zeros(n - k - 1))
            continue
        x[0] += norm if x[0] >= 0 else -norm
        v = x / np.abs(x).max()
        v /= np.sqrt(v @ v)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        w = p - (v @ p) * v
        inner -= 2 * (np.outer(v, w) + np.outer(w, v))
        below = a[k + 1 :, k]
        below -= 2 * v * (v @ below)
        a[k, k + 1 :] = below
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of ``x`` the number of eigenvalues under it: the negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for i, d in enumerate(diagonal):
        q = d - x - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring doubles' size."""
    n = len(diagonal)
    radius = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    slack = np.finfo(float).eps * max(np.abs(low).max(), np.abs(high).max()) * n
    low, high, rank = low - slack, high + slack, n - np.arange(k)
    for _ in range(2000):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        fewer = below(diagonal, off, middle) < rank  # so the rank-th smallest isn't under it
        low, high = np.where(fewer, middle, low), np.where(fewer, high, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) z = right by elimination with row exchanges; pivots are at least ``least``."""
    n = len(diagonal)
    u, u1, u2, z = np.zeros(n), np.zeros(n), np.zeros(n), right.copy()
    here, after = diagonal[0] - shift, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        lower, mid, right_of = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0
        if abs(here) >= abs(lower):
            here = here if abs(here) >= least else least
            f = lower / here
            u[i], u1[i] = here, after
            z[i + 1] -= f * z[i]
            here, after = mid - f * after, right_of
        else:
            f = here / lower
            u[i], u1[i], u2[i] = lower, mid, right_of
            z[i], z[i + 1] = z[i + 1], z[i] - f * z[i + 1]
            here, after = after - f * mid, -f * right_of
    u[n - 1] = here if abs(here) >= least else least
    for i in range(n - 1, -1, -1):
        z[i] -= (u1[i] * z[i + 1] if i + 1 < n else 0.0) + (u2[i] * z[i + 2] if i + 2 < n else 0.0)
        z[i] /= u[i]
        if abs(z[i]) > 1e150:
            z *= 1e-150
    return z


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors (rows) of the tridiagonal matrix for falling ``values``."""
    n, eps = len(diagonal), np.finfo(float).eps
    norm = max(np.abs(diagonal).max() + 2 * (np.abs(off).max() if n > 1 else 0.0), np.finfo(float).tiny)
    random, found = np.random.default_rng(13), np.zeros((len(values), n))
    shift = np.inf
    for j, value in enumerate(values):
        shift = min(value, shift - 10 * eps * norm) if j and shift - value < 10 * eps * norm else value
        close = [i for i in range(j) if abs(values[i] - value) <= CLUSTER * norm]
        z, settled = random.standard_normal(n), 0
        for _ in range(40):
            z = _solve(diagonal, off, shift, z / np.abs(z).max(), eps * norm)
            z /= np.abs(z).max()
            for _ in range(2):
                for i in close:
                    z -= (found[i] @ z) * found[i]
            size = np.sqrt(z @ z)
            if size < 1e-8:  # it lay in the cluster's span
                z, settled = random.standard_normal(n), 0
                continue
            z /= size
            rest = diagonal * z - value * z
            rest[:-1] += off * z[1:]
            rest[1:] += off * z[:-1]
            settled += np.sqrt(rest @ rest) <= 100 * eps * norm * np.sqrt(n)
            if settled == 3:
                break
        found[j] = z
    return found


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    if not len(a) or not k:
        return np.zeros(0), np.zeros((0, len(a)))
    if not a.any():
        return np.zeros(min(k, len(a))), np.eye(len(a))[:k]
    scale = np.abs(a).max()
    diagonal, off, reflectors = tridiagonal(a / scale)
    values = leading_values(diagonal, off, min(k, len(a)))
    out = vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        out[:, at + 1 :] -= 2 * np.outer(out[:, at + 1 :] @ v, v)
    return values * scale, out / np.sqrt((out * out).sum(axis=1, keepdims=True))


# --- sums over the rows ----------------------------------------------------


@dataclass(frozen=True)
class Model:
    """What the rows gave: their number, exact sums, trace, and leading eigenvalues with unit vectors as rows."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def _usable(column: str) -> Column:
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(MOST))
    return F.col(column).isNotNull() & F.forall(column, lambda e: F.coalesce(finite(e.cast("double")), F.lit(False)))


def usable(df: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """The rows that are whitened, their number and their vectors' length."""
    fine = df.where(_usable(column) & (F.size(column) > 0))
    top = fine.groupBy(F.size(column).alias("_d")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.desc("_d")).first()
    if top is None:
        return fine, 0, 0
    if top["_d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {top['_d']} entries; at most {MOST_DIMENSIONS}")
    return fine.where(F.size(column) == top["_d"]), top["_n"], top["_d"]


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """A batch's list column as rows of d doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _whole(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def exact_sums(vectors_of: DataFrame, d: int) -> tuple[int, ...]:
    """Exact sums by dimension of the whole numbers of a table's one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for piece in _pieces(batches):
            x = _whole(_vectors(piece.column(0), d))
            high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)
            total = [t + (int(h) << 31) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(decimal.Decimal, total), pa.decimal128(38, 0))], names=["i", "total"])

    rows = vectors_of.mapInArrow(run, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    return tuple(int(r["total"]) for r in sorted(rows))


def covariance(vectors_of: DataFrame, d: int, n: int, centred) -> np.ndarray:
    """The d x d covariance, divisor n, of ``centred(vectors)`` of a table's one column.

    What rounding left of the mean is taken off at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, rest = np.zeros((d, d)), np.zeros(d)
        for piece in _pieces(batches):
            y = centred(_vectors(piece.column(0), d))
            products += y.T @ y
            rest += y.sum(axis=0)
        width = pa.array(np.arange(0, (d + 1) * d + 1, d), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.ListArray.from_arrays(width, pa.array(np.vstack([products, rest]).ravel()))], names=["i", "row"])

    parts = vectors_of.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d + 1, d))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    left = out[d] / n
    out = out[:d] / n - np.outer(left, left)
    return (out + out.T) / 2


def fit(rows: DataFrame, column: str, n: int, d: int, components: int = 8) -> Model:
    """The model of usable rows; n and d are their number and length, as ``usable`` gives them."""
    only = rows.select(column)
    sums = exact_sums(only, d) if n else ()
    floor, part = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    v = covariance(only, d, n, lambda c: (_whole(c) - floor) - part) if n else np.zeros((0, 0))
    values, found = leading(v, components)
    real = values > (d * np.finfo(float).eps * values[0] if len(values) else 0)
    return Model(n, sums, float(np.trace(v)), values[real], found[real])


def _squares(c: np.ndarray, n: int, sums: tuple[int, ...]) -> list[decimal.Decimal | None]:
    """Exact sums over dimensions of (n * x - S) squared."""
    x = _whole(c)
    floor = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n for s in sums], object)
    off = x - floor
    if n * (int(np.abs(off).max(initial=0)) + 1) < 1 << 55 and len(sums) <= 128:
        y = np.abs(off * n - part.astype(np.int64))
        high, low = y >> 28, y & ((1 << 28) - 1)
        parts = zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist(), strict=True)
        found = [(a << 56) + (b << 29) + w for a, b, w in parts]
    else:
        y = off.astype(object) * n - part
        found = (y * y).sum(axis=1).tolist()
    return [decimal.Decimal(v) if v < 10**38 else None for v in found]


def project(rows: DataFrame, column: str, model: Model) -> DataFrame:
    """(_row, whitened array<double>, deviation decimal(38,0)) of usable rows; ``_row`` holds the row."""
    n, sums, d = model.n, model.sums, len(model.sums)
    floor, part = np.array([s // n for s in sums], np.int64) if n else None, np.array([s % n / n for s in sums]) if n else None
    to = (model.vectors / np.sqrt(model.values)[:, None]).T if len(model.values) else np.zeros((d, 0))
    k = to.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            c = _vectors(piece.column(1), d)
            out = ((_whole(c) - floor) - part) @ to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(c) * k + 1, k) if k else np.zeros(len(c) + 1, int), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists, pa.array(_squares(c, n, sums), pa.decimal128(38, 0))], names=["_row", "whitened", "deviation"])

    table = packed(rows).withColumn("_vector", F.col("_row")[column])
    schema = T.StructType([table.schema["_row"], T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    return table.mapInArrow(run, schema)


def whiten(df: DataFrame, column: str = "embedding", components: int = 8) -> tuple[DataFrame, Model, float]:
    """The usable rows with ``whitened`` and ``deviation``, the model, and the largest entry of whitened's covariance minus the identity."""
    rows, n, d = usable(df, column)
    model = fit(rows, column, n, d, components)
    if not n:
        done = packed(rows).withColumns({"whitened": F.array().cast("array<double>"), "deviation": F.lit(None).cast("decimal(38,0)")})
    else:
        done = kept(project(rows, column, model), "whitened")
    k = len(model.values)
    error = 0.0
    if k:
        means = [r["m"] for r in done.select(F.posexplode("whitened").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
        middle = np.array(means)
        error = float(np.abs(covariance(done.select("whitened"), k, n, lambda w: w - middle) - np.eye(k)).max())
    names = [c for c in df.columns if c not in ("whitened", "deviation")]
    return done.select(*[F.col("_row")[c].alias(c) for c in names], "whitened", "deviation"), model, error
