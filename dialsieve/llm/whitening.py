"""Whitening of embeddings: leading principal components of the distinct vectors, each of variance one.

Entries become whole numbers floor(256 * c) (saturated to a long).  The fit list holds each
distinct whole-number vector once (packed to two or eight bytes an entry, partial duplicates
dropped before the shuffle), so a vector that a third of the rows share counts once and is no
hot key.  Over it: exact whole sums, then the covariance of the entries centred by their
mean, as one matrix product per Arrow batch, summed per task and then row by row of the
matrix in a fixed order.  Nothing but the dimensions' square comes to the driver, where the
matrix is brought to tridiagonal form by Householder reflections, the leading eigenvalues
are bracketed by bisection on Sturm counts, and inverse iteration gives the eigenvectors,
those of close eigenvalues kept orthogonal to each other.  The components (dimensions x 4
numbers) go with the tasks that project all rows.

Defined results: rows without a vector, or with a null or non-finite entry, are dropped; a
vector shorter than the longest is filled up with zeros (an empty one is all zeros);
repeated rows and null ids are kept; without rows the result is empty; a component without
variance has ``whitened`` null, and ``explained`` is null when there is no variance at all;
``deviation`` is null where it passes a long; ``identity_error`` looks at the components
that have variance (null without any).  More than ``MAX_DIMS`` dimensions raise.  Only
the id and vector columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SCALE = 256.0
COMPONENTS = 4
#: Dimensions whose square the driver and each task hold (2048: 32 MB).
MAX_DIMS = 2048
#: Eigenvalues closer than this share of the largest have their vectors kept orthogonal.
CLUSTER = 1e-3

_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1


# --- whole-number vectors ------------------------------------------------------

def grid(col: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(rows that remain, [(their positions, whole-number matrix) per length of vector])."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    if n == 0:
        return np.zeros(0, np.int64), []
    offsets = np.asarray(col.offsets, dtype=np.int64)
    flat = col.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    values = np.asarray(flat.cast(pa.float64()).fill_null(math.nan), dtype=np.float64)
    lengths = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = np.asarray(col.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    out = []
    for length in np.unique(lengths[keep]):
        rows = np.flatnonzero(keep & (lengths == length))
        x = np.floor(SCALE * values[offsets[rows][:, None] + np.arange(length)])
        whole = np.where(np.abs(x) < 2.0 ** 63, x, 0).astype(np.int64)
        whole[x >= 2.0 ** 63] = _LONG_MAX
        whole[x <= -2.0 ** 63] = _LONG_MIN
        out.append((rows, whole))
    return np.flatnonzero(keep), out


def pack(whole: np.ndarray) -> list[bytes]:
    """Each row as bytes, equal exactly for rows that are equal but for zeros at the end."""
    n, length = whole.shape
    used = np.where(whole != 0, np.arange(1, length + 1), 0).max(axis=1, initial=0)
    wide = ((whole < -(1 << 15)) | (whole >= 1 << 15)).any(axis=1)
    out = [b""] * n
    for kind, size in (("<i2", 2), ("<i8", 8)):
        rows = np.flatnonzero(wide == (size == 8))
        data, step = whole[rows].astype(kind).tobytes(), length * size
        for k, (r, u) in enumerate(zip(rows.tolist(), used[rows].tolist())):
            out[r] = bytes([size]) + data[k * step:k * step + u * size]
    return out


def unpack(col: pa.Array, dims: int) -> np.ndarray:
    """Whole-number matrix of packed rows, filled up with zeros to ``dims`` columns."""
    buf, offsets = C.flat_bytes(col)
    out = np.zeros((len(col), dims), np.int64)
    lengths = np.diff(offsets)
    kinds = buf[offsets[:-1]] if len(col) else lengths
    for size in np.unique(kinds):
        for length in np.unique(lengths[kinds == size]):
            rows = np.flatnonzero((kinds == size) & (lengths == length))
            raw = buf[(offsets[rows] + 1)[:, None] + np.arange(length - 1)]
            out[rows, :(length - 1) // size] = np.ascontiguousarray(raw).view(f"<i{size}") if length > 1 else 0
    return out


def fit_list(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x, dims) of every distinct whole-number vector; ``dims`` is its longest spelling."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, dims = [], []
            for rows, whole in grid(b.column(0))[1]:
                xs += pack(whole)
                dims += [whole.shape[1]] * len(rows)
            if xs:
                one = pa.table({"x": pa.array(xs, pa.binary()), "dims": pa.array(dims, pa.int32())})
                yield from one.group_by("x").aggregate([("dims", "max")]).rename_columns(["x", "dims"]).to_batches()
    rows = df.select(F.col(vector).alias("vector")).mapInArrow(packed, "x binary, dims int")
    # the order inside a partition is fixed, so sums over it repeat
    return rows.groupBy("x").agg(F.max("dims").alias("dims")).sortWithinPartitions("x")


# --- sums and covariance --------------------------------------------------------

def exact_sums(fit: DataFrame, dims: int) -> list[int]:
    """Sum of every dimension, as whole numbers of any size."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for b in batches:
            x = unpack(b.column(0), dims)
            small = max(-int(x.min(initial=0)), int(x.max(initial=0))) < 1 << 40       # a batch has fewer than 2**23 rows
            part = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
            total = [t + int(p) for t, p in zip(total, part)]
        if any(total):
            yield pa.record_batch({"i": pa.array(range(dims), pa.int32()), "s": pa.array([str(t) for t in total])})
    out = [0] * dims
    # decimal of 38 digits: 19 for an entry, 19 for the number of rows
    for r in fit.select("x").mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["i"]] = int(r["s"])
    return out


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list's entries, centred before multiplying, divisor n."""
    dims = len(sums)
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((dims, dims)), False
        for b in batches:
            d = unpack(b.column(0), dims) - mean
            total += d.T @ d
            any_rows = any_rows or len(d) > 0
        if any_rows:
            task = TaskContext.get().partitionId()
            yield pa.record_batch({"i": pa.array(range(dims), pa.int32()), "task": pa.array([task] * dims, pa.int32()),
                                   "v": pa.array([row.tobytes() for row in total], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        total = np.zeros(dims)
        for v in group.column("v"):
            total += np.frombuffer(v.as_py(), np.float64)
        return pa.table({"i": group.column("i")[:1].cast(pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    rows = (fit.select("x").mapInArrow(products, "i int, task int, v binary")
            .groupBy("i").applyInArrow(add, "i int, v binary").collect())          # one row per dimension
    out = np.zeros((dims, dims))
    for r in rows:
        out[r["i"]] = np.frombuffer(bytes(r["v"]), np.float64)
    return (out + out.T) / (2 * n)


# --- leading eigenvectors of a symmetric matrix -----------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, next diagonal, reflectors) of the matrix after Householder reflections."""
    a, reflectors = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        norm = float(np.linalg.norm(v))
        if norm == 0.0 or not np.any(v[1:]):
            reflectors.append(np.zeros_like(v))
            continue
        alpha = -math.copysign(norm, v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        p -= (v @ p) * v
        block -= 2.0 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = alpha
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_count(d: list[float], e2: list[float], x: float, tiny: float) -> int:
    """Number of eigenvalues of the tridiagonal matrix below ``x``."""
    count, q = 0, 1.0
    for i, di in enumerate(d):
        q = di - x - (e2[i - 1] / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, by bisection until no number lies between."""
    off = np.concatenate([[0.0], np.abs(e), [0.0]])
    radius = off[:-1] + off[1:]
    size = float(np.max(np.abs(d) + radius)) if len(d) else 0.0
    if size == 0.0:
        return [0.0] * k
    tiny = size * 1e-300 if size > 1e-8 else np.finfo(float).tiny
    dl, e2 = d.tolist(), (e * e).tolist()
    out, top = [], float(np.max(d + radius)) + 4e-16 * size
    for i in range(k):
        low, high, want = float(np.min(d - radius)) - 4e-16 * size, top, len(dl) - i    # want - 1 or fewer lie below
        while True:
            mid = 0.5 * (low + high)
            if mid <= low or mid >= high:
                break
            if sturm_count(dl, e2, mid, tiny) >= want:
                high = mid
            else:
                low = mid
        out.append(0.5 * (low + high))
        top = high
    return out


def _solve(d: list[float], e: list[float], shift: float, b: list[float], tiny: float) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges."""
    n = len(d)
    main, up, up2, b = [x - shift for x in d], [*e, 0.0], [0.0] * n, list(b)
    for i in range(n - 1):
        low, nxt, nxt_up = e[i], main[i + 1], up[i + 1]
        if abs(low) > abs(main[i]):                       # exchange rows i and i + 1
            main[i], up[i], up2[i], row = low, nxt, nxt_up, (main[i], up[i])
            b[i], b[i + 1] = b[i + 1], b[i]
            f = row[0] / main[i]
            main[i + 1], up[i + 1] = row[1] - f * up[i], -f * up2[i]
        else:
            f = low / main[i] if main[i] else 0.0
            main[i + 1] = nxt - f * up[i]
        b[i + 1] -= f * b[i]
    x = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > tiny else math.copysign(tiny, main[i])
        x[i] = (b[i] - up[i] * x[i + 1] - up2[i] * x[i + 2]) / pivot
        if abs(x[i]) > 1e150:                             # only the direction counts
            x = [v * 1e-150 for v in x]
            b = [v * 1e-150 for v in b]
    return np.array(x[:n])


def leading_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k largest eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix;
    the largest entry of each vector is positive."""
    n = len(matrix)
    k = min(k, n)
    size = float(np.abs(matrix).max()) if n else 0.0
    if size == 0.0:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, reflectors = tridiagonal(matrix / size)
    values = leading_eigenvalues(d, e, k)
    tiny = np.finfo(float).eps * max(1.0, float(np.abs(d).max()))
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(0)                        # fixed start vectors
    dl, el = d.tolist(), e.tolist()
    for i, value in enumerate(values):
        near = [vectors[j] for j in range(i) if values[j] - value <= CLUSTER * max(abs(values[0]), tiny)]
        x = rng.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                for v in near:
                    x = x - (v @ x) * v
            x = x / np.linalg.norm(x)
            x = _solve(dl, el, value, x.tolist(), tiny)
            x = x / np.linalg.norm(x)
        for _ in range(2):
            for v in near:
                x = x - (v @ x) * v
            x = x / np.linalg.norm(x)
        vectors.append(x)
    out = np.array(vectors).T
    for r in reversed(range(len(reflectors))):
        v = reflectors[r]
        out[r + 1:] -= 2.0 * np.outer(v, v @ out[r + 1:])
    out /= np.linalg.norm(out, axis=0)
    out *= np.sign(out[np.abs(out).argmax(axis=0), np.arange(k)])
    return np.array(values) * size, out


# --- the operator ---------------------------------------------------------------

@dataclass
class Whitening:
    """What the projection needs: of the size of dimensions x components."""
    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def live(self) -> list[bool]:
        """Components with variance beyond rounding."""
        floor = self.dims * np.finfo(float).eps * max(self.values, default=0.0)
        return [v > floor for v in self.values]

    def project(self, whole: np.ndarray) -> np.ndarray:
        """Whitened components of whole-number rows (NaN for a component without variance)."""
        mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.live(), 1.0 / np.sqrt(np.maximum(self.values, 0.0)), np.nan)
            return ((whole - mean) @ self.vectors) * scale

    def deviation(self, whole: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)**2, exact; None beyond a long."""
        sums = np.array([float(s) for s in self.sums])
        rough = ((self.n * whole.astype(np.float64) - sums) ** 2).sum(axis=1)
        fits = rough < 9.0e18
        out: list[int | None] = [None] * len(whole)
        at = np.flatnonzero(fits)
        if len(at):
            narrow = self.n * max(1, -int(whole[at].min(initial=0)), int(whole[at].max(initial=0))) < 1 << 62 and max(map(abs, self.sums), default=0) < 1 << 62
            x = whole[at] if narrow else whole[at].astype(object)
            y = self.n * x - np.array(self.sums, dtype=np.int64 if narrow else object)
            for i, v in zip(at.tolist(), (y * y).sum(axis=1).tolist() if self.dims else [0] * len(at)):
                out[i] = int(v)
        for i in np.flatnonzero(~fits & (rough < 9.5e18)).tolist():
            v = sum((self.n * int(x) - s) ** 2 for x, s in zip(whole[i], self.sums))
            out[i] = v if v <= _LONG_MAX else None
        return out


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors; None when no row remains."""
    spark = C.prepare(df.sparkSession)
    folder = C.shared_folder(spark, "fit-list")
    fit_list(df, vector).write.parquet(folder)
    rows = spark.read.parquet(folder)
    n, dims = rows.agg(F.count(F.lit(1)), F.max("dims")).first()
    if not n:
        return None
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} dimensions, more than {MAX_DIMS}")
    if not dims:
        return Whitening(n, [], [], np.zeros((0, 0)), 0.0)
    sums = exact_sums(rows, dims)
    cov = covariance(rows, n, sums)
    values, vectors = leading_eigen(cov, components)
    model = Whitening(n, sums, values.tolist(), vectors, float(np.trace(cov)))
    live = [i for i, ok in enumerate(model.live()) if ok]
    if live:
        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = model.project(unpack(b.column(0), dims))
                yield pa.record_batch({f"w{i}": pa.array(w[:, i]) for i in live})
        # Spark's covariance merges centred moments; one row comes back
        pairs = [(i, j) for i in live for j in live if i <= j]
        row = (rows.select("x").mapInArrow(projected, ", ".join(f"w{i} double" for i in live))
               .agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first())
        model.identity_error = max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs))
    return model


def whiten(df: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, whitened array<double>) of every row that remains."""
    kind = df.schema[id].dataType
    schema = T.StructType([T.StructField(id, kind), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, whole in grid(b.column(1))[1]:
                if whole.shape[1] < model.dims:
                    whole = np.pad(whole, ((0, 0), (0, model.dims - whole.shape[1])))
                w = model.project(whole)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(model.deviation(whole), pa.int64()),
                     pa.ListArray.from_arrays(ends, flat)], [id, "deviation", "whitened"])
    return df.select(F.col(id), F.col(vector)).mapInArrow(project, schema)


def components_of(whitened: DataFrame, model: Whitening | None, id: str = "vec_id") -> DataFrame:
    """One row per row and component, with the fit's figures."""
    shown = whitened.select(id, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    trace = model.trace if model else 0.0
    share = [v / trace if trace > 0 else None for v in model.values] if model else []
    of = F.element_at(F.array(*[F.lit(s).cast("double") for s in [*share, None]]), F.col("at") + 1)
    return shown.select(id, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
                        "deviation", "whitened", of.alias("explained"),
                        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))
