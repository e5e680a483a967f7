"""Whitening of embeddings on their leading components, found by slicing the spectrum.

Vectors are turned into whole numbers, so everything that is added up over rows is exact and the same in every run: sums, and the covariance of the
distinct vectors as a fraction. Rows are centred on the whole numbers next to the mean before they are multiplied; what the mean has beside
those is taken off exactly afterwards. Tasks return sums for pairs of dimensions only, which Spark adds; the driver holds one matrix of d x d.

On that matrix the number of negative pivots of an LDLᵀ factoring of ``V - s`` is the number of eigenvalues below ``s`` (Sylvester's law of inertia). Such
counts part the axis until each leading eigenvalue has an interval of its own; Rayleigh quotient iteration, which converges cubically, finds the pair inside, and
two more counts just beside the value certify its number. Eigenvalues that no interval can part in double precision share theirs; their vectors are made orthogonal.

Defined cases: vectors that are null or hold null, NaN or infinite entries are dropped; shorter vectors count as if zeros followed; entries beyond
the range of a long are cut to it; repeated vectors count once in the fit list and every row of them is whitened; ids may be null or repeated; an empty table gives
no row. There are as many components as dimensions, four at most; one along which nothing varies has ``whitened`` null, and ``explained`` is null
where no dimension varies. A ``deviation`` beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.llm.common import materialize, ship

COMPONENTS = 4
SCALE = 256
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53
#: An eigenvalue below this share of the largest counts as none: it is rounding.
NOTHING = 1e-13


def quantised(rows: DataFrame, vector: str, id_col: str) -> DataFrame:
    """``vec_id, x``: vectors that are whole, as arrays of longs."""
    v = F.col(vector)
    whole = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    limit = float((1 << 63) - 1024)
    return rows.filter(whole).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(limit)), F.lit(-limit)))).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of longs as rows of a matrix, zeros after the shorter ones."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return flat.reshape(len(column), d)
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = flat
    return out


def _products(y: np.ndarray) -> np.ndarray:
    """yᵀy exactly: in double precision while every sum is a whole number below 2^53, else with whole numbers of any size."""
    most = int(np.abs(y).max(initial=0)) if y.dtype != object else EXACT
    if most and most < EXACT and most * most * len(y) < EXACT:
        part = y.astype(np.float64)
        return (part.T @ part).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def _sums(fit: DataFrame, d: int, centre: list[int] | None) -> dict[int, int]:
    """Exact sums over the fit list, added up by Spark: of each dimension (without a centre), or of centred products by ``i * d + j`` with i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centre or [0] * d, object)
        small = all(abs(c) < 1 << 61 for c in at)
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if centre is None:
                part = x.sum(axis=0, dtype=np.int64).astype(object) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0)
            else:
                y = x - at.astype(np.int64) if small and np.abs(x).max(initial=0) < 1 << 61 else x.astype(object) - at
                part = _products(y)
            total = part if total is None else total + part
        if total is None:
            return
        keys = np.arange(d) if centre is None else np.flatnonzero(np.triu(np.ones((d, d), bool)))
        values = [Decimal(int(v)) for v in np.asarray(total, object).reshape(-1)[keys]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.decimal128(38, 0))], names=["cell", "value"])

    parts = fit.select("x").mapInArrow(run, "cell bigint, value decimal(38,0)")
    return {r.cell: int(r.value) for r in parts.groupBy("cell").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()}


def inertia(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues below ``shift``: negative pivots of an LDLᵀ factoring with pivots of one or two rows (Bunch and Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, below, alpha = len(a), 0, 0, (1 + 17**0.5) / 8
    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most = abs(a[r, k]) if r > k else 0.0
        size = 1
        if max(abs(a[k, k]), most) > 0 and abs(a[k, k]) < alpha * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most**2:
                if abs(a[r, r]) >= alpha * row.max():
                    _swap(a, k, r)
                else:
                    size = 2
                    _swap(a, k + 1, r)
        if size == 1:
            pivot = a[k, k]
            below += pivot < 0
            if pivot != 0:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k] / pivot)
        else:
            block = a[k : k + 2, k : k + 2]
            below += 1  # such a block has one eigenvalue of each sign
            a[k + 2 :, k + 2 :] -= a[k + 2 :, k : k + 2] @ np.linalg.solve(block, a[k : k + 2, k + 2 :])
        k += size
    return int(below)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def leading_pairs(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit vectors as columns, of a symmetric matrix without negative eigenvalues."""
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    wanted = min(most, d)
    if norm == 0.0:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    v = v / norm
    eps = np.finfo(float).eps * max(d, 16)
    above = lambda s: d - inertia(v, s)
    values, vectors = [], []
    rng = np.random.default_rng(0)
    while len(values) < wanted:
        k = len(values)  # the next is the eigenvalue that has k above it
        low, high = -eps, (values[-1] + 4 * eps if values else 1.0 + eps)
        n_low, n_high = d, above(high) if values else 0
        while True:
            narrow = high - low <= 4 * eps
            if narrow or (n_low, n_high) == (k + 1, k):
                off, value, vector = _pair(v, low, high, np.array(vectors).reshape(k, d), rng, eps)
                if narrow or off <= eps:
                    break  # else a neighbour outside is nearer to the middle: narrow the interval further
            middle = (low + high) / 2
            n = above(middle)
            if n > k:
                low, n_low = middle, n
            else:
                high, n_high = middle, n
        if vector is None or not (above(value + 8 * eps) <= k < above(value - 8 * eps)):
            raise ArithmeticError(f"the counts beside component {k + 1} do not certify its number")
        values.append(value)
        vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")  # within a cluster values may differ by rounding
    return np.array(values)[order] * norm, np.array(vectors)[order].T


def _pair(v: np.ndarray, low: float, high: float, known: np.ndarray, rng: np.random.Generator, eps: float) -> tuple[float, float, np.ndarray | None]:
    """``(residual, value, vector)`` of an eigenpair with its value in an interval, if one is met: two steps of inverse iteration from the middle, then with the Rayleigh quotient as the shift while that stays inside."""
    d = len(v)

    def clean(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - known.T @ (known @ x)
        return x / np.linalg.norm(x)

    x, shift, best = clean(rng.standard_normal(d)), (low + high) / 2, (np.inf, np.nan, None)
    for turn in range(12):
        try:
            y = np.linalg.solve(v - shift * np.eye(d), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue: a hair beside it
            y = np.linalg.solve(v - (shift + 2 * eps) * np.eye(d), x)
        if not np.isfinite(y).all():
            break
        x = clean(y / np.abs(y).max())
        value = float(x @ v @ x)
        off = float(np.linalg.norm(v @ x - value * x))
        if low - 4 * eps <= value <= high + 4 * eps and off < best[0]:
            best = (off, value, x)
        if best[0] <= eps / 16 and turn > 2:
            break
        inside = low - eps <= value <= high + eps
        shift = value if turn >= 1 and inside else (low + high) / 2
    return best


def whiten(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every whole vector and each leading component."""
    spark = rows.sparkSession
    ship(spark)
    schema = f"vec_id {rows.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    xs = materialize(quantised(rows, vector, id_col), "whitening-rows")
    fit = materialize(xs.select("x").distinct(), "whitening-fit")  # copies meet before the shuffle
    n, d = fit.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not d:
        return spark.createDataFrame([], schema)
    totals = _sums(fit, d, None)
    s = [totals.get(j, 0) for j in range(d)]
    centre = [(2 * t + n) // (2 * n) for t in s]  # the whole number next to the mean
    rest = [t - n * c for t, c in zip(s, centre)]  # sums of centred entries
    cells = _sums(fit, d, centre)
    v = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = float(Fraction(n * cells.get(i * d + j, 0) - rest[i] * rest[j], n * n))
    values, vectors = leading_pairs(v, components)
    trace = float(sum(Fraction(n * cells.get(i * d + i, 0) - rest[i] * rest[i], n * n) for i in range(d)))
    kept = values > NOTHING * max(float(values.max()), 0.0)
    scale = np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), np.nan)
    mean = np.array([float(Fraction(r, n)) for r in rest])
    constant = sum(r * r for r in rest)

    def project(x: np.ndarray) -> np.ndarray:
        """Whitened rows; each is added up by itself, so equal vectors give equal values in every batch."""
        y = (x - np.array(centre, np.int64)).astype(np.float64) - mean
        return np.stack([(y * vectors[:, k]).sum(axis=1) * scale[k] for k in range(len(values))], axis=1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(values) + 1, len(values) + 1))
        for batch in batches:
            w = project(_matrix(batch.column(0), d))
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["cell", "value"])

    added = {r.cell: r.value for r in fit.mapInArrow(moments, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    m = np.array([added[i] for i in range((len(values) + 1) ** 2)]).reshape(len(values) + 1, -1) / n
    identity = np.abs(m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1]) - np.eye(len(values)))[np.ix_(kept, kept)]
    error = float(identity.max()) if kept.any() else None
    explained = [float(e) / trace if trace > 0 else None for e in values]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centre, np.int64)
        long_rest = np.array(rest, object)
        for batch in batches:
            ids, x = batch.column(0), _matrix(batch.column(1), d)
            w = project(x)
            y = x - c
            most, part = int(np.abs(y).max(initial=0)), max(map(abs, rest), default=0)
            if d * most * most < EXACT << 9 and d * most * part < EXACT << 9:
                squares, mixed = (y * y).sum(axis=1).astype(object), (y * long_rest.astype(np.int64)).sum(axis=1).astype(object)
            else:
                y = x.astype(object) - np.array(centre, object)
                squares, mixed = (y * y).sum(axis=1), (y * long_rest).sum(axis=1)
            deviation = pa.array([int(n * n * a - 2 * n * b + constant) for a, b in zip(squares, mixed)], pa.int64())
            for k in range(len(values)):
                k_ids, whole = len(ids), pa.array(w[:, k], from_pandas=True)  # NaN becomes null
                fixed = [pa.array([k + 1] * k_ids, pa.int32()), pa.array([n] * k_ids, pa.int64()), deviation, whole, pa.array([explained[k]] * k_ids, pa.float64()), pa.array([error] * k_ids, pa.float64())]
                yield pa.RecordBatch.from_arrays([ids, *fixed], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return xs.mapInArrow(results, schema)
