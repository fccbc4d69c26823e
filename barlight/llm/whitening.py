"""Whitening of embeddings by a bidiagonal qd solver.

Blocks of centred rows are reduced by QR, and the triangles of blocks by QR again, until one is left. Householder
reflections make it bidiagonal; dqds finds the squares of its singular values to high relative accuracy, one after the
other from the smallest, with shifts below it; a twisted factorisation of each gives its vector. What the driver holds is
a triangle of the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import stored, tidy

#: Steps of the grid and its offset, and components that are returned, fixed by the result contract.
GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Triangles that one task reduces to one, and the largest dimension (a triangle of it is held by the driver).
FAN, MOST_DIMENSIONS = 32, 4096
EPS = np.finfo(float).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, v of a square matrix: the diagonal and the one above it of u'rv, by Householder reflections."""
    r, d = r.astype(float).copy(), len(r)
    v = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        """The unit vector whose reflection sends x to its first axis."""
        size = np.linalg.norm(x)
        if size == 0 or len(x) == 1:
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := mirror(r[k:, k])) is not None:
            r[k:, k:] -= 2 * np.outer(w, w @ r[k:, k:])
        if k + 1 < d and (w := mirror(r[k, k + 1:])) is not None:
            r[k:, k + 1:] -= 2 * np.outer(r[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift is above the smallest value."""
    d, out, rest = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        t = q[k + 1] / top
        out.append(top)
        rest.append(e[k] * t)
        d = d * t - shift
    return None if d < 0 else ([*out, d], rest)


def qd_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    The shift is Newton's bound, the inverse of the trace of the inverse, which has no subtraction and stays below the
    smallest value. Blocks part where an off-diagonal is negligible; rank-deficient ones are moved off zero by 1e-100 of
    the largest entry.
    """
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(a))
    q0, e0 = np.maximum(np.abs(a / scale), 1e-100) ** 2, (b / scale) ** 2
    found, work = [], [(list(q0), list(e0), 0.0)]
    while work:
        q, e, sigma = work.pop()
        if len(q) == 1:
            found.append(sigma + q[0])
            continue
        cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (sigma + min(q[k], q[k + 1])) or e[k] < 1e-290), None)
        if cut is not None:
            work += [(q[:cut + 1], e[:cut], sigma), (q[cut + 1:], e[cut + 1:], sigma)]
            continue
        if 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]
        inverse, c = 0.0, 0.0
        for k, x in enumerate(q):
            c = (1 + (e[k - 1] * c if k else 0.0)) / max(x, 1e-290)
            inverse += c
        shift = (1 - 8 * len(q) * EPS) / inverse
        shift = 0.0 if shift < EPS * EPS * (sigma + min(q)) else shift
        while (step := _qd_step(q, e, shift)) is None:
            shift = shift / 2 if shift > EPS * EPS * sigma and shift > 1e-290 else 0.0
        work.append((*step, sigma + shift))
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of the bidiagonal's square for a value: factorised from both ends, joined where the remainder is
    least."""
    n, tiny = len(a), np.finfo(float).tiny
    scale = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) > 1e-100 * scale, a / scale, 1e-100)
    d, low, value = a * a, b / scale / a[:-1], value / scale**2
    away = lambda x: x if abs(x) > tiny else tiny
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, d[-1] - value
    for i in range(n - 1):
        down[i] = d[i] * low[i] / away(s[i] + d[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / away(d[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    rest = np.abs(np.nan_to_num(s + p + value, nan=np.inf))
    at = int(np.argmin(rest))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values of r, and the right vectors of the `most` largest as columns.

    Vectors of values that agree to 1e-6 are made orthogonal to each other. One that vanishes there, or that a matrix in
    parts has put into another part, is found anew by inverse iteration from an axis.
    """
    a, b, v = bidiagonal(r)
    values, d = qd_values(a, b), len(a)
    square = np.diag(a * a + np.r_[0.0, b * b]) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    found: list[np.ndarray] = []
    for k in range(min(most, d) if values[0] > 0 else 0):
        near = [found[i] for i in range(k) if values[i] - values[k] <= 1e-6 * values[i]]

        def apart(z: np.ndarray, near: list[np.ndarray] = near) -> np.ndarray:
            for x in [*near, *near]:
                z = z - x * (x @ z)
            return z

        good = lambda z, value=values[k]: np.linalg.norm(z) > 0.1 and np.linalg.norm(square @ z - value * z) <= 1e-11 * values[0] * np.linalg.norm(z)
        z = apart(np.nan_to_num(twisted_vector(a, b, values[k])))
        shifted = square - (values[k] + 4 * EPS * values[0]) * np.eye(d)
        for axis in range(d):
            if good(z):
                break
            z = apart(np.eye(d)[axis])
            for _ in range(3):
                z = apart(np.linalg.solve(shifted, z))
                z = z / max(np.linalg.norm(z), 1e-300)
        found.append(z / np.linalg.norm(z))
    return values, v @ np.array(found).reshape(-1, d).T


def grid(embeddings: DataFrame) -> DataFrame:
    """vec_id, x: the rows that can be used, their entries on the grid.

    Null vectors, empty ones and those with a null or non-finite entry go; so do vectors of another length than most
    have (ties: the longer one).
    """
    c = F.col("embedding")
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * GRID) + OFFSET)
    rows = embeddings.where(c.isNotNull() & (F.size(c) > 0) & whole).select("vec_id", x.alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common.d if common else 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame) -> np.ndarray:
    """Element by element sums of the arrays s; the driver gets one row for each place."""
    found = rows.select(F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = {r.at: r.s for r in found}
    return np.array([out[i] for i in range(len(out))])


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of the vectors and their exact sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(d + 1, np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            s += np.r_[len(x), x.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([s.tolist()], pa.list_(pa.int64()))], ["s"])

    n, *s = _summed(fit.mapInArrow(add, "s array<bigint>")).tolist()
    return int(n), [int(v) for v in s]


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x less the mean, from whole numbers: the mean's whole part is taken off before its fraction."""
    whole = np.array([v // n for v in s], np.int64)
    return (x - whole).astype(float) - np.array([v % n / n for v in s])


def triangle(fit: DataFrame, d: int, n: int, s: list[int]) -> np.ndarray:
    """R of the QR decomposition of all centred rows: a triangle a block, then FAN triangles into one, level by level."""

    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for x in blocks:
            for k in range(0, len(x), 4 * d):
                r = np.linalg.qr(np.vstack([r, x[k:k + 4 * d]]), mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduced(_centred(_matrix(b, d), n, s) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], ["id", "r"])

    def merged(table: pa.Table) -> pa.Table:
        r = reduced(np.frombuffer(t.as_py(), float).reshape(d, d) for t in table.column("r"))
        return pa.table({"id": pa.array([table.column("id")[0].as_py() // FAN], pa.int64()), "r": pa.array([r.tobytes()])})

    parts = stored(fit.mapInArrow(block, "id long, r binary"), "triangles")
    left = parts.agg(F.max("id")).first()[0] + 1
    while left > 1:
        parts = stored(parts.groupBy(F.expr(f"id div {FAN}")).applyInArrow(merged, "id long, r binary"), "triangles")
        left = -(-left // FAN)
    return np.frombuffer(bytes(parts.first().r), float).reshape(d, d)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    The fit takes each distinct vector once, so copies of one vector weigh nothing and a repeated row gets rows of its
    own. Components without variance (fewer distinct vectors than dimensions, or a single one) are left out; a table
    without usable rows gives none. A deviation above the range of long is null. Columns other than vec_id and embedding
    are not read.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stored(grid(embeddings.select("vec_id", "embedding")), "grid")
    one = rows.first()
    if one is None:
        return spark.createDataFrame([], schema)
    d = len(one.x)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions are more than {MOST_DIMENSIONS}")
    fit = stored(rows.select("x").distinct(), "fit")
    n, s = totals(fit, d)
    squares, vectors = directions(triangle(fit, d, n, s), components)
    some = int((squares[:vectors.shape[1]] > (d * n * EPS) ** 2 * squares[0]).sum()) if squares[0] > 0 else 0
    if not some:
        return spark.createDataFrame([], schema)
    onto = vectors[:, :some] / np.sqrt(squares[:some] / n)
    explained = squares[:some] / squares.sum()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(some * some + some)
        for batch in batches:
            w = _centred(_matrix(batch, d), n, s) @ onto
            out += np.r_[(w.T @ w).ravel(), w.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

    moments = _summed(fit.mapInArrow(spread, "s array<double>")) / n
    mean = moments[some * some:]
    error = float(np.abs(moments[:some * some].reshape(some, some) - np.outer(mean, mean) - np.eye(some)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        apart = [int(v) for v in np.abs(x).max(axis=0)] if len(x) else []
        if sum((n * m + abs(v)) ** 2 for m, v in zip(apart, s, strict=True) if apart) < 2**63:
            return ((n * x - np.array(s, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            w, k = _centred(x, n, s) @ onto, len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(k), some)))
            apart = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), some)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), k)), pa.array(np.full(k * some, n, np.int64)), apart,
                 pa.array(w.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * some, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, schema)


@tidy
def op13_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_qd_whitening": op13_qd_whitening}
ORACLES: dict[str, str] = {}
