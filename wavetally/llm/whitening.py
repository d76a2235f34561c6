"""Whitening directions of an embedding table from the singular values of its centred rows.

1. Every partition reduces its centred rows to a triangle R by blockwise QR; triangles are stacked and reduced again.
2. Householder reflections from both sides make R bidiagonal.
3. dqds, the differential quotient-difference algorithm with shifts, finds the singular values, small ones as
   accurately as large ones.
4. For each wanted value a twisted factorisation gives the singular vector, turned back by the reflections.

Steps 2 to 4 work on one square matrix of the embedding's dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.llm.tables import saved

EPS = np.finfo(float).eps
#: Rows that are reduced together.
_BLOCK = 4096
#: Partitions that triangles of the first round are dealt to, before the last round reduces one from each.
_FANIN = 32


# ---- one square matrix ----------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and the orthogonal V, with r = U B V^T."""
    a = np.array(r, float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """Unit vector u and value y: x - 2 u (u x) is (y, 0, ..., 0)."""
        scale = np.abs(x).max(initial=0.0)
        if scale == 0.0:
            return np.zeros_like(x), 0.0
        u = x / scale
        norm = np.sqrt(u @ u)
        y = -norm if u[0] >= 0 else norm
        u[0] -= y
        return u / np.sqrt(u @ u), y * scale

    for i in range(d):
        u, y = reflector(a[i:, i])
        a[i:, i + 1 :] -= 2 * np.outer(u, u @ a[i:, i + 1 :])
        a[i:, i] = 0.0
        a[i, i] = y
        if i < d - 2:
            u, y = reflector(a[i, i + 1 :])
            a[i + 1 :, i + 1 :] -= 2 * np.outer(a[i + 1 :, i + 1 :] @ u, u)
            a[i, i + 1 :] = 0.0
            a[i, i + 1] = y
            v[:, i + 1 :] -= 2 * np.outer(v[:, i + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """The qd array of B B^T - shift, and the values d, all of which are positive if that is."""
    to_q, to_e, all_d = [], [], []
    d = q[0] - shift
    for i in range(len(e)):
        all_d.append(d)
        s = d + e[i]
        to_q.append(s)
        if s == 0.0:
            to_e.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / s
            to_e.append(e[i] * t)
            d = d * t - shift
    all_d.append(d)
    to_q.append(d)
    return to_q, to_e, all_d


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, largest first.

    A step with shift 0 gives the diagonal 1/d of the inverse of B B^T, whose sum is the sum of the inverse
    eigenvalues; so 1 / sum(1/d) is a lower bound of the least of them and a safe shift. Without shift all terms are
    sums and products of numbers of one sign, so nothing cancels.
    """
    found: list[float] = []
    q0, e0 = np.square(diagonal, dtype=float).tolist(), np.square(above, dtype=float).tolist()
    tol = (4 * EPS) ** 2
    todo = [(q0, e0, 0.0)] if q0 else []
    while todo:
        q, e, moved = todo.pop()
        while True:
            cut = next((i for i in reversed(range(len(e))) if e[i] <= tol * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            plain = _qd_step(q, e, 0.0)
            least = min(plain[2])
            shift = 0.0 if least <= 0.0 else (1 - 1e-12) / sum(1 / d for d in plain[2])
            if moved + shift == moved:
                shift = 0.0
            shifted = _qd_step(q, e, shift) if shift > 0.0 else plain
            if min(shifted[2]) < 0.0:
                shift, shifted = 0.0, plain
            q, e, moved = shifted[0], shifted[1], moved + shift
    return np.array(sorted(found, reverse=True))


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Vectors of B^T B near the eigenvalue ``value``, that of the best twist first.

    L D L^T - value is factored downwards (stationary) and upwards (progressive); where the two meet, at the twist,
    what is left over is smallest for the right place.
    """
    n = len(diagonal)
    tiny = EPS * EPS * max(value, np.max(diagonal**2, initial=0.0), 1e-300)
    d = np.maximum(diagonal**2, tiny)
    low = above * np.where(diagonal == 0.0, np.sqrt(tiny), diagonal)[:-1] / d[:-1]

    def safe(x: float) -> float:
        return x if abs(x) > tiny else tiny

    down, up = np.zeros(n - 1), np.zeros(n - 1)
    s = np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        plus = safe(s[i] + d[i])
        down[i] = d[i] * low[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - value
    p = np.zeros(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        minus = safe(d[i] * low[i] ** 2 + p[i + 1])
        t = d[i] / minus
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    for k in np.argsort(gamma, kind="stable"):
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        norm = np.sqrt(z @ z)
        if np.isfinite(norm):
            yield z / norm


def _vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: right singular vectors of the bidiagonal matrix, orthogonal also where values nearly coincide.

    Vectors of well separated values are nearly orthogonal by themselves; what they hold of the ones before is taken
    out. Where little is left of one, as may be with close values, the next best twist is tried.
    """
    n = len(diagonal)
    out = np.zeros((n, len(values)))
    for j, value in enumerate(values):
        units = (np.eye(n)[i] for i in range(n))
        for z in chain(_twisted(diagonal, above, value), units):
            whole = z
            for _ in range(2):
                whole = whole - out[:, :j] @ (out[:, :j].T @ whole)
            norm = np.sqrt(whole @ whole)
            if norm > 0.1:
                out[:, j] = whole / norm
                break
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of the scaled components, exact
    values: np.ndarray  # eigenvalues, largest first
    total: float  # trace of the covariance
    directions: np.ndarray  # columns: unit eigenvectors

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows."""
        return centred(x, self.n, self.sums) @ self.directions / np.sqrt(self.values)


def _largest(x: np.ndarray) -> int:
    """The largest magnitude; that of the smallest integer is none of 64 bits."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, from whole numbers: n * x - sums has a single rounding where it is below 2**63."""
    if n * _largest(x) + max(map(abs, sums), default=0) < 1 << 63:
        return (n * x - np.array(sums, np.int64)) / n
    return x - np.array([s / n for s in sums])


def solve(r: np.ndarray, n: int, sums: list[int], components: int) -> Whitening:
    """Directions of the largest eigenvalues of R^T R / n; those without variance are left out."""
    diagonal, above, v = bidiagonal(r)
    squares = dqds(diagonal, above)
    total = float(np.square(r).sum()) / n
    # what rounding leaves of a singular value of zero
    floor = (len(squares) * EPS) ** 2 * squares.max(initial=0.0)
    top = squares[:components]
    top = top[top > floor]
    directions = v @ _vectors(diagonal, above, top)
    if directions.size:  # either sign will do, but always the same
        directions *= np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(top))] < 0, -1.0, 1.0)
    return Whitening(n, sums, top / n, total, directions)


# ---- tables ---------------------------------------------------------------------------------------------------------


def scaled(embedding: str = "embedding") -> Column:
    """floor(256 * component) of every component; null where the vector is null or holds null or NaN or infinity."""
    good = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(good, F.transform(embedding, lambda c: F.floor(256 * c.cast("double")).cast("bigint")))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _triangles(dimension: int, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dimension))
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            for start in range(0, len(x), _BLOCK):
                r = np.linalg.qr(np.vstack([r, centred(x[start : start + _BLOCK], n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def _stacked(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dimension))
        for batch in batches:
            for one in batch.column("r"):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(one.as_py()).reshape(-1, dimension)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of ``vectors`` (a saved table, ``x ARRAY<BIGINT>``, all of one length); None without rows.

    To the driver come a sum for each dimension and one triangle, both of the dimension's size.
    """
    sums = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    rows = sorted(sums.collect())
    if not rows:
        return None
    n, totals = rows[0].n, [int(r.s) for r in rows]
    d = len(totals)
    parts = vectors.select("x").mapInArrow(_triangles(d, n, totals), "r binary")
    fewer = parts.repartition(_FANIN).mapInArrow(_stacked(d), "r binary")
    one = fewer.repartition(1).mapInArrow(_stacked(d), "r binary").first()
    r = np.frombuffer(one.r).reshape(-1, d)
    square = np.zeros((d, d))
    square[: len(r)] = r
    return solve(square, n, totals, components)


def _products(w: Whitening, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        total = np.zeros((k, k))
        for batch in batches:
            z = w.project(_matrix(batch.column("x"), dimension))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"]
        )

    return run


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, in its worst entry.

    Whitened rows are centred already, exactly but for rounding.
    """
    k = len(w.values)
    sums = vectors.select("x").mapInArrow(_products(w, len(w.sums)), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    cov = np.zeros(k * k)
    for row in sums.collect():  # one row for each two components
        cov[row.i] = row.v / w.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0.0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - sums)^2, exact; None beyond 63 bits."""
    high = n * _largest(x) + max(map(abs, sums), default=0)
    if high * high * max(1, len(sums)) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(w: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        explained = w.values / w.total
        for batch in batches:
            x = _matrix(batch.column("x"), len(w.sums))
            z = w.project(x)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, w.n)),
                    pa.array(_deviations(x, w.n, w.sums), pa.int64()).take(at),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Per row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, or hold null or a component that is not finite, take no part; components become
    floor(256 * c). The whitening is fitted on every distinct vector once and applied to all rows. Components are
    numbered from 1 by falling eigenvalue; those without variance (equal or too few vectors) have no rows.
    ``deviation`` is null beyond 63 bits, components beyond them count as the largest or smallest number they hold.
    If vectors differ in length, those of the most frequent one (of equals the longest) take part. Null ids stay,
    repeated rows have a result each, further columns are not read; an empty table gives an empty one.
    """
    spark = embeddings.sparkSession
    kind = dict(embeddings.dtypes)["vec_id"]
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    rows = embeddings.select("vec_id", scaled().alias("x")).filter("size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == lengths.d)
    fitted = saved(rows.select("x").distinct(), "vectors")
    w = fit(fitted, components)
    if not len(w.values):
        return spark.createDataFrame([], schema)
    return rows.mapInArrow(_whitened(w, identity_error(fitted, w)), schema)
