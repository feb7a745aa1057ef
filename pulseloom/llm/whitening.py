"""Whitening of vectors through singular values of a bidiagonal matrix, without ever forming a covariance.

Vectors become integers, so that means and centring are exact. Every task reduces its centred rows block by block to one
triangular factor (QR), and factors are joined in a tree until one is left: a matrix of dims x dims, whatever the number of
rows. Householder reflections bring it to bidiagonal form, differential qd steps (dqds) find its singular values to high
relative accuracy, and twisted factorisations of the shifted matrix give their directions, which the reflections carry back.

Vectors that are null or hold null or non-finite entries are left out. Those of another length than the commonest one (of
equally common ones the greatest) have no place in the space: they are left out too. Directions in which the vectors do not
vary (to the accuracy of doubles) can't be whitened and give no rows, so one vector alone, or equal vectors only, give an empty
result, as an empty table does. Repeated rows and null ids count like any others. Extra columns play no part. ``deviation``
beyond a long is given as the largest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.common import attempt_name, stored
from pulseloom.llm.vectors import exact_sums, integers, limbs_of, rows_of, usable

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LONGEST = (1 << 63) - 1
EPS = float(np.finfo(float).eps)
JOINED_BYTES = 64 << 20  # factors that meet in one task


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of U' r V, and the reflections whose product is V."""
    a = r.astype(float).copy()
    n = len(a)
    mirrors: list[np.ndarray] = []

    def mirror(x: np.ndarray) -> np.ndarray:
        v, size = x.copy(), np.linalg.norm(x)
        if size:
            v[0] += np.copysign(size, x[0])
            v /= np.linalg.norm(v)
        return v

    for k in range(n):
        v = mirror(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = mirror(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def carried_back(z: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """V z."""
    out = z.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        out[k + 1:] -= 2 * v * (v @ out[k + 1:])
    return out


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd transform with a shift, and the least pivot; None if the shift was too large."""
    n, d = len(q), q[0] - shift
    out_q, out_e, least = [0.0] * n, [0.0] * (n - 1), d
    for k in range(n - 1):
        if d < 0:
            return None
        out_q[k] = d + e[k]
        ratio = q[k + 1] / out_q[k] if out_q[k] else 0.0
        out_e[k] = e[k] * ratio
        d = d * ratio - shift if out_q[k] else q[k + 1] - shift
        least = min(least, d)
    out_q[-1] = d
    return None if d < 0 else (out_q, out_e, least)


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, greatest first, by dqds with deflation and splitting."""
    found: list[float] = []
    tiny = 1e-290
    parts = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0, 0.0)]
    while parts:
        q, e, sigma, rest = parts.pop()  # the values are those of (q, e), plus sigma + rest (a sum in two parts)
        guess = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(sigma + (rest + q[0]))
                break
            negligible = [k for k in range(n - 1) if e[k] <= tiny or e[k] <= EPS ** 2 * min(sigma + q[k], sigma + q[k + 1])]
            if negligible:
                cut = negligible[-1] + 1
                if cut == n - 1:
                    found.append(sigma + (rest + q[-1]))
                else:
                    parts.append((q[cut:], e[cut:], sigma, rest))
                q, e = q[:cut], e[:cut - 1]
                guess = 0.0
                continue
            if 1.5 * q[0] < q[-1]:  # small values are found at the end
                q, e, guess = q[::-1], e[::-1], 0.0
            done = None
            for shift in (guess, guess / 4, 0.0):
                done = qd_step(q, e, shift)
                if done:
                    break
            if done is None:  # rounding: a zero value
                q[-1], e[-1] = max(q[-1], 0.0), 0.0
                continue
            q, e, least = done
            if shift:
                total = sigma + shift
                rest += (sigma - total) + shift
                sigma = total
            # the least value of the last 2 x 2 of the matrix lies near the least of all
            a, b, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            near = (a + c) / 2 - ((a - c) ** 2 / 4 + b) ** 0.5
            guess = max(0.0, min(near, least) * (1 - 4 * EPS))
    return np.array(sorted(found, reverse=True))


def _pivot(x: float, tiny: float) -> float:
    return x if abs(x) >= tiny else (tiny if x >= 0 else -tiny)


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, tiny: float) -> np.ndarray:
    """A unit vector for ``value`` of B'B, B bidiagonal: the factorisations from both ends meet where they fit best."""
    n = len(diagonal)
    d = diagonal ** 2
    low = [float(upper[k] / diagonal[k]) for k in range(n - 1)]
    s, left = [-value] * n, [0.0] * n
    for k in range(n - 1):
        pivot = _pivot(s[k] + d[k], tiny)
        left[k] = d[k] * low[k] / pivot
        s[k + 1] = left[k] * low[k] * s[k] - value
    p, right = [0.0] * n, [0.0] * n
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = _pivot(d[k] * low[k] ** 2 + p[k + 1], tiny)
        ratio = d[k] / pivot
        right[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    middle = int(np.argmin(np.abs(np.array(s) + np.array(p) + value)))
    z = np.zeros(n)
    z[middle] = 1.0
    for k in range(middle - 1, -1, -1):
        z[k] = -left[k] * z[k + 1]
    for k in range(middle, n - 1):
        z[k + 1] = -right[k] * z[k]
    return z / np.linalg.norm(z)


def directions(factor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest squared singular values of a triangular factor, their right directions as rows, and the sum of all squares.

    Values that are zero to the accuracy of the factor are left out. Where the bidiagonal matrix falls into parts, each
    part has its own directions; within a part, directions of values that agree to many digits are made orthogonal.
    """
    n = len(factor)
    diagonal, upper, mirrors = bidiagonal(factor)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((0, n)), 0.0
    small = EPS * scale
    diagonal = np.where(np.abs(diagonal) < small, small * 1e-3, diagonal)  # far below any direction that counts
    cuts = [0, *(k + 1 for k in range(n - 1) if abs(upper[k]) <= EPS * (abs(diagonal[k]) + abs(diagonal[k + 1]))), n]
    pairs = []
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        values = squared_singular_values(diagonal[a:b], upper[a:b - 1])
        total += float(values.sum())
        pairs += [(float(v), a, b) for v in values]
    pairs.sort(key=lambda x: -x[0])
    floor = pairs[0][0] * (n * EPS) ** 2 * 16
    values, rows = [], []
    for value, a, b in [x for x in pairs if x[0] > floor][:most]:
        z = np.zeros(n)
        z[a:b] = twisted(diagonal[a:b], upper[a:b - 1], value, small ** 2)
        for _ in range(2):
            for other in rows:
                z -= (z @ other) * other
        size = np.linalg.norm(z)
        if size < 0.5:  # the value is one of several that agree: another direction of their space
            z = _another(diagonal, upper, a, b, value, rows, small)
        else:
            z /= size
        values.append(value)
        rows.append(z)
    return np.array(values), np.array([carried_back(z, mirrors) for z in rows]).reshape(len(rows), n), total


def _another(diagonal: np.ndarray, upper: np.ndarray, a: int, b: int, value: float, taken: list[np.ndarray], small: float) -> np.ndarray:
    """Inverse iteration from a fixed start, orthogonal to the directions taken."""
    block = np.diag(diagonal[a:b]) + np.diag(upper[a:b - 1], 1)
    shifted = block.T @ block - (value * (1 + 4 * EPS) + small ** 2) * np.eye(b - a)
    z = np.zeros(len(diagonal))
    z[a:b] = np.random.Generator(np.random.PCG64(len(taken))).standard_normal(b - a)
    for _ in range(4):
        for other in [*taken, *taken]:
            z -= (z @ other) * other
        z /= np.linalg.norm(z)
        z[a:b] = np.linalg.solve(shifted, z[a:b])
    for other in [*taken, *taken]:
        z -= (z @ other) * other
    return z / np.linalg.norm(z)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact."""
    if x.dtype != object and x.size and sums.dtype != object and float(n) * float(np.abs(x).max()) < 1 << 61:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def joined_factor(rows: DataFrame, dims: int, n: int, sums: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """The triangular factor of all centred rows: one of each task, then joined in a tree."""
    def reduce_rows(batches):
        factor = np.zeros((0, dims))
        for _, x in rows_of(batches, dims):
            block = (centred(integers(x, scale, shift), n, sums) / n).astype(float)
            factor = np.linalg.qr(np.vstack([factor, block]), mode="r")
        if len(factor):
            yield packed(attempt_name()[0], factor)

    def packed(part: int, factor: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "factor": pa.array([factor.ravel().tolist()], pa.list_(pa.float64()))})

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        stack = np.vstack([np.array(f).reshape(-1, dims) for f in table["factor"].to_pylist()])
        return pa.Table.from_batches([packed(table["part"][0].as_py() // fan, np.linalg.qr(stack, mode="r"))])

    fan = max(2, JOINED_BYTES // max(1, 8 * dims * dims))
    schema = "part long, factor array<double>"
    factors = stored(rows.mapInArrow(reduce_rows, schema), "factors")
    while factors.count() > 1:
        factors = stored(factors.groupBy(F.floor(F.col("part") / fan).alias("_g")).applyInArrow(join, schema), "factors")
    last = factors.first()
    own = np.array(last["factor"]).reshape(-1, dims)
    return np.vstack([own, np.zeros((dims - len(own), dims))])


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Entries become ``x = floor(scale * c) + shift``. Components are the leading directions of the covariance, numbered from 1;
    ``whitened`` is the centred vector's coordinate over the root of the component's variance.
    """
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    rows = stored(given.filter(usable(F.col("vec")) & (F.size("vec") > 0)), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    empty = vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, {SCHEMA}")
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not common:
        return empty
    dims = common["d"]
    rows = rows.filter(F.size("vec") == dims)
    limbs = limbs_of(rows, "vec", scale)
    limbs = limbs + 1 if limbs > 1 or shift >= 1 << 25 else limbs
    n, sums = exact_sums(rows, dims, limbs, lambda x: np.zeros(len(x), np.int64), scale, shift)[0]
    sums = np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)
    values, axes, total = directions(joined_factor(rows, dims, n, sums, scale, shift), components)
    k = len(values)
    if not k:
        return empty
    roots = np.sqrt(values / n)

    def coordinates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = centred(integers(x, scale, shift), n, sums)
        return apart, (apart / n).astype(float) @ axes.T / roots

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in rows_of(batches, dims):
            w = coordinates(x)[1]
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_pydict({"m": pa.array([np.concatenate([first, second.ravel()]).tolist()], pa.list_(pa.float64()))})

    sums_of = rows.mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("at", "m")).groupBy("at").agg(F.sum("m").alias("m"))
    flat = np.zeros(k + k * k)
    for row in sums_of.collect():
        flat[row["at"]] = row["m"]
    mean = flat[:k] / n
    error = float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def emit(batches):
        for part, x in rows_of(batches, dims):
            apart, w = coordinates(x)
            wide = apart if apart.dtype == object or (apart.size and float(np.abs(apart).max()) ** 2 * dims < 1 << 62) else apart.astype(object)
            deviation = pa.array([min(v, LONGEST) for v in (wide * wide).sum(axis=1).tolist()], pa.int64())
            again = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(again), n)), deviation.take(again), pa.array(w.ravel()),
                 pa.array(np.tile(values / total, len(x))), pa.array(np.full(len(again), error))],
                names=[id_col, *SCHEMA.replace(",", "").split()[::2]])

    return rows.mapInArrow(emit, f"{id_col} {kind}, {SCHEMA}")
