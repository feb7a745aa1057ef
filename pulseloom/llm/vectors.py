"""Exact integer arithmetic over vector columns: which rows count, integer matrices inside tasks, sums of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LIMB = 31  # bits of each part of a sum that a long can't hold
ROWS_BITS = 41  # sums hold as many rows as this
CELLS = 1 << 20  # entries of a matrix that a task works on at once


def usable(vec: Column) -> Column:
    """Whether a vector is neither null nor holds a null, a NaN or an infinite entry."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(F.coalesce(vec.cast("array<double>"), F.array(F.lit(None).cast("double"))), bad)


def integers(x: np.ndarray, scale: int, shift: int = 0) -> np.ndarray:
    """``floor(scale * x) + shift``: longs where a double holds them exactly, Python integers otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < 1 << 52:
        return scaled.astype(np.int64) + shift
    # doubles this large are whole numbers already; their product may be beyond a double
    whole = [int(v) * scale if abs(v) >= 1 << 52 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return (np.array(whole, object) + shift).reshape(x.shape)


def rows_of(batches, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of bounded size of the batches of a task, with their second column as a matrix of ``dims`` columns."""
    step = max(1, CELLS // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part, flat.reshape(part.num_rows, dims)


def limbs_of(rows: DataFrame, vec_col: str, scale: int) -> int:
    """How many parts a sum of scaled entries needs, from the largest entry; 1 where plain longs do for squares too."""
    largest = F.array_max(F.transform(vec_col, lambda x: F.abs(x.cast("double"))))
    most = rows.agg(F.max(largest)).first()[0] or 0.0
    bits = (int(most) * scale + scale).bit_length()
    return 1 if bits <= 26 else (bits + ROWS_BITS) // LIMB + 1


def exact_sums(rows: DataFrame, dims: int, limbs: int, label: Callable[[np.ndarray], np.ndarray], scale: int,
               shift: int = 0) -> dict[int, tuple[int, list[int]]]:
    """For each label the number of its rows and the exact sums of their integer components.

    ``rows`` holds an id and a vector. Every task sends one row for each label it met, and Spark adds those up by label and
    component; the driver gets one number for each of them, whatever the number of rows.
    """
    def partial(batches):
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for _, x in rows_of(batches, dims):
            x = integers(x, scale, shift)
            names = label(x)
            for name in np.unique(names).tolist():
                own = x[names == name]
                count[name] = count.get(name, 0) + len(own)
                total[name] = total.get(name, 0) + own.sum(axis=0).astype(object)
        for name, sums in total.items():
            parts = [[s >> LIMB * k & (1 << LIMB) - 1 if k < limbs - 1 else s >> LIMB * k for k in range(limbs)] for s in sums.tolist()]
            yield pa.RecordBatch.from_pydict({"label": pa.array([name], pa.int32()), "n": pa.array([count[name]], pa.int64()),
                                              "parts": pa.array([[p for own in parts for p in own]], pa.list_(pa.int64()))})

    found = rows.mapInArrow(partial, "label int, n long, parts array<long>")
    added = found.select("label", "n", F.posexplode("parts").alias("at", "part")).groupBy("label", "at").agg(
        F.sum("part").alias("part"), F.sum("n").alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for row in added.collect():
        n, sums = out.setdefault(row["label"], (row["n"], [0] * dims))
        sums[row["at"] // limbs] += row["part"] << LIMB * (row["at"] % limbs)
    return out
