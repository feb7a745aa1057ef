"""Density clustering (HDBSCAN) of unit vectors, for all groups at once.

After Campello, Moulavi, Sander (2013) and McInnes, Healy (2017): core distances, minimum spanning tree of mutual
reachability, condensed hierarchy, excess-of-mass selection, merging below ``epsilon``.

Squared distances are rounded to whole multiples of 1e-9 and densities are whole numbers, and edges of equal weight come in the
order of their ends. So a result depends neither on how a group is laid out in blocks nor on rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulseloom import settings
from pulseloom.operators import hierarchy
from pulseloom.operators.similarity import any_large, compare_blocks, group_sizes, matrix, unit_rows
from pulseloom.session import cut

GRAIN = 1_000_000_000  # weights are squared distances in parts of this
DENSEST = 10 ** 21     # the density of points at no distance; others are GRAIN over their distance
NONE = np.iinfo(np.int64).max


def weights_of(sims: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.floor((2.0 - 2.0 * sims) * GRAIN + 0.5)).astype(np.int64)


def density_of(weight: int) -> int:
    return int(np.floor(GRAIN / np.sqrt(weight / GRAIN) + 0.5)) if weight else DENSEST


def density(weight: str) -> Column:
    """The same of a column."""
    return F.when(F.col(weight) == 0, F.lit(str(DENSEST)).cast(hierarchy.WIDE)).otherwise(
        F.floor(F.lit(float(GRAIN)) / F.sqrt(F.col(weight) / F.lit(float(GRAIN))) + 0.5).cast(hierarchy.WIDE))


def near(weight, epsilon: float):
    """Whether two clusters that meet at this weight are too close to be told apart."""
    root = F.sqrt(F.col(weight) / F.lit(float(GRAIN))) if isinstance(weight, str) else (weight / GRAIN) ** 0.5
    return root < epsilon


def spanning_edges(weights: np.ndarray, rank: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Prim's minimum spanning tree of a dense weight matrix (``NONE``: no edge). Equal weights come by the ranks of their ends."""
    n = weights.shape[0]
    rank = np.arange(n) if rank is None else rank
    order = lambda j: np.minimum(rank, rank[j]) * n + np.maximum(rank, rank[j])
    best, parent, key = weights[0].copy(), np.zeros(n, dtype=np.int64), order(0)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    edges = []
    for _ in range(n - 1):
        reach = np.where(outside, best, NONE)
        least = reach.min()
        if least == NONE:
            break
        equal = np.flatnonzero(reach == least)
        j = int(equal[np.argmin(key[equal])])
        edges.append((int(least), *sorted((int(parent[j]), j), key=rank.__getitem__)))
        outside[j] = False
        other = order(j)
        closer = outside & ((weights[j] < best) | ((weights[j] == best) & (other < key)))
        best[closer], parent[closer], key[closer] = weights[j][closer], j, other[closer]
    return edges


def flat_clusters(n: int, edges: list[tuple[int, int, int]], min_size: int, epsilon: float) -> np.ndarray:
    """Labels of ``n`` points from their spanning tree; -1 is noise.

    The tree is read bottom-up. A side of a merge that is smaller than ``min_size`` only adds its points to the other
    side; two sides of at least that size are two clusters that end there. A cluster's mass is the sum over its points
    of (density at which the point joined - density at which the cluster ended).
    """
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = [1] * n
    current: list[int | None] = [None] * n      # open cluster of a component
    loose: list[list[int]] = [[i] for i in range(n)]  # points of a component that is no cluster yet
    joined: list[int] = []                       # per cluster: sum of joining densities
    count: list[int] = []
    ended: list[int] = []                        # weight at which it split off its parent
    parent: list[int] = []
    parts: list[list[int]] = []
    points: list[list[int]] = []

    def open_cluster(children: list[int], members: list[int], density: int, total: int) -> int:
        joined.append(density * total)
        count.append(total)
        ended.append(0)
        parent.append(-1)
        parts.append(children)
        points.append(members)
        return len(joined) - 1

    for weight, u, v in sorted(edges):
        a, b = find(u), find(v)
        density = density_of(weight)
        ca, cb = current[a], current[b]
        total = size[a] + size[b]
        if ca is not None and cb is not None:
            made = open_cluster([ca, cb], [], density, total)
            for child in (ca, cb):
                ended[child], parent[child] = weight, made
        elif ca is None and cb is None:
            made = open_cluster([], loose[a] + loose[b], density, total) if total >= min_size else None
        else:
            made, small = (ca, b) if ca is not None else (cb, a)
            points[made].extend(loose[small])
            joined[made] += density * size[small]
            count[made] += size[small]
        root[b] = a
        size[a] = total
        loose[a] = [] if made is not None else loose[a] + loose[b]
        current[a] = made

    labels = np.full(n, -1)
    whole = [c for c in range(len(parent)) if parent[c] == -1]  # the cluster of everything is never selected
    mass, chosen = [0] * len(joined), [False] * len(joined)
    for c in range(len(joined)):                 # children precede their parent
        if parent[c] == -1:
            continue
        own = joined[c] - density_of(ended[c]) * count[c]
        inner = sum(mass[x] for x in parts[c])
        chosen[c] = not inner > own
        mass[c] = own if chosen[c] else inner

    def keep_outermost(c: int, covered: bool) -> list[int]:
        stack, found = [(c, covered)], []
        while stack:
            x, hidden = stack.pop()
            if chosen[x] and not hidden:
                found.append(x)
            stack.extend((y, hidden or chosen[x]) for y in parts[x])
        return found

    selected = sorted(x for c in whole for x in keep_outermost(c, False))
    if epsilon > 0:
        lifted: list[int] = []
        absorbed: set[int] = set()
        for c in selected:
            if not near(ended[c], epsilon):
                lifted.append(c)
                continue
            if c in absorbed:
                continue
            top = c
            while parent[parent[top]] != -1 and near(ended[top], epsilon):
                top = parent[top]
            lifted.append(top)
            stack = list(parts[top])
            while stack:
                x = stack.pop()
                absorbed.add(x)
                stack.extend(parts[x])
        selected = [c for c in lifted if c not in absorbed]
    firsts = []
    for c in selected:
        members, stack = [], [c]
        while stack:
            x = stack.pop()
            members.extend(points[x])
            stack.extend(parts[x])
        firsts.append((min(members), members))
    for label, (_, members) in enumerate(sorted(firsts)):
        labels[members] = label
    return labels


def density_clusters(df: DataFrame, *, keys: list[str], id_col: str, vec_col: str,
                     min_size: int = settings.CLUSTER_MIN_SIZE, min_samples: int = settings.CLUSTER_MIN_SAMPLES,
                     epsilon: float = settings.CLUSTER_EPSILON, block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """``keys, id, cluster_id``: clusters count from 0 in order of their smallest id, -1 is noise.

    A group of fewer than ``min_size`` rows is one cluster 0. Null vectors and vectors of zeros have no direction: they are noise.
    A group of at most one block is clustered in one task. For larger ones core distances and the edges that can be in the
    spanning tree come from block comparisons, and the tree, its hierarchy and the choice of clusters are joins and running totals
    over the edges (``hierarchy``): a group has no largest size.
    """
    base = df.select(*keys, F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    sizes = group_sizes(base, keys)
    large_exists = any_large(sizes, block_rows)
    sized = base.join(sizes, keys) if large_exists else base.withColumn("_rows", F.lit(0).cast("bigint"))
    schema = T.StructType([base.schema[k] for k in keys] + [base.schema["_id"], T.StructField("cluster_id", T.IntegerType())])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        n = table.num_rows
        labels = np.full(n, 0 if n < min_size else -1)
        some = np.flatnonzero([v is not None and any(v) for v in table["_vec"].to_pylist()]) if n >= min_size else []
        if len(some) > 1:
            unit = unit_rows(matrix(table["_vec"].take(pa.array(some))))
            weights = weights_of(unit @ unit.T)
            np.fill_diagonal(weights, 0)
            at = min(min_samples, len(some) - 1)
            core = np.partition(weights, at, axis=1)[:, at]
            reach = np.maximum(weights, np.maximum(core[:, None], core[None, :]))
            labels[some] = flat_clusters(len(some), spanning_edges(reach), min_size, epsilon)
        return pa.table({**{k: table[k] for k in keys}, "_id": table["_id"], "cluster_id": pa.array(labels.astype(np.int32))})

    result = sized.filter(F.col("_rows") <= block_rows).drop("_rows").groupBy(*keys).applyInArrow(whole, schema)
    if large_exists:
        large = cut(sized.filter(F.col("_rows") > block_rows).drop("_rows"))
        edges = tree_candidates(large, keys=keys, min_samples=min_samples, block_rows=block_rows)
        result = result.unionByName(hierarchy.labels(large, edges, keys=keys, min_size=min_size, density=density("_q"), merges=near("_q", epsilon)))
    return result.withColumnRenamed("_id", id_col)


def tree_candidates(rows: DataFrame, *, keys: list[str], min_samples: int, block_rows: int) -> DataFrame:
    """Edges ``keys, _q, _a, _b`` that hold the minimum spanning tree of mutual reachability of each group.

    A task keeps, of the pairs it compares, the few smallest distances of each row, then only the edges of its own
    minimum spanning tree: an edge outside the tree of some part of a graph is outside the tree of the whole.
    """
    id_type = rows.schema["_id"].dataType
    base = [rows.schema[k] for k in keys]
    near_schema = T.StructType(base + [rows.schema["_id"], T.StructField("_d", T.ArrayType(T.LongType()))])

    def nearest(left: pa.Table, right: pa.Table, sims: np.ndarray, same: bool) -> pa.Table:
        weights = weights_of(sims)
        if same:
            np.fill_diagonal(weights, NONE)
        tables = []
        for side, d in [(left, weights)] if same else [(left, weights), (right, weights.T)]:
            keep = np.sort(d, axis=1)[:, :min_samples]
            lists = [[x for x in row if x < NONE] for row in keep.tolist()]
            tables.append(pa.table({**{k: side[k] for k in keys}, "_id": side["_id"], "_d": pa.array(lists, pa.list_(pa.int64()))}))
        return pa.concat_tables(tables)

    everything = -1.0  # every pair counts, so no cell is out of reach
    shortest = compare_blocks(rows, keys, nearest, near_schema, everything, block_rows)
    # each task gives at most min_samples values per row, and a row takes part in as many tasks as there are blocks
    ordered = F.array_sort(F.flatten(F.collect_list("_d")))
    core = shortest.groupBy(*keys, "_id").agg(F.element_at(F.slice(ordered, 1, max(min_samples, 1)), -1).alias("_core") if min_samples else F.lit(0).cast("long").alias("_core"))
    cored = cut(rows.join(core, keys + ["_id"]))
    edge_schema = T.StructType(base + [T.StructField("_q", T.LongType()), T.StructField("_a", id_type), T.StructField("_b", id_type)])

    def local_tree(left: pa.Table, right: pa.Table, sims: np.ndarray, same: bool) -> pa.Table:
        core = lambda t: t["_core"].to_numpy()
        reach = np.maximum(weights_of(sims), np.maximum(core(left)[:, None], core(right)[None, :]))
        if same:
            both, weights = left, reach
        else:
            both = pa.concat_tables([left, right])
            n = left.num_rows
            weights = np.full((both.num_rows, both.num_rows), NONE)
            weights[:n, n:], weights[n:, :n] = reach, reach.T
        rank = np.empty(both.num_rows, dtype=np.int64)
        rank[both.append_column("_row", pa.array(np.arange(both.num_rows))).sort_by("_id")["_row"].to_numpy()] = np.arange(both.num_rows)
        edges = spanning_edges(weights, rank) if both.num_rows else []
        i, j = pa.array([e[1] for e in edges], pa.int64()), pa.array([e[2] for e in edges], pa.int64())
        return pa.table({**{k: both[k].take(i) for k in keys}, "_q": pa.array([e[0] for e in edges], pa.int64()),
                         "_a": both["_id"].take(i), "_b": both["_id"].take(j)})

    return compare_blocks(cored, keys, local_tree, edge_schema, everything, block_rows)
