"""Connected components of an edge table, for all groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseloom import settings
from pulseloom.operators.similarity import any_large, group_sizes, similarity_forest
from pulseloom.session import cut, stored


HOT_ROWS = 100_000  # rows of one key from which it is worth a look whether it is hot
HOT_SHARE = 1000    # a hot key has more than this part of all rows, so there are fewer hot keys than that


def connected_components(nodes: DataFrame, edges: DataFrame, *, keys: list[str], id_col: str) -> DataFrame:
    """``keys, id, component`` where a component is named after its smallest id.

    Large-star and small-star steps in turn (Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii, 2014): a large star hangs the greater
    partners of each node to the smallest of its partners, a small star the smaller ones and the node itself. The table
    never grows, and ends as one star for each component. Minima are summed up partially before any shuffle; rows that look
    up the minimum of a hub, or of a giant component's root, stay where they are, as the few hot keys are sent to them.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v"))
    table = edges.select(*keys, pair("src", "dst").alias("_e")).select(*keys, "_e.*").filter("_u <> _v")
    table = stored(table.distinct())
    seen = None
    while True:
        both = table.select(*keys, F.col("_v").alias("_x"), F.col("_u").alias("_y")).unionByName(table.select(*keys, F.col("_u").alias("_x"), F.col("_v").alias("_y")))
        lowest = both.groupBy(*keys, "_x").agg(F.min("_y").alias("_m"), F.count("*").alias("_n")).select(*keys, "_x", F.least("_x", "_m").alias("_m"), "_n")
        large = _looked_up(table, "_v", lowest, keys).select(*keys, "_u", F.col("_m").alias("_v")).distinct()
        large = stored(large)
        lowest = large.groupBy(*keys, F.col("_u").alias("_x")).agg(F.min("_v").alias("_m"), F.count("*").alias("_n"))
        met = _looked_up(large, "_u", lowest, keys)
        small = met.filter("_v <> _m").select(*keys, F.col("_v").alias("_u"), F.col("_m").alias("_v")).unionByName(
            lowest.select(*keys, F.col("_x").alias("_u"), F.col("_m").alias("_v")))
        table = stored(small.distinct())
        mark = F.xxhash64(*keys, "_u", "_v")
        now = table.agg(F.count("*"), F.bit_xor(mark), F.bit_xor(F.xxhash64(mark))).first()
        if now == seen:  # a star for each component: both steps leave it as it is
            named = table.select(*keys, F.col("_u").alias(id_col), F.col("_v").alias("_label"))
            return nodes.select(*keys, id_col).join(named, keys + [id_col], "left").select(
                *keys, id_col, F.coalesce("_label", id_col).alias("component"))
        seen = now


def _looked_up(rows: DataFrame, on: str, lowest: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the ``_m`` that ``lowest`` has for their key ``on``; ``_n`` there is at least how often the key occurs."""
    lowest = stored(lowest)
    most, total = lowest.agg(F.max("_n"), F.sum("_n")).first()
    table = lowest.select(*keys, F.col("_x").alias(on), "_m")
    if not most or most <= max(HOT_ROWS, total // HOT_SHARE):
        return rows.join(table, keys + [on])
    hot = F.broadcast(lowest.filter(F.col("_n") > max(HOT_ROWS, total // HOT_SHARE)).select(*keys, F.col("_x").alias(on), "_m"))
    return rows.join(hot, keys + [on]).unionByName(rows.join(hot.drop("_m"), keys + [on], "left_anti").join(table, keys + [on]))


def merge_groups(signals: DataFrame, threshold: float = settings.MERGE_THRESHOLD, *, keys: list[str], id_col: str,
                 vec_col: str, flag_col: str, block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """Groups of rows linked, directly or through others, by similarity at or above the threshold and an equal flag."""
    grouped = keys + [flag_col]
    find = lambda rows: similarity_forest(rows, threshold, keys=grouped, id_col=id_col, vec_col=vec_col,
                                          inclusive=True, block_rows=block_rows)
    if any_large(group_sizes(signals, grouped), block_rows):
        # equal vectors resemble the same rows: one of them stands for all. A zero vector stands for itself only.
        rows = signals.select(*grouped, id_col, vec_col)
        some, blank = rows.filter(F.exists(vec_col, lambda x: x != 0)), rows.filter(~F.exists(vec_col, lambda x: x != 0))
        distinct = cut(some.groupBy(*grouped, vec_col).agg(F.min(id_col).alias("_rep")))
        named = distinct.withColumnRenamed("_rep", id_col)
        found = connected_components(named, find(named), keys=grouped, id_col=id_col).withColumnRenamed(id_col, "_rep")
        copies = some.join(distinct, grouped + [vec_col]).select(*grouped, id_col, "_rep")
        return copies.join(found, grouped + ["_rep"]).select(*grouped, id_col, "component").unionByName(
            blank.select(*grouped, id_col, F.col(id_col).alias("component")))
    forest = find(signals)
    # every group was one task, whose forest already is a star around the smallest id of each component
    star = forest.select(*grouped, F.col("dst").alias(id_col), F.col("src").alias("component"))
    return signals.select(*grouped, id_col).join(star, grouped + [id_col], "left").withColumn(
        "component", F.coalesce("component", id_col))
