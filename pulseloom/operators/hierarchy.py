"""Flat clusters of a density hierarchy from an edge table, for groups of any size, as joins and grouped sums.

Borůvka's rounds contract a graph: in each, every component takes its lightest edge. The edges taken are the minimum spanning
tree, and the rounds order it (after Sao, Prokopenko, Lebrun-Grandié, 2024): below the lightest edge that leaves a
component, the lighter edges inside it form a *chain* of the dendrogram, sorted by weight. So the dendrogram is a set of chains,
each a run of rows in weight order, hung to one edge of a later round's chain. Sizes, clusters and their masses are running
totals along the chains, taken level by level; no group meets in one task.

Edges are ``keys, _q, _a, _b`` with ``_a < _b``; (``_q``, ``_a``, ``_b``) orders all edges of a group strictly. Numbers that are compared
are whole, so neither layout nor order of addition changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.operators.running import laid_out, running
from pulseloom.session import stored

EDGE = ["_q", "_a", "_b"]
WIDE = "decimal(38,0)"


def named(df: DataFrame, **names: str) -> DataFrame:
    """Columns under new names; the others as they are."""
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def roots(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _c, _root``: where the pointers ``_c`` to ``_to`` end. Every target has a pointer; a root points to itself.

    Each round doubles the distance looked over, twice before it is written: what a round costs in small tables is its jobs. Many
    rows may point to one root: its row alone is copied to their parts when Spark splits the skewed side of the join.
    """
    def doubled(now: DataFrame) -> DataFrame:
        return now.join(now.select(*keys, F.col("_c").alias("_to"), F.col("_to").alias("_next")), keys + ["_to"])

    further = lambda met: met.select(*keys, "_c", F.col("_next").alias("_to"))
    now = stored(pointers.select(*keys, "_c", "_to"))
    while True:
        met = stored(doubled(further(doubled(now))))
        now = further(met)
        if not met.filter("_next <> _to").limit(1).count():
            return now.withColumnRenamed("_to", "_root")


def contracted(edges: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """The tree's edges and where components hang.

    Edges: ``keys, _q, _a, _b, _round, _c1, _c2`` (the components of that round whose lightest edge it is; ``_c2`` null if one)
    and ``_level, _chain``, the chain it lies in. Components: ``keys, _level, _c, _q, _a, _b``, the lightest edge that leaves ``_c``.
    """
    live = stored(edges.select(*keys, *EDGE, F.col("_a").alias("_u"), F.col("_b").alias("_v")).filter("_u <> _v"))
    open_ = placed = lights = None
    level = 0
    edge = lambda of="": F.struct(*[F.col(of + c) for c in EDGE])
    while True:
        ends = live.select(*keys, F.col("_u").alias("_c"), F.struct(*EDGE, F.col("_v").alias("_o")).alias("_e")).unionByName(
            live.select(*keys, F.col("_v").alias("_c"), F.struct(*EDGE, F.col("_u").alias("_o")).alias("_e")))
        light = stored(ends.groupBy(*keys, "_c").agg(F.min("_e").alias("_e")).select(*keys, "_c", "_e.*"))
        if open_ is not None:
            above = light.select(*keys, F.col("_c").alias("_x"), edge().alias("_above"))
            met = open_.join(above, keys + ["_x"], "left")
            settles = F.col("_above").isNull() | (edge() < F.col("_above"))
            settled = met.filter(settles).drop("_above").withColumn("_level", F.lit(level)).withColumnRenamed("_x", "_chain")
            placed = settled if placed is None else placed.unionByName(settled)
            open_ = met.filter(~settles).drop("_above")
        if not light.limit(1).count():
            return placed, lights
        tagged = light.select(*keys, F.lit(level).alias("_level"), "_c", *EDGE)
        lights = tagged if lights is None else lights.unionByName(tagged)
        ends_of = F.struct("_c", "_o")
        taken = light.groupBy(*keys, *EDGE).agg(F.min(ends_of).alias("_1"), F.max(ends_of).alias("_2"))
        mutual = F.col("_1._c") != F.col("_2._c")
        point = lambda c, to: F.struct(F.col(c).alias("_c"), F.col(to).alias("_to"))
        pointers = taken.select(*keys, F.inline(F.when(mutual, F.array(point("_1._c", "_1._c"), point("_2._c", "_1._c"))).otherwise(
            F.array(point("_1._c", "_1._o")))))
        into = roots(pointers, keys)
        fresh = taken.select(*keys, *EDGE, F.lit(level).alias("_round"), F.col("_1._c").alias("_c1"),
                             F.when(mutual, F.col("_2._c")).alias("_c2"), F.col("_1._c").alias("_x"))
        open_ = fresh if open_ is None else open_.unionByName(fresh)
        open_ = stored(open_.join(named(into, _c="_x"), keys + ["_x"]).drop("_x").withColumnRenamed("_root", "_x"))
        for side in ("_u", "_v"):
            live = live.join(named(into, _c=side, _root="_to"), keys + [side]).drop(side).withColumnRenamed("_to", side)
        live = stored(live.filter("_u <> _v"))
        level += 1


def condensed(tree: DataFrame, keys: list[str], min_size: int, density: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and clusters of the condensed hierarchy.

    Nodes: ``keys, _q, _a, _b, _level, _chain, _event, _cluster``: the cluster that holds what the edge joins (null below ``min_size``).
    Clusters: ``keys, _c, _parent, _q, _chosen``: those that end by joining another, where and at which edge, and whether
    each has at least the mass of the chosen ones inside it. ``density`` is a whole number made of ``_q``.
    """
    chain = [*keys, "_level", "_chain"]
    laid = laid_out(tree.select("*", density.cast(WIDE).alias("_d")), chain + EDGE)
    laid = laid.withColumn("_n", F.monotonically_increasing_id())  # the same each time, as the layout is fixed
    zero = F.lit(0).cast(WIDE)
    tops = clusters = nodes = None  # of the chains so far: size, cluster, joining density, mass inside
    facts = ["_size", "_cluster", "_joined", "_inner"]
    last = laid.agg(F.max("_level")).first()[0] or 0
    for level in range(1, last + 1):
        rows = laid.filter(F.col("_level") == level)
        for k in ("1", "2"):
            if tops is None:
                rows = rows.select("*", F.lit(None).cast("long").alias("_size" + k), F.lit(None).cast("long").alias("_cluster" + k),
                                   zero.alias("_joined" + k), zero.alias("_inner" + k))
            else:
                below = tops.select(*keys, F.col("_level").alias("_round"), F.col("_chain").alias("_c" + k), *[F.col(f).alias(f + k) for f in facts])
                rows = rows.join(below, keys + ["_round", "_c" + k], "left")
        two = F.col("_c2").isNotNull()
        rows = rows.withColumns({"_size1": F.coalesce("_size1", F.lit(1).cast("long")),
                                 "_size2": F.when(two, F.coalesce("_size2", F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))})
        rows = running(stored(rows), chain, EDGE, _before=("sum", F.col("_size1") + F.col("_size2")))
        left = F.when(two, F.col("_size1")).otherwise(F.coalesce("_before", F.lit(0).cast("long")))
        side = lambda f: F.when(two, F.col(f + "2")).otherwise(F.col(f + "1"))  # noqa: E731  of the right side
        rows = rows.withColumns({"_left": left, "_right": side("_size"), "_of": side("_cluster"), "_rj": side("_joined"), "_ri": side("_inner"), "_two": two})
        big_left = F.when(F.col("_two"), F.col("_cluster1").isNotNull()).otherwise(F.col("_left") >= min_size)
        rows = rows.withColumns({"_size": F.col("_left") + F.col("_right"), "_bl": big_left, "_br": F.col("_of").isNotNull()})
        opens = (F.col("_bl") & F.col("_br")) | (~F.col("_bl") & ~F.col("_br") & (F.col("_size") >= min_size))
        event = F.when(opens, F.col("_n")).when(F.col("_br"), F.col("_of")).when(F.col("_bl") & F.col("_two"), F.col("_cluster1"))
        times = lambda n: F.col("_d") * F.col(n).cast(WIDE)
        gain = F.when(opens, times("_size")).when(F.col("_br"), times("_left") + F.col("_rj")).when(
            F.col("_bl"), times("_right") + F.when(F.col("_two"), F.col("_joined1")).otherwise(zero)).otherwise(zero)
        split = F.col("_bl") & F.col("_br")
        own_right = F.col("_rj") - times("_right")
        mass_right = F.when(split, F.greatest(own_right, F.col("_ri")).cast(WIDE))
        rows = stored(rows.withColumns({"_event": event, "_gain": gain.cast(WIDE), "_split": split, "_own_r": own_right.cast(WIDE),
                                     "_bm": F.when(split & ~F.col("_two"), mass_right).otherwise(zero).cast(WIDE), "_mass_r": mass_right}))
        rows = running(rows, chain, EDGE, _j=("sum", F.col("_gain")), _bb=("sum", F.col("_bm")), _was=("last", F.col("_event")))
        rows = stored(rows.withColumns({"_j": F.coalesce("_j", zero), "_bb": F.coalesce("_bb", zero)}))
        rows = running(rows, chain, EDGE, _j0=("last", F.when(F.col("_event").isNotNull(), F.col("_j"))))
        joined_left = F.when(F.col("_two"), F.col("_joined1")).otherwise(F.col("_j") - F.coalesce("_j0", zero))
        rows = rows.withColumn("_own_l", F.when(F.col("_split"), joined_left - times("_left")).cast(WIDE))
        # what lies inside the cluster that an event begins or goes on with; a split inside a chain sets its left against it later
        mass_left = F.greatest("_own_l", "_inner1")
        inside = F.when(F.col("_split") & F.col("_two"), mass_left + F.col("_mass_r")).when(F.col("_split"), F.col("_own_l") - F.col("_bb")).when(
            F.col("_event") == F.col("_n"), zero).when(F.col("_br"), F.col("_ri")).when(F.col("_event").isNotNull(), F.col("_inner1"))
        rows = running(stored(rows.withColumn("_z", inside.cast(WIDE))), chain, EDGE, _most=("max", F.col("_z")))
        inner_left = F.when(F.col("_two"), F.col("_inner1")).otherwise(F.col("_bb") + F.col("_most"))
        rows = stored(rows)
        ended = rows.filter("_split").select(*keys, F.col("_n").alias("_parent"), "_q", F.inline(F.array(
            F.struct(F.when(F.col("_two"), F.col("_cluster1")).otherwise(F.col("_was")).alias("_c"), (F.col("_own_l") >= inner_left).alias("_chosen")),
            F.struct(F.col("_of").alias("_c"), (F.col("_own_r") >= F.col("_ri")).alias("_chosen")))))
        clusters = ended if clusters is None else clusters.unionByName(ended)
        now = rows.withColumn("_cluster", F.coalesce("_event", "_was"))
        found = now.select(*chain, *EDGE, "_event", "_cluster")
        nodes = found if nodes is None else nodes.unionByName(found)
        start = F.when(F.col("_event").isNotNull(), F.col("_j")).otherwise(F.col("_j0"))
        state = F.struct("_size", "_cluster", (F.col("_j") + F.col("_gain") - F.coalesce(start, zero)).cast(WIDE).alias("_joined"),
                         (F.col("_bb") + F.col("_bm") + F.greatest("_z", "_most")).cast(WIDE).alias("_inner"))
        top = now.groupBy(*chain).agg(F.max_by(state, F.struct(*EDGE)).alias("_t")).select(*chain, "_t.*")
        tops = stored(top) if tops is None else stored(tops.unionByName(top))
    return nodes, clusters


def _outermost(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _c, _best``: of ``_c`` and the clusters around it the outermost one that is ``_marked`` (null: none)."""
    best = F.when(F.col("_marked"), F.col("_c"))
    state = stored(clusters.select(*keys, "_c", F.col("_parent").alias("_up"), best.alias("_best")))
    done = None
    while True:
        around = state.select(*keys, F.col("_c").alias("_up"), F.col("_up").alias("_next"), F.col("_best").alias("_outer"))
        if done is not None:
            around = around.unionByName(done.select(*keys, F.col("_c").alias("_up"), F.lit(None).cast("long").alias("_next"), F.col("_best").alias("_outer")))
        met = stored(state.join(around, keys + ["_up"], "left").select(*keys, "_c", F.col("_next").alias("_up"), F.coalesce("_outer", "_best").alias("_best")))
        ended = met.filter("_up is null").drop("_up")
        done = ended if done is None else done.unionByName(ended)
        state = met.filter("_up is not null")
        if not state.limit(1).count():
            return done


def labels(points: DataFrame, edges: DataFrame, *, keys: list[str], min_size: int, density: Column, merges: Column) -> DataFrame:
    """``keys, _id, cluster_id`` for all ``points``; clusters count from 0 in order of their smallest id, -1 is noise.

    ``merges`` tells of a cluster (by ``_q``, the edge at which it ends) whether it is too close to its sibling to stand alone:
    such a choice passes to the cluster around it, but never to the whole.
    """
    noise = points.select(*keys, "_id", F.lit(-1).alias("cluster_id"))
    tree, lights = contracted(edges, keys)
    if tree is None:
        return noise
    nodes, clusters = condensed(stored(tree), keys, min_size, density)
    # from each point's lightest edge up to the first cluster; what is looked through on the way is smaller than min_size
    chain = ["_level", "_chain"]
    first = (nodes.filter(F.col("_event").isNotNull()).groupBy(*keys, *chain).agg(F.min_by("_event", F.struct(*EDGE)).alias("_first")))
    hung = lights.select(*keys, "_level", F.col("_c").alias("_chain"), *[F.col(c).alias("_up" + c) for c in EDGE])
    at = lights.filter("_level = 0").select(*keys, F.col("_c").alias("_id"), *EDGE)
    homes = None
    while True:
        met = stored(at.join(nodes.select(*keys, *EDGE, *chain, "_cluster"), keys + EDGE).join(first, keys + chain, "left")
                  .withColumn("_home", F.coalesce("_cluster", "_first")))
        home = met.filter(F.col("_home").isNotNull()).select(*keys, "_id", "_home")
        homes = home if homes is None else homes.unionByName(home)
        at = met.filter(F.col("_home").isNull()).join(hung, keys + chain).select(*keys, "_id", *[F.col("_up" + c).alias(c) for c in EDGE])
        if not at.limit(1).count():
            break
    chosen = _outermost(clusters.withColumn("_marked", F.col("_chosen")), keys).filter("_c = _best").select(*keys, "_c")
    inner = clusters.select(*keys, F.col("_c").alias("_parent"), F.lit(True).alias("_known"))
    to = F.when(merges & F.col("_known"), F.col("_parent")).otherwise(F.col("_c"))  # the whole is no row of clusters
    lifted = roots(clusters.join(inner, keys + ["_parent"], "left").select(*keys, "_c", to.alias("_to")), keys)
    standing = stored(chosen.join(lifted, keys + ["_c"]).select(*keys, F.col("_root").alias("_c"), F.lit(True).alias("_marked")).distinct())
    final = _outermost(clusters.join(standing, keys + ["_c"], "left").withColumn("_marked", F.coalesce("_marked", F.lit(False))), keys)
    members = stored(homes.join(final.select(*keys, F.col("_c").alias("_home"), "_best"), keys + ["_home"]).filter(F.col("_best").isNotNull()))
    starts = laid_out(members.groupBy(*keys, "_best").agg(F.min("_id").alias("_start")), [*keys, "_start"])
    numbered = running(starts, keys, ["_start"], _number=("sum", F.lit(1).cast("long"))).select(
        *keys, "_best", F.coalesce("_number", F.lit(0)).cast("int").alias("cluster_id"))
    found = members.select(*keys, "_id", "_best").join(numbered, keys + ["_best"]).select(*keys, "_id", "cluster_id")
    return points.select(*keys, "_id").join(found, keys + ["_id"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
