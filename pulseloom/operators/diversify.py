"""Maximal-marginal-relevance selection for all groups at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window

from pulseloom import settings
from pulseloom.functions.scores import min_max, with_extent
from pulseloom.operators.similarity import apart, best_query_similarity, matrix, unit_rows
from pulseloom.session import cut


def greedy_picks(unit: np.ndarray, relevance: np.ndarray, penalty: np.ndarray, lam: float, picks: int,
                 outside: tuple[float, int] | None, ordinals: np.ndarray, first: bool) -> list[int]:
    """Picks by marginal relevance among the rows of one pool, in order of selection.

    ``penalty`` is each row's similarity to what was picked before. Scores only fall as more is picked, so a pick is
    final while it ranks ahead of ``outside``, the best row left out of the pool. The very first pick is the exception:
    it has no penalty, later scores may exceed it, so it is taken alone when the pool is not the whole group.
    """
    chosen: list[int] = []
    free = np.ones(len(relevance), dtype=bool)
    penalty = penalty.copy()
    while len(chosen) < picks and free.any():
        start = first and not chosen
        score = np.where(free, lam * relevance - (1 - lam) * (0.0 if start else penalty), -np.inf)
        best = int(np.lexsort((ordinals, -score))[0])
        if outside is not None and chosen and (score[best], -ordinals[best]) < (outside[0], -outside[1]):
            break
        chosen.append(best)
        free[best] = False
        near = unit @ unit[best]
        penalty = near if start else np.maximum(penalty, near)
        if start and outside is not None:
            break
    return chosen


def diversify(df: DataFrame, k: int = settings.MMR_TOP_K, lam: float = settings.MMR_LAMBDA, *, keys: list[str],
              id_col: str, vec_col: str, relevance_col: str, ordinal_col: str,
              pool_rows: int = settings.MMR_POOL_ROWS) -> DataFrame:
    """``keys, id, pick``: up to ``k`` rows per group in order of selection; a group of at most ``k`` passes whole.

    Per pass, each unfinished group sends its ``pool_rows`` best rows to one task, which picks as long as the picks
    are certain to beat every row left out; then the left-out rows are scored again against the picks. A group that
    fits one pool takes a single pass. A pool is the only thing of a group that one task ever holds.
    """
    assert len(keys) == 1, "groups are named by one column"
    key = keys[0]
    base = df.select(key, F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"),
                     F.col(relevance_col).cast("double").alias("_r"), F.col(ordinal_col).cast("bigint").alias("_ord"))
    sizes = base.groupBy(key).agg(F.count("*").alias("_rows"))
    sized = base.join(sizes, key)
    short = sized.filter(F.col("_rows") <= k)
    by_ordinal = Window.partitionBy(key).orderBy("_ord", "_id")
    result = short.withColumn("pick", F.row_number().over(by_ordinal)).filter(F.col("pick") <= k).select(key, "_id", "pick")

    long = with_extent(sized.filter(F.col("_rows") > k), keys, r="_r")
    state = cut(long.select(key, "_id", "_vec", "_ord", min_max(F.col("_r"), F.col("r_min"), F.col("r_max")).alias("_r")))
    pick_schema = T.StructType([base.schema[key], base.schema["_id"], base.schema["_vec"], T.StructField("pick", T.IntegerType()),
                                T.StructField("_done", T.BooleanType())])

    def select(first: bool):
        def run(pool: pa.Table, taken: pa.Table) -> pa.Table:
            pool = pool.sort_by("_rank")
            whole = pool["_left"][0].as_py() if pool.num_rows else 0
            cutoff = None
            if pool.num_rows < whole:
                last = pool.num_rows - 1
                cutoff = (pool["_score"][last].as_py(), pool["_ord"][last].as_py())
                pool = pool.slice(0, last)
            vectors = unit_rows(matrix(pool["_vec"])) if pool.num_rows else np.zeros((0, 1))
            relevance, ordinals = pool["_r"].to_numpy(), pool["_ord"].to_numpy()
            penalty = np.zeros(pool.num_rows) if first else pool["_near"].to_numpy()
            had = taken.num_rows
            chosen = greedy_picks(vectors, relevance, penalty, lam, k - had, cutoff, ordinals, first)
            rows = pool.take(pa.array(chosen, pa.int64()))
            done = had + len(chosen) >= k
            return pa.table({key: rows[key], "_id": rows["_id"], "_vec": rows["_vec"],
                             "pick": pa.array(np.arange(had + 1, had + 1 + len(chosen)).astype(np.int32)),
                             "_done": pa.array([done] * len(chosen), pa.bool_())})
        return run

    spark = df.sparkSession
    picks = spark.createDataFrame([], pick_schema)
    best_first = Window.partitionBy(key).orderBy(F.desc("_score"), "_ord")
    first = True
    while True:
        finished = picks.filter("_done").select(key).distinct()
        open_rows = state.join(picks.select(key, "_id"), [key, "_id"], "left_anti") if not first else state
        if not first:
            open_rows = open_rows.join(finished, key, "left_anti")
            near = best_query_similarity(open_rows, picks, key=key, id_col="_id", vec_col="_vec", query_vec="_vec")
            open_rows = open_rows.join(near.withColumnRenamed("relevance_score", "_near"), [key, "_id"])
            open_rows = cut(open_rows.withColumn("_score", lam * F.col("_r") - (1 - lam) * F.col("_near")))
        else:
            open_rows = open_rows.withColumn("_near", F.lit(0.0)).withColumn("_score", lam * F.col("_r"))
        left = open_rows.groupBy(key).agg(F.count("*").alias("_left"))
        pool = (open_rows.withColumn("_rank", F.row_number().over(best_first)).filter(F.col("_rank") <= pool_rows)
                .join(left, key))
        chosen = pool.groupBy(key).cogroup(apart(picks).groupBy(key)).applyInArrow(select(first), pick_schema) if not first else \
            pool.groupBy(key).applyInArrow(lambda t: select(True)(t, t.slice(0, 0)), pick_schema)
        picks = cut(picks.unionByName(chosen))
        first = False
        reached = picks.groupBy(key).agg(F.max("pick").alias("_n"))
        if state.select(key).distinct().join(reached.filter(F.col("_n") >= k), key, "left_anti").limit(1).count() == 0:
            break
    picked = picks.select(key, "_id", "pick")
    return result.unionByName(picked).withColumnRenamed("_id", id_col)
