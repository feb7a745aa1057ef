"""Set operations and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.operators.ranking import top_n


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Union that remembers which input a row came from."""
    return reduce(DataFrame.unionByName, [p.withColumn("part_ord", F.lit(i)) for i, p in enumerate(parts)])


def first_wins(df: DataFrame, key: Column, order: list[Column | str], keys: list[str] | None = None) -> DataFrame:
    """The first row of every key value (within ``keys``)."""
    return top_n(df.withColumn("_key", key), 1, (keys or []) + ["_key"], order, "_rank").drop("_rank", "_key")


def distinct_ignoring_case(df: DataFrame, column: str, order: list[Column | str], keys: list[str] | None = None,
                           trimmed: bool = False) -> DataFrame:
    key = F.lower(F.col(column))
    return first_wins(df, F.trim(key) if trimmed else key, order, keys)


def insert_or_ignore(base: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Fresh rows join unless their key exists; of several fresh rows with one key the first joins.

    Repeats go first: they vanish before the shuffle, so no key is hot when the two tables meet.
    """
    first = top_n(fresh, 1, keys, order, "_rank").drop("_rank")
    return base.unionByName(first.join(base.select(*keys), keys, "left_anti"))


def insert_or_update(base: DataFrame, fresh: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """On a known key only the ``updated`` columns change; ``fresh`` has one row per key."""
    renamed = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fresh.columns if c not in keys],
                           F.lit(True).alias("_fresh"))
    joined = base.withColumn("_known", F.lit(True)).join(renamed, keys, "full")
    pick = lambda c: (F.when(F.col("_fresh"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in updated
                      else F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_new_{c}")))
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in base.columns])


def patch(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Provided (non-null) fields of ``changes`` replace those of the base row with the same key."""
    columns = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def delete_cascading(tables: dict[str, tuple[DataFrame, str]], removed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows that belong to removed keys; ``tables`` gives each table its key column."""
    return {name: df.join(removed.select(F.col(key).alias(column)).distinct(), column, "left_anti")
            for name, (df, column) in tables.items()}
