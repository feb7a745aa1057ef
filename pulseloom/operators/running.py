"""Running totals over groups of any size, without a group meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseloom.session import stored

RANGE = "_p"  # the range of the sort that a row lies in


def laid_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted by range, with the number of each row's range; fixed, so that it may be read again."""
    return stored(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn(RANGE, F.spark_partition_id()))


def running(rows: DataFrame, within: list[str], order: list[str], **totals: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``totals``: a ``("sum" | "max" | "last", column)`` over the rows before, in ``order``, of the
    same ``within`` (null where there are none; ``last`` passes over nulls).

    ``rows`` come from ``laid_out`` by ``within`` and ``order``, and are read twice. A task works on one range of a group; only the totals of
    whole ranges, a row for each range and group, are carried on to the later ones.
    """
    rows = rows.select("*", *[value.alias(f"_v_{name}") for name, (_, value) in totals.items()])
    inside = Window.partitionBy(RANGE, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*within).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    parts = rows.groupBy(RANGE, *within).agg(*[whole[kind](f"_v_{name}").alias(f"_w_{name}") for name, (kind, _) in totals.items()])
    carried = parts.select(RANGE, *within, *[over[kind](f"_w_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in totals.items()])
    here = rows.select("*", *[over[kind](f"_v_{name}").over(inside).alias(f"_h_{name}") for name, (kind, _) in totals.items()])
    both = {"sum": lambda c, h: F.when(c.isNull(), h).when(h.isNull(), c).otherwise(c + h), "max": F.greatest, "last": lambda c, h: F.coalesce(h, c)}
    kept = [c for c in rows.columns if not c.startswith("_v_")]
    return here.join(carried, [RANGE, *within]).select(
        *kept, *[both[kind](F.col(f"_c_{name}"), F.col(f"_h_{name}")).alias(name) for name, (kind, _) in totals.items()])
