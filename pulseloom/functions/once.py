"""Evaluate an expression once.

Column functions build expression trees: an argument used three times is three copies of its tree, and a filter on a
computed column is pushed below the projection that computes it, where it is computed again. Cleaning long texts is
too expensive for either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` bound to a lambda variable, so it is evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator, which no filter is pushed below."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
