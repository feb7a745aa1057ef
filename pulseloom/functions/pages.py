"""Python parsers of large texts: one text at a time, results handed on in small batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

HELD_CHARS = 1 << 20  # of rows that a task holds before it hands them on


def row_batches(batches: Iterable[pa.RecordBatch], schema: pa.Schema, rows_of: Callable[..., Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
    """What ``rows_of`` makes of the keys and the text (the last column) of each row. Only one text is a Python object at a time."""
    rows: list[tuple] = []
    held = 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        for k in range(batch.num_rows):
            *key, text = (column[k].as_py() for column in batch.columns)
            for row in rows_of(key, text):
                rows.append(row)
                held += 64 + sum(len(v) for v in row if isinstance(v, str))
                if held >= HELD_CHARS:
                    yield pack()
                    rows, held = [], 0
    if rows:
        yield pack()


def parsed(df: DataFrame, keys: list[str], text: str, schema: str | T.StructType, rows_of: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Rows by ``schema`` that ``rows_of(key, text)`` finds in each row."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    return df.select(*keys, text).mapInArrow(lambda batches: row_batches(batches, arrow, rows_of), schema)
