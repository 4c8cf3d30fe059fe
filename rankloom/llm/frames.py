"""Row-wise operators as Arrow maps that keep the columns they get."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankloom.llm.storage import small_batches


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns with any name do no harm."""
    return df.select(*[df[n] for n in names])


def append_columns(df: DataFrame, column: str, fields: list[T.StructField], compute: Callable[[Iterator[list]], Iterator[list[pa.Array]]]) -> DataFrame:
    """Add columns computed from one column, batch by batch.

    ``compute`` gets an iterator over lists of that column's values and yields, for each list, arrays for ``fields``.
    """
    schema = T.StructType(df.schema.fields + fields)
    small_batches(df.sparkSession)
    names = [f.name for f in schema.fields]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def values() -> Iterator[list]:
            for b in batches:
                held.append(b)
                yield b.column(at).to_pylist()

        for arrays in compute(values()):
            b = held.pop()
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=names)

    return df.mapInArrow(run, schema)
