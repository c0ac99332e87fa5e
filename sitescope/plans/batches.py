"""Python over rows of an Arrow batch, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task holds as Python objects at a time: pages and sitemap files may be large.
SLICE_ROWS = 32


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices (views, not copies)."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def map_rows(df: DataFrame, each: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of every row; nested values are dicts and lists."""
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_pylist([x for r in b.to_pylist() for x in each(r)], schema=types)

    return df.mapInArrow(run, schema)
