"""Arrow-batched maps: a Python function gets a record batch's columns as lists and yields rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that leave a Python worker at once.
OUT_ROWS = 20_000


def flat_map(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """`make()` runs once in each task; what it returns gets the columns of each batch as lists and gives rows."""
    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spark_schema)
        rows_of = make()
        kept: list[tuple] = []
        for batch in batches:
            kept.extend(rows_of(*(c.to_pylist() for c in batch.columns)))
            while len(kept) >= OUT_ROWS:
                yield _batch(kept[:OUT_ROWS], arrow)
                del kept[:OUT_ROWS]
        if kept:
            yield _batch(kept, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
