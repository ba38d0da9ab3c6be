"""The one bridge from DataFrames to batch Python code."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BatchFn = Callable[..., Sequence[Sequence]]


def arrow_map(df: DataFrame, setup: Callable[[], BatchFn], schema: str) -> DataFrame:
    """Run a batch function over ``df`` in Arrow batches.

    ``setup`` runs once a task and returns ``fn``; ``fn`` gets one Python list
    per column of ``df`` and returns one sequence (list or NumPy array) per
    column of ``schema``. The number of rows may change.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = setup()
        for batch in batches:
            columns = fn(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
