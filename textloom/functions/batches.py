"""How many rows go to Python at once, and lists of rows that come back."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a batch of texts, where the session has Spark's own 10,000: whole texts of that many rows are much for a worker.
ROWS = 500


def small(spark: SparkSession | None) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS))


def nested(rows: Iterable[list[tuple]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """array<struct> of lists of tuples, built a column at a time."""
    ends, flat = [0], []
    for row in rows:
        flat += row
        ends.append(len(flat))
    columns = zip(*flat, strict=True) if flat else [()] * len(fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, fields.values(), strict=True)], list(fields)))
