"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: What an operator unpacks of an Arrow batch at once: rows, and bytes beyond which no row is added.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def parts(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and, by its texts or binaries in ``column``, bytes. The session's batch size may be larger."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        within = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right"))
        stop = max(at + 1, min(at + BATCH_ROWS, within))
        yield batch.slice(at, stop - at)
        at = stop


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` and ``BATCH_BYTES`` for what is run inside; the session's settings come back after."""
    before = {}
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            before[key] = now
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def map_texts(df: DataFrame, key: str, text: str, fields: str, per_batch: Callable[[list], list[list]]) -> DataFrame:
    """(key, *fields) for each row of ``df``; other columns are not read.

    ``per_batch`` gets the texts of a slice of an Arrow batch (null as None) and returns
    one list for each field. Slices are bounded in rows and bytes, so a task never
    unpacks its whole partition, whatever the session's batch size.
    """
    base = df.select(df[key], df[text])
    kind = base.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                columns = per_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, kinds)], names=names)

    schema = f"{key} {kind}, {fields}"
    names = [key, *(f.split()[0] for f in fields.split(", "))]
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(fields)]
    return base.mapInArrow(run, schema)
