"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.session import configure

#: White space that parts words: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary Arrow column as (all bytes, offsets); null values have no bytes."""
    column = column.fill_null(b"")
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Apply ``work`` to each Arrow batch in turn; only one batch is held, and none once the task is done.

    Python workers outlive their tasks: what Arrow keeps for later is given back at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out
                del out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def list_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of the given lengths over ``values``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """``used`` and all other columns in one, ``_row``, where no name can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *rest).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], **used: Column) -> DataFrame:
    """``columns`` in their order again, from ``used`` or else ``_row``."""
    return rows.select(*[(used[c] if c in used else F.col("_row").getField(c)).alias(c) for c in columns])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` ready for output columns of these names: columns of the same name are replaced."""
    return df.drop(*[c for c in df.columns if c.lower() in names])
