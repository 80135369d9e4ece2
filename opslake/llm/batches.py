"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows, and bytes of text, that a task holds as Python objects at once; a longer text is a slice of its own.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches."""
    for batch in batches:
        weights = np.zeros(batch.num_rows, dtype=np.int64)
        for name, kind in zip(batch.schema.names, batch.schema.types, strict=True):
            if pa.types.is_string(kind) or pa.types.is_large_string(kind):
                weights += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(weights)
        start = 0
        while start < batch.num_rows:
            reached = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, reached + SLICE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``fn`` over slices of each partition; rows stay where they are."""

    def run(batches):
        for part in slices(batches):
            yield fn(part)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def share(spark: SparkSession, value):
    """Broadcast ``value``; a worker process unpacks it once, so what it caches on it lasts over tasks."""
    return spark.sparkContext.broadcast(value)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Which values the top ``bits`` bits of the single column (64-bit hashes) take, one bit each.

    Its size depends on ``bits`` alone: executors combine the marks, and one map
    comes to the driver.  Rows that it passes are a superset of those with an
    equal hash; a join decides.
    """
    (name,) = hashes.columns
    place = f"shiftrightunsigned(`{name}`, {64 - bits})"
    marks = hashes.selectExpr(f"cast(shiftright({place}, 6) as int) as word", f"shiftleft(1L, cast({place} & 63 as int)) as bit")
    words = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    total = np.zeros((1 << bits) // 64, np.uint64)
    total[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    # The first value is the highest bit of the first byte.
    return np.packbits(np.unpackbits(total.view(np.uint8), bitorder="little"))


def keep_marked(df: DataFrame, marks: np.ndarray, hash_col: str) -> DataFrame:
    """The rows whose hash is marked in a ``bitmap``; nothing is shuffled."""
    held = share(df.sparkSession, [marks])
    bits = len(marks).bit_length() + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = held.value
        if len(kit) == 1:
            kit.append(np.unpackbits(kit[0]).astype(bool))
        for batch in batches:
            places = batch.column(hash_col).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            yield batch.filter(pa.array(kit[1][places]))

    return df.mapInArrow(run, df.schema)


def modest_sample(df: DataFrame, key: str, rows: int, parts: int = 1 << 20) -> DataFrame:
    """About ``rows`` rows of ``df``, picked by a hash of ``key`` so that a second run picks the same.

    The count reads no text.  Inputs of up to ``rows`` rows are taken whole.
    """
    total = df.select(key).count()
    if total <= rows:
        return df
    share_of = int(parts * rows / total) + 1
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(parts)) < share_of)
