"""Rows written into very many small folders.

A table by tenant and day has a folder for every few rows where tenants are many
or quiet.  Spark's writer then spends its time on the file system: without native
libraries Hadoop starts a process for every local folder and file that it makes.
On a disk that all machines mount, tasks write these files themselves; any other
address goes through Spark's writer.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.scratch import materialize, remove

SUFFIX = {"json": ".json.gz", "parquet": ".snappy.parquet"}
#: Bytes of one key that a task holds before it writes them as a row group.
HELD_BYTES = 32 << 20
#: Folders that are opened as one table.
MOST_FOLDERS = 20_000
#: Characters of a folder's name that Spark writes as their code.
ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}
#: Types that Arrow and Spark store alike.
PLAIN = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType,
    T.DateType, T.TimestampNTZType, T.DecimalType,
)


def mounted(spark: SparkSession, uri: str) -> str | None:
    """The local path of an address that Spark keeps on a mounted disk, else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def folder_name(key: str, value: str | None) -> str:
    """The folder of a key's value as Spark names it."""
    escaped = "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value or "")
    return f"{key}={escaped or '__HIVE_DEFAULT_PARTITION__'}"


def _stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys."""
    values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield values[start], batch.slice(start, i - start)
            start = i


class _File:
    """One file under a name that no reader lists."""

    def __init__(self, folder: str, name: str, kind: str, attempt: int):
        os.makedirs(folder, exist_ok=True)
        self.draft, self.final, self.kind = f"{folder}/.{name}.{attempt}", f"{folder}/{name}", kind
        self.held: list[pa.RecordBatch] = []
        self.bytes, self.writer, self.raw = 0, None, None

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        self.bytes += rows.nbytes
        if self.bytes > HELD_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.kind == "json":
            if self.writer is None:
                self.raw = open(self.draft, "wb")  # noqa: SIM115
                self.writer = gzip.GzipFile("", "wb", 6, self.raw, 0)
            for rows in self.held:
                self.writer.write("".join(f"{line}\n" for line in rows.column(0).to_pylist()).encode())
        else:
            self.writer = self.writer or pq.ParquetWriter(self.draft, self.held[0].schema)
            self.writer.write_table(pa.Table.from_batches(self.held))
        self.held, self.bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        self.writer.close()
        if self.raw is not None:
            self.raw.close()


def _drafts(batches: Iterator[pa.RecordBatch], root: str, keys: list[str], kind: str, job: str) -> Iterator[pa.RecordBatch]:
    """A file for each key of a partition that is sorted by its keys; gives the names of the drafts and of the files."""
    task = TaskContext.get()
    name = f"part-{task.partitionId():05d}-{job}{SUFFIX[kind]}"
    made: list[_File] = []
    current, file = None, None

    def names() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"draft": [f.draft for f in made], "final": [f.final for f in made]})

    try:
        for batch in batches:
            for key, rows in _stretches(batch, keys):
                if file is None or key != current:
                    if file is not None:
                        file.close()
                    folder = "/".join([root, *map(folder_name, keys, key)])
                    current, file = key, _File(folder, name, kind, task.taskAttemptId())
                    made.append(file)
                file.add(rows.select([c for c in rows.schema.names if c not in keys]))
        if file is not None:
            file.close()
        yield names()
    except BaseException:
        for f in made:
            if os.path.exists(f.draft):
                os.remove(f.draft)
        raise


def _publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give drafts their names; one that an attempt before has named is done."""
    for batch in batches:
        for draft, final in zip(batch.column("draft").to_pylist(), batch.column("final").to_pylist(), strict=True):
            try:
                os.replace(draft, final)
            except FileNotFoundError:
                if not os.path.exists(final):
                    raise
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def append_folders(rows: DataFrame, uri: str, keys: list[str], kind: str) -> None:
    """Append ``rows`` to a table of JSON lines (gzip) or Parquet by ``keys``; a busy key gets as many files as its size asks for.

    Files on a mounted disk are all written first, under names that readers do not list, and then renamed.
    """
    spark = rows.sparkSession
    root = mounted(spark, uri)
    even = rows.hint("rebalance", *keys)
    others = [f for f in rows.schema.fields if f.name.lower() not in keys]
    if root is None or not others or (kind == "parquet" and not all(isinstance(f.dataType, PLAIN) for f in others)):
        writer = even.write.mode("append").partitionBy(*keys)
        if kind == "json":
            # Tasks put their files in place themselves; the driver would move those of all folders one by one.
            writer = writer.option("compression", "gzip").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.format(kind).save(uri)
        return
    names = [f"`{f.name}`" for f in others]
    content = [F.to_json(F.struct(*names)).alias("_line")] if kind == "json" else names
    # Empty and missing values have one folder, so they are one key.
    values = (F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)
    text = even.select(*values, *content).sortWithinPartitions(*keys)
    job = uuid.uuid4().hex
    drafts = materialize(text.mapInArrow(lambda b: _drafts(b, root, keys, kind, job), "draft string, final string"), "drafts")
    drafts.mapInArrow(_publish, "n bigint").agg(F.sum("n")).collect()
    remove(drafts)
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"), True).close()


def _visible(folder: str) -> list[str]:
    return sorted(n for n in os.listdir(folder) if not n.startswith((".", "_")))


def folders_in(spark: SparkSession, uri: str) -> list[str]:
    """Names of the folders of key values at an address on a mounted disk; none where it is another one or missing."""
    root = mounted(spark, uri)
    return [n for n in _visible(root) if "=" in n and os.path.isdir(f"{root}/{n}")] if root and os.path.isdir(root) else []


def parts_of(spark: SparkSession, uri: str) -> list[list[str]]:
    """The folders of a table by two keys, in parts of at most ``MOST_FOLDERS``; the table itself where one part holds all.

    What Spark does with the folders of one table takes time by the square of their number.
    """
    root, uri = mounted(spark, uri), uri.rstrip("/")
    parts, part, held = [], [], 0
    for top in _visible(root) if root and os.path.isdir(root) else ():
        names = _visible(f"{root}/{top}") if os.path.isdir(f"{root}/{top}") else [top]
        if len(names) > MOST_FOLDERS:
            parts += [[f"{uri}/{top}/{n}" for n in names[i : i + MOST_FOLDERS]] for i in range(0, len(names), MOST_FOLDERS)]
            continue
        if held + len(names) > MOST_FOLDERS:
            parts, part, held = [*parts, part], [], 0
        part, held = [*part, f"{uri}/{top}"], held + len(names)
    parts = [p for p in (*parts, part) if p]
    return parts if len(parts) > 1 else [[uri]]


def open_in_parts(spark: SparkSession, uri: str, read: Callable[[DataFrameReader, list[str]], DataFrame]) -> DataFrame:
    """A table by two keys, opened as the union of its parts."""
    return reduce(DataFrame.union, (read(spark.read.option("basePath", uri), p) for p in parts_of(spark, uri)))


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """Rows of a table of many small files, read in tasks by their bytes.

    Spark counts the opening of a file as 4 MB, so a task would be started for every few files.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bytes_each = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.coalesce(max(8 * spark.sparkContext.defaultParallelism, -(-size // bytes_each)))
