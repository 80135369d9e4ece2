"""Tables written once and read several times.

Used where a plan would otherwise compute an expensive input for each of its
branches.  The files lie in the shared folder of the cluster, so a lost
executor costs nothing but the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    A session on one machine that names none gets a folder of its own; on a
    cluster that would be a folder the executors cannot share, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="opslake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a columnar table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders of a table that is opened here are listed by as many tasks as there are cores.

    Else every folder is a task of its own, up to ten thousand, whose start takes longer than the listing.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave, once nothing will read them again."""
    for table in tables:
        spark = table.sparkSession
        root = shared_folder(spark).split(":", 1)[-1].rstrip("/") + "/"
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if root.lstrip("/") in folder:  # never anything outside the shared folder
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
