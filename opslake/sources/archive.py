"""Compressed JSON log archive by service and day, and where scratch tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.folders import append_folders, in_few_tasks, open_in_parts
from opslake.functions.scratch import listed_in_few_tasks


def archive_logs(logs: DataFrame, uri: str, ts: str = "ts") -> None:
    """Write logs as JSON lines by service and day under any storage address.

    A service's day is spread over files by its size, so a busy one is not one task.
    """
    append_folders(logs.withColumn("log_date", F.to_date(ts)), uri, ["service", "log_date"], "json")


def read_archive(spark: SparkSession, uri: str, schema: T.StructType) -> DataFrame:
    """Archived logs with the partition columns; filters on them skip folders."""
    fields = [f for f in schema.fields if f.name not in ("service", "log_date")]
    full = T.StructType(
        [*fields, T.StructField("service", T.StringType()), T.StructField("log_date", T.DateType())]
    )
    with listed_in_few_tasks(spark):
        return in_few_tasks(open_in_parts(spark, uri, lambda reader, paths: reader.schema(full).json(paths)))
