"""A term index beside stored logs: which files of a tenant-day hold a word.

The index is a table (tenant, day, term, file) in folders by tenant and month,
sorted by day and term inside its files, so a lookup reads few row groups of the
days that are asked for.  A folder for every day would hold a few rows where a
tenant logs little.  Files that were written after the last index run are not in it; a search reads them
whole, so it is complete at any time.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions.folders import folder_name, folders_in, in_few_tasks, parts_of
from opslake.functions.scratch import listed_in_few_tasks, remove, scratch_path
from opslake.functions.skew import plain_join
from opslake.operators import logs as log_ops

INDEX_SCHEMA = "term string, file string, log_date date, tenant_id string, log_month string"
LOG_SCHEMA = "message string, tenant_id string, log_date date"
#: Stands for a whole file in the index, so that a file without any word is known too; no word can look like it.
WHOLE_FILE = ""
WORD = r"(?U)\w+"
#: Characters of messages whose words one task takes in.
TASK_CHARS = 8_000_000
MONTH = "yyyy-MM"


def terms(message: Column) -> Column:
    """The different words of a message as search compares them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(message, F.lit(""))), F.lit(WORD), 0))


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The stored index; empty where none was written yet."""
    try:
        with listed_in_few_tasks(spark):
            return spark.read.schema(INDEX_SCHEMA).parquet(_by_month(index_path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).selectExpr(*(f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, INDEX_SCHEMA.split(", "))))


def _by_month(index_path: str) -> str:
    """Beside it may lie the folders of an index by days; its files count as new ones."""
    return f"{index_path}/months"


def extend_index(spark: SparkSession, logs_path: str, index_path: str) -> None:
    """Add the files that the index does not know, tenant-day by tenant-day; only these are read.

    Files are dealt out by the length of their messages, so what a task holds does not grow with the table.
    Their rows are stored once in between, so that each file is opened once.
    """

    # A file is known by its tenant, its day's folder and its name: a third of its address, which every term would carry.
    file = F.regexp_extract(F.input_file_name(), "[^/]+/[^/]+$", 0).alias("file")
    known = read_index(spark, index_path).where(F.col("term") == WHOLE_FILE).select("tenant_id", "file")
    path = scratch_path(spark, "unindexed")
    # One part after the other, so the driver never holds the listing of more than one.
    for folders in parts_of(spark, logs_path):
        with listed_in_few_tasks(spark):
            stored = spark.read.schema(LOG_SCHEMA).option("basePath", logs_path).parquet(*folders)
        files = in_few_tasks(stored.select("tenant_id", "log_date", file, "message"))
        plain_join(files, known, ["tenant_id", "file"], "left_anti").write.mode("append").parquet(path)
    fresh = spark.read.schema(f"{LOG_SCHEMA}, file string").parquet(path)
    chars = fresh.agg(F.sum(F.char_length("message"))).first()[0] or 0
    words = F.concat(F.array(F.lit(WHOLE_FILE)), terms(F.col("message")))
    # A file goes in with all its rows or not at all, so a term of a file is written once.
    listed = fresh.repartition(1 + chars // TASK_CHARS, "tenant_id", "file").select("tenant_id", "log_date", "file", F.explode(words).alias("term"))
    keys = ["tenant_id", "log_month"]
    (
        listed.groupBy("tenant_id", "log_date", "term", "file")
        .agg(F.date_format("log_date", MONTH).alias("log_month"))
        .hint("rebalance", *keys)
        .sortWithinPartitions(*keys, "log_date", "term")
        .write.mode("append")
        .partitionBy(*keys)
        .parquet(_by_month(index_path))
    )
    remove(fresh)


def files_to_read(
    spark: SparkSession, logs_path: str, index_path: str, tenant_id: str, query: str, start: datetime | None, end: datetime | None
) -> tuple[list[str], list[str]]:
    """Files of the tenant and days that may hold a word of the query, and all their files.

    What comes to the driver is part of a listing of files, as any reader keeps there.
    """
    every = _files_of(spark, logs_path, tenant_id, start, end)
    index = read_index(spark, index_path).where(F.col("tenant_id") == tenant_id)
    for day, beyond in ((start, lambda c, d: c >= d), (end, lambda c, d: c <= d)):
        if day is not None:
            index = index.where(beyond(F.col("log_date"), F.lit(day.date())) & beyond(F.col("log_month"), F.lit(f"{day:%Y-%m}")))
    asked = sorted({t for t in re.split(r"\W+", query.lower()) if t})
    # The engine may see several words, or none, where the query has one; a file must hold all of them.
    split = spark.createDataFrame([(t,) for t in asked], "asked string").select("asked", terms(F.col("asked")).alias("parts")).collect()
    wanted = sorted({part for r in split for part in r.parts})
    if any(not r.parts for r in split):
        return every, every
    held = index.where(F.col("term").isin(WHOLE_FILE, *wanted)).groupBy("file").agg(F.collect_set("term").alias("held"))
    any_word = F.lit(False)
    for r in split:
        any_word = any_word | F.forall(F.array(*(F.lit(p) for p in r.parts)), lambda p: F.array_contains("held", p))
    told = {_plain(r.file): r.hit for r in held.select("file", any_word.alias("hit")).toLocalIterator()}
    return [f for f in every if told.get(_plain("/".join(f.rsplit("/", 2)[1:])), True)], every


def _files_of(spark: SparkSession, logs_path: str, tenant_id: str, start: datetime | None, end: datetime | None) -> list[str]:
    """A listing of the tenant's own folder, without the days outside of the time range."""
    folder = f"{logs_path}/{folder_name('tenant_id', tenant_id)}"

    def wanted(file: str) -> bool:
        day = date.fromisoformat(re.search(r"/log_date=([0-9-]{10})/", file).group(1))
        return (start is None or day >= start.date()) and (end is None or day <= end.date())

    try:
        days = [f"{folder}/{d}/" for d in folders_in(spark, folder)]
        asked = [d for d in days if wanted(d)]
        if days and not asked:
            return []
        with listed_in_few_tasks(spark):
            listed = spark.read.schema("id string").parquet(*(asked if len(asked) < len(days) else [folder])).inputFiles()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [f for f in listed if wanted(f)]


def _stored_rows(spark: SparkSession, logs_path: str) -> DataFrame:
    """Stored logs for their columns and types: all tenants, and of each only the first day where the folders can be listed."""
    tenants = [f"{logs_path}/{t}" for t in folders_in(spark, logs_path)]
    first = [f"{t}/{days[0]}" for t in tenants if (days := folders_in(spark, t))]
    with listed_in_few_tasks(spark):
        return spark.read.option("basePath", logs_path).parquet(*(first or [logs_path]))


def _plain(file: str) -> str:
    """One spelling for a file whether a listing or a reader names it."""
    return unquote(re.sub("^file:/+", "/", file))


def indexed_search(
    spark: SparkSession,
    logs_path: str,
    index_path: str,
    tenant_id: str,
    query: str,
    min_level: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """``log_search`` over stored logs that opens only files which can hold a word of the query."""
    if not query.strip():
        return log_ops.log_search(log_ops.read_logs(spark, logs_path, tenant_id, start, end), tenant_id, query, min_level, start, end)
    stored = _stored_rows(spark, logs_path)
    chosen, _ = files_to_read(spark, logs_path, index_path, tenant_id, query, start, end)
    if not chosen:
        return stored.where(F.lit(False))
    rows = spark.read.schema(stored.schema).option("basePath", logs_path).parquet(*(unquote(f) for f in chosen))  # a listing names files as addresses
    return log_ops.log_search(rows.select(*stored.columns), tenant_id, query, min_level, start, end)
