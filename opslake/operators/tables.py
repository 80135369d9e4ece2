"""Table work: scoped listing, paging, upsert, patches, chunks and retention."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from opslake.functions.skew import latest_per_key, salted_join

CHUNK = "7 days"


def scoped(df: DataFrame, tenant_id: str | None = None, **equal) -> DataFrame:
    """Rows of a tenant with the given column values; None means any."""
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(tie))


def active_jobs(jobs: DataFrame, tenant_id: str) -> DataFrame:
    return scoped(jobs, tenant_id, status="ACTIVE").orderBy(F.desc("job_id"))


def jobs_by_tags(jobs: DataFrame, tags: list[str], every: bool = False) -> DataFrame:
    """Jobs carrying any, or every, of the tags."""
    if every:
        for tag in tags:
            jobs = jobs.filter(F.array_contains("tags", tag))
        return jobs
    return jobs.filter(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags))))


def in_range(df: DataFrame, ts: str, start: datetime, end: datetime) -> DataFrame:
    """Rows with ``start <= ts <= end``."""
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def default_window(
    as_of: datetime, start: datetime | None = None, end: datetime | None = None, days: int = 7
) -> tuple[datetime, datetime]:
    return start or as_of - timedelta(days=days), end or as_of


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a listing with the totals of the whole listing.

    The rows come from a top-n, the total from a count that reads no columns;
    neither sorts the whole table.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(*order).offset(page * size).limit(size)
    pages = F.ceil(F.col("total_elements") / F.lit(size)).cast("int")
    return (
        rows.withColumn("page", F.lit(page))
        .withColumn("total_elements", total)
        .withColumn("total_pages", pages)
        .withColumn("first_page", F.col("page") == 0)
        .withColumn("last_page", F.col("page") + 1 >= F.col("total_pages"))
    )


def page_after(df: DataFrame, order: list[tuple[str, bool]], size: int, cursor: dict | None = None) -> DataFrame:
    """The next ``size`` rows of a listing behind a cursor, which holds the ``order`` columns of the last row seen.

    ``order``: columns and whether they go down; together they are unique.  Nulls
    come first going up and last going down, as Spark sorts.  The cursor is a
    filter, so it reaches the scan, and any page costs a top-n like the first.
    """
    rows = df
    if cursor is not None:
        behind, equal = F.lit(False), F.lit(True)
        for column, down in order:
            c, seen = F.col(column), cursor[column]
            value = F.lit(seen).cast(df.schema[column].dataType)
            if seen is None:
                further = F.lit(False) if down else c.isNotNull()
            else:
                further = ((c < value) | c.isNull()) if down else c > value
            behind = behind | (equal & further)
            equal = equal & (c.isNull() if seen is None else c == value)
        lead, down = order[0]
        if cursor[lead] is not None:  # a plain bound on the first column is what a scan can use
            value = F.lit(cursor[lead]).cast(df.schema[lead].dataType)
            rows = rows.filter((F.col(lead) <= value) | F.col(lead).isNull() if down else F.col(lead) >= value)
        rows = rows.filter(F.coalesce(behind, F.lit(False)))
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)).limit(size)


def cursor_of(page: list[Row], order: list[tuple[str, bool]]) -> dict | None:
    """The cursor behind a page; None where the page is empty and the listing at its end."""
    return {c: page[-1][c] for c, _ in order} if page else None


def decide_changes(base: DataFrame, changes: DataFrame, keys: list[str], changed_at: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """The rows that a batch of changes writes, with their new version, and the changes refused.

    A change must name the stored version (or, for a new key, none).  Of several
    that do for one key the first is taken and its version goes up by one; the
    others then name a stale version and are refused like any other stale one.
    Changes at one time go by the hash of all their columns.
    """
    stored = base.select(*keys, F.col("version").alias("_stored"))
    offered = salted_join(changes, stored, keys, changed_at, "left")
    fits = F.coalesce(F.col("version") == F.col("_stored"), F.col("_stored").isNull())
    order = Window.partitionBy(*keys, "_fits").orderBy(F.asc(changed_at), F.xxhash64(*changes.columns))
    ranked = offered.withColumn("_fits", fits).withColumn("_nth", F.row_number().over(order))
    first = F.col("_fits") & (F.col("_nth") == 1)
    conflicts = ranked.filter(~first).drop("_stored", "_fits", "_nth")
    taken = ranked.filter(first).drop("_fits", "_nth")
    written = taken.withColumn(
        "version", F.when(F.col("_stored").isNull(), F.lit(0)).otherwise(F.col("_stored") + 1).cast("int")
    ).drop("_stored")
    return written, conflicts


def versioned_upsert(
    base: DataFrame, changes: DataFrame, keys: list[str], changed_at: str = "updated_at"
) -> tuple[DataFrame, DataFrame]:
    """The table after a batch of changes, and the changes refused (see ``decide_changes``).

    The whole table as one DataFrame; ``sources.versions`` changes a stored one part by part.
    """
    written, conflicts = decide_changes(base, changes, keys, changed_at)
    kept = base.join(written.select(*keys), keys, "left_anti")
    return kept.unionByName(written), conflicts


def apply_patch(base: DataFrame, patch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Base rows with the non-null patch values laid over them; keys not in the base are ignored.

    Of several patches for one key the first by ``order`` counts, by default
    that with the smallest hash of its columns.
    """
    values = [c for c in patch.columns if c not in keys]
    single = latest_per_key(patch, keys, order or [F.xxhash64(*patch.columns)])
    renamed = single.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values))
    joined = base.join(renamed, keys, "left")
    return joined.select(
        *(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns)
    )


def create_or_update(base: DataFrame, rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Base rows with the given rows in their place, and those of new keys added; of several for one key the first counts."""
    single = latest_per_key(rows, keys, order or [F.xxhash64(*rows.columns)])
    return base.join(single.select(*keys), keys, "left_anti").unionByName(single)


def chunk_start(ts: str) -> Column:
    """Start of the seven-day chunk, aligned to the epoch."""
    week = 7 * 86_400
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(week))).cast("timestamp_ntz")


def chunk_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(chunk_start(ts).alias("chunk_start")).agg(F.count("*").alias("rows"))


def write_chunks(df: DataFrame, path: str, ts: str, sort: list[str]) -> None:
    """Append rows by chunk, sorted inside each file so row-group statistics can skip; a large chunk gets more files."""
    (
        df.withColumn("chunk_date", F.to_date(chunk_start(ts)))
        .hint("rebalance", "chunk_date")
        .sortWithinPartitions("chunk_date", *sort)
        .write.mode("append")
        .partitionBy("chunk_date")
        .parquet(path)
    )


def read_chunks(spark, path: str, ts: str, start: datetime, end: datetime) -> DataFrame:
    """Rows in a time range; the chunk bounds prune partitions and the time itself filters rows."""
    df = spark.read.parquet(path)
    low, high = (start - timedelta(days=7)).date(), end.date()
    return in_range(df.filter(F.col("chunk_date").between(F.lit(low), F.lit(high))), ts, start, end)


def expired_chunks(df: DataFrame, ts: str, as_of: datetime, keep_days: int) -> DataFrame:
    """Chunks that end at or before the cutoff; a chunk across it stays whole."""
    cutoff = F.lit(as_of - timedelta(days=keep_days)).cast("timestamp_ntz")
    return chunk_counts(df, ts).filter(F.col("chunk_start") + F.expr("interval 7 days") <= cutoff)


def retained_chunks(df: DataFrame, ts: str, as_of: datetime, keep_days: int) -> DataFrame:
    """Rows whose chunk ends after the cutoff; the rows of the other chunks are those that retention drops."""
    cutoff = F.lit(as_of - timedelta(days=keep_days)).cast("timestamp_ntz")
    return df.filter(F.coalesce(chunk_start(ts) + F.expr("interval 7 days") > cutoff, F.lit(True)))


# Days that raw rows are kept, by table.
RETENTION_DAYS = {"job_executions": 90, "alert_history": 180, "notifications": 90}


def drop_expired_chunks(
    spark: SparkSession, paths: dict[str, str], as_of: datetime, keep_days: dict[str, int] | None = None
) -> dict[str, list[date]]:
    """Remove whole chunks of stored chunk tables that end at or before their table's cutoff; tells which.

    ``paths`` names the folder of each table as ``write_chunks`` wrote it.  A
    chunk across the cutoff stays whole, so no row younger than the term goes.
    Only folders are listed and deleted, no row is read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    dropped: dict[str, list[date]] = {}
    for table, path in paths.items():
        cutoff = as_of - timedelta(days={**RETENTION_DAYS, **(keep_days or {})}[table])
        root = hadoop.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [str(s.getPath().getName()) for s in files.listStatus(root)] if files.exists(root) else []
        chunks = sorted(date.fromisoformat(n.split("=")[1]) for n in names if re.fullmatch(r"chunk_date=[0-9-]{10}", n))
        old = [c for c in chunks if datetime(c.year, c.month, c.day) + timedelta(days=7) <= cutoff]
        dropped[table] = [c for c in old if files.delete(hadoop.Path(root, f"chunk_date={c}"), True)]
    return dropped


def dedup_events(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First copy of every event delivered more than once."""
    return latest_per_key(events, [key], order)
