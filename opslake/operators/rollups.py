"""Roll-ups of job executions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.skew import HOT_ROWS, Running, hot_keys, scan, trailing_count

ROLLUP_KEYS = ["job_id", "tenant_id", "bucket"]


def _literal(moment: datetime) -> F.Column:
    return F.lit(moment).cast("timestamp_ntz")


def hour_of(ts: str) -> F.Column:
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def hourly_rollup(executions: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Runs, successes, failures and duration statistics per job, tenant and hour.

    One read and one aggregate.  The exact percentile keeps a count per
    duration value and combines before the shuffle, so what a group sends grows
    with its distinct durations, not with its runs.
    """
    runs = executions.select("job_id", "tenant_id", hour_of("started_at").alias("bucket"), "status", "duration_ms")
    return runs.groupBy(*ROLLUP_KEYS).agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("status") == "SUCCESS").alias("success_count"),
        F.count_if(F.col("status") == "FAILED").alias("failure_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.percentile("duration_ms", F.lit(quantile)).alias("p95_duration_ms"),
    )


def refresh_bounds(as_of: datetime, start_offset: timedelta, end_offset: timedelta) -> tuple[datetime, datetime]:
    """First and one-past-last hour bucket lying wholly inside the refresh window."""
    hour = timedelta(hours=1)
    low = (as_of - start_offset).replace(minute=0, second=0, microsecond=0)
    if low < as_of - start_offset:
        low += hour
    return low, (as_of - end_offset).replace(minute=0, second=0, microsecond=0)


def refreshed_buckets(
    executions: DataFrame,
    as_of: datetime,
    start_offset: timedelta = timedelta(hours=3),
    end_offset: timedelta = timedelta(hours=1),
) -> DataFrame:
    """Recomputed buckets of the refresh window; the time filter reaches the scan."""
    low, high = refresh_bounds(as_of, start_offset, end_offset)
    started = F.col("started_at")
    return hourly_rollup(executions.filter((started >= _literal(low)) & (started < _literal(high))))


def refresh_rollup(
    rollup: DataFrame,
    executions: DataFrame,
    as_of: datetime,
    start_offset: timedelta = timedelta(hours=3),
    end_offset: timedelta = timedelta(hours=1),
) -> DataFrame:
    """The roll-up after a refresh: buckets in the window recomputed, all others kept."""
    low, high = refresh_bounds(as_of, start_offset, end_offset)
    kept = rollup.filter((F.col("bucket") < _literal(low)) | (F.col("bucket") >= _literal(high)))
    return kept.unionByName(refreshed_buckets(executions, as_of, start_offset, end_offset))


def write_rollup(buckets: DataFrame, path: str) -> None:
    """Store roll-up rows by day and hour; only the hours present are replaced, a large one in files of even size."""
    (
        buckets.withColumn("bucket_date", F.to_date("bucket"))
        .withColumn("bucket_hour", F.hour("bucket"))
        .hint("rebalance", "bucket_date", "bucket_hour")
        .sortWithinPartitions("bucket_date", "bucket_hour", "tenant_id", "job_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket_date", "bucket_hour")
        .parquet(path)
    )


def failure_counts(executions: DataFrame, since: datetime, status: str = "FAILED") -> DataFrame:
    """Executions per job with the given status since a time."""
    return (
        executions.filter((F.col("status") == status) & (F.col("started_at") >= _literal(since)))
        .groupBy("job_id")
        .agg(F.count("*").alias("failure_count"))
    )


def failures_since(executions: DataFrame, job_id, since: datetime, status: str = "FAILED") -> DataFrame:
    """The same count for one job; one row even when there is none."""
    return executions.filter(
        (F.col("job_id") == job_id) & (F.col("status") == status) & (F.col("started_at") >= _literal(since))
    ).agg(F.count("*").alias("failure_count"))


def success_rate(executions: DataFrame) -> DataFrame:
    """Whole percent of successful runs per job (rule contexts hold whole numbers)."""
    return (
        executions.groupBy("tenant_id", "job_id")
        .agg(F.count("*").alias("total_runs"), F.count_if(F.col("status") == "SUCCESS").alias("success_count"))
        .withColumn("success_rate", F.expr("success_count * 100 div total_runs"))
    )


def windowed_failure_count(executions: DataFrame, seconds: int) -> DataFrame:
    """Per job and failure time: failures in the look-back window ending there."""
    failed = executions.filter(F.col("status") == "FAILED")
    return trailing_count(failed, ["tenant_id", "job_id"], "started_at", seconds, out="failure_count")


def running_outcomes(executions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The runs with what is known of their job by then: ``success_rate`` in whole percent and, for a failed run,
    ``consecutive_failures``.

    Failures in a row are counted from the last success; other states neither
    add nor end them.  Both passes share one count of large keys, one shuffle and
    one sort.
    """
    keys, order = ["tenant_id", "job_id"], ["started_at", "id"]
    failed, ok = F.col("status") == "FAILED", F.col("status") == "SUCCESS"
    hot = hot_keys(executions, keys, hot_rows)
    counted = scan(
        executions,
        keys,
        order,
        hot_rows,
        hot,
        _runs=Running("sum", F.lit(1)),
        _successes=Running("sum", F.when(ok, 1).otherwise(0)),
        _failures=Running("sum", F.when(failed, 1).otherwise(0)),
    )
    # The running count of failures never falls, so its value at the last success is the largest at any success.
    based = scan(counted, keys, order, hot_rows, hot, _base=Running("max", F.when(ok, F.col("_failures"))))
    streak = F.when(failed, F.col("_failures") - F.coalesce("_base", F.lit(0))).cast("bigint")
    return based.select(
        *(F.col(c) for c in executions.columns),
        F.expr("_successes * 100 div _runs").alias("success_rate"),
        streak.alias("consecutive_failures"),
    )


def failure_streaks(executions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failures in a row up to and including each failed run; a success starts over, other states do neither.

    The streak is the running failure count minus its value at the last success.
    """
    keys, order = ["tenant_id", "job_id"], ["started_at", "id"]
    failed, ok = F.col("status") == "FAILED", F.col("status") == "SUCCESS"
    decided = executions.filter(F.col("status").isin("FAILED", "SUCCESS")).select(*keys, *order, "status")
    hot = hot_keys(decided, keys, hot_rows)
    counted = scan(decided, keys, order, hot_rows, hot, failures=Running("sum", F.when(failed, 1).otherwise(0)))
    based = scan(counted, keys, order, hot_rows, hot, base=Running("max", F.when(ok, F.col("failures"))))
    return based.filter(failed).select(
        *keys, *order, (F.col("failures") - F.coalesce("base", F.lit(0))).cast("bigint").alias("consecutive_failures")
    )
