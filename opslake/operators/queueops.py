"""Work queue: statistics, claims, transitions, cleanup, retry schedule."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCK_SECONDS = 300
RETRY_BASE_MS = 1000

_COUNTED = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER")


def queue_stats(queue: DataFrame) -> DataFrame:
    """Items per status, total and completed percent (two decimals, ties up) per tenant in one pass."""
    counted = queue.groupBy("tenant_id").agg(
        *(F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in _COUNTED)
    )
    total = sum((F.col(f"{s.lower()}_count") for s in _COUNTED), F.lit(0).cast("bigint"))
    share = F.col("completed_count") / F.col("total_count") * F.lit(100.0)
    return counted.withColumn("total_count", total).withColumn(
        "processing_rate", F.when(F.col("total_count") > 0, F.floor(share * 100 + 0.5) / 100).otherwise(F.lit(0.0))
    )


def claimable(queue: DataFrame, as_of: datetime) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return queue.filter(
        (F.col("status") == "PENDING")
        & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= now))
        & (F.col("locked_until").isNull() | (F.col("locked_until") < now))
    )


def queue_claims(queue: DataFrame, workers: list[str], as_of: datetime, lock_seconds: int = LOCK_SECONDS) -> DataFrame:
    """Give the first due items, one each, to the workers asking, in the order they ask.

    The top-n runs per input partition first; only as many rows as workers
    reach the final ranking.
    """
    order = [F.asc("priority"), F.asc("created_at"), F.asc("id")]
    first = claimable(queue, as_of).orderBy(*order).limit(len(workers))
    names = F.array(*(F.lit(w) for w in workers))
    now = F.lit(as_of).cast("timestamp_ntz")
    return first.withColumn("claim_rank", F.row_number().over(Window.orderBy(*order))).select(
        "id",
        "tenant_id",
        "job_type",
        "priority",
        "claim_rank",
        F.lit("PROCESSING").alias("status"),
        F.element_at(names, F.col("claim_rank")).alias("assigned_worker"),
        (F.col("attempt_count") + 1).alias("attempt_count"),
        now.alias("started_at"),
        F.lit(as_of + timedelta(seconds=lock_seconds)).cast("timestamp_ntz").alias("locked_until"),
    )


def queue_transitions(queue: DataFrame, commands: DataFrame, as_of: datetime) -> DataFrame:
    """Apply complete / fail / cancel commands; unknown ids come back as NOT_FOUND."""
    current = queue.select("id", "tenant_id", "attempt_count", "max_attempts", "assigned_worker", "status")
    joined = commands.join(current.withColumnRenamed("status", "old_status"), "id", "left")
    known = F.col("old_status").isNotNull()
    exhausted = F.col("attempt_count") >= F.col("max_attempts")
    command = F.col("command")
    return joined.select(
        "id",
        "tenant_id",
        "command",
        "old_status",
        F.when(~known, "NOT_FOUND")
        .when(command == "complete", "COMPLETED")
        .when(command == "cancel", "CANCELLED")
        .when((command == "fail") & exhausted, "DEAD_LETTER")
        .when(command == "fail", "PENDING")
        .alias("status"),
        F.when(known & (command == "complete"), F.lit(as_of).cast("timestamp_ntz")).alias("completed_at"),
        F.when(known & (command == "fail"), F.col("error_message")).alias("error_message"),
        F.lit(None).cast("timestamp_ntz").alias("locked_until"),
        F.when(~known, None)
        .when(command == "complete", "COMPLETED")
        .when(command == "cancel", "CANCELLED")
        .when((command == "fail") & exhausted, "FAILED")
        .when(command == "fail", "RETRYING")
        .alias("event_action"),
    )


def queue_timeout_cleanup(queue: DataFrame, as_of: datetime) -> DataFrame:
    """The queue after releasing items whose lock has expired."""
    expired = F.coalesce(
        (F.col("status") == "PROCESSING") & (F.col("locked_until") < F.lit(as_of).cast("timestamp_ntz")), F.lit(False)
    )
    dead = expired & (F.col("attempt_count") >= F.col("max_attempts"))
    released = expired & ~(F.col("attempt_count") >= F.col("max_attempts"))
    return queue.withColumns(
        {
            "status": F.when(dead, "DEAD_LETTER").when(released, "PENDING").otherwise(F.col("status")),
            "error_message": F.when(
                dead, F.concat(F.lit("Timed out after "), F.col("attempt_count").cast("string"), F.lit(" attempts"))
            ),
            "assigned_worker": F.when(released, None).otherwise(F.col("assigned_worker")),
            "locked_until": F.when(expired, None).otherwise(F.col("locked_until")),
        }
    )


def failed_to_dead_letter(queue: DataFrame) -> DataFrame:
    """Failed items with no attempts left move to the dead letters."""
    spent = (F.col("status") == "FAILED") & (F.col("attempt_count") >= F.col("max_attempts"))
    return queue.withColumn("status", F.when(spent, "DEAD_LETTER").otherwise(F.col("status")))


def queue_listing(queue: DataFrame, tenant_id: str, status: str | None = None) -> DataFrame:
    rows = queue.filter(F.col("tenant_id") == tenant_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status.upper())
    return rows.orderBy(F.asc("priority"), F.asc("created_at"), F.asc("id"))


def retry_schedule(
    items: DataFrame, failed_at: str, max_retries: str, multiplier: float = 2.0, base_ms: int = RETRY_BASE_MS
) -> DataFrame:
    """Every retry of an item: wait before it and when it is due, growing by ``multiplier``."""
    attempts = F.sequence(F.lit(1), F.col(max_retries))
    step = F.lit(float(base_ms))

    def wait(n):
        return F.floor(step * F.pow(F.lit(float(multiplier)), n - 1))

    total = F.aggregate(
        F.sequence(F.lit(1), F.col("attempt")), F.lit(0).cast("bigint"), lambda acc, n: acc + wait(n).cast("bigint")
    )
    return (
        items.filter(F.col(max_retries) > 0)
        .withColumn("attempt", F.explode(attempts))
        .withColumn("delay_ms", wait(F.col("attempt")).cast("bigint"))
        .withColumn("total_delay_ms", total)
        .withColumn("due_at", F.col(failed_at) + F.make_dt_interval(secs=F.col("total_delay_ms") / 1000))
    )
