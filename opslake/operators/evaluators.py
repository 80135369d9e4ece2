"""Job evaluators: SLA, heartbeat, execution events and retries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.skew import latest_per_key, plain_join, salted_join
from opslake.functions.text import is_blank

EVENT_COLUMNS = {
    "tenant_id": "string",
    "job_id": "bigint",
    "execution_id": "bigint",
    "action": "string",
    "job_name": "string",
    "cron_expression": "string",
    "exit_code": "int",
    "error_message": "string",
    "execution_start_time": "timestamp_ntz",
    "execution_end_time": "timestamp_ntz",
    "producer": "string",
    "event_id": "string",
    "event_time": "timestamp_ntz",
}


def latest_execution(executions: DataFrame) -> DataFrame:
    """Newest run of each job; the id breaks ties."""
    return latest_per_key(executions, ["job_id"], [F.desc("started_at"), F.desc("id")])


def status_to_action(status: Column) -> Column:
    upper = F.upper(status)
    return (
        F.when(upper == "SUCCESS", "COMPLETED")
        .when(upper == "FAILED", "FAILED")
        .when(upper == "TIMEOUT", "SLA_VIOLATED")
        .when(upper == "RETRYING", "RETRYING")
        .otherwise("STARTED")
    )


def sla_violations(
    jobs: DataFrame, executions: DataFrame, latest: DataFrame | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """Active jobs with an SLA whose newest run took strictly longer.

    ``latest`` is ``latest_execution(executions)`` where the caller has it already; ``also`` names columns of the run to keep.
    """
    watched = jobs.filter((F.col("status") == "ACTIVE") & (F.col("sla_seconds") > 0)).select(
        "job_id", "tenant_id", "name", "sla_seconds"
    )
    latest = (latest_execution(executions) if latest is None else latest).select(
        "job_id", F.col("id").alias("execution_id"), "started_at", "completed_at", "duration_ms", *also
    )
    return plain_join(watched, latest, ["job_id"]).filter(F.col("duration_ms") > F.col("sla_seconds").cast("bigint") * 1000)


def missed_heartbeats(
    jobs: DataFrame, executions: DataFrame, as_of: datetime, latest: DataFrame | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """Active scheduled jobs silent for longer than expected runtime plus grace."""
    scheduled = jobs.filter((F.col("status") == "ACTIVE") & ~is_blank(F.col("cron_expression"))).select(
        "job_id",
        "tenant_id",
        "name",
        "cron_expression",
        (
            F.coalesce("expected_runtime_seconds", F.lit(3600)) + F.coalesce("grace_period_seconds", F.lit(300))
        ).alias("allowed_seconds"),
    )
    latest = (latest_execution(executions) if latest is None else latest).select(
        "job_id", F.coalesce("completed_at", "started_at").alias("last_seen_at"), *also
    )
    now = F.lit(as_of).cast("timestamp_ntz")
    silent = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))
    return (
        plain_join(scheduled, latest, ["job_id"])
        .withColumn("_silent", silent)
        .filter(F.col("_silent") > F.col("allowed_seconds").cast("bigint") * 1_000_000)
        .withColumn("silence_seconds", F.expr("_silent div 1000000"))
        .drop("_silent")
    )


def _event(df: DataFrame, action: Column | str, producer: str, also: Sequence[str] = (), **columns: Column) -> DataFrame:
    """Project to the common job-event columns, missing ones null, and the columns ``also`` as they are."""
    given = {**columns, "action": F.lit(action) if isinstance(action, str) else action, "producer": F.lit(producer)}
    return df.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVENT_COLUMNS.items()), *also)


def execution_events(executions: DataFrame, jobs: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """One job event per recorded execution of a known job."""
    named = jobs.select("tenant_id", "job_id", F.col("name").alias("job_name"))
    joined = salted_join(executions, named, ["tenant_id", "job_id"], "id")
    return _event(
        joined,
        status_to_action(F.col("status")),
        "executions",
        also,
        tenant_id=F.col("tenant_id"),
        job_id=F.col("job_id"),
        execution_id=F.col("id"),
        job_name=F.col("job_name"),
        exit_code=F.col("exit_code"),
        error_message=F.col("error_message"),
        execution_start_time=F.col("started_at"),
        execution_end_time=F.col("completed_at"),
        event_id=F.concat(F.lit("executions-"), F.col("id").cast("string")),
        event_time=F.col("started_at"),
    )


def _at(as_of: datetime) -> dict[str, Column]:
    return {"event_time": F.lit(as_of).cast("timestamp_ntz")}


def sla_events(violations: DataFrame, as_of: datetime, also: Sequence[str] = ()) -> DataFrame:
    """One event per late run and evaluation time."""
    return _event(
        violations,
        "SLA_VIOLATED",
        "sla",
        also,
        tenant_id=F.col("tenant_id"),
        job_id=F.col("job_id"),
        execution_id=F.col("execution_id"),
        job_name=F.col("name"),
        execution_start_time=F.col("started_at"),
        execution_end_time=F.col("completed_at"),
        event_id=F.concat_ws("-", F.lit("sla"), F.col("execution_id").cast("string"), F.lit(as_of.isoformat())),
        **_at(as_of),
    )


def heartbeat_events(missed: DataFrame, as_of: datetime, also: Sequence[str] = ()) -> DataFrame:
    """One event per silent job and evaluation time."""
    return _event(
        missed,
        "HEARTBEAT_MISSED",
        "heartbeat",
        also,
        tenant_id=F.col("tenant_id"),
        job_id=F.col("job_id"),
        job_name=F.col("name"),
        cron_expression=F.col("cron_expression"),
        event_id=F.concat_ws("-", F.lit("heartbeat"), "tenant_id", F.col("job_id").cast("string"), F.lit(as_of.isoformat())),
        **_at(as_of),
    )


# What an outside event type means.
GATEWAY_ACTIONS = {
    "STARTED": "STARTED",
    "COMPLETED": "COMPLETED",
    "FAILED": "FAILED",
    "HEARTBEAT": "HEARTBEAT_MISSED",
    "SLA_VIOLATED": "SLA_VIOLATED",
    "RETRYING": "RETRYING",
}


def gateway_action(event_type: Column) -> Column:
    """Event type of an outside request to job action; unknown and missing types register the job."""
    table = F.create_map(*(F.lit(x) for pair in GATEWAY_ACTIONS.items() for x in pair))
    return F.coalesce(F.element_at(table, F.upper(event_type)), F.lit("REGISTERED"))


def ingest_normalize(requests: DataFrame) -> DataFrame:
    """Outside requests as keyed job events; they carry no job id."""
    return requests.select(
        "request_id",
        "tenant_id",
        F.concat_ws(":", "tenant_id", "job_name").alias("event_key"),
        "job_name",
        gateway_action(F.col("event_type")).alias("action"),
        "exit_code",
        F.col("received_at").alias("execution_start_time"),
    )


def gateway_events(requests: DataFrame) -> DataFrame:
    normal = ingest_normalize(requests)
    return _event(
        normal,
        F.col("action"),
        "gateway",
        tenant_id=F.col("tenant_id"),
        job_name=F.col("job_name"),
        exit_code=F.col("exit_code"),
        execution_start_time=F.col("execution_start_time"),
        event_id=F.concat(F.lit("gateway-"), F.col("request_id").cast("string")),
        event_time=F.col("execution_start_time"),
    )


def job_event_feed(*producers: DataFrame) -> DataFrame:
    """All producers of job events as one feed."""
    feed = producers[0]
    for other in producers[1:]:
        feed = feed.unionByName(other, allowMissingColumns=True)
    return feed


def retry_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Accepted and rejected retry requests; only active jobs may be retried."""
    known = jobs.select("tenant_id", "job_id", F.col("name").alias("job_name"), F.col("status").alias("job_status"))
    joined = salted_join(requests, known, ["tenant_id", "job_id"], "request_id", "left")
    active = F.col("job_status") == "ACTIVE"
    return joined.select(
        "request_id",
        "tenant_id",
        "job_id",
        "job_name",
        F.when(active, "RETRYING").alias("action"),
        F.when(F.col("job_status").isNull(), "Job not found")
        .when(~active, F.concat(F.lit("Can only retry ACTIVE jobs, current status: "), F.col("job_status")))
        .alias("rejection"),
    )
