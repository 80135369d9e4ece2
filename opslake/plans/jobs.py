"""Jobs and executions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opslake.functions.scratch import materialize, scratch_path
from opslake.operators import evaluators, rollups, tables
from opslake.plans.registry import query
from opslake.sources import versions
from opslake.sources.fixtures import AS_OF

ROLLUP_SQL = """
SELECT job_id, tenant_id, date_trunc('hour', started_at) AS bucket, count(*) AS total_runs,
       count(*) FILTER (WHERE status = 'SUCCESS') AS success_count,
       count(*) FILTER (WHERE status = 'FAILED') AS failure_count,
       avg(duration_ms) AS avg_duration_ms, max(duration_ms) AS max_duration_ms, min(duration_ms) AS min_duration_ms,
       quantile_cont(duration_ms, 0.95) AS p95_duration_ms
FROM v_job_executions {where} GROUP BY ALL"""

LATEST_SQL = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, id DESC) AS rn FROM v_job_executions)
WHERE rn = 1"""

REFRESH_AT = datetime(2024, 1, 20, 12, 30)
STALE_BEFORE = datetime(2024, 1, 20, 10, 15)

ACTION_SQL = """CASE upper(status) WHEN 'SUCCESS' THEN 'COMPLETED' WHEN 'FAILED' THEN 'FAILED'
       WHEN 'TIMEOUT' THEN 'SLA_VIOLATED' WHEN 'RETRYING' THEN 'RETRYING' ELSE 'STARTED' END"""


@query("hourly_rollup", ROLLUP_SQL.format(where=""))
def _(t):
    return rollups.hourly_rollup(t.job_executions)


@query(
    "job_duration_p95",
    """
SELECT job_id, quantile_cont(duration_ms, 0.95) AS p95_duration_ms FROM v_job_executions
WHERE duration_ms IS NOT NULL GROUP BY job_id""",
)
def _(t):
    counts = t.job_executions.filter("duration_ms is not null").groupBy("job_id", "duration_ms").agg(F.count("*").alias("n"))
    from opslake.functions.skew import exact_quantile

    return exact_quantile(counts, ["job_id"], "duration_ms", "n", 0.95, "p95_duration_ms")


@query(
    "rollup_refresh",
    f"""
WITH stale AS ({ROLLUP_SQL.format(where="WHERE started_at < TIMESTAMP '2024-01-20 10:15:00'")}),
fresh AS ({ROLLUP_SQL.format(where="")})
SELECT * FROM stale WHERE bucket < TIMESTAMP '2024-01-20 10:00:00' OR bucket >= TIMESTAMP '2024-01-20 11:00:00'
UNION ALL
SELECT * FROM fresh WHERE bucket >= TIMESTAMP '2024-01-20 10:00:00' AND bucket < TIMESTAMP '2024-01-20 11:00:00'""",
)
def _(t):
    runs = t.job_executions
    stored = rollups.hourly_rollup(runs.filter(F.col("started_at") < F.lit(STALE_BEFORE).cast("timestamp_ntz")))
    return rollups.refresh_rollup(stored, runs, REFRESH_AT)


@query("latest_execution", LATEST_SQL)
def _(t):
    return evaluators.latest_execution(t.job_executions)


@query(
    "sla_violations",
    f"""
WITH latest AS ({LATEST_SQL})
SELECT j.job_id, j.tenant_id, j.name, j.sla_seconds, l.id AS execution_id, l.started_at, l.completed_at, l.duration_ms
FROM v_jobs j JOIN latest l ON l.job_id = j.job_id
WHERE j.status = 'ACTIVE' AND j.sla_seconds > 0 AND l.duration_ms > j.sla_seconds * 1000""",
)
def _(t):
    return evaluators.sla_violations(t.jobs, t.job_executions)


HEARTBEAT_SQL = f"""
SELECT j.job_id, j.tenant_id, j.name, j.cron_expression,
       coalesce(j.expected_runtime_seconds, 3600) + coalesce(j.grace_period_seconds, 300) AS allowed_seconds,
       coalesce(l.completed_at, l.started_at) AS last_seen_at,
       CAST(floor(epoch_us(TIMESTAMP '2024-01-31 00:00:00' - coalesce(l.completed_at, l.started_at)) / 1000000) AS bigint) AS silence_seconds
FROM v_jobs j JOIN ({LATEST_SQL}) l ON l.job_id = j.job_id
WHERE j.status = 'ACTIVE' AND trim(j.cron_expression) <> ''
  AND TIMESTAMP '2024-01-31 00:00:00' - coalesce(l.completed_at, l.started_at)
      > (coalesce(j.expected_runtime_seconds, 3600) + coalesce(j.grace_period_seconds, 300)) * INTERVAL '1' SECOND"""


@query("missed_heartbeats", HEARTBEAT_SQL)
def _(t):
    return evaluators.missed_heartbeats(t.jobs, t.job_executions, AS_OF)


@query(
    "status_to_action",
    f"SELECT status, {ACTION_SQL} AS action, count(*) AS executions FROM v_job_executions GROUP BY ALL",
)
def _(t):
    return (
        t.job_executions.withColumn("action", evaluators.status_to_action(F.col("status")))
        .groupBy("status", "action")
        .agg(F.count("*").alias("executions"))
    )


EXECUTION_EVENTS_SQL = f"""
SELECT e.tenant_id, e.job_id, e.id AS execution_id, {ACTION_SQL.replace("status", "e.status")} AS action, j.name AS job_name,
       CAST(NULL AS string) AS cron_expression, e.exit_code, e.error_message, e.started_at AS execution_start_time,
       e.completed_at AS execution_end_time, 'executions' AS producer,
       concat('executions-', CAST(e.id AS string)) AS event_id, e.started_at AS event_time
FROM v_job_executions e JOIN v_jobs j ON j.job_id = e.job_id AND j.tenant_id = e.tenant_id"""


@query("execution_events", EXECUTION_EVENTS_SQL)
def _(t):
    return evaluators.execution_events(t.job_executions, t.jobs)


INGEST_SQL = """
SELECT request_id, tenant_id, concat(tenant_id, ':', job_name) AS event_key, job_name,
       CASE upper(event_type) WHEN 'STARTED' THEN 'STARTED' WHEN 'COMPLETED' THEN 'COMPLETED' WHEN 'FAILED' THEN 'FAILED'
            WHEN 'HEARTBEAT' THEN 'HEARTBEAT_MISSED' WHEN 'SLA_VIOLATED' THEN 'SLA_VIOLATED'
            WHEN 'RETRYING' THEN 'RETRYING' ELSE 'REGISTERED' END AS action,
       exit_code, received_at AS execution_start_time
FROM v_ingest_requests"""


@query("ingest_normalize", INGEST_SQL)
def _(t):
    return evaluators.ingest_normalize(t.ingest_requests)


FEED_SQL = f"""
{EXECUTION_EVENTS_SQL}
UNION ALL SELECT tenant_id, job_id, id, 'SLA_VIOLATED', name, NULL, NULL, NULL, started_at, completed_at, 'sla',
  concat('sla-', CAST(id AS string), '-2024-01-31T00:00:00'), TIMESTAMP '2024-01-31 00:00:00'
  FROM (SELECT j.tenant_id, j.job_id, l.id, j.name, l.started_at, l.completed_at
        FROM v_jobs j JOIN ({LATEST_SQL}) l ON l.job_id = j.job_id
        WHERE j.status = 'ACTIVE' AND j.sla_seconds > 0 AND l.duration_ms > j.sla_seconds * 1000)
UNION ALL SELECT tenant_id, job_id, NULL, 'HEARTBEAT_MISSED', name, cron_expression, NULL, NULL, NULL, NULL, 'heartbeat',
  concat('heartbeat-', tenant_id, '-', CAST(job_id AS string), '-2024-01-31T00:00:00'), TIMESTAMP '2024-01-31 00:00:00'
  FROM ({HEARTBEAT_SQL})
UNION ALL SELECT tenant_id, NULL, NULL, action, job_name, NULL, exit_code, NULL, execution_start_time, NULL, 'gateway',
  concat('gateway-', CAST(request_id AS string)), execution_start_time
  FROM ({INGEST_SQL})"""


def job_events(t, history: bool = False):
    """The feed of all four producers; the newest runs, one row per job, are looked up once for both evaluators.

    With ``history`` events carry the streak and success rate of their run, a missed heartbeat the rate at the job's
    newest run.  They are taken onto the runs before the feed is made, so no event is joined with its run again.
    """
    jobs, runs = t.jobs, t.job_executions
    streak, rate = ("consecutive_failures",) * history, ("success_rate",) * history
    if history:
        runs = rollups.running_outcomes(runs)
    latest = materialize(evaluators.latest_execution(runs), "latest-runs")
    late = evaluators.sla_violations(jobs, runs, latest, streak + rate)
    silent = evaluators.missed_heartbeats(jobs, runs, AS_OF, latest, rate)
    return evaluators.job_event_feed(
        evaluators.execution_events(runs, jobs, streak + rate),
        evaluators.sla_events(late, AS_OF, streak + rate),
        evaluators.heartbeat_events(silent, AS_OF, rate),
        evaluators.gateway_events(t.ingest_requests),
    )


@query("job_event_feed", FEED_SQL)
def _(t):
    return job_events(t)


@query(
    "retry_requests",
    """
SELECT r.id AS request_id, r.tenant_id, r.job_id, j.name AS job_name,
       CASE WHEN j.status = 'ACTIVE' THEN 'RETRYING' END AS action,
       CASE WHEN j.status IS NULL THEN 'Job not found'
            WHEN j.status <> 'ACTIVE' THEN concat('Can only retry ACTIVE jobs, current status: ', j.status) END AS rejection
FROM (SELECT id, tenant_id, CASE WHEN id % 11 = 0 THEN -job_id ELSE job_id END AS job_id
      FROM v_job_executions WHERE status = 'FAILED') r
LEFT JOIN v_jobs j ON j.job_id = r.job_id AND j.tenant_id = r.tenant_id""",
)
def _(t):
    requests = t.job_executions.filter("status = 'FAILED'").select(
        F.col("id").alias("request_id"), "tenant_id", F.expr("if(id % 11 = 0, -job_id, job_id)").alias("job_id")
    )
    return evaluators.retry_requests(requests, t.jobs)


SINCE = AS_OF - timedelta(days=14)


@query(
    "failure_counts",
    """
SELECT job_id, count(*) AS failure_count FROM v_job_executions
WHERE status = 'FAILED' AND started_at >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY job_id""",
)
def _(t):
    return rollups.failure_counts(t.job_executions, SINCE)


@query(
    "failures_since",
    """
SELECT count(*) AS failure_count FROM v_job_executions
WHERE status = 'FAILED' AND job_id = 8 AND started_at >= TIMESTAMP '2024-01-17 00:00:00'""",
)
def _(t):
    return rollups.failures_since(t.job_executions, 8, SINCE)


@query(
    "success_rate",
    """
SELECT tenant_id, job_id, count(*) AS total_runs, count(*) FILTER (WHERE status = 'SUCCESS') AS success_count,
       CAST(count(*) FILTER (WHERE status = 'SUCCESS') * 100 // count(*) AS bigint) AS success_rate
FROM v_job_executions GROUP BY ALL""",
)
def _(t):
    return rollups.success_rate(t.job_executions)


@query(
    "windowed_failure_count",
    """
SELECT DISTINCT tenant_id, job_id, started_at, count(*) OVER (PARTITION BY tenant_id, job_id ORDER BY started_at
       RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS failure_count
FROM v_job_executions WHERE status = 'FAILED'""",
)
def _(t):
    return rollups.windowed_failure_count(t.job_executions, 86_400)


@query(
    "failure_streaks",
    """
WITH g AS (
  SELECT *, count(*) FILTER (WHERE status = 'SUCCESS') OVER (PARTITION BY tenant_id, job_id ORDER BY started_at, id) AS grp
  FROM v_job_executions WHERE status IN ('FAILED', 'SUCCESS'))
SELECT tenant_id, job_id, started_at, id,
       row_number() OVER (PARTITION BY tenant_id, job_id, grp ORDER BY started_at, id) AS consecutive_failures
FROM g WHERE status = 'FAILED'""",
)
def _(t):
    return rollups.failure_streaks(t.job_executions)


@query("tenant_scope", "SELECT * FROM v_jobs WHERE tenant_id = '7'")
def _(t):
    return tables.scoped(t.jobs, "7")


@query("jobs_by_status", "SELECT * FROM v_jobs WHERE status = 'INACTIVE'")
def _(t):
    return tables.scoped(t.jobs, status="INACTIVE")


@query("active_jobs", "SELECT * FROM v_jobs WHERE tenant_id = '7' AND status = 'ACTIVE'")
def _(t):
    return tables.active_jobs(t.jobs, "7")


@query(
    "jobs_by_tag",
    """
SELECT job_id, tenant_id, name, tags_csv FROM v_jobs
WHERE list_has_any(string_split(tags_csv, ','), ['nightly', 'machinery'])""",
)
def _(t):
    return tables.jobs_by_tags(t.tagged_jobs, ["nightly", "machinery"]).select("job_id", "tenant_id", "name", "tags_csv")


@query(
    "executions_in_range",
    """
SELECT * FROM v_job_executions
WHERE started_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""",
)
def _(t):
    rows = tables.in_range(t.job_executions, "started_at", datetime(2024, 1, 10), datetime(2024, 1, 12, 12))
    return tables.newest_first(rows, "started_at", "id")


@query(
    "page_of_jobs",
    """
SELECT *, 2 AS page, (SELECT count(*) FROM v_jobs) AS total_elements,
       CAST(ceil((SELECT count(*) FROM v_jobs) / 20.0) AS int) AS total_pages, false AS first_page,
       3 >= ceil((SELECT count(*) FROM v_jobs) / 20.0) AS last_page
FROM v_jobs ORDER BY name, job_id LIMIT 20 OFFSET 40""",
)
def _(t):
    return tables.page_of(t.jobs, [F.asc("name"), F.asc("job_id")], 2, 20)


@query(
    "chunk_counts",
    """
SELECT time_bucket(INTERVAL '7 days', started_at, TIMESTAMP '1970-01-01') AS chunk_start, count(*) AS rows
FROM v_job_executions GROUP BY ALL""",
)
def _(t):
    return tables.chunk_counts(t.job_executions, "started_at")


@query(
    "expired_chunks",
    """
SELECT * FROM (SELECT time_bucket(INTERVAL '7 days', started_at, TIMESTAMP '1970-01-01') AS chunk_start, count(*) AS rows
               FROM v_job_executions GROUP BY ALL)
WHERE chunk_start + INTERVAL '7 days' <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '14 days'""",
)
def _(t):
    return tables.expired_chunks(t.job_executions, "started_at", AS_OF, 14)


UPSERT_CHANGES = """
SELECT job_id, name || ' v2' AS name, CASE WHEN job_id % 3 = 0 THEN 7 ELSE 1 END AS version, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
FROM v_jobs
UNION ALL
SELECT job_id, name || ' v3', CASE WHEN job_id % 4 = 0 THEN 1 ELSE 0 END, TIMESTAMP '2024-02-02 00:00:00' FROM v_jobs
UNION ALL
SELECT -job_id - 1, name || ' new', 0, TIMESTAMP '2024-02-01 00:00:00' FROM v_jobs"""
UPSERT_BASE = "SELECT job_id, name, 1 AS version, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM v_jobs"


@query(
    "versioned_upsert",
    f"""
WITH base AS ({UPSERT_BASE}), changes AS ({UPSERT_CHANGES}),
offered AS (SELECT c.*, b.version AS stored FROM changes c LEFT JOIN base b ON b.job_id = c.job_id),
fitting AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at) AS rn FROM offered
            WHERE stored IS NULL OR version = stored),
taken AS (SELECT * FROM fitting WHERE rn = 1)
SELECT job_id, name, version, updated_at, 'stored' AS outcome FROM base WHERE job_id NOT IN (SELECT job_id FROM taken)
UNION ALL
SELECT job_id, name, CASE WHEN stored IS NULL THEN 0 ELSE stored + 1 END, updated_at, 'stored' FROM taken
UNION ALL
SELECT job_id, name, version, updated_at, 'conflict' FROM fitting WHERE rn > 1
UNION ALL
SELECT job_id, name, version, updated_at, 'conflict' FROM offered WHERE stored IS NOT NULL AND version <> stored""",
)
def _(t):
    def ntz(df):
        return df.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))

    stored, conflicts = tables.versioned_upsert(ntz(t.sql(UPSERT_BASE)), ntz(t.sql(UPSERT_CHANGES)), ["job_id"])
    return stored.withColumn("outcome", F.lit("stored")).unionByName(conflicts.withColumn("outcome", F.lit("conflict")))


@query(
    "stored_upsert",
    f"""
WITH base AS ({UPSERT_BASE}), changes AS (SELECT * FROM ({UPSERT_CHANGES}) WHERE job_id % 16 = 3),
offered AS (SELECT c.*, b.version AS stored FROM changes c LEFT JOIN base b ON b.job_id = c.job_id),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at) AS rn FROM offered
                         WHERE stored IS NULL OR version = stored) WHERE rn = 1)
SELECT job_id, name, version, updated_at FROM base WHERE job_id NOT IN (SELECT job_id FROM taken)
UNION ALL
SELECT job_id, name, CASE WHEN stored IS NULL THEN 0 ELSE stored + 1 END, updated_at FROM taken""",
)
def _(t):
    """A batch that touches some keys, applied to the stored table and read back."""

    def ntz(df):
        return df.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))

    table = versions.VersionedTable(t.spark, scratch_path(t.spark, "jobs"))
    table.create(ntz(t.sql(UPSERT_BASE)), ["job_id"])
    table.upsert(ntz(t.sql(UPSERT_CHANGES)).where("job_id % 16 = 3"))
    return table.read()


@query(
    "jobs_after_cursor",
    """
SELECT * FROM v_jobs WHERE name > (SELECT name FROM v_jobs ORDER BY name, job_id LIMIT 1 OFFSET 39)
   OR (name = (SELECT name FROM v_jobs ORDER BY name, job_id LIMIT 1 OFFSET 39)
       AND job_id > (SELECT job_id FROM v_jobs ORDER BY name, job_id LIMIT 1 OFFSET 39))
ORDER BY name, job_id LIMIT 20""",
)
def _(t):
    """The third page of twenty, each page behind the cursor of the one before it."""
    order, cursor = [("name", False), ("job_id", False)], None
    for _ in range(2):
        cursor = tables.cursor_of(tables.page_after(t.jobs, order, 20, cursor).collect(), order)
    return tables.page_after(t.jobs, order, 20, cursor)


@query(
    "dimension_patch",
    """
SELECT job_id, tenant_id, name, CASE WHEN job_id % 5 = 1 THEN 'INACTIVE' ELSE status END AS status, cron_expression,
       CASE WHEN job_id % 5 = 2 THEN 99 ELSE sla_seconds END AS sla_seconds, grace_period_seconds,
       expected_runtime_seconds, tags_csv
FROM v_jobs""",
)
def _(t):
    jobs = t.jobs
    patch = jobs.select(
        "job_id",
        F.expr("if(job_id % 5 = 1, 'INACTIVE', null)").alias("status"),
        F.expr("if(job_id % 5 = 2, 99, null)").alias("sla_seconds"),
        F.lit(1).alias("sent"),
    )
    later = patch.filter("job_id % 2 = 0").withColumns({"sla_seconds": F.lit(7), "sent": F.lit(2)})
    unknown = patch.withColumn("job_id", -F.col("job_id") - 1)
    patches = patch.unionByName(later).unionByName(unknown)
    return tables.apply_patch(jobs, patches, ["job_id"], [F.asc("sent")])


@query(
    "expired_chunk_rows",
    """
SELECT count(*) AS kept FROM v_job_executions
WHERE time_bucket(INTERVAL '7 days', started_at, TIMESTAMP '1970-01-01') + INTERVAL '7 days'
      > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '14 days'""",
)
def _(t):
    return tables.retained_chunks(t.job_executions, "started_at", AS_OF, 14).agg(F.count("*").alias("kept"))
