"""Work queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.operators import queueops
from opslake.plans.registry import query
from opslake.sources.fixtures import QUEUE_AS_OF

WORKERS = [f"worker-{i}" for i in range(1, 9)]


@query(
    "queue_stats",
    """
WITH s AS (
  SELECT tenant_id, count(*) FILTER (WHERE status = 'PENDING') AS pending_count,
         count(*) FILTER (WHERE status = 'PROCESSING') AS processing_count,
         count(*) FILTER (WHERE status = 'COMPLETED') AS completed_count,
         count(*) FILTER (WHERE status = 'FAILED') AS failed_count,
         count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled_count,
         count(*) FILTER (WHERE status = 'DEAD_LETTER') AS dead_letter_count,
         count(*) AS total_count
  FROM v_job_queue GROUP BY tenant_id)
SELECT *, floor(CAST(completed_count AS double) / total_count * 100.0 * 100 + 0.5) / 100 AS processing_rate FROM s""",
)
def _(t):
    return queueops.queue_stats(t.job_queue)


@query(
    "queue_claims",
    """
WITH due AS (
  SELECT *, row_number() OVER (ORDER BY priority, created_at, id) AS rn FROM v_job_queue
  WHERE status = 'PENDING' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '1999-01-01 00:00:00')
    AND (locked_until IS NULL OR locked_until < TIMESTAMP '1999-01-01 00:00:00'))
SELECT id, tenant_id, job_type, priority, CAST(rn AS int) AS claim_rank, 'PROCESSING' AS status,
       concat('worker-', CAST(rn AS string)) AS assigned_worker, attempt_count + 1 AS attempt_count,
       TIMESTAMP '1999-01-01 00:00:00' AS started_at, TIMESTAMP '1999-01-01 00:05:00' AS locked_until
FROM due WHERE rn <= 8""",
)
def _(t):
    return queueops.queue_claims(t.job_queue, WORKERS, QUEUE_AS_OF)


@query(
    "queue_transitions",
    """
WITH commands AS (
  SELECT CASE WHEN id % 7 = 0 THEN -id - 1 ELSE id END AS id,
         CASE CAST(id % 3 AS int) WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'cancel' END AS command,
         concat('boom ', CAST(id AS string)) AS error_message
  FROM v_job_queue WHERE status = 'PROCESSING')
SELECT c.id, q.tenant_id, c.command, q.status AS old_status,
       CASE WHEN q.id IS NULL THEN 'NOT_FOUND' WHEN command = 'complete' THEN 'COMPLETED' WHEN command = 'cancel' THEN 'CANCELLED'
            WHEN q.attempt_count >= q.max_attempts THEN 'DEAD_LETTER' ELSE 'PENDING' END AS status,
       CASE WHEN q.id IS NOT NULL AND command = 'complete' THEN TIMESTAMP '1999-01-01 00:00:00' END AS completed_at,
       CASE WHEN q.id IS NOT NULL AND command = 'fail' THEN c.error_message END AS error_message,
       CAST(NULL AS timestamp) AS locked_until,
       CASE WHEN q.id IS NULL THEN NULL WHEN command = 'complete' THEN 'COMPLETED' WHEN command = 'cancel' THEN 'CANCELLED'
            WHEN q.attempt_count >= q.max_attempts THEN 'FAILED' ELSE 'RETRYING' END AS event_action
FROM commands c LEFT JOIN v_job_queue q ON q.id = c.id""",
)
def _(t):
    queue = t.job_queue
    commands = queue.filter("status = 'PROCESSING'").select(
        F.expr("if(id % 7 = 0, -id - 1, id)").alias("id"),
        F.expr("case id % 3 when 0 then 'complete' when 1 then 'fail' else 'cancel' end").alias("command"),
        F.concat(F.lit("boom "), F.col("id").cast("string")).alias("error_message"),
    )
    return queueops.queue_transitions(queue, commands, QUEUE_AS_OF)


@query(
    "queue_timeout_cleanup",
    """
WITH q AS (SELECT *, status = 'PROCESSING' AND coalesce(locked_until < TIMESTAMP '1999-01-01 00:00:00', false) AS expired,
                  attempt_count >= max_attempts AS spent FROM v_job_queue)
SELECT id, tenant_id, job_type, priority, CASE WHEN expired AND spent THEN 'DEAD_LETTER' WHEN expired THEN 'PENDING' ELSE status END AS status,
       attempt_count, max_attempts, created_at, scheduled_at, CASE WHEN expired THEN NULL ELSE locked_until END AS locked_until,
       CASE WHEN expired AND NOT spent THEN NULL ELSE assigned_worker END AS assigned_worker,
       CASE WHEN expired AND spent THEN concat('Timed out after ', CAST(attempt_count AS string), ' attempts') END AS error_message
FROM q""",
)
def _(t):
    return queueops.queue_timeout_cleanup(t.job_queue, QUEUE_AS_OF)


@query(
    "failed_to_dead_letter",
    """
SELECT * REPLACE (CASE WHEN status = 'FAILED' AND attempt_count >= max_attempts THEN 'DEAD_LETTER' ELSE status END AS status)
FROM v_job_queue""",
)
def _(t):
    return queueops.failed_to_dead_letter(t.job_queue)


@query("queue_listing", "SELECT * FROM v_job_queue WHERE tenant_id = '3' AND status = 'PENDING'")
def _(t):
    return queueops.queue_listing(t.job_queue, "3", "pending")


@query(
    "retry_schedule",
    """
SELECT id, created_at, attempt_count, CAST(n AS int) AS attempt, CAST(1000 * pow(2.0, n - 1) AS bigint) AS delay_ms,
       CAST(1000 * (pow(2.0, n) - 1) AS bigint) AS total_delay_ms,
       created_at + CAST(1000 * (pow(2.0, n) - 1) AS bigint) * INTERVAL '1' MILLISECOND AS due_at
FROM v_job_queue, unnest(range(1, attempt_count + 1)) AS r(n)""",
)
def _(t):
    items = t.job_queue.select("id", "created_at", "attempt_count")
    return queueops.retry_schedule(items, "created_at", "attempt_count")


@query(
    "dead_letter_records",
    """
SELECT sha256(concat(CAST(id AS string), ':', CAST(attempt_count AS string))) AS id, CAST(id AS string) AS original_id, tenant_id,
       'jobs' AS queue_name, job_type, concat('{"id":', CAST(id AS string), '}') AS payload, 'handler failed' AS error_message,
       attempt_count AS retry_count, TIMESTAMP '1999-01-01 00:00:00' AS failed_at
FROM v_job_queue WHERE status IN ('FAILED', 'CANCELLED') AND attempt_count >= 3""",
)
def _(t):
    from opslake.streaming.events import dead_letter_records, failure_route

    failed = t.job_queue.filter("status in ('FAILED', 'CANCELLED')").withColumns(
        {"payload": F.to_json(F.struct("id")), "error": F.lit("handler failed"), "route": failure_route(F.col("attempt_count"))}
    )
    return dead_letter_records(
        failed.filter("route = 'dead-letter'"), "id", "tenant_id", "jobs", "job_type", "payload", "error", "attempt_count",
        F.lit(QUEUE_AS_OF).cast("timestamp_ntz"),
    )


@query(
    "dead_letter_split",
    """
SELECT id, tenant_id, CASE WHEN id % 10 = 0 THEN 'dead-letter' ELSE 'decoded' END AS route,
       CASE WHEN id % 10 = 0 THEN NULL ELSE job_type END AS job_type FROM v_job_queue""",
)
def _(t):
    from opslake.streaming.events import decode_events

    raw = t.job_queue.select(
        "id",
        "tenant_id",
        F.when(F.col("id") % 10 == 0, F.concat(F.lit('{"eventType": "QUEUE", "jobType": '), F.col("job_type")))
        .otherwise(
            F.to_json(
                F.struct(
                    F.col("id").cast("string").alias("eventId"),
                    F.lit("QUEUE").alias("eventType"),
                    F.col("tenant_id").alias("tenantId"),
                    F.col("job_type").alias("jobType"),
                )
            )
        )
        .alias("value"),
    )
    decoded = decode_events(raw, "value")
    return decoded.select(
        "id",
        "tenant_id",
        F.when(F.col("valid"), "decoded").otherwise("dead-letter").alias("route"),
        F.when(F.col("valid"), F.col("event.jobType")).alias("job_type"),
    )
