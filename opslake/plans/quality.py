"""Data quality, events and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake import schemas
from opslake.functions.scratch import scratch_path
from opslake.operators import evaluators, quality, tables
from opslake.plans.alerts import COOLDOWN_WITH, fired
from opslake.plans.jobs import EXECUTION_EVENTS_SQL, FEED_SQL, job_events
from opslake.plans.registry import query
from opslake.sources import archive
from opslake.streaming import events


@query(
    "row_violations",
    """
SELECT job_id, tenant_id, concat_ws('; ',
         CASE WHEN coalesce(trim(name) = '', true) THEN 'Job name is required' END,
         CASE WHEN length(name) > 255 THEN 'Job name must not exceed 255 characters' END,
         CASE WHEN length(cron_expression) > 100 THEN 'Cron expression must not exceed 100 characters' END,
         CASE WHEN sla_seconds <= 0 THEN 'SLA seconds must be positive' END,
         CASE WHEN grace_period_seconds <= 0 THEN 'Grace period must be positive' END,
         CASE WHEN expected_runtime_seconds <= 0 THEN 'Expected runtime must be positive' END,
         CASE WHEN job_id % 13 = 0 THEN 'Timeout must be positive' END,
         CASE WHEN job_id % 11 = 0 THEN 'Max retries must be positive' END) AS violations
FROM (SELECT * REPLACE (CASE WHEN job_id % 17 = 0 THEN ' ' WHEN job_id % 19 = 0 THEN repeat('x', 300) ELSE name END AS name,
                        CASE WHEN job_id % 4 = 3 THEN -1 ELSE sla_seconds END AS sla_seconds) FROM v_jobs)""",
)
def _(t):
    jobs = t.jobs.withColumns(
        {
            "timeout_seconds": F.expr("case when job_id % 13 = 0 then 0 when job_id % 3 = 0 then null else 60 end"),
            "max_retries": F.expr("if(job_id % 11 = 0, -1, 3)"),
            "name": F.expr("case when job_id % 17 = 0 then ' \\t\\n' when job_id % 19 = 0 then repeat('x', 300) else name end"),
            "sla_seconds": F.expr("if(job_id % 4 = 3, -1, sla_seconds)"),
        }
    )
    checked = quality.row_violations(jobs, quality.JOB_RULES)
    return checked.select("job_id", "tenant_id", F.array_join("violations", "; ").alias("violations"))


def _violations(rows, rules, *keys):
    checked = quality.row_violations(rows, rules)
    return checked.select(*keys, F.array_join("violations", "; ").alias("violations"))


@query(
    "alert_rule_violations",
    """
SELECT rule_id, concat_ws('; ', CASE WHEN rule_id % 7 = 0 THEN 'Alert rule name is required' END,
         CASE WHEN rule_id % 9 = 0 THEN 'Description must not exceed 2000 characters' END,
         CASE WHEN rule_id % 10 = 6 THEN 'Rule type must not exceed 50 characters' END,
         CASE WHEN rule_id % 11 = 0 THEN 'Condition JSON is required' END,
         CASE WHEN cooldown_seconds > 20000 THEN 'Cooldown seconds must be positive' END) AS violations
FROM v_alert_rules""",
)
def _(t):
    broken = t.alert_rules.withColumns(
        {
            "name": F.expr("if(rule_id % 7 = 0, '\\t', name)"),
            "description": F.expr("if(rule_id % 9 = 0, repeat('d', 2001), null)"),
            "rule_type": F.expr("if(rule_id % 10 = 6, repeat('t', 51), rule_type)"),
            "condition_json": F.expr("if(rule_id % 11 = 0, null, condition_json)"),
            "cooldown_seconds": F.expr("if(cooldown_seconds > 20000, 0, cooldown_seconds)"),
        }
    )
    return _violations(broken, quality.ALERT_RULE_RULES, "rule_id")


@query(
    "notification_violations",
    """
SELECT id, concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'Channel is required' END,
         CASE WHEN id % 6 = 0 THEN 'Recipient is required' WHEN id % 7 = 0 THEN 'Recipient must not exceed 500 characters' END,
         CASE WHEN id % 8 = 0 THEN 'Subject must not exceed 500 characters' END,
         CASE WHEN priority > 8 THEN 'Priority must be positive' END) AS violations
FROM v_notifications""",
)
def _(t):
    broken = t.notifications.withColumns(
        {
            "channel": F.expr("if(id % 5 = 0, null, channel)"),
            "recipient": F.expr("case when id % 6 = 0 then ' ' when id % 7 = 0 then repeat('r', 501) else recipient end"),
            "subject": F.expr("if(id % 8 = 0, repeat('s', 501), 's')"),
            "priority": F.expr("if(priority > 8, 0, priority)"),
        }
    )
    return _violations(broken, quality.NOTIFICATION_RULES, "id")


@query(
    "queue_violations",
    """
SELECT id, concat_ws('; ', CASE WHEN id % 9 = 0 THEN 'Job type is required' END,
         CASE WHEN id % 4 = 0 OR id % 7 = 0 THEN 'Priority must be between 1 and 10' END) AS violations
FROM v_job_queue""",
)
def _(t):
    broken = t.job_queue.withColumns(
        {
            "job_type": F.expr("if(id % 9 = 0, '', job_type)"),
            "priority": F.expr("case when id % 4 = 0 then 0 when id % 7 = 0 then 11 else priority end"),
        }
    )
    return _violations(broken, quality.QUEUE_RULES, "id")


@query(
    "ingest_violations",
    """
SELECT request_id, concat_ws('; ', CASE WHEN request_id % 6 = 0 THEN 'Job name is required' END,
         CASE WHEN event_type IS NULL THEN 'Event type is required' END) AS violations
FROM v_ingest_requests""",
)
def _(t):
    broken = t.ingest_requests.withColumn("job_name", F.expr("if(request_id % 6 = 0, '  ', job_name)"))
    return _violations(broken, quality.INGEST_RULES, "request_id")


USERS_SQL = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_name END AS username,
       CONCAT('u', CAST(CAST(c_custkey AS bigint) - c_custkey % 2 AS string), '@example.com') AS email,
       CASE CAST(c_custkey % 4 AS int) WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'OPERATOR' WHEN 2 THEN 'VIEWER' ELSE 'ROOT' END AS role
FROM customer"""


@query(
    "user_constraints",
    f"""
WITH u AS ({USERS_SQL})
SELECT 'users' AS table_name, 'not_null:username' AS rule, count(*) FILTER (WHERE username IS NULL) AS violations FROM u
UNION ALL SELECT 'users', 'allowed:role', count(*) FILTER (WHERE role NOT IN ('ADMIN', 'OPERATOR', 'VIEWER')) FROM u
UNION ALL SELECT 'users', 'unique:username', count(*) FROM (SELECT 1 FROM u WHERE username IS NOT NULL GROUP BY username HAVING count(*) > 1)
UNION ALL SELECT 'users', 'unique:email', count(*) FROM (SELECT 1 FROM u GROUP BY email HAVING count(*) > 1)""",
)
def _(t):
    unique = {"username": ["username"], "email": ["email"]}
    return quality.constraint_report(t.sql(USERS_SQL), "users", unique, ["username"], {"role": schemas.ROLES})


@query(
    "event_contract",
    f"""
SELECT execution_id, concat_ws(',',
         CASE WHEN execution_id % 5 = 1 THEN 'bad action' END,
         CASE WHEN execution_id % 11 = 0 THEN 'bad eventId' END,
         CASE WHEN execution_id % 7 = 0 THEN 'bad exitCode' END,
         CASE WHEN execution_id % 9 = 0 THEN 'bad timestamp' END,
         CASE WHEN execution_id % 5 = 2 THEN 'missing jobName' END,
         CASE WHEN execution_id % 5 = 3 THEN 'missing source' END,
         CASE WHEN execution_id % 5 = 4 THEN 'unknown colour' END) AS violations
FROM ({EXECUTION_EVENTS_SQL})""",
)
def _(t):
    def uuid_of(column):
        parts = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
        return F.regexp_replace(F.md5(F.col(column).cast("string")), parts, "$1-$2-$3-$4-$5")

    k = F.col("execution_id") % 5
    broken = evaluators.execution_events(t.job_executions, t.jobs).select(
        "execution_id",
        F.to_json(
            F.struct(
                F.when(F.col("execution_id") % 11 == 0, "17").otherwise(uuid_of("execution_id")).alias("eventId"),
                F.lit("JOB").alias("eventType"),
                F.when(F.col("execution_id") % 9 == 0, "not a time")
                .otherwise(F.date_format("execution_start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                .alias("timestamp"),
                F.when(F.col("execution_id") % 7 == 0, "oops").otherwise(F.col("exit_code").cast("string")).alias("exitCode"),
                F.when(k != 3, "job-monitoring-service").alias("source"),
                F.col("tenant_id").alias("tenantId"),
                uuid_of("job_id").alias("jobId"),
                F.when(k == 1, "DANCED").otherwise(F.col("action")).alias("action"),
                F.when(k != 2, F.col("job_name")).alias("jobName"),
                F.when(k == 4, "blue").alias("colour"),
            )
        ).alias("payload"),
    )
    return quality.event_contract(broken).select("execution_id", F.array_join("violations", ",").alias("violations"))


@query(
    "duplicate_names",
    """
WITH c AS (SELECT job_id, tenant_id, CASE WHEN job_id % 3 = 0 THEN 'shared' ELSE name END AS name FROM v_jobs)
SELECT c.tenant_id, c.name, c.job_id FROM c
WHERE EXISTS (SELECT 1 FROM c o WHERE o.tenant_id = c.tenant_id AND o.name = c.name AND o.job_id <> c.job_id)""",
)
def _(t):
    named = t.jobs.select("job_id", "tenant_id", F.expr("if(job_id % 3 = 0, 'shared', name)").alias("name"))
    return quality.duplicate_names(named, named, ["tenant_id", "name"], "job_id")


@query(
    "orphan_rows",
    """
SELECT tenant_id, job_id, count(*) AS rows FROM v_job_executions e
WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.tenant_id = e.tenant_id AND j.job_id = e.job_id AND j.status = 'ACTIVE')
GROUP BY ALL""",
)
def _(t):
    return quality.orphan_rows(t.job_executions, t.jobs.filter("status = 'ACTIVE'"), ["tenant_id", "job_id"])


@query(
    "constraint_report",
    """
SELECT 'jobs' AS table_name, 'not_null:cron_expression' AS rule, count(*) FILTER (WHERE cron_expression IS NULL) AS violations FROM v_jobs
UNION ALL SELECT 'jobs', 'allowed:status', count(*) FILTER (WHERE status NOT IN ('ACTIVE')) FROM v_jobs
UNION ALL SELECT 'jobs', 'unique:tenant_tags', count(*) FROM (SELECT 1 FROM v_jobs GROUP BY tenant_id, tags_csv HAVING count(*) > 1)
UNION ALL SELECT 'jobs', 'unique:tenant_name', count(*) FROM (SELECT 1 FROM v_jobs GROUP BY tenant_id, name HAVING count(*) > 1)""",
)
def _(t):
    return quality.constraint_report(
        t.jobs,
        "jobs",
        {"tenant_tags": ["tenant_id", "tags_csv"], "tenant_name": ["tenant_id", "name"]},
        ["cron_expression"],
        {"status": ("ACTIVE",)},
    )


def uuid_sql(name: str) -> str:
    """The uuid made from a text."""
    h = f"md5({name})"
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-3', substr({h}, 14, 3), '-8', substr({h}, 18, 3), '-', substr({h}, 21, 12))"


@query(
    "publish_envelope",
    f"""
SELECT tenant_id AS key, 'JOB' AS event_type, {uuid_sql("event_id")} AS event_id,
       CAST(job_id AS string) AS job_id, action, job_name, CAST(exit_code AS string) AS exit_code, error_message
FROM ({FEED_SQL})""",
)
def _(t):
    def field(name):
        return F.get_json_object("value", f"$.{name}")

    return events.job_event_messages(job_events(t)).select(
        "key",
        field("eventType").alias("event_type"),
        field("eventId").alias("event_id"),
        events.number_of_uuid(field("jobId")).cast("string").alias("job_id"),
        field("action").alias("action"),
        field("jobName").alias("job_name"),
        field("exitCode").alias("exit_code"),
        field("errorMessage").alias("error_message"),
    )


def _fields(messages, **names):
    return messages.select("key", *(F.get_json_object("value", f"$.{path}").alias(name) for name, path in names.items()))


@query(
    "publish_alerts",
    f"""{COOLDOWN_WITH}
SELECT tenant_id AS key, 'ALERT' AS event_type, {uuid_sql("concat('alerts-', CAST(rule_id AS string), '-', event_id)")} AS event_id, status AS action,
       severity, rule_name AS alert_name, message AS description, string_split(channels_csv, ',')[1] AS first_channel
FROM alerts""",
)
def _(t):
    return _fields(
        events.alert_event_messages(fired(t)), event_type="eventType", event_id="eventId", action="action", severity="severity",
        alert_name="alertName", description="description", first_channel="channels[0]",
    )


@query(
    "publish_queue",
    f"""
SELECT tenant_id AS key, {uuid_sql("concat('queue-', CAST(id AS string), '-', action, '-', CAST(attempt_count AS string))")} AS event_id, action,
       job_type, CAST(priority AS string) AS priority, assigned_worker AS worker
FROM (SELECT *, CASE status WHEN 'PENDING' THEN 'ENQUEUED' ELSE status END AS action FROM v_job_queue)""",
)
def _(t):
    return _fields(
        events.queue_event_messages(t.job_queue), event_id="eventId", action="action", job_type="jobType", priority="priority", worker="workerNodeId"
    )


@query(
    "publish_notifications",
    f"""
SELECT tenant_id AS key, {uuid_sql("concat('notification-', CAST(id AS string), '-', action, '-', CAST(retry_count AS string))")} AS event_id,
       CAST(id AS string) AS notification_id, action, channel, recipient
FROM (SELECT *, CASE status WHEN 'PENDING' THEN 'REQUESTED' ELSE status END AS action FROM v_notifications)""",
)
def _(t):
    told = _fields(
        events.notification_event_messages(t.notifications), event_id="eventId", notification="notificationId", action="action", channel="channel",
        recipient="recipient",
    )
    return told.withColumn("notification_id", events.number_of_uuid(F.col("notification")).cast("string")).drop("notification")


@query(
    "published_contract",
    f"SELECT 'JOB' AS event_type, CAST(count(*) AS bigint) AS messages, CAST(0 AS bigint) AS violating FROM ({FEED_SQL}) WHERE job_id IS NOT NULL "
    "UNION ALL SELECT 'QUEUE', count(*), 0 FROM v_job_queue UNION ALL SELECT 'NOTIFICATION', count(*), 0 FROM v_notifications",
)
def _(t):
    """What is published keeps the contract; requests from outside name no job and are judged by ``event_contract``."""
    known = job_events(t).where("job_id is not null")
    sent = [
        events.job_event_messages(known),
        events.queue_event_messages(t.job_queue),
        events.notification_event_messages(t.notifications),
    ]
    every = sent[0].union(sent[1]).union(sent[2])
    judged = quality.event_contract(every, "value").withColumn("event_type", F.get_json_object("value", "$.eventType"))
    return judged.groupBy("event_type").agg(F.count("*").alias("messages"), F.count_if(F.size("violations") > 0).alias("violating"))


@query(
    "decode_events",
    f"""
SELECT tenant_id, CAST(job_id AS string) AS job_id, CAST(execution_id AS string) AS execution_id, action, exit_code, error_message,
       execution_start_time, execution_end_time FROM ({FEED_SQL})""",
)
def _(t):
    decoded = events.decode_events(events.job_event_messages(job_events(t)))
    return events.events_of_type(decoded, "JOB").select(
        F.col("tenantId").alias("tenant_id"),
        events.number_of_uuid(F.col("jobId")).cast("string").alias("job_id"),
        events.number_of_uuid(F.col("executionId")).cast("string").alias("execution_id"),
        "action",
        F.col("exitCode").alias("exit_code"),
        F.col("errorMessage").alias("error_message"),
        F.col("executionStartTime").cast("timestamp_ntz").alias("execution_start_time"),
        F.col("executionEndTime").cast("timestamp_ntz").alias("execution_end_time"),
    )


@query("dedup_events", "SELECT * FROM v_job_executions")
def _(t):
    """Every event delivered twice comes out once."""
    once = t.job_executions
    return tables.dedup_events(once.unionByName(once), "id", [F.asc("started_at")])


@query(
    "log_archive_roundtrip",
    "SELECT service, CAST(ts AS date) AS log_date, count(*) AS entries, CAST(sum(length(message)) AS bigint) AS characters FROM v_logs GROUP BY ALL",
)
def _(t):
    path = scratch_path(t.spark, "log-archive")
    archive.archive_logs(t.logs, path)
    return (
        archive.read_archive(t.spark, path, t.logs.schema)
        .groupBy("service", "log_date")
        .agg(F.count("*").alias("entries"), F.sum(F.length("message")).cast("bigint").alias("characters"))
    )
