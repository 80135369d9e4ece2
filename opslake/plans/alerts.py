"""Alert rules and alert history."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opslake.operators import rules, tables
from opslake.plans.jobs import FEED_SQL, job_events
from opslake.plans.registry import query
from opslake.sources.fixtures import AS_OF

THRESHOLD_SQL = """CASE WHEN regexp_full_match(trim(regexp_extract(condition_json, 'threshold[^:]*:([^,}]*)[,}]', 1)), '[+-]?[0-9]+')
     THEN CAST(trim(regexp_extract(condition_json, 'threshold[^:]*:([^,}]*)[,}]', 1)) AS bigint) END"""

CONTEXT_SQL = f"""
SELECT tenant_id, job_id, execution_id, action, coalesce(job_name, 'unknown') AS job_name, cron_expression,
       CASE WHEN action = 'FAILED' THEN exit_code END AS exit_code,
       CASE WHEN action = 'FAILED' THEN error_message END AS error_message,
       execution_start_time, execution_end_time, producer, event_id, event_time,
       CASE WHEN action = 'FAILED' THEN CAST(1 AS bigint) END AS failure_count,
       CAST(floor((epoch_us(execution_end_time) - epoch_us(execution_start_time)) / 1000) AS bigint) AS duration_ms,
       CASE WHEN action = 'SLA_VIOLATED' THEN CAST(1 AS bigint) END AS timeout_seconds
FROM ({FEED_SQL})
WHERE action IN ('FAILED', 'SLA_VIOLATED', 'HEARTBEAT_MISSED', 'COMPLETED') AND job_id IS NOT NULL AND tenant_id IS NOT NULL"""

STREAK_SQL = """
SELECT id, row_number() OVER (PARTITION BY tenant_id, job_id, grp ORDER BY started_at, id) AS consecutive_failures
FROM (SELECT *, count(*) FILTER (WHERE status = 'SUCCESS') OVER (PARTITION BY tenant_id, job_id ORDER BY started_at, id) AS grp
      FROM v_job_executions WHERE status IN ('FAILED', 'SUCCESS')) WHERE status = 'FAILED'"""

RATE_SQL = """
SELECT id, tenant_id, job_id, row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY started_at DESC, id DESC) AS age,
       CAST(count(*) FILTER (WHERE status = 'SUCCESS') OVER runs * 100 // count(*) OVER runs AS bigint) AS success_rate
FROM v_job_executions WINDOW runs AS (PARTITION BY tenant_id, job_id ORDER BY started_at, id)"""

FULL_CONTEXT_SQL = f"""
SELECT c.*, s.consecutive_failures, coalesce(r.success_rate, n.success_rate) AS success_rate
FROM ({CONTEXT_SQL}) c LEFT JOIN ({STREAK_SQL}) s ON s.id = c.execution_id
LEFT JOIN ({RATE_SQL}) r ON r.id = c.execution_id
LEFT JOIN ({RATE_SQL}) n ON n.tenant_id = c.tenant_id AND n.job_id = c.job_id AND n.age = 1"""

EVALUATED_SQL = f"""
SELECT c.*, r.rule_id, r.name AS rule_name, r.rule_type, r.severity, r.channels_csv, r.threshold,
       coalesce(r.cooldown_seconds, 300) AS cooldown_seconds,
       coalesce(CASE r.rule_type WHEN 'FAILURE_COUNT' THEN c.failure_count >= r.threshold
                WHEN 'SLA_BREACH' THEN c.duration_ms > r.threshold
                WHEN 'CONSECUTIVE_FAILURES' THEN c.consecutive_failures >= r.threshold
                WHEN 'SUCCESS_RATE_DROP' THEN c.success_rate < r.threshold
                WHEN 'TIMEOUT' THEN c.timeout_seconds >= r.threshold END, false) AS fires
FROM ({FULL_CONTEXT_SQL}) c
JOIN (SELECT *, {THRESHOLD_SQL} AS threshold FROM v_alert_rules WHERE enabled) r
  ON r.tenant_id = c.tenant_id AND r.job_id = c.job_id"""

MESSAGE_SQL = """concat('Alert ''', rule_name, ''' (', rule_type, ') triggered. Context: [',
       concat_ws(', ', 'action=' || action, 'consecutiveFailures=' || CAST(consecutive_failures AS string),
                 'durationMs=' || CAST(duration_ms AS string), 'errorMessage=' || error_message,
                 'exitCode=' || CAST(exit_code AS string), 'failureCount=' || CAST(failure_count AS string),
                 'jobName=' || job_name, 'successRate=' || CAST(success_rate AS string),
                 'timeoutSeconds=' || CAST(timeout_seconds AS string)), ']')"""

COOLDOWN_WITH = f"""
WITH RECURSIVE firing AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY event_time, event_id) AS rn
  FROM ({EVALUATED_SQL}) WHERE fires),
walk AS (
  SELECT rule_id, rn, event_time AS last, true AS fired FROM firing WHERE rn = 1
  UNION ALL
  SELECT f.rule_id, f.rn,
         CASE WHEN f.event_time > w.last + f.cooldown_seconds * INTERVAL '1' SECOND THEN f.event_time ELSE w.last END,
         f.event_time > w.last + f.cooldown_seconds * INTERVAL '1' SECOND
  FROM walk w JOIN firing f ON f.rule_id = w.rule_id AND f.rn = w.rn + 1),
alerts AS (
  SELECT f.rule_id, f.tenant_id, f.job_id, f.event_id, f.event_time AS triggered_at, f.severity,
         f.channels_csv, f.rule_name, 'TRIGGERED' AS status, {MESSAGE_SQL} AS message
  FROM firing f JOIN walk w ON w.rule_id = f.rule_id AND w.rn = f.rn AND w.fired)"""


def full_context(t):
    """Events with their own values plus the job's streak and its success rate up to the event.

    An event without a run of its own, a missed heartbeat, takes the rate at the job's newest run.
    """
    return rules.event_context(rules.alertable_events(job_events(t, history=True)))


def evaluated(t):
    return rules.evaluate_rules(full_context(t), t.alert_rules)


def fired(t):
    return rules.cooldown_alerts(evaluated(t))


@query(
    "alertable_events",
    f"""
SELECT * FROM ({FEED_SQL}) WHERE action IN ('FAILED', 'SLA_VIOLATED', 'HEARTBEAT_MISSED', 'COMPLETED')
  AND job_id IS NOT NULL AND tenant_id IS NOT NULL""",
)
def _(t):
    return rules.alertable_events(job_events(t))


@query("event_context", CONTEXT_SQL)
def _(t):
    return rules.event_context(rules.alertable_events(job_events(t)))


@query("rule_thresholds", f"SELECT rule_id, condition_json, {THRESHOLD_SQL} AS threshold FROM v_alert_rules")
def _(t):
    return rules.rule_thresholds(t.alert_rules).select("rule_id", "condition_json", "threshold")


@query("rules_by_type", "SELECT * FROM v_alert_rules WHERE rule_type = 'TIMEOUT' AND enabled")
def _(t):
    return tables.scoped(t.alert_rules, rule_type="TIMEOUT", enabled=True)


@query(
    "rule_matches",
    f"""
SELECT e.event_id, e.action, r.rule_id, r.rule_type, r.threshold
FROM ({FEED_SQL}) e JOIN (SELECT *, {THRESHOLD_SQL} AS threshold FROM v_alert_rules WHERE enabled) r
  ON r.tenant_id = e.tenant_id AND r.job_id = e.job_id
WHERE e.action IN ('FAILED', 'SLA_VIOLATED', 'HEARTBEAT_MISSED', 'COMPLETED')""",
)
def _(t):
    matched = rules.rule_matches(rules.alertable_events(job_events(t)), t.alert_rules)
    return matched.select("event_id", "action", "rule_id", "rule_type", "threshold")


@query("rule_eval", f"SELECT event_id, rule_id, rule_type, fires FROM ({EVALUATED_SQL})")
def _(t):
    return evaluated(t).select("event_id", "rule_id", "rule_type", "fires")


@query("cooldown_alerts", f"{COOLDOWN_WITH} SELECT * FROM alerts")
def _(t):
    return fired(t)


@query(
    "cooldown_gate",
    """
SELECT r.rule_id, r.tenant_id, r.job_id, r.cooldown_seconds, h.last_triggered_at,
       coalesce(TIMESTAMP '2024-01-30 12:00:00' > h.last_triggered_at + coalesce(r.cooldown_seconds, 300) * INTERVAL '1' SECOND, true) AS allowed
FROM v_alert_rules r
LEFT JOIN (SELECT alert_rule_id, max(triggered_at) AS last_triggered_at FROM v_alert_history GROUP BY 1) h
  ON h.alert_rule_id = r.rule_id""",
)
def _(t):
    return rules.cooldown_gate(t.alert_rules, t.alert_history, AS_OF - timedelta(hours=12))


WORKER_SQL = f"""
SELECT tenant_id, job_id, execution_id, event_id, concat(tenant_id, ':', job_name) AS event_key, 'TRIGGERED' AS action, 'HIGH' AS severity,
       concat(CASE action WHEN 'FAILED' THEN 'FAILURE' WHEN 'SLA_VIOLATED' THEN 'SLA_BREACH' ELSE 'HEARTBEAT_MISSED' END, ': ', job_name) AS alert_name,
       concat(CASE action WHEN 'FAILED' THEN 'Job failed: ' WHEN 'SLA_VIOLATED' THEN 'SLA violated for: ' ELSE 'Heartbeat missed for: ' END, job_name) AS description,
       coalesce(CAST(exit_code AS string), 'null') AS context_exit_code, coalesce(error_message, '') AS context_error_message,
       job_name AS context_job_name
FROM ({FEED_SQL}) WHERE action IN ('FAILED', 'SLA_VIOLATED', 'HEARTBEAT_MISSED')"""


@query("worker_alerts", WORKER_SQL)
def _(t):
    return rules.worker_alerts(job_events(t))


@query(
    "alert_feed",
    f"""{COOLDOWN_WITH}
SELECT tenant_id, rule_id, event_id, severity, rule_name AS alert_name, message AS description, 'rules' AS producer FROM alerts
UNION ALL
SELECT tenant_id, NULL, event_id, severity, alert_name, description, 'worker' FROM ({WORKER_SQL})""",
)
def _(t):
    return rules.alert_feed(fired(t), rules.worker_alerts(job_events(t)))


@query(
    "alert_fanout",
    f"""{COOLDOWN_WITH},
per_channel AS (SELECT tenant_id, rule_id, event_id, triggered_at, severity, message,
                       unnest(string_split(channels_csv, ',')) AS channel FROM alerts)
SELECT p.*, t.template_id FROM per_channel p
LEFT JOIN v_templates t ON t.tenant_id = p.tenant_id AND t.channel = p.channel""",
)
def _(t):
    return rules.alert_fanout(fired(t), t.templates)


@query(
    "alerts_per_rule",
    """
SELECT alert_rule_id, count(*) AS alert_count FROM v_alert_history
WHERE triggered_at >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1""",
)
def _(t):
    return rules.alerts_per_rule(t.alert_history, AS_OF - timedelta(days=14))


@query("alerts_by_status", "SELECT * FROM v_alert_history WHERE tenant_id = '7' AND status = 'ACKNOWLEDGED'")
def _(t):
    return tables.newest_first(tables.scoped(t.alert_history, "7", status="ACKNOWLEDGED"), "triggered_at", "id")


@query(
    "history_last_7d",
    """
SELECT * FROM v_alert_history
WHERE tenant_id = '7' AND triggered_at BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'""",
)
def _(t):
    start, end = tables.default_window(AS_OF)
    rows = tables.in_range(tables.scoped(t.alert_history, "7"), "triggered_at", start, end)
    return tables.newest_first(rows, "triggered_at", "id")


@query(
    "alert_acks",
    """
SELECT id, alert_rule_id, tenant_id, job_id, severity, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'ACKNOWLEDGED' ELSE status END AS status,
       message, triggered_at, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'ops' END AS acknowledged_by,
       CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS acknowledged_at
FROM v_alert_history""",
)
def _(t):
    history = t.alert_history
    # Even ids name the right tenant, odd ones another one, which must not match.
    # Every command comes twice; the first name counts.
    commands = history.filter("status = 'TRIGGERED'").select(
        "id",
        "triggered_at",
        F.expr("if(id % 2 = 0, tenant_id, concat(tenant_id, 'x'))").alias("tenant_id"),
        F.explode(F.array(F.lit("ops"), F.lit("second"))).alias("acknowledged_by"),
    )
    return rules.acknowledge(history, commands, AS_OF)
