"""Metric time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize
from opslake.functions.skew import HOT_ROWS, Running, hot_keys, scan
from opslake.operators import metrics
from opslake.plans.registry import query

SERIES = ["job", "status"]

INCREASE_SQL = """
SELECT job, status, ts, CASE WHEN value - prev < 0 THEN value ELSE value - prev END AS increase
FROM (SELECT job, status, ts, value, lag(value) OVER (PARTITION BY job, status ORDER BY ts) AS prev
      FROM (SELECT job, status, ts, max(value) AS value FROM v_metric_samples GROUP BY ALL))
WHERE prev IS NOT NULL"""

STEP_SQL = """CAST(ceil(epoch_us(ts) / {step}000000.0) AS bigint)"""


def rate_sql(by: str, rng: int, step: int) -> str:
    n = rng // step
    return f"""
SELECT {by}make_timestamp((s + c) * {step}000000) AS "at", sum(increase) / {rng}.0 AS rate
FROM (SELECT *, {STEP_SQL.format(step=step)} AS s FROM ({INCREASE_SQL})), unnest(range({n})) AS r(c)
GROUP BY ALL"""


@query("metric_rate", rate_sql("job, ", 3600, 900))
def _(t):
    return metrics.metric_rate(t.metric_samples, SERIES, ["job"], 3600, 900)


@query("metric_rate_total", rate_sql("", 3600, 3600))
def _(t):
    return metrics.metric_rate(t.metric_samples, SERIES, [], 3600, 3600)


@query(
    "error_ratio",
    f"""
WITH r AS (SELECT job, status = 'error' AS failed, make_timestamp({STEP_SQL.format(step=7200)} * 7200000000) AS "at", sum(increase) / 7200.0 AS rate
           FROM ({INCREASE_SQL}) GROUP BY ALL),
s AS (SELECT job, "at", coalesce(sum(rate) FILTER (WHERE failed), 0.0) AS error_rate, sum(rate) AS total_rate FROM r GROUP BY ALL)
SELECT *, CASE WHEN total_rate <> 0 THEN error_rate / total_rate END AS ratio,
       coalesce(CASE WHEN total_rate <> 0 THEN error_rate / total_rate END > 0.05, false) AS breached FROM s""",
)
def _(t):
    return metrics.error_ratio(
        t.metric_samples, SERIES, ["job"], F.col("status") == "error", range_seconds=7200
    )


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@query(
    "histogram_p95",
    """
WITH o AS (SELECT concat('job', CAST(user_id % 3 AS string)) AS job, value FROM events),
b AS (SELECT o.job, l.le, count(*) FILTER (WHERE o.value <= l.le) AS cnt
      FROM o, (VALUES (1.0::double), (5.0::double), (10.0::double), (25.0::double), (50.0::double), (100.0::double), ('infinity'::double)) AS l(le) GROUP BY ALL),
w AS (SELECT *, max(cnt) OVER (PARTITION BY job) AS total, coalesce(lag(cnt) OVER (PARTITION BY job ORDER BY le), 0) AS below,
             coalesce(lag(le) OVER (PARTITION BY job ORDER BY le), 0.0) AS low FROM b)
SELECT job, min(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95::double * total - below) / (cnt - below) END) AS quantile
FROM w WHERE cnt >= 0.95::double * total AND below < 0.95::double * total GROUP BY job""",
)
def _(t):
    observed = t.base("events").select(F.concat(F.lit("job"), (F.col("user_id") % 3).cast("string")).alias("job"), "value")
    return metrics.histogram_quantile(metrics.cumulative_buckets(observed, ["job"], "value", BOUNDS), ["job"])


BUCKETS_SQL = """
SELECT job, le, ts, count(*) OVER (PARTITION BY job, le ORDER BY ts, event_id) AS value
FROM (SELECT CONCAT('job', CAST(user_id % 3 AS string)) AS job, ts, event_id, value AS seen FROM events) e
JOIN (SELECT * FROM (VALUES (1.0), (5.0), (10.0), (25.0), (50.0), (100.0), (1e300)) AS l(le)) l ON e.seen <= l.le"""


P95_SQL = f"""
WITH c AS (SELECT job, le, ts, max(value) AS value FROM ({BUCKETS_SQL}) GROUP BY ALL),
i AS (SELECT job, le, ts, value - lag(value) OVER (PARTITION BY job, le ORDER BY ts) AS increase FROM c),
b AS (SELECT job, le, make_timestamp({STEP_SQL.format(step=3600)} * 3600000000) AS "at", sum(increase) / 3600.0 AS cnt
      FROM i WHERE increase IS NOT NULL GROUP BY ALL),
w AS (SELECT *, max(cnt) OVER (PARTITION BY job, "at") AS total,
             coalesce(lag(cnt) OVER (PARTITION BY job, "at" ORDER BY le), 0) AS below,
             coalesce(lag(le) OVER (PARTITION BY job, "at" ORDER BY le), 0.0) AS low FROM b)
SELECT job, "at", min(CASE WHEN le > 1e200 THEN low ELSE low + (le - low) * (0.95::double * total - below) / (cnt - below) END) AS quantile
FROM w WHERE cnt >= 0.95::double * total AND below < 0.95::double * total GROUP BY ALL"""


def response_p95(t):
    job = F.concat(F.lit("job"), (F.col("user_id") % 3).cast("string")).alias("job")
    bounds = F.array(*(F.lit(b) for b in [*BOUNDS, float("inf")]))
    seen = t.base("events").select(job, "ts", F.explode(F.filter(bounds, lambda b: F.col("value") <= b)).alias("le"))
    # Counters as scraped: what each bucket has counted so far, one sample per time.
    at_time = seen.groupBy("job", "le", "ts").agg(F.count("*").alias("seen"))
    hot = hot_keys(seen, ["job", "le"], HOT_ROWS)  # times are no more than observations
    counted = scan(at_time, ["job", "le"], ["ts"], HOT_ROWS, hot, value=Running("sum", F.col("seen")))
    scraped = counted.select("job", "le", "ts", F.col("value").cast("double").alias("value"))
    return metrics.rate_quantile(materialize(scraped, "scraped"), ["job"], ["job"], 0.95, 3600)


@query("response_p95_by_hour", P95_SQL)
def _(t):
    return response_p95(t)


LATEST_GAUGE = """
SELECT metric, job, instance, arg_max(value, ts) AS value FROM v_gauge_samples GROUP BY ALL"""


@query(
    "services_up",
    f"""
SELECT job, count(*) FILTER (WHERE value = 1) AS up, count(*) FILTER (WHERE value = 0) AS down
FROM ({LATEST_GAUGE}) WHERE metric = 'up' GROUP BY job""",
)
def _(t):
    return metrics.services_up(t.gauge_samples, ["job"], ["job", "instance"])


@query(
    "gauge_ratio",
    f"""
SELECT job, instance, u / 1048576.0 AS used_mib, m / 1048576.0 AS limit_mib, u / m AS ratio, u / m > 0.85 AS breached
FROM (SELECT job, instance, max(value) FILTER (WHERE metric = 'heap_used') AS u, max(value) FILTER (WHERE metric = 'heap_max') AS m
      FROM ({LATEST_GAUGE}) WHERE metric IN ('heap_used', 'heap_max') GROUP BY ALL)""",
)
def _(t):
    return metrics.gauge_ratio(t.gauge_samples, "heap_used", "heap_max", ["job", "instance"])


@query(
    "gauge_sum",
    f"SELECT job, sum(value) AS value FROM ({LATEST_GAUGE}) WHERE metric = 'consumer_lag' GROUP BY job",
)
def _(t):
    return metrics.gauge_sum(t.gauge_samples, "consumer_lag", ["job"], ["job", "instance"])


@query(
    "queue_backlog",
    """
SELECT tenant_id, CAST(count(*) FILTER (WHERE metric = 'enqueued') AS double) AS enqueued,
       CAST(count(*) FILTER (WHERE metric = 'completed') AS double) AS completed,
       CAST(count(*) FILTER (WHERE metric = 'enqueued') - count(*) FILTER (WHERE metric = 'completed') AS double) AS backlog,
       count(*) FILTER (WHERE metric = 'enqueued') - count(*) FILTER (WHERE metric = 'completed') > 100 AS breached
FROM v_queue_counters GROUP BY tenant_id""",
)
def _(t):
    # Scraped counters hold the number of transitions so far; the newest is their count.
    scraped = t.queue_counters.groupBy("tenant_id", "metric").agg(
        F.count("*").cast("double").alias("value"), F.max("ts").alias("ts")
    )
    return metrics.queue_backlog(scraped, ["tenant_id"])


@query(
    "sustained_breaches",
    """
WITH p AS (SELECT job, ts, max(value > 5 * 1048576) AS bad FROM v_gauge_samples WHERE metric = 'heap_used' GROUP BY ALL),
g AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY job ORDER BY ts) AS island FROM p)
SELECT job, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS samples FROM g WHERE bad GROUP BY job, island
HAVING max(ts) >= min(ts) + INTERVAL '3600 seconds'""",
)
def _(t):
    heap = t.gauge_samples.filter("metric = 'heap_used'")
    return metrics.sustained_breaches(heap, ["job"], F.col("value") > 5 * 1048576, 3600)


ALERTS_WITH = f"""
WITH r AS (SELECT job, status = 'error' AS failed, make_timestamp({STEP_SQL.format(step=900)} * 900000000) AS "at", sum(increase) / 900.0 AS rate
           FROM ({INCREASE_SQL}) GROUP BY ALL),
total AS (SELECT job, "at", sum(rate) AS rate FROM r GROUP BY ALL),
moves AS (SELECT concat('tenant', tenant_id) AS job, ts, sum(CASE metric WHEN 'enqueued' THEN 1 ELSE -1 END) AS change
          FROM v_queue_counters GROUP BY ALL),
p95 AS ({P95_SQL}),
v AS (
  SELECT 'ServiceDown' AS alertname, job, instance, ts, value, value = 0 AS bad, 60 AS hold, 'critical' AS severity
  FROM v_gauge_samples WHERE metric = 'up'
  UNION ALL
  SELECT 'HighMemoryUsage', job, instance, ts, ratio, ratio > 0.85, 300, 'warning' FROM (
    SELECT job, instance, ts, max(value) FILTER (WHERE metric = 'heap_used') / max(value) FILTER (WHERE metric = 'heap_max') AS ratio
    FROM v_gauge_samples WHERE metric IN ('heap_used', 'heap_max') GROUP BY ALL)
  UNION ALL
  SELECT 'HighErrorRate', job, '', "at", ratio, ratio > 0.05, 120, 'warning' FROM (
    SELECT job, "at", coalesce(sum(rate) FILTER (WHERE failed), 0.0) / nullif(sum(rate), 0) AS ratio FROM r GROUP BY ALL)
  UNION ALL SELECT 'HighGCPause', job, '', "at", rate / 4, rate / 4 > 0.5, 180, 'warning' FROM total
  UNION ALL SELECT 'HighAlertRate', job, '', "at", rate * 4, rate * 4 > 10, 300, 'info' FROM total
  UNION ALL SELECT 'QueueBacklog', job, '', ts, backlog, backlog > 100, 300, 'warning'
    FROM (SELECT job, ts, sum(change) OVER (PARTITION BY job ORDER BY ts) AS backlog FROM moves)
  UNION ALL SELECT 'SlowIngestion', job, '', "at", quantile, quantile > 2, 180, 'warning' FROM p95),
p AS (SELECT alertname, job, instance, ts, hold, severity, max(coalesce(bad, false)) AS bad FROM v GROUP BY ALL),
g AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY alertname, job, instance ORDER BY ts) AS island FROM p),
held AS (SELECT alertname, job, instance, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS samples, severity
         FROM g WHERE bad GROUP BY alertname, job, instance, island, severity, hold
         HAVING max(ts) >= min(ts) + hold * INTERVAL '1' SECOND)"""


def held_alerts(t):
    """All seven metric alerts over the samples they look at."""

    def values(df, alert, value, ts="at", instance=None):
        label = F.lit("").alias("instance") if instance is None else F.col(instance).alias("instance")
        return df.select(F.lit(alert).alias("alertname"), "job", label, F.col(ts).alias("ts"), value.cast("double").alias("value"))

    gauges = t.gauge_samples
    heap = gauges.filter("metric in ('heap_used', 'heap_max')").groupBy("job", "instance", "ts").agg(
        F.max(F.when(F.col("metric") == "heap_used", F.col("value"))).alias("used"),
        F.max(F.when(F.col("metric") == "heap_max", F.col("value"))).alias("top"),
    )
    errors = metrics.error_ratio(t.metric_samples, SERIES, ["job"], F.col("status") == "error", range_seconds=900)
    total = metrics.metric_rate(t.metric_samples, SERIES, ["job"], 900, 900)
    moves = t.queue_counters.groupBy(F.concat(F.lit("tenant"), "tenant_id").alias("job"), "ts").agg(
        F.sum(F.when(F.col("metric") == "enqueued", 1).otherwise(-1)).alias("change")
    )
    backlog = scan(moves, ["job"], ["ts"], backlog=Running("sum", F.col("change")))
    fed = [
        values(gauges.filter("metric = 'up'"), "ServiceDown", F.col("value"), "ts", "instance"),
        values(heap, "HighMemoryUsage", F.try_divide("used", "top"), "ts", "instance"),
        values(errors, "HighErrorRate", F.col("ratio")),
        values(total, "HighGCPause", F.col("rate") / 4),
        values(total, "HighAlertRate", F.col("rate") * 4),
        values(backlog, "QueueBacklog", F.col("backlog"), "ts"),
        values(response_p95(t), "SlowIngestion", F.col("quantile")),
    ]
    return metrics.metric_alerts(materialize(reduce(DataFrame.unionByName, fed), "alert-values"), ["job", "instance"])


@query("metric_alerts", f"{ALERTS_WITH} SELECT * FROM held")
def _(t):
    return held_alerts(t)


@query(
    "metric_alert_groups",
    f"""{ALERTS_WITH},
a AS (SELECT alertname, job AS service, started_at, instance, ended_at,
        lag(started_at) OVER (PARTITION BY alertname, job ORDER BY started_at, instance, ended_at) AS prev FROM held),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR started_at >= prev + INTERVAL '1 hour' THEN 1 ELSE 0 END)
             OVER (PARTITION BY alertname, service ORDER BY started_at, instance, ended_at) AS grp FROM a)
SELECT alertname, service, min(started_at) AS started_at, max(started_at) AS ended_at, count(*) AS alerts
FROM n GROUP BY alertname, service, grp""",
)
def _(t):
    alerts = materialize(held_alerts(t), "held-alerts").withColumnRenamed("job", "service")
    return metrics.alert_groups(alerts, ["alertname", "service"], "started_at", "instance", 3600)


@query(
    "alert_groups",
    """
WITH a AS (SELECT tenant_id, severity, triggered_at, id,
             lag(triggered_at) OVER (PARTITION BY tenant_id, severity ORDER BY triggered_at, id) AS prev FROM v_alert_history),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR triggered_at >= prev + INTERVAL '4 hours' THEN 1 ELSE 0 END)
             OVER (PARTITION BY tenant_id, severity ORDER BY triggered_at, id) AS grp FROM a)
SELECT tenant_id, severity, min(triggered_at) AS started_at, max(triggered_at) AS ended_at, count(*) AS alerts
FROM g GROUP BY tenant_id, severity, grp""",
)
def _(t):
    return metrics.alert_groups(t.alert_history, ["tenant_id", "severity"], "triggered_at", "id", 4 * 3600)


@query(
    "alert_repeats",
    """
WITH RECURSIVE a AS (SELECT id, alert_rule_id, triggered_at, row_number() OVER (PARTITION BY alert_rule_id ORDER BY triggered_at, id) AS rn
                     FROM v_alert_history),
w AS (
  SELECT alert_rule_id, rn, triggered_at AS last, true AS fired FROM a WHERE rn = 1
  UNION ALL
  SELECT a.alert_rule_id, a.rn, CASE WHEN a.triggered_at > w.last + INTERVAL '1 day' THEN a.triggered_at ELSE w.last END,
         a.triggered_at > w.last + INTERVAL '1 day'
  FROM w JOIN a ON a.alert_rule_id = w.alert_rule_id AND a.rn = w.rn + 1)
SELECT a.id, a.alert_rule_id, a.triggered_at FROM a JOIN w ON w.alert_rule_id = a.alert_rule_id AND w.rn = a.rn AND w.fired""",
)
def _(t):
    alerts = t.alert_history.select("id", "alert_rule_id", "triggered_at")
    return metrics.repeat_suppressed(alerts, "alert_rule_id", "triggered_at", "id", 86_400).select(
        "id", "alert_rule_id", "triggered_at"
    )


@query(
    "inhibited_alerts",
    """
SELECT tenant_id, triggered_at, id, severity FROM v_alert_history m
WHERE severity = 'MEDIUM' AND EXISTS (
  SELECT 1 FROM v_alert_history c WHERE c.tenant_id = m.tenant_id AND c.severity = 'CRITICAL'
    AND c.triggered_at <= m.triggered_at AND c.triggered_at + INTERVAL '12 hours' > m.triggered_at)""",
)
def _(t):
    return metrics.inhibited_alerts(
        t.alert_history, ["tenant_id"], "triggered_at", "id", 12 * 3600, "CRITICAL", "MEDIUM"
    )
