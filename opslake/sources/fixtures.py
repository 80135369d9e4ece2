"""Domain tables as views over the star-schema test data.

The texts run unchanged on Spark and on the checking engine.  ``Domain`` gives
each view as a DataFrame; nothing is read before a query asks for it.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions.skew import outgrows_broadcast

# Column types of the test tables, so reading one never starts a job to look them up.
BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

AS_OF = datetime(2024, 1, 31)
QUEUE_AS_OF = datetime(1999, 1, 1)

VIEWS = {
    "v_tenants": """
SELECT CAST(n_nationkey AS string) AS tenant_id, n_name AS name,
       CASE WHEN n_nationkey % 3 = 0 THEN 'FREE' WHEN n_nationkey % 3 = 1 THEN 'PRO' ELSE 'ENTERPRISE' END AS plan,
       'ACTIVE' AS status
FROM nation""",
    "v_jobs": """
SELECT c_custkey AS job_id, CAST(c_nationkey AS string) AS tenant_id, c_name AS name,
       CASE WHEN c_custkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
       CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '0 0 2 * * *' ELSE '' END AS cron_expression,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(10 + (c_custkey % 4) * 10 AS int) END AS sla_seconds,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 120 END AS grace_period_seconds,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(600 * (c_custkey % 11) AS int) END AS expected_runtime_seconds,
       CONCAT(lower(c_mktsegment), ',', CASE WHEN c_custkey % 2 = 0 THEN 'nightly' ELSE 'hourly' END) AS tags_csv
FROM customer""",
    "v_job_executions": """
SELECT e.event_id AS id, e.user_id AS job_id, CAST(c.c_nationkey AS string) AS tenant_id,
       CASE e.event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED'
            WHEN 'click' THEN 'RUNNING' ELSE 'TIMEOUT' END AS status,
       e.ts AS started_at,
       CASE WHEN e.event_type = 'click' THEN NULL
            ELSE e.ts + CAST(floor(e.value) AS bigint) * INTERVAL '1' SECOND END AS completed_at,
       CASE WHEN e.event_type = 'click' THEN NULL ELSE CAST(round(e.value * 1000) AS bigint) END AS duration_ms,
       CASE WHEN e.event_type = 'error' THEN 1 WHEN e.event_type = 'click' THEN NULL ELSE 0 END AS exit_code,
       CASE WHEN e.event_type = 'error' THEN CONCAT('failure k=', e.props) ELSE NULL END AS error_message
FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    "v_alert_history": """
SELECT id, job_id * 10 + 1 AS alert_rule_id, tenant_id, job_id,
       CASE CAST(id % 4 AS int) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE CAST(id % 3 AS int) WHEN 0 THEN 'TRIGGERED' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status,
       error_message AS message, started_at AS triggered_at
FROM v_job_executions WHERE status = 'FAILED'""",
    "v_job_queue": """
SELECT o.o_orderkey AS id, CAST(c.c_nationkey AS string) AS tenant_id, CONCAT('TYPE_', o.o_orderpriority) AS job_type,
       CAST(substring(o.o_orderpriority, 1, 1) AS int) AS priority,
       CASE WHEN o.o_orderstatus = 'F' THEN 'COMPLETED' WHEN o.o_orderstatus = 'P' THEN 'PROCESSING'
            WHEN o.o_orderkey % 13 = 0 THEN 'FAILED' WHEN o.o_orderkey % 17 = 0 THEN 'CANCELLED'
            ELSE 'PENDING' END AS status,
       CAST(o.o_orderkey % 5 AS int) AS attempt_count, 3 AS max_attempts, o.o_orderdate AS created_at,
       CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_orderdate + INTERVAL '1' DAY ELSE NULL END AS scheduled_at,
       CASE WHEN o.o_orderstatus = 'P' THEN o.o_orderdate + INTERVAL '5' MINUTE ELSE NULL END AS locked_until,
       CONCAT('w', CAST(o.o_orderkey % 4 AS string)) AS assigned_worker
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "v_notifications": """
SELECT e.event_id AS id, CAST(c.c_nationkey AS string) AS tenant_id,
       CASE CAST(e.event_id % 5 AS int) WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'SMS' WHEN 2 THEN 'SLACK'
            WHEN 3 THEN 'PUSH' ELSE 'WEBHOOK' END AS channel,
       CONCAT('user', CAST(e.user_id AS string), '@example.com') AS recipient,
       CASE WHEN e.event_type = 'error' THEN 'FAILED' WHEN e.event_type = 'signup' THEN 'PENDING'
            ELSE 'SENT' END AS status,
       CAST(1 + e.event_id % 10 AS int) AS priority, CAST(e.event_id % 5 AS int) AS retry_count, 3 AS max_retries,
       e.ts AS created_at
FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    "v_logs": """
SELECT doc_id AS id, CONCAT('t', CAST(doc_id % 5 AS string)) AS tenant_id, source AS service,
       CASE CAST(doc_id % 6 AS int) WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN'
            WHEN 4 THEN 'ERROR' ELSE 'FATAL' END AS level,
       text AS message, (SELECT min(ts) FROM events) + CAST(doc_id * 37 AS bigint) * INTERVAL '1' MINUTE AS ts
FROM documents""",
    "v_query_log": """
SELECT l_orderkey * 10 + l_linenumber AS query_id, l_suppkey % 4 AS database_id,
       CASE CAST(l_linenumber % 4 AS int)
            WHEN 0 THEN CONCAT('SELECT * FROM part WHERE p_size = ', CAST(CAST(l_quantity AS int) AS string), ' ORDER BY p_name')
            WHEN 1 THEN CONCAT('SELECT o_orderkey FROM orders  WHERE o_orderstatus = ''', l_returnflag, ''' OR o_custkey = ', CAST(l_partkey AS string))
            WHEN 2 THEN CONCAT('SELECT DISTINCT c_name FROM customer JOIN nation ON c_nationkey = ', CAST(l_suppkey AS string))
            ELSE CONCAT('SELECT p_name FROM part WHERE p_name LIKE ''%', lower(l_linestatus), '%'' LIMIT 10') END AS query,
       l_quantity AS calls, l_extendedprice / 10 AS mean_exec_time, l_extendedprice / 5 AS max_exec_time,
       CAST(l_partkey AS bigint) AS shared_blks_hit, CAST(l_suppkey AS bigint) AS shared_blks_read,
       l_shipdate AS captured_at
FROM lineitem""",
    # A request counter per (job, status) that resets every thousand events.
    "v_metric_samples": """
SELECT ts, 'requests_total' AS metric, CONCAT('job', CAST(user_id % 3 AS string)) AS job, event_type AS status,
       CONCAT('i', CAST(user_id AS string)) AS instance, CAST(event_id % 1000 AS double) AS value
FROM events""",
    # Gauges: heap in use per instance, up/down, and consumer lag.
    "v_gauge_samples": """
SELECT ts, 'heap_used' AS metric, CONCAT('job', CAST(user_id % 3 AS string)) AS job,
       CONCAT('i', CAST(user_id AS string)) AS instance, value * 1048576 AS value
FROM events
UNION ALL
SELECT ts, 'heap_max' AS metric, CONCAT('job', CAST(user_id % 3 AS string)) AS job,
       CONCAT('i', CAST(user_id AS string)) AS instance, CAST(64 AS double) * 1048576 AS value
FROM events
UNION ALL
SELECT ts, 'up' AS metric, CONCAT('job', CAST(user_id % 3 AS string)) AS job,
       CONCAT('i', CAST(user_id AS string)) AS instance,
       CASE WHEN event_type = 'error' THEN CAST(0 AS double) ELSE CAST(1 AS double) END AS value
FROM events
UNION ALL
SELECT ts, 'consumer_lag' AS metric, CONCAT('job', CAST(user_id % 3 AS string)) AS job,
       CONCAT('i', CAST(user_id AS string)) AS instance, CAST(event_id % 97 AS double) AS value
FROM events""",
    # Queue counters as scraped: one sample per item of the named transition.
    "v_queue_counters": """
SELECT created_at AS ts, 'enqueued' AS metric, tenant_id, id FROM v_job_queue
UNION ALL
SELECT created_at AS ts, 'completed' AS metric, tenant_id, id FROM v_job_queue WHERE status = 'COMPLETED'""",
    # Requests as an outside client posts them to the gateway.
    "v_ingest_requests": """
SELECT e.event_id AS request_id, CAST(c.c_nationkey AS string) AS tenant_id, c.c_name AS job_name,
       CASE e.event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'Started' WHEN 'error' THEN 'FAILED'
            WHEN 'click' THEN 'heartbeat' WHEN 'signup' THEN CASE WHEN e.event_id % 2 = 0 THEN NULL ELSE 'other' END
            END AS event_type,
       CASE WHEN e.event_type = 'error' THEN 1 ELSE NULL END AS exit_code, e.ts AS received_at
FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    # One alert rule per job and rule type.  Six branches instead of a product.
    "v_alert_rules": """
SELECT job_id * 10 + 1 AS rule_id, tenant_id, job_id, CONCAT('FAILURE_COUNT', '-', name) AS name, 'FAILURE_COUNT' AS rule_type,
       '{"threshold": 1}' AS condition_json, 'HIGH' AS severity, 'EMAIL,SLACK' AS channels_csv,
       CASE WHEN job_id % 9 = 0 THEN NULL ELSE 3600 END AS cooldown_seconds, (job_id + 1) % 8 <> 0 AS enabled FROM v_jobs
UNION ALL
SELECT job_id * 10 + 2, tenant_id, job_id, CONCAT('SLA_BREACH', '-', name), 'SLA_BREACH',
       '{"threshold": 30000, "unit": "ms"}', 'CRITICAL', 'SMS',
       CASE WHEN job_id % 9 = 0 THEN NULL ELSE 7200 END, (job_id + 2) % 8 <> 0 FROM v_jobs
UNION ALL
SELECT job_id * 10 + 3, tenant_id, job_id, CONCAT('CONSECUTIVE_FAILURES', '-', name), 'CONSECUTIVE_FAILURES',
       '{"threshold": 2}', 'MEDIUM', 'EMAIL',
       CASE WHEN job_id % 9 = 0 THEN NULL ELSE 10800 END, (job_id + 3) % 8 <> 0 FROM v_jobs
UNION ALL
SELECT job_id * 10 + 4, tenant_id, job_id, CONCAT('SUCCESS_RATE_DROP', '-', name), 'SUCCESS_RATE_DROP',
       '{"threshold": 35}', 'LOW', 'WEBHOOK',
       CASE WHEN job_id % 9 = 0 THEN NULL ELSE 14400 END, (job_id + 4) % 8 <> 0 FROM v_jobs
UNION ALL
SELECT job_id * 10 + 5, tenant_id, job_id, CONCAT('TIMEOUT', '-', name), 'TIMEOUT',
       CASE WHEN job_id % 2 = 0 THEN '{"threshold": 1}' ELSE '{"threshold": 1.5}' END, 'MEDIUM', 'PUSH,EMAIL',
       CASE WHEN job_id % 9 = 0 THEN NULL ELSE 18000 END, (job_id + 5) % 8 <> 0 FROM v_jobs
UNION ALL
SELECT job_id * 10 + 6, tenant_id, job_id, CONCAT('UNKNOWN_TYPE', '-', name), 'UNKNOWN_TYPE',
       '{"limit": 1}', 'LOW', 'EMAIL',
       CASE WHEN job_id % 9 = 0 THEN NULL ELSE 21600 END, (job_id + 6) % 8 <> 0 FROM v_jobs""",
    # Small dimensions.
    "v_databases": """
SELECT * FROM (VALUES (CAST(0 AS bigint), 't0', CAST(1000 AS bigint)), (CAST(1 AS bigint), 't0', CAST(1000 AS bigint)),
  (CAST(2 AS bigint), 't1', CAST(5000 AS bigint)), (CAST(3 AS bigint), 't1', CAST(1000 AS bigint)))
  AS d(database_id, tenant_id, threshold_ms)""",
    "v_index_catalogue": """
SELECT * FROM (VALUES ('t0', 'part', 'CREATE INDEX part_size ON part USING btree (P_SIZE, p_type)'),
  ('t1', 'orders', 'CREATE INDEX orders_cust ON orders USING btree (o_custkey)'))
  AS i(tenant_id, tablename, indexdef)""",
    "v_templates": """
SELECT CAST(n_nationkey AS string) AS tenant_id, n_nationkey * 10 + 1 AS template_id, 'EMAIL' AS channel, 'job-alert' AS name,
       'Notice {{status}} for {{recipient}}' AS subject,
       'Hello {{recipient}}, item {{id}} is {{status}} ({{missing}}), again {{id}}.' AS body
FROM nation WHERE n_regionkey <> 1
UNION ALL
SELECT CAST(n_nationkey AS string), n_nationkey * 10 + 2, 'SLACK', 'job-alert',
       CAST(NULL AS string), '{{id}}:{{status}}' FROM nation WHERE n_regionkey <> 2""",
    "v_retention_policies": """
SELECT * FROM (VALUES ('t0', 7, true), ('t1', 14, true), ('t2', 3, false), ('t3', 30, true))
  AS r(tenant_id, retention_days, enabled)""",
}

# The same tables on Spark without reading their source once per branch.
SPARK_VIEWS = {
    "v_gauge_samples": """
SELECT ts, g.metric, job, instance, g.value FROM (
  SELECT ts, CONCAT('job', CAST(user_id % 3 AS string)) AS job, CONCAT('i', CAST(user_id AS string)) AS instance,
         explode(array(
           named_struct('metric', 'heap_used', 'value', value * 1048576),
           named_struct('metric', 'heap_max', 'value', CAST(64 AS double) * 1048576),
           named_struct('metric', 'up', 'value', CASE WHEN event_type = 'error' THEN CAST(0 AS double) ELSE CAST(1 AS double) END),
           named_struct('metric', 'consumer_lag', 'value', CAST(event_id % 97 AS double)))) AS g
  FROM events)""",
    "v_queue_counters": """
SELECT created_at AS ts, metric, tenant_id, id FROM (
  SELECT *, explode(CASE WHEN status = 'COMPLETED' THEN array('enqueued', 'completed') ELSE array('enqueued') END) AS metric
  FROM v_job_queue)""",
    "v_alert_rules": """
SELECT job_id * 10 + r.n AS rule_id, tenant_id, job_id, CONCAT(r.rule_type, '-', name) AS name, r.rule_type,
       CASE WHEN r.n = 5 AND job_id % 2 = 0 THEN '{"threshold": 1}' ELSE r.condition_json END AS condition_json,
       r.severity, r.channels_csv, CASE WHEN job_id % 9 = 0 THEN NULL ELSE 3600 * r.n END AS cooldown_seconds,
       (job_id + r.n) % 8 <> 0 AS enabled
FROM (SELECT *, explode(array(
        named_struct('n', 1, 'rule_type', 'FAILURE_COUNT', 'condition_json', '{"threshold": 1}', 'severity', 'HIGH', 'channels_csv', 'EMAIL,SLACK'),
        named_struct('n', 2, 'rule_type', 'SLA_BREACH', 'condition_json', '{"threshold": 30000, "unit": "ms"}', 'severity', 'CRITICAL', 'channels_csv', 'SMS'),
        named_struct('n', 3, 'rule_type', 'CONSECUTIVE_FAILURES', 'condition_json', '{"threshold": 2}', 'severity', 'MEDIUM', 'channels_csv', 'EMAIL'),
        named_struct('n', 4, 'rule_type', 'SUCCESS_RATE_DROP', 'condition_json', '{"threshold": 35}', 'severity', 'LOW', 'channels_csv', 'WEBHOOK'),
        named_struct('n', 5, 'rule_type', 'TIMEOUT', 'condition_json', '{"threshold": 1.5}', 'severity', 'MEDIUM', 'channels_csv', 'PUSH,EMAIL'),
        named_struct('n', 6, 'rule_type', 'UNKNOWN_TYPE', 'condition_json', '{"limit": 1}', 'severity', 'LOW', 'channels_csv', 'EMAIL'))) AS r
      FROM v_jobs)""",
}

_NAME = re.compile(r"\bv_\w+\b")
_LOOKUP = re.compile(r"\bJOIN (\w+) \w+ ON\b")


def needed_views(sql: str, views: dict[str, str]) -> list[str]:
    """Views a text uses, dependencies first."""
    seen: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in views and name not in seen:
                visit(views[name])
                if name not in seen:
                    seen.append(name)

    visit(sql)
    return seen


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """Prefix a query with the views it uses as common table expressions."""
    ctes = ",\n".join(f"{name} AS ({views[name].strip()})" for name in needed_views(sql, views))
    body = sql.strip()
    own = re.match(r"WITH(\s+RECURSIVE)?\s+", body, re.IGNORECASE)
    if own:
        body = body[own.end() :]
        return f"WITH RECURSIVE {ctes},\n{body}" if ctes else f"WITH RECURSIVE {body}"
    return f"WITH {ctes}\n{body}" if ctes else body


class Domain:
    """Views as attributes: ``Domain(spark, dir).job_executions``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._views: dict[str, DataFrame] = {}
        self._outgrown: dict[str, bool] = {}

    def base(self, table: str) -> DataFrame:
        return self.spark.read.schema(BASE[table]).parquet(f"{self.directory}/{table}.parquet")

    def lookup(self, table: str) -> DataFrame:
        """A table that views join rows with.

        Spark's estimate goes by a few columns of compressed files; a table with more rows than the
        broadcast threshold holds is merged, not sent through the driver once for every view.
        """
        rows = self.base(table)
        if table not in self._outgrown:
            self._outgrown[table] = outgrows_broadcast(rows)
        return rows.hint("merge") if self._outgrown[table] else rows

    def sql(self, text: str) -> DataFrame:
        full = with_views(text, {**VIEWS, **SPARK_VIEWS})
        joined = _LOOKUP.findall(full)
        for table in BASE:
            if re.search(rf"\b{table}\b", full):
                (self.lookup(table) if table in joined else self.base(table)).createOrReplaceTempView(table)
        return self.spark.sql(full)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        if name not in self._views:
            self._views[name] = self.sql(f"SELECT * FROM v_{name}")
        return self._views[name]

    @property
    def tagged_jobs(self) -> DataFrame:
        return self.jobs.withColumn("tags", F.split("tags_csv", ","))
