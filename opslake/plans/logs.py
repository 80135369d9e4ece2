"""Logs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from opslake.functions.scratch import scratch_path
from opslake.operators import logindex, logs, tables
from opslake.plans.registry import query
from opslake.sources.fixtures import AS_OF

# Patterns as registered; the last one does not compile and must be left out.
PATTERNS = [
    {"tenant_id": "t0", "name": "energy", "regex_pattern": r"e(n|r)ergy|http", "min_level": "DEBUG", "service_filter": None},
    {"tenant_id": "t0", "name": "with-word", "regex_pattern": r"\bwith\b", "min_level": "TRACE", "service_filter": "src5"},
    {"tenant_id": "t1", "name": "severe", "regex_pattern": r".*", "min_level": "ERROR", "service_filter": ""},
    {"tenant_id": "t2", "name": "digits", "regex_pattern": r"[0-9]{3,}", "min_level": "WARN", "service_filter": None},
    {"tenant_id": "t3", "name": "off", "regex_pattern": r".*", "min_level": "TRACE", "enabled": False},
    {"tenant_id": "t4", "name": "mail", "regex_pattern": r"[a-z]+@[a-z]+", "min_level": "INFO", "service_filter": None},
    {"tenant_id": "t4", "name": "broken", "regex_pattern": "[invalid(", "min_level": "TRACE", "service_filter": None},
]

RANK_SQL = "list_position(['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'], {})"

HITS_SQL = f"""
SELECT l.id, l.tenant_id, l.service, l.level, l.ts,
       CASE WHEN length(message) > 200 THEN concat(substring(message, 1, 200), '...') ELSE message END AS preview, p.pattern
FROM v_logs l JOIN (VALUES ('t0', 'energy', 'e(n|r)ergy|http', 'DEBUG', NULL), ('t0', 'with-word', '\\bwith\\b', 'TRACE', 'src5'),
     ('t1', 'severe', '.*', 'ERROR', ''), ('t2', 'digits', '[0-9]{{3,}}', 'WARN', NULL),
     ('t4', 'mail', '[a-z]+@[a-z]+', 'INFO', NULL)) AS p(tenant_id, pattern, regex_pattern, min_level, service_filter)
  ON p.tenant_id = l.tenant_id AND {RANK_SQL.format("l.level")} >= {RANK_SQL.format("p.min_level")}
 AND (coalesce(trim(p.service_filter), '') = '' OR p.service_filter = l.service)
 AND regexp_matches(l.message, concat('(?i)', p.regex_pattern))"""


@query(
    "log_partition_counts",
    "SELECT tenant_id, CAST(ts AS date) AS log_date, count(*) AS entries FROM v_logs GROUP BY ALL",
)
def _(t):
    return logs.log_partition_counts(t.logs, AS_OF)


@query("logs_min_level", "SELECT id, tenant_id, level, ts FROM v_logs WHERE level IN ('WARN', 'ERROR', 'FATAL')")
def _(t):
    return logs.logs_min_level(t.logs, "WARN").select("id", "tenant_id", "level", "ts")


SEARCH_SQL = """
SELECT id, tenant_id, service, level, message, ts FROM v_logs
WHERE tenant_id = 't1' AND level IN ('INFO', 'WARN', 'ERROR', 'FATAL') AND ts >= TIMESTAMP '2024-01-02 00:00:00'
  AND ts <= TIMESTAMP '2024-03-01 00:00:00'
  AND (list_has_any(regexp_split_to_array(lower(message), '[^a-zA-Z0-9_]'), ['with', 'http']))"""


def _searched(t):
    return logs.log_search(t.logs, "t1", "with HTTP", "INFO", datetime(2024, 1, 2), datetime(2024, 3, 1))


@query("log_search", SEARCH_SQL)
def _(t):
    return _searched(t).select("id", "tenant_id", "service", "level", "message", "ts")


@query("log_search_indexed", SEARCH_SQL)
def _(t):
    """The same rows from stored logs, of which only the files that the term index names are opened."""
    path = scratch_path(t.spark, "logs")
    logs.write_logs(logs.prepare_logs(t.logs, AS_OF), f"{path}/rows")
    logindex.extend_index(t.spark, f"{path}/rows", f"{path}/terms")
    found = logindex.indexed_search(
        t.spark, f"{path}/rows", f"{path}/terms", "t1", "with HTTP", "INFO", datetime(2024, 1, 2), datetime(2024, 3, 1)
    )
    return found.select("id", "tenant_id", "service", "level", "message", "ts")


@query(
    "log_search_words",
    r"""
SELECT id, tenant_id, message FROM v_logs
WHERE tenant_id = 't2' AND list_has_any(regexp_split_to_array(lower(message), '[^\p{L}\p{M}\p{N}_]'), ['für', 'él', 'été'])""",
)
def _(t):
    return logs.log_search(t.logs, "t2", "FÜR, él Été").select("id", "tenant_id", "message")


@query(
    "log_search_page",
    f"""
WITH s AS ({SEARCH_SQL})
SELECT id, ts, 0 AS page, (SELECT count(*) FROM s) AS total_elements, CAST(ceil((SELECT count(*) FROM s) / 10.0) AS int) AS total_pages,
       true AS first_page, 1 >= ceil((SELECT count(*) FROM s) / 10.0) AS last_page
FROM s ORDER BY ts DESC, id DESC LIMIT 10""",
)
def _(t):
    return tables.page_of(_searched(t).select("id", "ts"), [F.desc("ts"), F.desc("id")], 0, 10)


@query("log_pattern_hits", HITS_SQL)
def _(t):
    return logs.pattern_hits(t.logs, PATTERNS)


@query("log_pattern_hits_join", HITS_SQL)
def _(t):
    table = t.spark.createDataFrame(
        [
            (p["tenant_id"], p["name"], p["regex_pattern"], p["min_level"], p.get("service_filter"), p.get("enabled", True))
            for p in PATTERNS
        ],
        "tenant_id string, name string, regex_pattern string, min_level string, service_filter string, enabled boolean",
    )
    return logs.pattern_hits_join(t.logs, table)


@query(
    "log_alert_summary",
    f"SELECT (SELECT count(*) FROM v_logs) AS entries, count(DISTINCT id) AS entries_with_hit FROM ({HITS_SQL})",
)
def _(t):
    return logs.log_alert_summary(t.logs, PATTERNS)


@query("pattern_hit_counts", f"SELECT tenant_id, pattern, count(*) AS hits FROM ({HITS_SQL}) GROUP BY ALL")
def _(t):
    return logs.pattern_hit_counts(logs.pattern_hits(t.logs, PATTERNS))


@query(
    "retained_logs",
    """
SELECT l.tenant_id, CAST(l.ts AS date) AS log_date, count(*) AS entries FROM v_logs l
LEFT JOIN v_retention_policies p ON p.tenant_id = l.tenant_id AND p.enabled
WHERE CAST(l.ts AS date) >= DATE '2024-01-31' - coalesce(p.retention_days, 10) GROUP BY ALL""",
)
def _(t):
    kept = logs.retained_logs(t.logs, t.retention_policies, date(2024, 1, 31), 10)
    return kept.groupBy("tenant_id", F.to_date("ts").alias("log_date")).agg(F.count("*").alias("entries"))


@query(
    "upsert_policies",
    """
SELECT tenant_id, retention_days, enabled FROM v_retention_policies WHERE tenant_id NOT IN ('0', '1', 't1')
UNION ALL SELECT 't1', 90, true
UNION ALL SELECT CAST(n_nationkey AS string), 5, true FROM nation WHERE n_nationkey < 2""",
)
def _(t):
    own = t.sql("SELECT CAST(n_nationkey AS string) AS tenant_id, 5 AS retention_days, true AS enabled FROM nation WHERE n_nationkey < 2")
    changed = t.retention_policies.filter("tenant_id = 't1'").withColumn("retention_days", F.lit(90))
    twice = own.withColumn("retention_days", F.lit(6))
    rows = own.unionByName(changed).unionByName(twice)
    return tables.create_or_update(t.retention_policies, rows, ["tenant_id"], [F.asc("retention_days")])


@query(
    "expired_log_partitions",
    """
SELECT l.tenant_id, l.log_date, l.entries, p.retention_days, CAST(DATE '2024-01-31' - p.retention_days AS date) AS cutoff_date
FROM (SELECT tenant_id, CAST(ts AS date) AS log_date, count(*) AS entries FROM v_logs GROUP BY ALL) l
JOIN v_retention_policies p ON p.tenant_id = l.tenant_id AND p.enabled
WHERE l.log_date < DATE '2024-01-31' - p.retention_days""",
)
def _(t):
    return logs.expired_log_partitions(t.logs, t.retention_policies, date(2024, 1, 31))
