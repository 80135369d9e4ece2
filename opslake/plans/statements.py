"""Query statistics."""

from __future__ import annotations

from opslake.operators import querylog
from opslake.plans.registry import query
from pyspark.sql import functions as F

NORMAL_SQL = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(query, '\s+', ' ', 'g'), '''[^'']*''', '?', 'g'), '\b\d+\b', '?', 'g')))"""

COLLECTED_SQL = f"""
SELECT * EXCLUDE (rn), substring(sha256({NORMAL_SQL}), 1, 32) AS fingerprint FROM (
  SELECT q.*, d.tenant_id, row_number() OVER (PARTITION BY q.database_id, q.captured_at ORDER BY q.mean_exec_time DESC, q.query_id, q.query) AS rn
  FROM v_query_log q JOIN v_databases d ON d.database_id = q.database_id
  WHERE q.mean_exec_time > d.threshold_ms AND q.query NOT LIKE '%pg_stat_statements%')
WHERE rn <= 100"""

MERGED_SQL = f"""
SELECT n.tenant_id, n.database_id, n.fingerprint, o.query AS query_text, n.mean_exec_time, n.max_exec_time, n.calls,
       n.shared_blks_hit, n.shared_blks_read, o.captured_at AS first_captured_at, n.captured_at AS last_captured_at
FROM (SELECT *, row_number() OVER (PARTITION BY database_id, fingerprint ORDER BY captured_at DESC, mean_exec_time ASC, query_id DESC) AS rn
      FROM ({COLLECTED_SQL})) n
JOIN (SELECT *, row_number() OVER (PARTITION BY database_id, fingerprint ORDER BY captured_at ASC, mean_exec_time DESC, query_id ASC) AS rn
      FROM ({COLLECTED_SQL})) o ON o.database_id = n.database_id AND o.fingerprint = n.fingerprint AND o.rn = 1
WHERE n.rn = 1"""

TABLES = r"regexp_extract_all({}, '(?i)(?:FROM|JOIN|UPDATE|INTO)\s+(\w+)', 1)"
COLUMNS = r"regexp_extract_all({}, '(?i)(?:WHERE|AND|OR|JOIN\s+\w+\s+ON)\s+(?:\w+\.)?([a-zA-Z_]\w*)\s*(?:=|<|>|IN|LIKE|BETWEEN)', 1)"


def collected(t):
    return querylog.collected_statements(t.query_log, t.databases)


def merged(t):
    return querylog.merge_slow_queries(collected(t))


@query(
    "top_slow_queries",
    """
SELECT *, CAST(row_number() OVER (PARTITION BY database_id ORDER BY mean_exec_time DESC, query_id, query) AS int) AS slow_rank
FROM v_query_log WHERE mean_exec_time > 1000 AND query NOT LIKE '%pg_stat_statements%' QUALIFY slow_rank <= 100""",
)
def _(t):
    return querylog.top_slow_queries(t.query_log)


@query("slow_query_merge", MERGED_SQL)
def _(t):
    return merged(t)


@query("slow_queries_by_tenant", f"SELECT * FROM ({MERGED_SQL}) WHERE tenant_id = 't1'")
def _(t):
    return querylog.slow_queries_by_tenant(merged(t), "t1")


@query(
    "query_fingerprints",
    f"""
SELECT normal_form, count(*) AS statements, CAST(sum(CAST(calls AS bigint)) AS bigint) AS calls, max(max_exec_time) AS max_exec_time,
       substring(sha256(normal_form), 1, 32) AS fingerprint
FROM (SELECT *, {NORMAL_SQL} AS normal_form FROM v_query_log) GROUP BY normal_form""",
)
def _(t):
    return querylog.query_fingerprints(t.query_log)


@query(
    "query_columns",
    f"""
SELECT table_name, column_name, count(*) AS uses
FROM (SELECT table_name, unnest(cols) AS column_name
      FROM (SELECT unnest({TABLES.format("query")}) AS table_name, {COLUMNS.format("query")} AS cols FROM v_query_log))
GROUP BY ALL""",
)
def _(t):
    return querylog.query_columns(t.query_log)


_RULES = {
    "select_star": "contains(u, 'SELECT *')",
    "not_in": "contains(u, 'NOT IN')",
    "leading_wildcard": "contains(u, 'LIKE ''%')",
    "or_conditions": "contains(u, 'OR') AND contains(u, 'WHERE')",
    "order_without_limit": "NOT contains(u, 'LIMIT') AND contains(u, 'ORDER BY')",
    "distinct": "contains(u, 'DISTINCT')",
    "having_without_group": "contains(u, 'HAVING') AND NOT contains(u, 'GROUP BY')",
}


def _advice_sql() -> str:
    return " UNION ALL ".join(
        "SELECT '{}' AS advice FROM (SELECT upper(query) AS u FROM v_query_log) WHERE {}".format(
            querylog.ADVICE[name].replace("'", "''"), test
        )
        for name, test in _RULES.items()
    )


@query("query_lint", f"SELECT advice, count(*) AS statements FROM ({_advice_sql()}) GROUP BY advice")
def _(t):
    return querylog.query_lint(t.query_log)


@query(
    "index_suggestions",
    f"""
WITH named AS (
  SELECT *, lower(concat(table_name, '.', column_name)) AS index_key FROM (
    SELECT *, unnest(cols) AS column_name, unnest(range(len(cols))) AS c FROM (
      SELECT tenant_id, fingerprint, mean_exec_time, calls, shared_blks_hit, shared_blks_read,
             unnest({TABLES.format("query_text")}) AS table_name, unnest(range(len({TABLES.format("query_text")}))) AS t,
             {COLUMNS.format("query_text")} AS cols
      FROM ({MERGED_SQL})))),
taken AS (
  SELECT tenant_id, lower(concat(tablename, '.', trim(unnest(string_split(regexp_extract(indexdef, '\\(([^)]+)\\)', 1), ','))))) AS index_key
  FROM v_index_catalogue),
first AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, index_key ORDER BY mean_exec_time DESC, fingerprint, t, c) AS rn FROM named)
SELECT tenant_id, index_key, table_name, column_name,
       concat('CREATE INDEX idx_', lower(table_name), '_', lower(column_name), ' ON ', table_name, ' (', column_name, ');') AS suggested_ddl,
       concat('Column ''', column_name, ''' used in WHERE/JOIN clause of slow query (mean=', printf('%.1f', round(mean_exec_time, 1)),
              'ms, calls=', CAST(CAST(calls AS bigint) AS string), ')') AS reason,
       CASE WHEN shared_blks_hit + shared_blks_read = 0 THEN 30.0
            ELSE least(90.0, 20.0 + CAST(shared_blks_read AS double) / (shared_blks_hit + shared_blks_read) * 70.0) END AS estimated_improvement_pct
FROM first WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM taken k WHERE k.tenant_id = first.tenant_id AND k.index_key = first.index_key)""",
)
def _(t):
    return querylog.index_suggestions(merged(t), t.index_catalogue)


@query(
    "slow_query_upsert",
    MERGED_SQL,
)
def _(t):
    """The merge split at a date: stored rows first, then a later batch over them."""
    rows = collected(t)
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    stored = querylog.merge_slow_queries(rows.filter(F.col("captured_at") < cut))
    batch = querylog.merge_slow_queries(rows.filter(F.col("captured_at") >= cut))
    return querylog.upsert_slow_queries(stored, batch)
