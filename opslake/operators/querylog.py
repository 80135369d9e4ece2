"""Query statistics: slow statements, fingerprints, lint and index advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions import text
from opslake.functions.scratch import materialize
from opslake.functions.skew import latest_per_key, salted_join, top_per_key

SLOW_MS = 1000.0
TOP_STATEMENTS = 100

# Advice per rule name.
ADVICE = {
    "select_star": "Replace SELECT * with explicit column names to reduce I/O and network transfer.",
    "not_in": "Consider replacing NOT IN with NOT EXISTS or LEFT JOIN ... IS NULL for better performance with NULLs.",
    "leading_wildcard": "Leading wildcard in LIKE prevents index usage. Consider full-text search or reverse index for prefix matching.",
    "or_conditions": "Multiple OR conditions may prevent index usage. Consider UNION ALL of separate queries or use IN clause.",
    "order_without_limit": "Add LIMIT clause when using ORDER BY to avoid sorting the entire result set.",
    "distinct": "DISTINCT can be expensive. Verify it's necessary — it may indicate a JOIN issue.",
    "having_without_group": "HAVING without GROUP BY is unusual. Verify query logic.",
}


def _slow(statements: DataFrame, threshold: Column) -> DataFrame:
    return statements.filter(
        (F.col("mean_exec_time") > threshold) & ~F.col("query").contains("pg_stat_statements")
    )


def top_slow_queries(statements: DataFrame, threshold_ms: float = SLOW_MS, k: int = TOP_STATEMENTS) -> DataFrame:
    """The slowest statements of each database."""
    order = [F.desc("mean_exec_time"), F.asc("query_id"), F.asc("query")]
    return top_per_key(_slow(statements, F.lit(threshold_ms)), ["database_id"], order, k, "slow_rank")


def collected_statements(statements: DataFrame, databases: DataFrame, k: int = TOP_STATEMENTS) -> DataFrame:
    """What each collection run keeps: the top slow statements per database and capture time."""
    watched = databases.select("database_id", "tenant_id", F.col("threshold_ms").cast("double").alias("_threshold"))
    joined = salted_join(statements, watched, ["database_id"], "query_id")
    slow = _slow(joined, F.col("_threshold")).drop("_threshold")
    order = [F.desc("mean_exec_time"), F.asc("query_id"), F.asc("query")]
    return top_per_key(slow, ["database_id", "captured_at"], order, k).withColumn(
        "fingerprint", text.query_fingerprint(F.col("query"))
    )


_STATS = ("mean_exec_time", "max_exec_time", "calls", "shared_blks_hit", "shared_blks_read")


def merge_slow_queries(collected: DataFrame) -> DataFrame:
    """One row per database and fingerprint: first text, latest statistics.

    Within one collection the statement read last (lowest mean) wins.
    """
    keys = ["tenant_id", "database_id", "fingerprint"]
    # Both prune to a row per key before their shuffle; the statements are ranked and fingerprinted once.
    stored = materialize(collected.select(*keys, "query_id", "query", "captured_at", *_STATS), "statements")
    first = latest_per_key(stored, keys, [F.asc("captured_at"), F.desc("mean_exec_time"), F.asc("query_id")])
    last = latest_per_key(stored, keys, [F.desc("captured_at"), F.asc("mean_exec_time"), F.desc("query_id")])
    named = first.select(*keys, F.col("query").alias("query_text"), F.col("captured_at").alias("first_captured_at"))
    newest = last.select(*keys, *_STATS, F.col("captured_at").alias("last_captured_at"))
    return named.join(newest, keys).select(*keys, "query_text", *_STATS, "first_captured_at", "last_captured_at")


def upsert_slow_queries(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows with a newly merged batch laid over them."""
    stamped = base.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    keep = [c for c in base.columns if c not in ("tenant_id", "database_id", "fingerprint", "query_text")]
    return (
        stamped.groupBy("tenant_id", "database_id", "fingerprint")
        .agg(
            F.min_by("query_text", "_new").alias("query_text"),
            F.max_by(F.struct(*[c for c in keep if c != "first_captured_at"]), "_new").alias("_latest"),
            F.min("first_captured_at").alias("first_captured_at"),
        )
        .select(
            "tenant_id",
            "database_id",
            "fingerprint",
            "query_text",
            *(F.col("first_captured_at") if c == "first_captured_at" else F.col(f"_latest.{c}").alias(c) for c in keep),
        )
    )


def _per_text(statements: DataFrame) -> DataFrame:
    """One row per distinct text: statistics repeat the same statements, so the text work is done once each."""
    return statements.groupBy("query").agg(
        F.count("*").alias("statements"),
        F.sum(F.col("calls").cast("bigint")).alias("calls"),
        F.max("max_exec_time").alias("max_exec_time"),
    )


def query_fingerprints(statements: DataFrame) -> DataFrame:
    """Calls and longest time per statement shape."""
    return (
        _per_text(statements)
        .withColumn("normal_form", text.query_normal_form(F.col("query")))
        .groupBy("normal_form")
        .agg(
            F.sum("statements").alias("statements"),
            F.sum("calls").alias("calls"),
            F.max("max_exec_time").alias("max_exec_time"),
        )
        .withColumn("fingerprint", F.substring(F.sha2("normal_form", 256), 1, 32))
    )


def query_columns(statements: DataFrame) -> DataFrame:
    """How many statements name each table with each predicate column."""
    return (
        _per_text(statements)
        .select(
            "statements",
            F.explode(text.query_tables(F.col("query"))).alias("table_name"),
            text.query_predicate_columns(F.col("query")).alias("_columns"),
        )
        .select("statements", "table_name", F.explode("_columns").alias("column_name"))
        .groupBy("table_name", "column_name")
        .agg(F.sum("statements").alias("uses"))
    )


def lint_flags(query: Column) -> dict[str, Column]:
    """One test per rule.  Plain substring tests, so ORDER also counts as OR."""
    upper = F.upper(query)
    return {
        "select_star": upper.contains("SELECT *"),
        "not_in": upper.contains("NOT IN"),
        "leading_wildcard": upper.contains("LIKE '%"),
        "or_conditions": upper.contains("OR") & upper.contains("WHERE"),
        "order_without_limit": ~upper.contains("LIMIT") & upper.contains("ORDER BY"),
        "distinct": upper.contains("DISTINCT"),
        "having_without_group": upper.contains("HAVING") & ~upper.contains("GROUP BY"),
    }


def suggest_rewrites(query: Column) -> Column:
    """Advice texts that apply to a statement."""
    return F.array_compact(F.array(*(F.when(test, F.lit(ADVICE[name])) for name, test in lint_flags(query).items())))


def query_lint(statements: DataFrame) -> DataFrame:
    """How often each advice applies."""
    return (
        _per_text(statements)
        .select("statements", F.explode(suggest_rewrites(F.col("query"))).alias("advice"))
        .groupBy("advice")
        .agg(F.sum("statements").alias("statements"))
    )


def estimated_improvement(hit: Column, read: Column) -> Column:
    total = hit + read
    share = F.when(total == 0, None).otherwise(read.cast("double") / total)
    return F.when(total == 0, F.lit(30.0)).otherwise(F.least(F.lit(90.0), F.lit(20.0) + share * F.lit(70.0)))


def indexed_columns(catalogue: DataFrame) -> DataFrame:
    """Lower-case table.column keys that already have an index."""
    inside = F.regexp_extract("indexdef", text.INDEX_COLUMNS_PATTERN, 1)
    return catalogue.select(
        "tenant_id",
        F.explode(F.split(inside, ",")).alias("_column"),
        "tablename",
    ).select("tenant_id", F.lower(F.concat("tablename", F.lit("."), F.trim("_column"))).alias("index_key")).distinct()


def index_suggestions(slow_queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One suggested index per tenant and unindexed table.column, argued from the slowest query using it."""
    named = (
        slow_queries.select(
            "tenant_id",
            "fingerprint",
            "mean_exec_time",
            "calls",
            "shared_blks_hit",
            "shared_blks_read",
            F.posexplode(text.query_tables(F.col("query_text"))).alias("_t", "table_name"),
            text.query_predicate_columns(F.col("query_text")).alias("_columns"),
        )
        .select("*", F.posexplode("_columns").alias("_c", "column_name"))
        .withColumn("index_key", F.lower(F.concat("table_name", F.lit("."), "column_name")))
    )
    order = [F.desc("mean_exec_time"), F.asc("fingerprint"), F.asc("_t"), F.asc("_c")]
    first = latest_per_key(named.drop("_columns"), ["tenant_id", "index_key"], order)
    fresh = first.join(indexed_columns(catalogue), ["tenant_id", "index_key"], "left_anti")
    table, column = F.col("table_name"), F.col("column_name")
    return fresh.select(
        "tenant_id",
        "index_key",
        table.alias("table_name"),
        column.alias("column_name"),
        F.format_string("CREATE INDEX idx_%s_%s ON %s (%s);", F.lower(table), F.lower(column), table, column).alias(
            "suggested_ddl"
        ),
        F.format_string(
            "Column '%s' used in WHERE/JOIN clause of slow query (mean=%.1fms, calls=%d)",
            column,
            F.col("mean_exec_time"),
            F.col("calls").cast("bigint"),
        ).alias("reason"),
        estimated_improvement(F.col("shared_blks_hit"), F.col("shared_blks_read")).alias(
            "estimated_improvement_pct"
        ),
    )


def slow_queries_by_tenant(slow_queries: DataFrame, tenant_id: str) -> DataFrame:
    return slow_queries.filter(F.col("tenant_id") == tenant_id).orderBy(
        F.desc("mean_exec_time"), F.asc("database_id"), F.asc("fingerprint")
    )
