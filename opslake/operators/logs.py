"""Logs: ingest, search, alert patterns, retention."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions.folders import append_folders
from opslake.functions.levels import at_least, level_rank
from opslake.functions.skew import salted_join
from opslake.functions.text import LOG_PREVIEW, is_blank, truncated


def prepare_logs(logs: DataFrame, received_at: datetime) -> DataFrame:
    """Fill missing ids and times, and add the partition date."""
    filled = logs.withColumn("ts", F.coalesce("ts", F.lit(received_at).cast(logs.schema["ts"].dataType)))
    identity = F.sha2(F.to_json(F.struct(*filled.columns)), 256)
    id_type = logs.schema["id"].dataType
    if id_type.simpleString() == "string":
        filled = filled.withColumn("id", F.coalesce("id", identity))
    return filled.withColumn("log_date", F.to_date("ts"))


def write_logs(logs: DataFrame, path: str) -> None:
    """Append prepared logs by tenant and day; a busy tenant-day is spread over as many files as its size asks for."""
    append_folders(logs, path, ["tenant_id", "log_date"], "parquet")


def read_logs(
    spark: SparkSession, path: str, tenant_id: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Stored logs of a tenant; the tenant and the days of the time range prune partitions."""
    rows = spark.read.parquet(path).filter(F.col("tenant_id") == tenant_id)
    if start is not None:
        rows = rows.filter(F.col("log_date") >= F.lit(start.date()))
    if end is not None:
        rows = rows.filter(F.col("log_date") <= F.lit(end.date()))
    return rows


def log_partition_counts(logs: DataFrame, received_at: datetime) -> DataFrame:
    """Rows each tenant-day partition receives."""
    return prepare_logs(logs, received_at).groupBy("tenant_id", "log_date").agg(F.count("*").alias("entries"))


def has_any_token(message: Column, query: str) -> Column:
    """Whether the message holds at least one word of the query, ignoring case.

    Words are runs of letters, digits and underscores of any script; a query without any matches nothing.
    """
    tokens = sorted({t for t in re.split(r"\W+", query.lower()) if t})
    if not tokens:
        return F.lit(False)
    return F.lower(message).rlike(r"(?U)(^|\W)(" + "|".join(re.escape(t) for t in tokens) + r")(\W|$)")


def log_search(
    logs: DataFrame,
    tenant_id: str,
    query: str | None = None,
    min_level: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Matching entries of a tenant; cheap filters first, then the text."""
    rows = logs.filter(F.col("tenant_id") == tenant_id)
    if min_level is not None:
        rows = rows.filter(at_least(F.col("level"), min_level))
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast(logs.schema["ts"].dataType))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast(logs.schema["ts"].dataType))
    if query is not None and query.strip():
        rows = rows.filter(has_any_token(F.col("message"), query))
    return rows


def logs_min_level(logs: DataFrame, min_level: str) -> DataFrame:
    return logs.filter(at_least(F.col("level"), min_level))


def _compiles(spark: SparkSession, pattern: str | None) -> bool:
    """Whether the engine's own regular expressions take the pattern."""
    if pattern is None:
        return False
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
        return True
    except IllegalArgumentException:
        return False


def split_patterns(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable and rejected pattern rows; a pattern that does not compile would stop the job.

    The distinct patterns pass the driver one by one, and only those that do not compile stay there.
    """
    spark = patterns.sparkSession
    distinct = patterns.select("regex_pattern").distinct().toLocalIterator()
    broken = [r.regex_pattern for r in distinct if not _compiles(spark, r.regex_pattern)]
    bad = F.col("regex_pattern").isNull() | F.coalesce(F.col("regex_pattern").isin(*broken), F.lit(False))
    return patterns.filter(~bad), patterns.filter(bad)


def valid_patterns(patterns: list[dict]) -> list[dict]:
    """The same guard for patterns given as plain records."""
    spark = SparkSession.active()
    return [p for p in patterns if _compiles(spark, p.get("regex_pattern"))]


def _pattern_tests(patterns: list[dict]) -> list[tuple[str, Column]]:
    """Name and match test of each usable enabled pattern."""
    tests = []
    for p in valid_patterns(patterns):
        if not p.get("enabled", True):
            continue
        test = (F.col("tenant_id") == p["tenant_id"]) & at_least(F.col("level"), p["min_level"])
        if (p.get("service_filter") or "").strip():
            test = test & (F.col("service") == p["service_filter"])
        tests.append((p["name"], test & F.coalesce("message", F.lit("")).rlike("(?i)" + p["regex_pattern"])))
    return tests


def pattern_hits(logs: DataFrame, patterns: list[dict]) -> DataFrame:
    """Log entries with each enabled pattern they match.

    Patterns are few and known when the job is planned, so each becomes a
    literal test in one projection: compiled once, no join, no shuffle.
    """
    names = [F.when(test, F.lit(name)) for name, test in _pattern_tests(patterns)]
    matched = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return logs.select(
        "id",
        "tenant_id",
        "service",
        "level",
        "ts",
        truncated(F.col("message"), LOG_PREVIEW).alias("preview"),
        F.explode(matched).alias("pattern"),
    )


def needed_literal(pattern: Column) -> Column:
    """The longest stretch of plain characters, in lower case, that every match holds; empty where the pattern has
    alternatives, groups, classes, escapes or repeats that may be left out."""
    pieces = F.split(pattern, r"[.^$+]", -1)
    longest = F.reduce(
        pieces, F.lit(""), lambda best, piece: F.when(F.char_length(piece) > F.char_length(best), piece).otherwise(best)
    )
    return F.lower(F.when(pattern.rlike(r"[|()\[\]{}?*\\]"), F.lit("")).otherwise(longest))


def pattern_hits_join(logs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same for a pattern table too large for one expression: tenant join, then level, service and text.

    Pairs whose message lacks what the pattern needs go within the join.  The
    others are put in the order of their patterns, so a task compiles each
    pattern that it meets once: ``regexp_instr`` keeps its last pattern, where
    ``rlike`` with a column compiles one for every row.
    """
    usable, _ = split_patterns(patterns.filter("enabled"))
    dim = usable.select(
        "tenant_id",
        F.col("name").alias("pattern"),
        F.concat(F.lit("(?i)"), "regex_pattern").alias("_regex"),
        needed_literal(F.col("regex_pattern")).alias("_needed"),
        level_rank(F.col("min_level")).alias("_min_rank"),
        "service_filter",
    )
    joined = salted_join(logs, dim, ["tenant_id"], "id")
    any_service = is_blank(F.col("service_filter"))
    text = F.coalesce("message", F.lit(""))
    plausible = joined.filter(
        (level_rank(F.col("level")) >= F.col("_min_rank"))
        & (any_service | (F.col("service_filter") == F.col("service")))
        & F.contains(F.lower(text), F.col("_needed"))
    ).select("id", "tenant_id", "service", "level", "ts", "message", "pattern", "_regex")
    hits = plausible.sortWithinPartitions("_regex").filter(F.regexp_instr(text, F.col("_regex")) > 0)
    return hits.select(
        "id", "tenant_id", "service", "level", "ts", truncated(F.col("message"), LOG_PREVIEW).alias("preview"), "pattern"
    )


def log_alert_summary(logs: DataFrame, patterns: list[dict]) -> DataFrame:
    """Entries and entries with at least one hit, in one pass over the logs."""
    hit = F.lit(False)
    for _, test in _pattern_tests(patterns):
        hit = hit | test
    return logs.agg(F.count("*").alias("entries"), F.count_if(hit).alias("entries_with_hit"))


def pattern_hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("tenant_id", "pattern").agg(F.count("*").alias("hits"))


def expired_log_partitions(logs: DataFrame, policies: DataFrame, as_of: date, default_days: int | None = None) -> DataFrame:
    """Tenant-day partitions older than the tenant's enabled policy."""
    partitions = (
        logs.select("tenant_id", F.to_date("ts").alias("log_date"))
        .groupBy("tenant_id", "log_date")
        .agg(F.count("*").alias("entries"))
    )
    enabled = policies.filter("enabled").select("tenant_id", "retention_days")
    joined = partitions.join(enabled, "tenant_id", "left")
    days = F.col("retention_days") if default_days is None else F.coalesce("retention_days", F.lit(default_days))
    return joined.withColumn("cutoff_date", F.date_sub(F.lit(as_of), days)).filter(
        F.col("log_date") < F.col("cutoff_date")
    )


def retained_logs(logs: DataFrame, policies: DataFrame, as_of: date, default_days: int | None = None) -> DataFrame:
    """The rows that retention keeps: of tenants without an enabled policy, or a default, all of them."""
    enabled = policies.filter("enabled").groupBy("tenant_id").agg(F.max("retention_days").alias("_days"))
    days = F.col("_days") if default_days is None else F.coalesce("_days", F.lit(default_days))
    kept = F.to_date("ts") >= F.date_sub(F.lit(as_of), days)
    return salted_join(logs, enabled, ["tenant_id"], "id", "left").filter(F.coalesce(kept, F.lit(True))).drop("_days")


def drop_partitions(spark: SparkSession, path: str, expired: DataFrame) -> int:
    """Remove the folders of expired tenant-days from a log table; returns how many there were."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    removed = 0
    for row in expired.select("tenant_id", "log_date").toLocalIterator():
        folder = hadoop.Path(root, f"tenant_id={escape(row.tenant_id)}/log_date={row.log_date}")
        removed += bool(files.delete(folder, True))
    return removed
