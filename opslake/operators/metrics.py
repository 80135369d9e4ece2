"""Time-series queries over metric samples: rates, ratios, quantiles, held thresholds, alert grouping.

A rate is the sum of positive changes in the range divided by its seconds; a
change belongs to the later of its two samples and a falling counter has been
reset, so the new value is the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.greedy import keep_spaced
from opslake.functions.skew import HOT_ROWS, Running, hot_keys, latest_per_key, scan


def counter_increases(samples: DataFrame, series: list[str]) -> DataFrame:
    """Change of each sample against the one before it in its series."""
    points = samples.groupBy(*series, "ts").agg(F.max("value").alias("value"))
    hot = hot_keys(samples, series, HOT_ROWS)  # points are no more than samples
    paired = scan(points, series, ["ts"], HOT_ROWS, hot, previous=Running("last", F.col("value"), exclusive=True))
    change = F.col("value") - F.col("previous")
    return paired.filter("previous is not null").select(
        *series, "ts", F.when(change < 0, F.col("value")).otherwise(change).alias("increase")
    )


def metric_rate(
    samples: DataFrame, series: list[str], by: list[str], range_seconds: int = 300, step_seconds: int = 300
) -> DataFrame:
    """Per-second rate by labels at every step time, over the range ending there.

    Changes are summed per step before they are copied to the few steps whose
    range covers them.
    """
    if range_seconds % step_seconds:
        raise ValueError("the range must be a whole number of steps")
    # A change at t counts for evaluation times T with T - range < t <= T.
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = step_seconds * 1_000_000
    first = F.ceil(micros / F.lit(step)).cast("bigint")
    per_step = (
        counter_increases(samples, series)
        .groupBy(*by, first.alias("_step"))
        .agg(F.sum("increase").alias("increase"))
    )
    copies = F.sequence(F.lit(0), F.lit(range_seconds // step_seconds - 1))
    return (
        per_step.withColumn("_copy", F.explode(copies))
        .groupBy(*by, (F.col("_step") + F.col("_copy")).alias("_at"))
        .agg(F.sum("increase").alias("increase"))
        .select(
            *by,
            F.timestamp_micros(F.col("_at") * step).cast("timestamp_ntz").alias("at"),
            (F.col("increase") / F.lit(float(range_seconds))).alias("rate"),
        )
    )


def error_ratio(
    samples: DataFrame,
    series: list[str],
    by: list[str],
    failed: Column,
    threshold: float = 0.05,
    range_seconds: int = 300,
) -> DataFrame:
    """Share of failed requests per label and step, flagged above the threshold.

    Both rates come from one pass: the label ``failed`` is carried through the
    step sums and split at the end.
    """
    marked = samples.withColumn("_failed", failed)
    rates = metric_rate(marked, [*series, "_failed"], [*by, "_failed"], range_seconds, range_seconds)
    return (
        rates.groupBy(*by, "at")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_failed"), F.col("rate"))), F.lit(0.0)).alias("error_rate"),
            F.sum("rate").alias("total_rate"),
        )
        .withColumn("ratio", F.try_divide("error_rate", "total_rate"))
        .withColumn("breached", F.coalesce(F.col("ratio") > threshold, F.lit(False)))
    )


def cumulative_buckets(observations: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Histogram as scraped: per label and upper bound, how many observations lie at or below it."""
    counts = observations.groupBy(*by).agg(
        *(F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)), F.count("*").alias("_all")
    )
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("count")))
    return counts.select(*by, F.explode(F.array(*pairs)).alias("_p")).select(*by, "_p.le", "_p.count")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float = 0.95) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket; the open bucket gives its lower bound."""
    ordered = Window.partitionBy(*by).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*by))
    ranked = (
        buckets.withColumn("_total", total)
        .withColumn("_below", F.coalesce(F.lag("count").over(ordered), F.lit(0)))
        .withColumn("_from", F.coalesce(F.lag("le").over(ordered), F.lit(0.0)))
    )
    rank = F.lit(q) * F.col("_total")
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * (rank - F.col("_below")) / (
        F.col("count") - F.col("_below")
    )
    holds = (F.col("count") >= rank) & (F.col("_below") < rank)
    value = F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(inside)
    return ranked.filter(holds).groupBy(*by).agg(F.min(value).alias("quantile"))


def rate_quantile(
    samples: DataFrame, series: list[str], by: list[str], q: float = 0.95, range_seconds: int = 300, step_seconds: int | None = None
) -> DataFrame:
    """Quantile at every step from the rates of cumulative bucket counters (label ``le``) over the range ending there.

    A step in which a label's buckets did not grow has no quantile.
    """
    rates = metric_rate(samples, [*series, "le"], [*by, "le"], range_seconds, step_seconds or range_seconds)
    return histogram_quantile(rates.withColumnRenamed("rate", "count"), [*by, "at"], q)


def latest_samples(samples: DataFrame, series: list[str]) -> DataFrame:
    """Newest value of each series; of several at one time the largest."""
    rows = samples.select(*series, "value", "ts")
    return latest_per_key(rows, series, [F.desc("ts"), F.desc("value")])


def _newest_of(samples: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """The newest value of each metric as a column ``_0``, ``_1``, ..., one row per key; null where there is none."""
    latest = latest_samples(samples, [*keys, "metric"])
    picked = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"_{i}") for i, m in enumerate(metrics)]
    return latest.groupBy(*keys).agg(*picked)


def services_up(samples: DataFrame, by: list[str], series: list[str]) -> DataFrame:
    latest = latest_samples(samples.filter(F.col("metric") == "up"), series)
    return latest.groupBy(*by).agg(
        F.count_if(F.col("value") == 1).alias("up"), F.count_if(F.col("value") == 0).alias("down")
    )


def gauge_ratio(samples: DataFrame, used: str, limit: str, series: list[str], threshold: float = 0.85) -> DataFrame:
    """Newest used and limit gauge per series in MiB, their ratio and whether it is too high."""
    newest = _newest_of(samples.filter(F.col("metric").isin(used, limit)), [used, limit], series)
    mib = F.lit(1048576.0)
    return newest.select(
        *series, (F.col("_0") / mib).alias("used_mib"), (F.col("_1") / mib).alias("limit_mib"), F.try_divide("_0", "_1").alias("ratio")
    ).withColumn("breached", F.coalesce(F.col("ratio") > threshold, F.lit(False)))


def queue_backlog(counters: DataFrame, by: list[str], threshold: float = 100) -> DataFrame:
    """Enqueued minus completed from the newest counters, flagged above the threshold."""
    zero = F.lit(0.0)
    newest = _newest_of(counters, ["enqueued", "completed"], by)
    return (
        newest.select(*by, F.coalesce("_0", zero).alias("enqueued"), F.coalesce("_1", zero).alias("completed"))
        .withColumn("backlog", F.col("enqueued") - F.col("completed"))
        .withColumn("breached", F.col("backlog") > threshold)
    )


def gauge_sum(samples: DataFrame, metric: str, by: list[str], series: list[str]) -> DataFrame:
    latest = latest_samples(samples.filter(F.col("metric") == metric), series)
    return latest.groupBy(*by).agg(F.sum("value").alias("value"))


def sustained_breaches(
    samples: DataFrame, series: list[str], breached: Column, hold_seconds: int | str
) -> DataFrame:
    """Stretches of breached samples lasting at least the hold time (seconds, or a column of the series).

    The running count of healthy samples numbers the stretches; every breached
    sample between two healthy ones has the same number.
    """
    labels = [*series, hold_seconds] if isinstance(hold_seconds, str) else series
    points = (
        samples.withColumn("_bad", F.coalesce(breached, F.lit(False)))
        .groupBy(*labels, "ts")
        .agg(F.max("_bad").alias("_bad"))
    )
    # Points are fewer than samples, so counting the samples' labels finds all large series without the aggregate.
    hot = hot_keys(samples, labels, HOT_ROWS)
    numbered = scan(points, labels, ["ts"], HOT_ROWS, hot, _island=Running("sum", F.when(F.col("_bad"), 0).otherwise(1)))
    seconds = F.col(hold_seconds) if isinstance(hold_seconds, str) else F.lit(hold_seconds)
    return (
        numbered.filter("_bad")
        .groupBy(*labels, "_island")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("samples"))
        .filter(F.col("ended_at") >= F.col("started_at") + F.make_dt_interval(secs=seconds))
        .select(*series, "started_at", "ended_at", "samples")
    )


# Comparison, threshold, hold seconds and severity of each metric alert.
METRIC_ALERTS = {
    "ServiceDown": ("=", 0.0, 60, "critical"),
    "HighErrorRate": (">", 0.05, 120, "warning"),
    "HighMemoryUsage": (">", 0.85, 300, "warning"),
    "HighGCPause": (">", 0.5, 180, "warning"),
    "QueueBacklog": (">", 100.0, 300, "warning"),
    "SlowIngestion": (">", 2.0, 180, "warning"),
    "HighAlertRate": (">", 10.0, 300, "info"),
}


def metric_alerts(
    values: DataFrame, labels: list[str], alerts: dict[str, tuple[str, float, int, str]] | None = None
) -> DataFrame:
    """All metric alerts in one pass.  ``values`` holds alertname, labels, ts and the value the alert looks at."""
    alerts = alerts or METRIC_ALERTS
    name = F.col("alertname")
    breached, hold, severity = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("string")
    for alert, (compare, threshold, seconds, level) in alerts.items():
        beyond = F.col("value") == threshold if compare == "=" else F.col("value") > threshold
        breached = F.when(name == alert, beyond).otherwise(breached)
        hold = F.when(name == alert, F.lit(seconds)).otherwise(hold)
        severity = F.when(name == alert, F.lit(level)).otherwise(severity)
    known = values.filter(name.isin(*alerts)).withColumn("_hold", hold)
    held = sustained_breaches(known, ["alertname", *labels], breached, "_hold")
    return held.withColumn("severity", severity)


def alert_groups(alerts: DataFrame, by: list[str], ts: str, tie: str, gap_seconds: int = 10) -> DataFrame:
    """Alerts of one group key closer together than the gap, as one notification."""
    order = [ts, tie]
    rows = alerts.select(*by, *order)
    hot = hot_keys(rows, by, HOT_ROWS)
    paired = scan(rows, by, order, hot=hot, _previous=Running("last", F.col(ts), exclusive=True))
    gap = F.expr(f"interval {int(gap_seconds)} seconds")
    opens = F.col("_previous").isNull() | (F.col(ts) >= F.col("_previous") + gap)
    marked = paired.withColumn("_opens", F.when(opens, 1).otherwise(0))
    numbered = scan(marked, by, order, hot=hot, _group=Running("sum", F.col("_opens")))
    return (
        numbered.groupBy(*by, "_group")
        .agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("alerts"))
        .drop("_group")
    )


def repeat_suppressed(alerts: DataFrame, key: str, ts: str, tie: str, repeat_seconds: int = 3600) -> DataFrame:
    """Alerts left after repeats within the interval are dropped."""
    spaced = alerts.withColumn("_repeat", F.lit(repeat_seconds))
    return keep_spaced(spaced, key, ts, tie, "_repeat").drop("_repeat")


def inhibited_alerts(
    alerts: DataFrame, equal: list[str], ts: str, tie: str, active_seconds: int, source: str, target: str
) -> DataFrame:
    """Target-severity alerts raised while a source-severity alert with equal labels is active.

    An alert is active from its time for ``active_seconds``.  The newest source
    alert at or before each target decides, so this is a running last value and
    no pairs are formed.
    """
    rows = alerts.filter(F.col("severity").isin(source, target)).select(*equal, ts, tie, "severity")
    # At one instant the source comes first.
    ranked = rows.withColumn("_late", F.when(F.col("severity") == source, 0).otherwise(1))
    seen = scan(
        ranked, equal, [ts, "_late", tie], _source_at=Running("last", F.when(F.col("severity") == source, F.col(ts)))
    )
    active = F.col("_source_at") + F.expr(f"interval {int(active_seconds)} seconds") > F.col(ts)
    return seen.filter((F.col("severity") == target) & active).drop("_late", "_source_at")
