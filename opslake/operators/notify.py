"""Notifications: templates, limits, payloads, delivery outcomes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions import text
from opslake.functions.greedy import keep_within_limit
from opslake.functions.skew import salted_join, trailing_count

# Sends per hour; other channels share the first limit.
HOURLY_LIMITS = {"EMAIL": 100, "SMS": 50, "SLACK": 200, "PUSH": 300}
FALLBACK_CHANNEL = "EMAIL"
DISPATCHABLE = ("EMAIL", "SMS", "SLACK", "PUSH", "WEBHOOK")


def channel_limit(channel: Column, limits: dict[str, int] | None = None) -> Column:
    limits = limits or HOURLY_LIMITS
    table = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    return F.coalesce(F.element_at(table, F.upper(channel)), F.lit(limits[FALLBACK_CHANNEL])).cast("bigint")


def render_notifications(
    requests: DataFrame, templates: DataFrame, variables: Column, spread: str = "id"
) -> DataFrame:
    """Subject and body from the tenant's template, or the request's own text.

    ``requests`` carries tenant_id, template_id, subject and body.
    """
    known = templates.select(
        "tenant_id", "template_id", F.col("subject").alias("_subject"), F.col("body").alias("_body")
    )
    joined = salted_join(requests.withColumn("_vars", variables), known, ["tenant_id", "template_id"], spread, "left")
    empty = F.lit("")
    return joined.withColumns(
        {
            "subject": F.coalesce(text.render_template(F.col("_subject"), F.col("_vars")), F.col("subject"), empty),
            "body": F.coalesce(text.render_template(F.col("_body"), F.col("_vars")), F.col("body"), empty),
        }
    ).drop("_subject", "_body", "_vars")


def rate_limit_status(notifications: DataFrame, as_of: datetime, hours: float, limits: dict[str, int]) -> DataFrame:
    """Sends per tenant and channel in the last hours against the channel's limit."""
    since = F.lit(as_of - timedelta(hours=hours)).cast("timestamp_ntz")
    return (
        notifications.filter(F.col("created_at") > since)
        .groupBy("tenant_id", "channel")
        .agg(F.count("*").alias("sent"))
        .withColumn("channel_limit", channel_limit(F.col("channel"), limits))
        .withColumn("limited", F.col("sent") >= F.col("channel_limit"))
    )


def rate_limit_attempts(notifications: DataFrame, limits: dict[str, int], seconds: int = 3600) -> DataFrame:
    """Per send time: attempts in the window ending there, and whether they exceed the limit."""
    counted = trailing_count(notifications, ["tenant_id", "channel"], "created_at", seconds, out="attempts")
    return counted.withColumn("channel_limit", channel_limit(F.col("channel"), limits)).withColumn(
        "over_limit", F.col("attempts") > F.col("channel_limit")
    )


def rate_limit_accepted(notifications: DataFrame, limits: dict[str, int], seconds: int = 3600) -> DataFrame:
    """Sends accepted one by one: fewer accepted sends than the limit in the window before.  Rejected ones do not count."""
    limited = notifications.withColumn("channel_limit", channel_limit(F.col("channel"), limits))
    return keep_within_limit(limited, ["tenant_id", "channel"], "created_at", "id", "channel_limit", seconds)


def pending_notifications(notifications: DataFrame, size: int, status: str = "PENDING") -> DataFrame:
    """Next sends with retries left, most urgent first."""
    return (
        notifications.filter((F.col("status") == status) & (F.col("retry_count") < F.col("max_retries")))
        .orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id"))
        .limit(size)
    )


def channel_payloads(messages: DataFrame, sent_at: str, sender: str = "Opslake", source: str = "opslake") -> DataFrame:
    """What each channel would send; unknown channels get no payload."""
    recipient, subject, body = F.col("recipient"), F.col("subject"), F.col("body")
    channel = F.upper("channel")
    return messages.withColumns(
        {
            "channel": channel,
            "address": F.when(channel == "SLACK", text.slack_channel(recipient))
            .when(channel == "PUSH", text.truncated(recipient, text.TOKEN_PREVIEW))
            .otherwise(recipient),
            "payload": F.when(channel == "EMAIL", F.concat(subject, F.lit("\n"), body))
            .when(channel == "SMS", text.sms_text(subject, body))
            .when(channel == "SLACK", text.slack_payload(recipient, subject, body, sender))
            .when(channel == "PUSH", text.push_payload(recipient, subject, body, source))
            .when(channel == "WEBHOOK", text.webhook_payload(subject, body, sent_at, source)),
        }
    )


def delivery_routes(events: DataFrame) -> DataFrame:
    """Where a delivery event goes; dispatch needs a known channel."""
    action = F.col("action")
    return events.withColumn(
        "route",
        F.when(
            action.isin("REQUESTED", "QUEUED"),
            F.when(F.col("channel").isin(*DISPATCHABLE), "dispatch").otherwise("no_dispatcher"),
        )
        .when(action == "FAILED", "failure")
        .when(action == "BOUNCED", "bounce")
        .when(action.isin("SENT", "DELIVERED"), "log"),
    )


def delivery_outcomes(
    notifications: DataFrame,
    results: DataFrame,
    as_of: datetime,
    channels: tuple[str, ...] = DISPATCHABLE,
) -> DataFrame:
    """Apply send results (id, ok, error): sent, failed with one more retry, or failed for want of a channel.

    Of several results for one notification a success counts before a failure.
    """
    single = results.groupBy("id").agg(F.max(F.struct("ok", "error")).alias("r")).select("id", "r.ok", "r.error")
    joined = notifications.join(single, "id")
    supported = F.upper("channel").isin(*channels)
    return joined.select(
        "id",
        "tenant_id",
        "channel",
        F.when(supported & F.col("ok"), "SENT").otherwise("FAILED").alias("status"),
        F.when(supported & F.col("ok"), F.lit(as_of).cast("timestamp_ntz")).alias("sent_at"),
        F.when(~supported, F.concat(F.lit("Unsupported channel: "), F.col("channel")))
        .when(~F.col("ok"), F.col("error"))
        .alias("error_message"),
        (F.col("retry_count") + F.when(supported & ~F.col("ok"), 1).otherwise(0)).alias("retry_count"),
    )
