"""Event envelopes: decode, encode, and splitting off what cannot be decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake import schemas

_CORRUPT = "_corrupt_record"
_PARSED = T.StructType([*schemas.EVENT.fields, T.StructField(_CORRUPT, T.StringType())])


def decode_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON event texts.  ``valid`` is false for broken JSON, unknown types and missing ids."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = raw.withColumn("event", F.from_json(F.col(value).cast("string"), _PARSED, options))
    known = F.col("event.eventType").isin(*schemas.CONTRACTS) & F.col("event.eventId").isNotNull()
    return parsed.withColumn("valid", F.col(f"event.{_CORRUPT}").isNull() & F.coalesce(known, F.lit(False)))


def events_of_type(decoded: DataFrame, event_type: str) -> DataFrame:
    """Valid events of one type with only that type's columns."""
    contract = schemas.CONTRACTS[event_type]
    fields = [*schemas.ENVELOPE_FIELDS, *contract["required"], *contract["optional"]]
    return decoded.filter(F.col("valid") & (F.col("event.eventType") == event_type)).select(
        *(F.col(f"event.{name}").alias(name) for name in fields)
    )


MAX_ATTEMPTS = 3


def dead_letters(decoded: DataFrame, value: str = "value") -> DataFrame:
    """Undecodable records with the reason; ``dead_letter_records`` makes the stored form of any failed record."""
    reason = (
        F.when(F.col(f"event.{_CORRUPT}").isNotNull() | F.col("event").isNull(), "not valid JSON")
        .when(F.col("event.eventId").isNull(), "missing eventId")
        .otherwise("unknown eventType")
    )
    return decoded.filter(~F.col("valid")).select(F.col(value).alias("value"), reason.alias("error_message"))


def failure_route(attempts: Column) -> Column:
    """Where a record goes whose handling failed: tried again until the third try, then the dead letters."""
    return F.when(attempts >= MAX_ATTEMPTS, "dead-letter").otherwise("retry")


def dead_letter_records(
    failed: DataFrame, original_id: str, tenant: str, queue: str, job_type: str, payload: str, error: str, attempts: str, failed_at: Column
) -> DataFrame:
    """Failed records as they are stored for good; the id follows from the original id and the number of tries."""
    return failed.select(
        F.sha2(F.concat_ws(":", F.col(original_id).cast("string"), F.col(attempts).cast("string")), 256).alias("id"),
        F.col(original_id).cast("string").alias("original_id"),
        F.col(tenant).alias("tenant_id"),
        F.lit(queue).alias("queue_name"),
        F.col(job_type).alias("job_type"),
        F.col(payload).alias("payload"),
        F.col(error).alias("error_message"),
        F.col(attempts).cast("int").alias("retry_count"),
        failed_at.alias("failed_at"),
    )


def decode_logs(raw: DataFrame, received_at: Column, value: str = "value") -> DataFrame:
    """Log entries from JSON texts, with the id and time filled where the sender left them out."""
    entry = F.from_json(F.col(value).cast("string"), schemas.LOG_ENTRY)
    filled = raw.select(F.col(value).alias("_text"), entry.alias("e")).filter(F.col("e.tenantId").isNotNull())
    return filled.select(
        F.coalesce("e.id", F.sha2("_text", 256)).alias("id"),
        F.col("e.tenantId").alias("tenant_id"),
        "e.source",
        "e.hostname",
        "e.service",
        "e.level",
        "e.message",
        "e.logger",
        F.col("e.threadName").alias("thread_name"),
        F.col("e.stackTrace").alias("stack_trace"),
        "e.metadata",
        F.coalesce("e.timestamp", received_at).alias("ts"),
    )


def log_dead_letters(raw: DataFrame, value: str = "value") -> DataFrame:
    """Raw log records that ``decode_logs`` gives no entry for: an ``id`` from the text, the text and the reason.

    Other columns of ``raw`` are kept.
    """
    text = F.col(value).cast("string")
    entry = F.from_json(text, T.StructType([*schemas.LOG_ENTRY.fields, T.StructField(_CORRUPT, T.StringType())]), {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = raw.withColumn("_entry", entry)
    reason = F.when(F.col("_entry").isNull() | F.col(f"_entry.{_CORRUPT}").isNotNull(), "not valid JSON").otherwise("missing tenantId")
    bad = parsed.where(F.col("_entry.tenantId").isNull())
    return bad.withColumns({"id": F.sha2(F.coalesce(text, F.lit("")), 256), "error_message": reason}).drop("_entry")


def uuid_of(name: Column) -> Column:
    """A uuid made from a hash of a text, the same for the same text."""
    h = F.md5(name.cast("string").cast("binary"))
    part = lambda start, size: F.substring(h, start, size)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def uuid_of_number(number: Column) -> Column:
    """A whole number in the form of a uuid, so that ``number_of_uuid`` gives it back."""
    h = F.lower(F.lpad(F.hex(number.cast("bigint")), 16, "0"))
    part = lambda start, size: F.substring(h, start, size)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8000-8000-00000000"), part(13, 4))


def number_of_uuid(text: Column) -> Column:
    h = F.concat(F.substring(text, 1, 8), F.substring(text, 10, 4), F.substring(text, 33, 4))
    return F.conv(h, 16, -10).cast("bigint")


def envelope(event_type: str, event_id: Column, timestamp: Column, tenant_id: Column, **fields: Column) -> Column:
    """JSON text of an event; its id is a uuid made from ``event_id``."""
    return F.to_json(
        F.struct(
            uuid_of(event_id).alias("eventId"),
            F.lit(event_type).alias("eventType"),
            timestamp.alias("timestamp"),
            F.lit(schemas.CONTRACTS[event_type]["source"]).alias("source"),
            tenant_id.alias("tenantId"),
            *(c.alias(n) for n, c in fields.items()),
        ),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )


def job_event_messages(events: DataFrame) -> DataFrame:
    """Job events as keyed messages; one tenant's events share a key."""
    return events.select(
        F.col("tenant_id").alias("key"),
        envelope(
            "JOB",
            F.col("event_id"),
            F.col("event_time").cast("timestamp"),
            F.col("tenant_id"),
            jobId=uuid_of_number(F.col("job_id")),
            executionId=uuid_of_number(F.col("execution_id")),
            action=F.col("action"),
            jobName=F.col("job_name"),
            exitCode=F.col("exit_code"),
            errorMessage=F.col("error_message"),
            executionStartTime=F.col("execution_start_time").cast("timestamp"),
            executionEndTime=F.col("execution_end_time").cast("timestamp"),
        ).alias("value"),
    )


def alert_event_messages(alerts: DataFrame) -> DataFrame:
    """Alerts as keyed messages; rule and event make the id, so a repeated run names the same alert."""
    alert_id = F.concat_ws("-", F.col("rule_id").cast("string"), F.col("event_id"))
    return alerts.select(
        F.col("tenant_id").alias("key"),
        envelope(
            "ALERT",
            F.concat(F.lit("alerts-"), alert_id),
            F.col("triggered_at").cast("timestamp"),
            F.col("tenant_id"),
            alertId=uuid_of(alert_id),
            ruleId=uuid_of_number(F.col("rule_id")),
            action=F.col("status"),
            severity=F.col("severity"),
            alertName=F.col("rule_name"),
            description=F.col("message"),
            channels=F.split("channels_csv", ","),
        ).alias("value"),
    )


# What a queue item's state is called in events.
QUEUE_EVENT_ACTIONS = {
    "PENDING": "ENQUEUED",
    "PROCESSING": "PROCESSING",
    "COMPLETED": "COMPLETED",
    "FAILED": "FAILED",
    "DEAD_LETTER": "FAILED",
    "CANCELLED": "CANCELLED",
}


def queue_event_messages(items: DataFrame) -> DataFrame:
    """Queue items as keyed messages of their present state, one id for each item, state and try."""
    table = F.create_map(*(F.lit(x) for pair in QUEUE_EVENT_ACTIONS.items() for x in pair))
    action = F.element_at(table, F.col("status"))
    return items.select(
        F.col("tenant_id").alias("key"),
        envelope(
            "QUEUE",
            F.concat_ws("-", F.lit("queue"), F.col("id").cast("string"), action, F.col("attempt_count").cast("string")),
            F.col("created_at").cast("timestamp"),
            F.col("tenant_id"),
            queuedJobId=uuid_of_number(F.col("id")),
            action=action,
            jobType=F.col("job_type"),
            priority=F.col("priority"),
            attemptNumber=F.when(F.col("attempt_count") > 0, F.col("attempt_count")),  # none before the first try
            workerNodeId=F.col("assigned_worker"),
        ).alias("value"),
    )


# What the state of a notification is called in events.
NOTIFICATION_EVENT_ACTIONS = {"PENDING": "REQUESTED", "QUEUED": "QUEUED", "SENT": "SENT", "DELIVERED": "DELIVERED", "FAILED": "FAILED", "BOUNCED": "BOUNCED"}


def notification_event_messages(notifications: DataFrame, at: str = "created_at") -> DataFrame:
    """Notifications as keyed messages of their present state, one id for each notification, state and try."""
    table = F.create_map(*(F.lit(x) for pair in NOTIFICATION_EVENT_ACTIONS.items() for x in pair))
    action = F.element_at(table, F.col("status"))
    reason = F.col("error_message") if "error_message" in notifications.columns else F.lit(None).cast("string")
    name = F.concat_ws("-", F.lit("notification"), F.col("id").cast("string"), action, F.col("retry_count").cast("string"))
    return notifications.select(
        F.col("tenant_id").alias("key"),
        envelope(
            "NOTIFICATION",
            name,
            F.col(at).cast("timestamp"),
            F.col("tenant_id"),
            notificationId=uuid_of_number(F.col("id")),
            action=action,
            channel=F.col("channel"),
            recipient=F.col("recipient"),
            failureReason=F.when(action == "FAILED", reason),
        ).alias("value"),
    )


def read_event_stream(
    spark: SparkSession, source: str, files_per_trigger: int | None = None, topic: str | None = None
) -> DataFrame:
    """Raw event texts: a topic when ``topic`` is named (needs the Kafka connector), else a folder of text files."""
    if topic is not None:
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", source)
            .option("subscribe", topic)
            .load()
            .select(F.col("key").cast("string"), F.col("value").cast("string"))
        )
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(source)
