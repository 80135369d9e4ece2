"""Event schemas and allowed values (fixed values agreed between producers and consumers)."""

from __future__ import annotations

from pyspark.sql import types as T

JOB_ACTIONS = ("REGISTERED", "STARTED", "COMPLETED", "FAILED", "SLA_VIOLATED", "RETRYING", "HEARTBEAT_MISSED")
ALERT_ACTIONS = ("TRIGGERED", "ACKNOWLEDGED", "RESOLVED", "ESCALATED")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
NOTIFICATION_ACTIONS = ("REQUESTED", "QUEUED", "SENT", "DELIVERED", "FAILED", "BOUNCED")
CHANNELS = ("EMAIL", "SMS", "SLACK", "PUSH", "WEBHOOK")
QUEUE_ACTIONS = ("ENQUEUED", "PROCESSING", "COMPLETED", "FAILED", "RETRYING", "CANCELLED", "TIMED_OUT")
QUEUE_STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "DEAD_LETTER", "CANCELLED")
ROLES = ("ADMIN", "OPERATOR", "VIEWER")

ENVELOPE_FIELDS = ("eventId", "eventType", "timestamp", "source", "tenantId", "correlationId")

# Per event type: required fields, optional fields, enumerated fields.
CONTRACTS = {
    "JOB": {
        "source": "job-monitoring-service",
        "required": ("jobId", "action", "jobName"),
        "optional": (
            "executionId",
            "cronExpression",
            "exitCode",
            "errorMessage",
            "executionStartTime",
            "executionEndTime",
            "metadata",
        ),
        "enums": {"action": JOB_ACTIONS},
    },
    "ALERT": {
        "source": "alerting-service",
        "required": ("alertId", "ruleId", "action", "severity", "alertName"),
        "optional": ("description", "channels", "context"),
        "enums": {"action": ALERT_ACTIONS, "severity": SEVERITIES},
    },
    "NOTIFICATION": {
        "source": "notification-service",
        "required": ("notificationId", "action", "channel", "recipient"),
        "optional": ("templateId", "subject", "templateVariables", "providerMessageId", "failureReason"),
        "enums": {"action": NOTIFICATION_ACTIONS, "channel": CHANNELS},
    },
    "QUEUE": {
        "source": "job-queue-service",
        "required": ("queuedJobId", "action", "jobType", "priority"),
        "optional": ("attemptNumber", "workerNodeId", "errorMessage", "payload"),
        "enums": {"action": QUEUE_ACTIONS},
    },
}


# Formats of text fields and which fields have them; least values of whole-number fields.
FORMATS = {
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "date-time": r"(?i)^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])t([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)"
    r"(\.[0-9]+)?(z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z",
}
FIELD_FORMATS = {
    "eventId": "uuid",
    "jobId": "uuid",
    "executionId": "uuid",
    "alertId": "uuid",
    "ruleId": "uuid",
    "notificationId": "uuid",
    "queuedJobId": "uuid",
    "timestamp": "date-time",
    "executionStartTime": "date-time",
    "executionEndTime": "date-time",
}
WHOLE_NUMBERS = {"exitCode": None, "priority": 0, "attemptNumber": 1}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _TS, _MAP = T.StringType(), T.IntegerType(), T.TimestampType(), T.MapType(T.StringType(), T.StringType())

# One nullable struct for all event types; the type field says which part is filled.
EVENT = _struct(
    eventId=_S,
    eventType=_S,
    timestamp=_TS,
    source=_S,
    tenantId=_S,
    correlationId=_S,
    jobId=_S,
    executionId=_S,
    action=_S,
    jobName=_S,
    cronExpression=_S,
    exitCode=_I,
    errorMessage=_S,
    executionStartTime=_TS,
    executionEndTime=_TS,
    metadata=_MAP,
    alertId=_S,
    ruleId=_S,
    severity=_S,
    alertName=_S,
    description=_S,
    channels=T.ArrayType(_S),
    context=_MAP,
    notificationId=_S,
    channel=_S,
    templateId=_S,
    recipient=_S,
    subject=_S,
    templateVariables=_MAP,
    providerMessageId=_S,
    failureReason=_S,
    queuedJobId=_S,
    jobType=_S,
    priority=_I,
    attemptNumber=_I,
    workerNodeId=_S,
    payload=_MAP,
)

LOG_ENTRY = _struct(
    id=_S,
    tenantId=_S,
    source=_S,
    hostname=_S,
    service=_S,
    level=_S,
    message=_S,
    logger=_S,
    threadName=_S,
    stackTrace=_S,
    metadata=_MAP,
    timestamp=_TS,
)
