"""Notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.operators import notify
from opslake.plans.registry import query
from opslake.sources.fixtures import AS_OF

LIMITS = {"EMAIL": 2, "SMS": 1, "SLACK": 3, "PUSH": 4}
LIMIT_SQL = "CASE channel WHEN 'EMAIL' THEN 2 WHEN 'SMS' THEN 1 WHEN 'SLACK' THEN 3 WHEN 'PUSH' THEN 4 ELSE 2 END"


def messages(t):
    """Notifications with their own text and, by channel, a template id."""
    n = t.notifications
    code = F.when(F.col("channel") == "EMAIL", 1).when(F.col("channel") == "SLACK", 2)
    return n.withColumns(
        {
            "template_id": (F.col("tenant_id").cast("int") * 10 + code).cast("int"),
            "subject": F.when(F.col("channel") != "SMS", F.concat(F.lit("Item "), F.col("id").cast("string"))),
            "body": F.concat(F.lit('Status "'), F.col("status"), F.lit('"\nfor '), F.col("recipient")),
        }
    ).drop("job_name")


MESSAGES_SQL = """
SELECT *, CAST(CAST(tenant_id AS int) * 10 + CASE channel WHEN 'EMAIL' THEN 1 WHEN 'SLACK' THEN 2 END AS int) AS template_id,
       CASE WHEN channel <> 'SMS' THEN concat('Item ', CAST(id AS string)) END AS subject,
       concat('Status "', status, '"', chr(10), 'for ', recipient) AS body
FROM v_notifications"""

RENDERED_SQL = f"""
SELECT m.id, m.tenant_id, m.channel, m.recipient, m.template_id,
       coalesce(replace(replace(t.subject, '{{{{status}}}}', m.status), '{{{{recipient}}}}', m.recipient), m.subject, '') AS subject,
       coalesce(replace(replace(replace(t.body, '{{{{status}}}}', m.status), '{{{{recipient}}}}', m.recipient),
                        '{{{{id}}}}', CAST(m.id AS string)), m.body, '') AS body
FROM ({MESSAGES_SQL}) m LEFT JOIN v_templates t ON t.tenant_id = m.tenant_id AND t.template_id = m.template_id"""


def rendered(t):
    variables = F.create_map(
        F.lit("status"), F.col("status"), F.lit("recipient"), F.col("recipient"), F.lit("id"), F.col("id").cast("string")
    )
    return notify.render_notifications(messages(t), t.templates, variables).select(
        "id", "tenant_id", "channel", "recipient", "template_id", "subject", "body"
    )


@query("render_notifications", RENDERED_SQL)
def _(t):
    return rendered(t)


@query(
    "channel_payloads",
    f"""
WITH r AS ({RENDERED_SQL}),
e AS (SELECT *, replace(replace(subject, '"', '\\"'), chr(10), '\\n') AS js, replace(replace(body, '"', '\\"'), chr(10), '\\n') AS jb,
             concat(subject, ': ', body) AS sms FROM r)
SELECT id, tenant_id, channel, recipient, template_id, subject, body,
       CASE channel WHEN 'SLACK' THEN concat('#', recipient)
            WHEN 'PUSH' THEN CASE WHEN length(recipient) > 12 THEN concat(substring(recipient, 1, 12), '...') ELSE recipient END
            ELSE recipient END AS address,
       CASE channel WHEN 'EMAIL' THEN concat(subject, chr(10), body)
            WHEN 'SMS' THEN CASE WHEN length(sms) > 160 THEN concat(substring(sms, 1, 157), '...') ELSE sms END
            WHEN 'SLACK' THEN concat('{{"channel":"#', recipient, '","username":"Opslake","text":"*', js, '*\\n', jb, '","icon_emoji":":warning:"}}')
            WHEN 'PUSH' THEN concat('{{"to":"', recipient, '","notification":{{"title":"', js, '","body":"', jb,
                 '","sound":"default"}},"data":{{"source":"opslake"}},"priority":"high"}}')
            ELSE concat('{{"subject":"', js, '","body":"', jb, '","timestamp":"2024-01-31T00:00:00Z","source":"opslake"}}') END AS payload
FROM e""",
)
def _(t):
    return notify.channel_payloads(rendered(t), "2024-01-31T00:00:00Z")


@query(
    "rate_limit_status",
    f"""
SELECT tenant_id, channel, count(*) AS sent, CAST({LIMIT_SQL} AS bigint) AS channel_limit, count(*) >= {LIMIT_SQL} AS limited
FROM v_notifications WHERE created_at > TIMESTAMP '2024-01-30 12:00:00' GROUP BY tenant_id, channel""",
)
def _(t):
    return notify.rate_limit_status(t.notifications, AS_OF, 12, LIMITS)


@query(
    "rate_limit_attempts",
    f"""
SELECT DISTINCT tenant_id, channel, created_at, attempts, CAST({LIMIT_SQL} AS bigint) AS channel_limit, attempts > {LIMIT_SQL} AS over_limit
FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id, channel ORDER BY created_at
             RANGE BETWEEN INTERVAL 43199999999 MICROSECOND PRECEDING AND CURRENT ROW) AS attempts FROM v_notifications)""",
)
def _(t):
    return notify.rate_limit_attempts(t.notifications, LIMITS, 43_200)


@query(
    "rate_limit_accepted",
    f"""
WITH RECURSIVE n AS (
  SELECT *, {LIMIT_SQL} AS channel_limit, row_number() OVER (PARTITION BY tenant_id, channel ORDER BY created_at, id) AS rn
  FROM v_notifications),
walk AS (
  SELECT tenant_id, channel, rn, [created_at] AS recent, true AS ok FROM n WHERE rn = 1
  UNION ALL
  SELECT n.tenant_id, n.channel, n.rn,
         CASE WHEN len(list_filter(w.recent, lambda x: x > n.created_at - INTERVAL '12 hours')) < n.channel_limit
              THEN list_append(list_filter(w.recent, lambda x: x > n.created_at - INTERVAL '12 hours'), n.created_at)
              ELSE w.recent END,
         len(list_filter(w.recent, lambda x: x > n.created_at - INTERVAL '12 hours')) < n.channel_limit
  FROM walk w JOIN n ON n.tenant_id = w.tenant_id AND n.channel = w.channel AND n.rn = w.rn + 1)
SELECT n.* EXCLUDE (rn) REPLACE (CAST(channel_limit AS bigint) AS channel_limit) FROM n JOIN walk w USING (tenant_id, channel, rn) WHERE w.ok""",
)
def _(t):
    return notify.rate_limit_accepted(t.notifications, LIMITS, 43_200)


@query(
    "pending_notifications",
    """
SELECT * FROM v_notifications WHERE status = 'PENDING' AND retry_count < max_retries
ORDER BY priority DESC, created_at, id LIMIT 100""",
)
def _(t):
    return notify.pending_notifications(t.notifications, 100)


EVENT_ACTION = """CASE WHEN status = 'FAILED' AND priority = 1 THEN 'BOUNCED' WHEN status = 'FAILED' THEN 'FAILED'
       WHEN status = 'PENDING' AND priority > 5 THEN 'QUEUED' WHEN status = 'PENDING' THEN 'REQUESTED'
       WHEN priority > 8 THEN 'DELIVERED' ELSE 'SENT' END"""


@query(
    "delivery_routes",
    f"""
SELECT id, tenant_id, channel, action,
       CASE WHEN action IN ('REQUESTED', 'QUEUED') THEN CASE WHEN channel = 'FAX' THEN 'no_dispatcher' ELSE 'dispatch' END
            WHEN action = 'FAILED' THEN 'failure' WHEN action = 'BOUNCED' THEN 'bounce' ELSE 'log' END AS route
FROM (SELECT id, tenant_id, CASE WHEN channel = 'WEBHOOK' THEN 'FAX' ELSE channel END AS channel, {EVENT_ACTION} AS action FROM v_notifications)""",
)
def _(t):
    events = t.notifications.select(
        "id",
        "tenant_id",
        F.expr("if(channel = 'WEBHOOK', 'FAX', channel)").alias("channel"),
        F.expr(EVENT_ACTION).alias("action"),
    )
    return notify.delivery_routes(events)


@query(
    "delivery_outcomes",
    """
SELECT id, tenant_id, channel, CASE WHEN channel <> 'WEBHOOK' AND status <> 'FAILED' THEN 'SENT' ELSE 'FAILED' END AS status,
       CASE WHEN channel <> 'WEBHOOK' AND status <> 'FAILED' THEN TIMESTAMP '2024-01-31 00:00:00' END AS sent_at,
       CASE WHEN channel = 'WEBHOOK' THEN 'Unsupported channel: WEBHOOK' WHEN status = 'FAILED' THEN 'provider refused' END AS error_message,
       retry_count + CASE WHEN channel <> 'WEBHOOK' AND status = 'FAILED' THEN 1 ELSE 0 END AS retry_count
FROM v_notifications""",
)
def _(t):
    results = t.notifications.select(
        "id", (F.col("status") != "FAILED").alias("ok"), F.lit("provider refused").alias("error")
    )
    # A second, failed result for what was sent must not count.
    again = results.filter("ok").withColumns({"ok": F.lit(False), "error": F.lit("late refusal")})
    return notify.delivery_outcomes(t.notifications, results.unionByName(again), AS_OF, ("EMAIL", "SMS", "SLACK", "PUSH"))
