"""Streams over files against the batch operators on the same rows."""

import os
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opslake.functions.scratch import scratch_path
from opslake.operators import evaluators, logs, rollups, rules
from opslake.plans.alerts import fired
from opslake.plans.jobs import job_events
from opslake.plans.logs import PATTERNS
from opslake.sources.fixtures import AS_OF, Domain
from opslake.streaming import events, jobs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Domain(spark, DATA)


def by_time(spark, df, ts, parts=3):
    """Rows as files in time order, so late data does not appear by accident."""
    path = scratch_path(spark, "stream-input")
    numbered = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(ts)))
    for i in range(parts):
        numbered.filter(F.col("_part") == i + 1).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run(spark, df, mode="append"):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").option("path", out).start().awaitTermination(300)
    return spark.read.schema(df.schema).parquet(out)


def run_batches(spark, df, write):
    q = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(300)


def utc(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def same_rows(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_duplicates_are_dropped(spark, t):
    messages = events.decode_events(
        events.job_event_messages(evaluators.execution_events(t.job_executions, t.jobs))
    )
    once = events.events_of_type(messages, "JOB").select("eventId", "timestamp", "action")
    path = scratch_path(spark, "twice")
    once.write.parquet(path)
    once.write.mode("append").parquet(path)
    got = run(spark, jobs.deduplicated(stream(spark, path, once.schema, 100)))
    assert got.count() == once.count()
    assert got.select("eventId").distinct().count() == got.count()


def test_rollup_stream_equals_batch_for_closed_hours(spark, t):
    runs = utc(t.job_executions, "started_at", "completed_at")
    path = by_time(spark, runs, "started_at")
    got = run(spark, jobs.hourly_rollup(stream(spark, path, runs.schema)))
    batch = utc(rollups.hourly_rollup(t.job_executions), "bucket")
    newest = runs.agg(F.max("started_at")).collect()[0][0]
    closed = batch.filter(F.col("bucket") + F.expr("interval 4 hours") <= F.lit(newest))
    assert closed.count() > 100
    exact = ["job_id", "tenant_id", "bucket", "total_runs", "success_count", "failure_count", "max_duration_ms"]
    joined = closed.select(*exact, "p95_duration_ms").join(
        got.select(*exact, F.col("p95_duration_ms").alias("p")), exact, "left"
    )
    assert joined.filter(F.col("p").isNull() & F.col("p95_duration_ms").isNotNull()).count() == 0
    # The sketch answers with an observed value, the batch interpolates between two.
    assert joined.filter(F.col("p") < F.col("p95_duration_ms") * 0.5).filter("total_runs = 1").count() == 0


def test_alert_stream_does_not_change_with_the_rule_table(spark, t):
    """A rule table beyond the broadcast threshold joins a stream all the same."""
    feed = evaluators.execution_events(t.job_executions, t.jobs)
    path = by_time(spark, feed, "execution_start_time")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = run(spark, jobs.evaluate_events(stream(spark, path, feed.schema), t.alert_rules)).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = run(spark, jobs.evaluate_events(stream(spark, path, feed.schema), t.alert_rules)).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert large == small > 0


def test_alert_stream_equals_batch(spark, t):
    feed = evaluators.execution_events(t.job_executions, t.jobs)
    path = by_time(spark, feed, "execution_start_time")
    table = t.alert_rules
    batch = rules.cooldown_alerts(rules.evaluate_rules(rules.event_context(rules.alertable_events(feed)), table))
    got = run(spark, jobs.cooldown_alerts(jobs.evaluate_events(stream(spark, path, feed.schema), table)))
    want = utc(batch, "triggered_at").select("rule_id", "event_id", "triggered_at")
    assert want.count() > 50
    assert same_rows(got, want)


def test_rule_stream_with_run_history_equals_batch(spark, t):
    """All five rule types, with runs that come late, across a restart."""
    feed = job_events(t)
    # One event in ten comes up to two hours late.
    lag = F.when(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0, F.pmod(F.xxhash64("event_id"), F.lit(7200))).otherwise(0)
    arrival = F.unix_seconds(F.col("event_time").cast("timestamp")) + lag
    path = scratch_path(spark, "feed")
    ordered = feed.withColumn("_part", F.ntile(4).over(Window.orderBy(arrival))).cache()
    closing = feed.limit(1).select(
        *(F.lit("nobody").alias(c) if c in ("tenant_id", "event_id") else F.lit(datetime(2100, 1, 1)).cast("timestamp_ntz").alias(c) if c == "event_time" else F.col(c) for c in feed.columns)
    ).withColumn("job_id", F.lit(-1).cast("bigint"))
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    for parts in ((1, 2), (3, 4)):
        for part in parts:
            ordered.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
        if 4 in parts:
            closing.write.mode("append").parquet(path)
        # A new query each time: it goes on from the checkpoint of the one before.
        alerts = jobs.rule_alerts(stream(spark, path, feed.schema), t.alert_rules, "3 hours", 4000)
        writer = alerts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.format("parquet").option("path", out).start().awaitTermination(300)
    got = spark.read.schema(alerts.schema).parquet(out)
    want = utc(fired(t), "triggered_at").select("rule_id", "event_id", "triggered_at")
    types = got.join(t.alert_rules.select("rule_id", "rule_type"), "rule_id").groupBy("rule_type").count().collect()
    assert {r.rule_type for r in types} == set(rules.CONDITIONS)
    assert same_rows(got, want)


def test_events_later_than_the_lateness_are_dropped(spark, t):
    base = datetime(2024, 1, 1)
    row = lambda i, minutes, action: ("t", 1, i, action, "executions", f"e{i}", base + timedelta(minutes=minutes))
    kind = "tenant_id string, job_id bigint, execution_id bigint, action string, producer string, event_id string, event_time timestamp_ntz"
    path = scratch_path(spark, "late")
    for rows in ([row(1, 0, "FAILED"), row(2, 300, "FAILED")], [row(4, 299, "FAILED"), row(5, 301, "FAILED")], [row(3, 200, "COMPLETED"), row(6, 999, "FAILED")], [row(7, 2000, "STARTED")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    got = run(spark, jobs.with_run_history(stream(spark, path, spark.createDataFrame([], kind).schema), "10 minutes"))
    told = {r.execution_id: (r.consecutive_failures, r.success_rate, r.event_time) for r in got.collect()}
    assert told == {
        1: (1, 0, base),
        4: (2, 0, base + timedelta(minutes=299)),
        2: (3, 0, base + timedelta(minutes=300)),
        5: (4, 0, base + timedelta(minutes=301)),
        6: (5, 0, base + timedelta(minutes=999)),
    }


def test_heartbeat_stream_finds_the_silent_jobs(spark, t):
    runs = utc(t.job_executions, "started_at", "completed_at").drop("status")
    path = by_time(spark, runs, "started_at")
    out = scratch_path(spark, "silent")
    query = (
        jobs.heartbeat_timeouts(stream(spark, path, runs.schema), t.jobs)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(processingTime="1 second")
        .start()
    )
    # Timers run by the clock, so the query never ends by itself: three input batches and two more will do.
    deadline = time.time() + 120
    while (query.lastProgress is None or query.lastProgress["batchId"] < 5) and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    got = spark.read.parquet(out)
    # All test data lies in the past, so every watched job is overdue in the end.
    want = evaluators.missed_heartbeats(t.jobs, t.job_executions, AS_OF.replace(year=2025))
    assert {r.job_id for r in got.collect()} == {r.job_id for r in want.collect()}


def test_log_batches(spark, t):
    rows = t.logs
    path = by_time(spark, rows, "ts")
    out = scratch_path(spark, "logs")
    run_batches(spark, stream(spark, path, rows.schema), jobs.log_batch_writer(out, PATTERNS))
    assert spark.read.parquet(f"{out}/logs").count() == rows.count()
    hits = spark.read.parquet(f"{out}/hits").drop("batch_id")
    assert same_rows(logs.pattern_hits(rows, PATTERNS), hits)


def test_a_replayed_batch_replaces_itself(spark, t):
    out = scratch_path(spark, "replayed")
    write, rows = jobs.log_batch_writer(out, PATTERNS), t.logs
    for batch_id in (0, 0, 1):
        write(rows, batch_id)
    stored = spark.read.parquet(f"{out}/logs")
    assert stored.count() == 2 * rows.count()
    one = stored.filter("tenant_id = 't1' and batch_id = 0")
    assert one.count() == rows.filter("tenant_id = 't1'").count() > 0
    assert all(re.search("/tenant_id=[^/]+/log_date=[^/]+/batch_id=[01]/", f) for f in stored.inputFiles())


def test_dead_letters_are_kept_with_a_reason(spark):
    path = scratch_path(spark, "raw")
    texts = [
        '{"eventId": "1", "eventType": "JOB", "tenantId": "a", "action": "FAILED"}',
        '{"eventId": "2", "eventType": "ALERT", "channels": ["EMAIL", "SMS"], "context": {"k": "v"}}',
        '{"eventId": "3", "eventType": "PARTY"}',
        '{"eventType": "QUEUE"}',
        "{broken",
    ]
    spark.createDataFrame([(x,) for x in texts], "value string").write.text(path)
    out = scratch_path(spark, "decoded")
    run_batches(spark, events.read_event_stream(spark, path), jobs.decode_batch_writer(out))
    good = {r.eventId: r for r in spark.read.parquet(f"{out}/events").collect()}
    assert set(good) == {"1", "2"} and good["2"].channels == ["EMAIL", "SMS"]
    bad = {r.value: r.error_message for r in spark.read.parquet(f"{out}/dead_letters").collect()}
    assert bad == {
        texts[2]: "unknown eventType",
        texts[3]: "missing eventId",
        texts[4]: "not valid JSON",
    }


def test_bad_log_records_are_kept(spark):
    texts = ['{"tenantId": "a", "message": "fine", "timestamp": "2024-01-01T00:00:00"}', '{"message": "no tenant"}', "{broken", '{"tenantId": "b"}']
    path, out = scratch_path(spark, "raw"), scratch_path(spark, "stored")
    spark.createDataFrame([(x,) for x in texts], "value string").write.text(path)
    run_batches(spark, events.read_event_stream(spark, path), jobs.raw_log_batch_writer(out))
    assert {r.tenant_id for r in spark.read.parquet(f"{out}/logs").collect()} == {"a", "b"}
    bad = {r.payload: (r.error_message, r.retry_count, r.queue_name) for r in spark.read.parquet(f"{out}/dead_letters").collect()}
    assert bad == {texts[1]: ("missing tenantId", 1, "logs"), texts[2]: ("not valid JSON", 1, "logs")}


def test_poison_records_end_in_the_dead_letters_after_three_tries(spark):
    path, out = scratch_path(spark, "records"), scratch_path(spark, "routed")
    trials = scratch_path(spark, "trials").split(":", 1)[-1]
    os.makedirs(trials)
    rows = [(str(i), f"fine {i}") for i in range(5)] + [("p", "poison"), ("j", "broken json"), ("s", "slow start")]
    spark.createDataFrame(rows, "id string, payload string").coalesce(1).write.parquet(path)

    def handle(payload):
        if payload == "broken json":
            raise ValueError("cannot parse")
        if payload in ("poison", "slow start"):
            with open(f"{trials}/{payload}", "a+") as seen:
                seen.write("x")
                seen.seek(0)
                if payload == "poison" or len(seen.read()) < 3:
                    raise RuntimeError("down")

    routed = jobs.with_retries(stream(spark, path, spark.createDataFrame([], "id string, payload string").schema), handle, 500)
    query = (
        routed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(processingTime="1 second")
        .start()
    )
    deadline = time.time() + 120
    while time.time() < deadline:
        time.sleep(1)
        if query.lastProgress is not None and query.lastProgress["batchId"] >= 3 and spark.read.schema(routed.schema).parquet(out).count() >= 8:
            break
    query.stop()
    got = {r.id: (r.payload, r.route, r.attempts, r.error_message) for r in spark.read.parquet(out).collect()}
    assert got == {
        **{str(i): (f"fine {i}", "handled", 1, None) for i in range(5)},
        "p": ("poison", "dead-letter", 3, "RuntimeError: down"),
        "j": ("broken json", "dead-letter", 1, "ValueError: cannot parse"),
        "s": ("slow start", "handled", 3, None),
    }


def test_delivery_sinks_are_pluggable(spark, t):
    n = t.notifications.select(
        "id",
        "tenant_id",
        "channel",
        "recipient",
        F.lit("S").alias("subject"),
        F.lit("B").alias("body"),
        F.expr("case status when 'FAILED' then 'FAILED' when 'PENDING' then 'REQUESTED' else 'SENT' end").alias("action"),
    )
    path = by_time(spark, n, "id")
    taken = []
    out = scratch_path(spark, "mail")
    sinks = {
        "EMAIL": jobs.file_sink(out),
        "SMS": lambda rows, batch: taken.extend(r.id for r in rows.collect()),
        "failure": jobs.file_sink(scratch_path(spark, "failure")),
    }
    run_batches(spark, stream(spark, path, n.schema), jobs.delivery_batch_writer(sinks, "now"))
    wanted = n.filter("action = 'REQUESTED'")
    assert spark.read.parquet(out).count() == wanted.filter("channel = 'EMAIL'").count()
    assert sorted(taken) == sorted(r.id for r in wanted.filter("channel = 'SMS'").collect())
