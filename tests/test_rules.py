"""Alert, queue, log, notification and query rules on literal cases."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslake import schemas
from opslake.functions import text
from opslake.operators import evaluators, logs, metrics, notify, quality, querylog, queueops, rollups, rules, tables
from opslake.streaming import events

NOW = datetime(2024, 1, 31)


def value(spark, expression, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return df.select(expression.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "rule_type, threshold, context, fires",
    [
        ("FAILURE_COUNT", "5", {"failure_count": 10}, True),
        ("FAILURE_COUNT", "5", {"failure_count": 5}, True),
        ("FAILURE_COUNT", "5", {"failure_count": 2}, False),
        ("FAILURE_COUNT", "3", {"failure_count": 1}, False),
        ("FAILURE_COUNT", "5.5", {"failure_count": 10}, False),
        ("SLA_BREACH", "1000", {"duration_ms": 1000}, False),
        ("SLA_BREACH", "1000", {"duration_ms": 1001}, True),
        ("SLA_BREACH", "1000", {}, False),
        ("CONSECUTIVE_FAILURES", "4", {"consecutive_failures": 4}, True),
        ("SUCCESS_RATE_DROP", "80", {"success_rate": 80}, False),
        ("SUCCESS_RATE_DROP", "80", {"success_rate": 79}, True),
        ("TIMEOUT", "1", {"timeout_seconds": 1}, True),
        ("SOMETHING_ELSE", "1", {"failure_count": 9}, False),
    ],
)
def test_rule_conditions(spark, rule_type, threshold, context, fires):
    columns = {c: None for c, _ in rules.CONDITIONS.values()} | context
    df = spark.range(1).select(
        F.lit(rule_type).alias("rule_type"),
        F.lit(f'{{"threshold": {threshold}, "unit": "x"}}').alias("condition_json"),
        *(F.lit(v).cast("bigint").alias(k) for k, v in columns.items()),
    )
    row = rules.rule_thresholds(df).select(rules.rule_condition().alias("fires")).collect()[0]
    assert row.fires is fires


def test_conditions_can_be_added(spark):
    df = spark.range(1).select(F.lit("EXIT").alias("rule_type"), F.lit(3).alias("threshold"), F.lit(3).alias("exit_code"))
    extended = {**rules.CONDITIONS, "EXIT": ("exit_code", "=")}
    assert df.select(rules.rule_condition(extended, df.columns).alias("f")).collect()[0].f is True


@pytest.mark.parametrize(
    "condition, threshold",
    [
        ('{"threshold": 5}', 5),
        ('{"threshold":-7,"a":1}', -7),
        ('{"a": 1, "threshold" : +3 }', 3),
        ('{"threshold": 1.5}', None),
        ('{"threshold": "5"}', None),
        ('{"limit": 1}', None),
        (None, None),
    ],
)
def test_thresholds(spark, condition, threshold):
    assert value(spark, text.condition_threshold(F.col("c")), c=F.lit(condition).cast("string")) == threshold


@pytest.mark.parametrize("minutes, allowed", [(30, False), (60, False), (61, True), (None, True)])
def test_cooldown_against_history(spark, minutes, allowed):
    rule = spark.createDataFrame([(1, "t", 2, 3600)], "rule_id int, tenant_id string, job_id int, cooldown_seconds int")
    past = [(1, 7, NOW - timedelta(minutes=minutes)), (1, 6, NOW - timedelta(days=2))] if minutes else []
    history = spark.createDataFrame(past, "alert_rule_id int, id int, triggered_at timestamp_ntz")
    assert rules.cooldown_gate(rule, history, NOW).collect()[0].allowed is allowed


def test_default_cooldown_is_five_minutes(spark):
    rule = spark.createDataFrame([(1, "t", 2, None)], "rule_id int, tenant_id string, job_id int, cooldown_seconds int")
    for seconds, allowed in ((300, False), (301, True)):
        history = spark.createDataFrame(
            [(1, 7, NOW - timedelta(seconds=seconds))], "alert_rule_id int, id int, triggered_at timestamp_ntz"
        )
        assert rules.cooldown_gate(rule, history, NOW).collect()[0].allowed is allowed


def test_message_lists_the_context_by_name(spark):
    df = spark.range(1).select(
        F.lit("R").alias("rule_name"),
        F.lit("FAILURE_COUNT").alias("rule_type"),
        F.lit(2).alias("failure_count"),
        F.lit("FAILED").alias("action"),
        F.lit(None).cast("int").alias("exit_code"),
    )
    message = df.select(rules.alert_message(df.columns).alias("m")).collect()[0].m
    assert message == "Alert 'R' (FAILURE_COUNT) triggered. Context: [action=FAILED, failureCount=2]"


def test_gate_needs_keys_and_an_actionable_event(spark):
    rows = [("FAILED", "t", 1), ("COMPLETED", "t", 1), ("STARTED", "t", 1), ("REGISTERED", "t", 1), ("RETRYING", "t", 1),
            ("SLA_VIOLATED", "t", 1), ("HEARTBEAT_MISSED", "t", 1), ("FAILED", None, 1), ("FAILED", "t", None), (None, "t", 1)]
    df = spark.createDataFrame(rows, "action string, tenant_id string, job_id int")
    assert sorted(r.action for r in rules.alertable_events(df).collect()) == [
        "COMPLETED", "FAILED", "HEARTBEAT_MISSED", "SLA_VIOLATED"]


def test_worker_alerts_only_for_bad_news(spark):
    rows = [("FAILED", None, None), ("STARTED", 0, None), ("COMPLETED", 0, None), ("REGISTERED", 0, None)]
    df = spark.createDataFrame(rows, "action string, exit_code int, error_message string").select(
        "*", F.lit("t").alias("tenant_id"), F.lit(1).alias("job_id"), F.lit(2).alias("execution_id"), F.lit("e").alias("event_id"), F.lit("j").alias("job_name"))
    (alert,) = rules.worker_alerts(df).collect()
    assert (alert.alert_name, alert.description) == ("FAILURE: j", "Job failed: j")
    assert (alert.context_exit_code, alert.context_error_message) == ("null", "")


@pytest.mark.parametrize(
    "given, action",
    [("STARTED", "STARTED"), ("completed", "COMPLETED"), ("Failed", "FAILED"), ("whatever", "REGISTERED"),
     ("HEARTBEAT", "HEARTBEAT_MISSED"), (None, "REGISTERED")],
)
def test_gateway_actions(spark, given, action):
    assert value(spark, evaluators.gateway_action(F.col("e")), e=F.lit(given).cast("string")) == action


@pytest.mark.parametrize(
    "status, action",
    [("SUCCESS", "COMPLETED"), ("failed", "FAILED"), ("TIMEOUT", "SLA_VIOLATED"), ("RUNNING", "STARTED"),
     ("RETRYING", "RETRYING"), ("odd", "STARTED"), (None, "STARTED")],
)
def test_status_actions(spark, status, action):
    assert value(spark, evaluators.status_to_action(F.col("s")), s=F.lit(status).cast("string")) == action


RUNS = "id long, job_id long, tenant_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, duration_ms long"
JOBS = ("job_id long, tenant_id string, name string, status string, cron_expression string, sla_seconds int, "
        "expected_runtime_seconds int, grace_period_seconds int")


@pytest.mark.parametrize("duration, late", [(10_000, False), (10_001, True), (None, False)])
def test_sla_is_strict_and_looks_at_the_newest_run(spark, duration, late):
    runs = spark.createDataFrame(
        [(1, 1, "t", "SUCCESS", NOW - timedelta(hours=2), None, 99_000), (2, 1, "t", "SUCCESS", NOW, None, duration)], RUNS)
    jobs = spark.createDataFrame(
        [(1, "t", "a", "ACTIVE", None, 10, None, None), (2, "t", "never ran", "ACTIVE", None, 1, None, None)], JOBS)
    assert [r.job_id for r in evaluators.sla_violations(jobs, runs).collect()] == ([1] if late else [])


@pytest.mark.parametrize("seconds, missed", [(3900, False), (3901, True)])
def test_heartbeat_defaults_and_boundary(spark, seconds, missed):
    seen = NOW - timedelta(seconds=seconds)
    runs = spark.createDataFrame([(1, j, "t", "SUCCESS", seen - timedelta(hours=9), seen, 1) for j in (1, 2, 3)], RUNS)
    jobs = spark.createDataFrame(
        [(1, "t", "a", "ACTIVE", "0 0 * * *", None, None, None), (2, "t", "b", "ACTIVE", " ", None, None, None),
         (3, "t", "c", "PAUSED", "0 0 * * *", None, None, None), (4, "t", "d", "ACTIVE", "0 0 * * *", None, None, None)], JOBS)
    assert [r.job_id for r in evaluators.missed_heartbeats(jobs, runs, NOW).collect()] == ([1] if missed else [])


def test_queue_stats(spark):
    counts = {"PENDING": 10, "PROCESSING": 5, "COMPLETED": 80, "FAILED": 3, "DEAD_LETTER": 1, "CANCELLED": 1}
    df = spark.createDataFrame([("t", s) for s, n in counts.items() for _ in range(n)], "tenant_id string, status string")
    row = queueops.queue_stats(df).collect()[0]
    assert (row.total_count, row.processing_rate, row.pending_count) == (100, 80.0, 10)
    third = spark.createDataFrame([("t", "COMPLETED")] + [("t", "PENDING")] * 2, "tenant_id string, status string")
    assert queueops.queue_stats(third).collect()[0].processing_rate == 33.33
    assert queueops.queue_stats(df.filter("false")).count() == 0


QUEUE = ("id long, tenant_id string, job_type string, priority int, status string, attempt_count int, max_attempts int, "
         "created_at timestamp_ntz, scheduled_at timestamp_ntz, locked_until timestamp_ntz, assigned_worker string")


@pytest.mark.parametrize("attempts, status, action", [(3, "DEAD_LETTER", "FAILED"), (1, "PENDING", "RETRYING")])
def test_failing_a_queue_item(spark, attempts, status, action):
    queue = spark.createDataFrame([(1, "t", "x", 5, "PROCESSING", attempts, 3, NOW, None, NOW, "w")], QUEUE)
    commands = spark.createDataFrame([(1, "fail", "boom"), (2, "fail", "boom")], "id long, command string, error_message string")
    rows = {r.id: r for r in queueops.queue_transitions(queue, commands, NOW).collect()}
    assert (rows[1].status, rows[1].event_action, rows[1].error_message) == (status, action, "boom")
    assert rows[2].status == "NOT_FOUND"


def test_claims_take_due_unlocked_items_in_order(spark):
    late, early = NOW + timedelta(hours=1), NOW - timedelta(hours=1)
    queue = spark.createDataFrame(
        [(1, "t", "x", 2, "PENDING", 0, 3, early, None, None, None), (2, "t", "x", 1, "PENDING", 0, 3, NOW, NOW, None, None),
         (3, "t", "x", 1, "PENDING", 1, 3, early, late, None, None), (4, "t", "x", 1, "PENDING", 0, 3, early, None, NOW, None),
         (5, "t", "x", 1, "COMPLETED", 0, 3, early, None, None, None)], QUEUE)
    rows = queueops.queue_claims(queue, ["a", "b", "c"], NOW).orderBy("claim_rank").collect()
    assert [(r.id, r.assigned_worker, r.attempt_count) for r in rows] == [(2, "a", 1), (1, "b", 1)]
    assert rows[0].locked_until == NOW + timedelta(minutes=5)


def test_lock_expiry_is_strict(spark):
    queue = spark.createDataFrame(
        [(1, "t", "x", 1, "PROCESSING", 3, 3, NOW, None, NOW - timedelta(seconds=1), "w"),
         (2, "t", "x", 1, "PROCESSING", 1, 3, NOW, None, NOW - timedelta(seconds=1), "w"),
         (3, "t", "x", 1, "PROCESSING", 1, 3, NOW, None, NOW, "w")], QUEUE)
    rows = {r.id: r for r in queueops.queue_timeout_cleanup(queue, NOW).collect()}
    assert (rows[1].status, rows[1].error_message, rows[1].assigned_worker) == ("DEAD_LETTER", "Timed out after 3 attempts", "w")
    assert (rows[2].status, rows[2].assigned_worker, rows[2].locked_until) == ("PENDING", None, None)
    assert rows[3].status == "PROCESSING"


@pytest.mark.parametrize(
    "pattern, level, service, message, hits",
    [("NullPointerException|IOException", "ERROR", "order", "java.lang.nullpointerexception at x", 1),
     ("NullPointerException|IOException", "ERROR", "order", "fine", 0),
     (".*", "INFO", "order", "anything", 0), (".*", "ERROR", "payment", "anything", 1), ("[invalid(", "ERROR", "order", "[invalid(", 0)],
)
def test_log_patterns(spark, pattern, level, service, message, hits):
    df = spark.createDataFrame([(1, "t", service, level, NOW, message)], "id long, tenant_id string, service string, level string, ts timestamp_ntz, message string")
    record = {"tenant_id": "t", "name": "p", "regex_pattern": pattern, "min_level": "ERROR", "service_filter": None}
    assert logs.pattern_hits(df, [record]).count() == hits
    table = spark.createDataFrame([("t", "p", pattern, "ERROR", None, True)],
                                  "tenant_id string, name string, regex_pattern string, min_level string, service_filter string, enabled boolean")
    assert logs.pattern_hits_join(df, table).count() == hits
    other = dict(record, service_filter="billing")
    assert logs.pattern_hits(df, [other]).count() == 0
    good, bad = logs.split_patterns(table)
    assert (good.count(), bad.count()) == ((0, 1) if pattern.startswith("[") else (1, 0))


def test_patterns_are_judged_by_the_engine_that_runs_them(spark):
    given = {r"\p{javaLowerCase}+": True, r"\Qa.b\E": True, r"\x{41}": True, "(?P<n>x)": False, "a{,3}": False, None: False, "": True}
    table = spark.createDataFrame([(p,) for p in given], "regex_pattern string")
    good, bad = logs.split_patterns(table)
    assert {r.regex_pattern for r in good.collect()} == {p for p, ok in given.items() if ok}
    assert bad.count() == 3
    assert [p["regex_pattern"] for p in logs.valid_patterns([{"regex_pattern": p} for p in given])] == [p for p, ok in given.items() if ok]
    df = spark.createDataFrame([(1, "t", "s", "ERROR", NOW, "a.b A")], "id long, tenant_id string, service string, level string, ts timestamp_ntz, message string")
    for minimum, hits in (("ERROR", 1), ("LOUD", 0)):
        record = {"tenant_id": "t", "name": "p", "regex_pattern": r"\Qa.b\E", "min_level": minimum, "service_filter": "\t"}
        assert logs.pattern_hits(df, [record]).count() == hits
        rows = spark.createDataFrame([("t", "p", r"\Qa.b\E", minimum, "\t", True)], "tenant_id string, name string, regex_pattern string, min_level string, service_filter string, enabled boolean")
        assert logs.pattern_hits_join(df, rows).count() == hits


@pytest.mark.parametrize("pattern, needed", [
    ("disk full", "disk full"), ("a.bcd+e$", "bcd"), ("^Foo", "foo"), ("a|b", ""), ("(ab)c", ""), ("ab?c", ""), (r"\bword", ""), ("[ab]cd", ""), ("", ""),
])
def test_needed_literal(spark, pattern, needed):
    df = spark.createDataFrame([(pattern,)], "p string")
    assert df.select(logs.needed_literal(F.col("p")).alias("n")).first().n == needed


def test_ten_thousand_patterns_are_compiled_once_in_a_task(spark):
    rng = random.Random(4)
    messages = [f"Event {rng.randrange(3000)} on NODE{rng.randrange(40)} took {rng.randrange(900)}ms ÉTÉ" for _ in range(400)]
    rows = [(i, f"t{i % 5}", "svc", "ERROR", NOW, m) for i, m in enumerate([*messages, None, ""])]
    df = spark.createDataFrame(rows, "id long, tenant_id string, service string, level string, ts timestamp_ntz, message string")
    kinds = ["event {n} ", "node{k}\\b", "took ({n}|{k})ms", "on node{k}.took", "x{n}", "^event {k}+", "été"]
    table = [(f"t{i % 5}", f"p{i}", kinds[i % 7].format(n=i % 3000, k=i % 40), "INFO", None, True) for i in range(10_000)]
    kind = "tenant_id string, name string, regex_pattern string, min_level string, service_filter string, enabled boolean"
    hits = logs.pattern_hits_join(df, spark.createDataFrame(table, kind))
    tree = hits._jdf.queryExecution().executedPlan().toString()
    assert "regexp_instr" in tree.lower() and "Sort [_regex" in tree
    by_tenant = {}
    for tenant, name, pattern, *_ in table:
        # Case is ignored for ASCII letters only, as the engine does.
        by_tenant.setdefault(tenant, []).append((name, re.compile(pattern, re.I | re.A) if pattern.isascii() else re.compile(pattern)))
    want = {(i, name) for i, tenant, *_, m in rows for name, p in by_tenant[tenant] if p.search(m or "")}
    assert {(r.id, r.pattern) for r in hits.collect()} == want and len(want) > 5000


def test_search_in_any_script(spark):
    texts = ["日本 語", "über alles", "ber x", "naïve", "plain"]
    df = spark.createDataFrame([(i, "t", "INFO", NOW, m) for i, m in enumerate(texts)], "id long, tenant_id string, level string, ts timestamp_ntz, message string")
    for asked, found in (("日本", [0]), ("ÜBER", [1]), ("naïve", [3]), ("na", []), ("!!", [])):
        assert [r.id for r in logs.log_search(df, "t", asked).collect()] == found


def test_retention_is_applied(spark, tmp_path):
    schema = "id long, tenant_id string, ts timestamp_ntz"
    rows = [(1, "a b", datetime(2024, 1, 1)), (2, "a b", datetime(2024, 1, 20)), (3, "c", datetime(2023, 1, 1))]
    df = logs.prepare_logs(spark.createDataFrame(rows, schema), NOW)
    policies = spark.createDataFrame([("a b", 14, True), ("c", 1, False)], "tenant_id string, retention_days int, enabled boolean")
    assert {r.id for r in logs.retained_logs(df, policies, datetime(2024, 1, 31).date()).collect()} == {2, 3}
    assert {r.id for r in logs.retained_logs(df, policies, datetime(2024, 1, 31).date(), 30).collect()} == {2}
    path = str(tmp_path / "logs")
    logs.write_logs(df, path)
    expired = logs.expired_log_partitions(df, policies, datetime(2024, 1, 31).date())
    assert logs.drop_partitions(spark, path, expired) == 1
    assert {r.id for r in spark.read.parquet(path).collect()} == {2, 3}


def test_search_matches_whole_words_in_any_case(spark):
    df = spark.createDataFrame([(1, "t", "INFO", NOW, "Disk-FULL on node7"), (2, "t", "INFO", NOW, "diskfull"), (3, "u", "INFO", NOW, "disk")],
                               "id long, tenant_id string, level string, ts timestamp_ntz, message string")
    assert [r.id for r in logs.log_search(df, "t", "disk, cpu").collect()] == [1]
    assert logs.log_search(df, "t", "  ").count() == 2
    assert logs.log_search(df, "t", None, "WARN").count() == 0


def test_templates(spark):
    template = "Job {{jobName}} has triggered alert {{alertName}}. Status: {{status}}{{end}}"
    variables = F.create_map(*(F.lit(x) for x in ("jobName", "etl", "alertName", "slow {{status}}", "status", "$1\\")))
    assert value(spark, text.render_template(F.col("t"), variables), t=template) == (
        "Job etl has triggered alert slow {{status}}. Status: $1\\{{end}}")
    assert value(spark, text.render_template(F.col("t"), variables), t="") == ""


def test_rate_limit_rejects_at_the_limit(spark):
    sent = spark.createDataFrame([(i, "t", "EMAIL", NOW - timedelta(seconds=i)) for i in range(150)] + [(900, "t", "WEBHOOK", NOW)],
                                 "id long, tenant_id string, channel string, created_at timestamp_ntz")
    rows = {r.channel: r for r in notify.rate_limit_status(sent, NOW, 1, notify.HOURLY_LIMITS).collect()}
    assert rows["EMAIL"].limited and rows["EMAIL"].sent == 150
    assert not rows["WEBHOOK"].limited and rows["WEBHOOK"].channel_limit == 100
    assert notify.rate_limit_accepted(sent, notify.HOURLY_LIMITS).filter("channel = 'EMAIL'").count() == 100


@pytest.mark.parametrize("length, expected", [(153, 160), (154, 160), (400, 160)])
def test_sms_length(spark, length, expected):
    out = value(spark, text.sms_text(F.lit("Hello"), F.col("b")), b="x" * length)
    assert len(out) == expected and out.endswith("...") == (length > 153)


def test_payload_helpers(spark):
    assert value(spark, text.json_escaped(F.col("x")), x='a"b\nc') == 'a\\"b\\nc'
    assert value(spark, text.slack_channel(F.col("x")), x="ops") == "#ops"
    assert value(spark, text.slack_channel(F.col("x")), x="#ops") == "#ops"
    assert value(spark, text.truncated(F.col("x"), 12), x="abcdefghijklm") == "abcdefghijkl..."
    assert value(spark, text.truncated(F.col("x"), 12), x="abcdefghijkl") == "abcdefghijkl"


@pytest.mark.parametrize(
    "sql, names",
    [("SELECT * FROM users WHERE id = 1", {"select_star"}),
     ("SELECT id FROM invoices WHERE user_id NOT IN (SELECT id FROM blocked)", {"not_in"}),
     ("SELECT * FROM products WHERE name LIKE '%widget%'", {"select_star", "leading_wildcard"}),
     ("SELECT id FROM users ORDER BY created_at DESC", {"order_without_limit"}),
     ("SELECT DISTINCT email FROM users JOIN bills ON users.id = bills.user_id", {"distinct"}),
     ("SELECT id FROM users WHERE name = 'x' OR email = 'y'", {"or_conditions"}),
     ("SELECT id FROM users WHERE id = 1 ORDER BY id LIMIT 5", {"or_conditions"}),
     ("SELECT count(*) FROM users HAVING count(*) > 1", {"having_without_group"}),
     ("SELECT id, name FROM users WHERE id = 1 LIMIT 10", set())],
)
def test_query_lint(spark, sql, names):
    advice = value(spark, querylog.suggest_rewrites(F.col("q")), q=sql)
    assert set(advice) == {querylog.ADVICE[n] for n in names}


def test_fingerprints_ignore_literals_and_spacing(spark):
    a = value(spark, text.query_normal_form(F.col("q")), q="SELECT  * FROM t\n WHERE a = 'x''y' AND b1 = 42 ")
    assert a == "select * from t where a = ?? and b1 = ?"
    assert len(value(spark, text.query_fingerprint(F.col("q")), q="select 1")) == 32


@pytest.mark.parametrize("hit, read, pct", [(0, 0, 30.0), (0, 10, 90.0), (10, 0, 20.0), (50, 50, 55.0)])
def test_improvement(spark, hit, read, pct):
    assert value(spark, querylog.estimated_improvement(F.col("h"), F.col("r")), h=hit, r=read) == pct


def test_streaks_start_over_after_success(spark):
    marks = ["FAILED", "FAILED", "RUNNING", "FAILED", "SUCCESS", "FAILED", "TIMEOUT", "FAILED"]
    runs = spark.createDataFrame(
        [(i, 1, "t", s, NOW + timedelta(minutes=40 * i), None, None) for i, s in enumerate(marks)], RUNS)
    for hot_rows in (2, 1_000_000):
        got = {r.id: r.consecutive_failures for r in rollups.failure_streaks(runs, hot_rows).collect()}
        assert got == {0: 1, 1: 2, 3: 3, 5: 1, 7: 2}


def test_refresh_replaces_whole_hours_only(spark, tmp_path):
    at = datetime(2024, 1, 10, 12, 20)
    assert rollups.refresh_bounds(at, timedelta(hours=3), timedelta(hours=1)) == (
        datetime(2024, 1, 10, 10), datetime(2024, 1, 10, 11))
    runs = [(i, 1, "t", "SUCCESS", datetime(2024, 1, 10, 8) + timedelta(minutes=10 * i), None, i) for i in range(24)]
    path = str(tmp_path / "rollup")
    rollups.write_rollup(rollups.hourly_rollup(spark.createDataFrame(runs[:14], RUNS)), path)
    rollups.write_rollup(rollups.refreshed_buckets(spark.createDataFrame(runs, RUNS), at), path)
    got = {r.bucket.hour: r.total_runs for r in spark.read.parquet(path).collect()}
    assert got == {8: 6, 9: 6, 10: 6}


def test_chunks_round_trip_and_expire_whole(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    path = str(tmp_path / "chunks")
    tables.write_chunks(df, path, "at", ["id"])
    part = tables.read_chunks(spark, path, "at", datetime(2024, 1, 10), datetime(2024, 1, 12))
    assert sorted(r.id for r in part.collect()) == [9, 10, 11]
    assert "PartitionFilters: [isnotnull(chunk_date" in part._jdf.queryExecution().toString()
    expired = tables.expired_chunks(df, "at", datetime(2024, 2, 1), 14).collect()
    assert {r.chunk_start for r in expired} == {datetime(2023, 12, 28), datetime(2024, 1, 4), datetime(2024, 1, 11)}


def test_upsert_refuses_stale_versions(spark):
    schema = "k int, v string, version int, updated_at timestamp_ntz"
    base = spark.createDataFrame([(1, "a", 4, NOW), (2, "b", 1, NOW)], schema)
    changes = spark.createDataFrame([(1, "a2", 4, NOW), (1, "a3", 4, NOW + timedelta(1)), (2, "b2", 0, NOW), (3, "c", 0, NOW)], schema)
    stored, conflicts = tables.versioned_upsert(base, changes, ["k"])
    assert {(r.k, r.v, r.version) for r in stored.collect()} == {(1, "a2", 5), (2, "b", 1), (3, "c", 0)}
    assert {(r.k, r.v) for r in conflicts.collect()} == {(2, "b2"), (1, "a3")}


def test_upsert_ties_and_several_new_rows(spark):
    schema = "k int, v string, version int, updated_at timestamp_ntz"
    base = spark.createDataFrame([(1, "a", 4, NOW)], schema)
    changes = spark.createDataFrame([(1, "x", 4, NOW), (1, "y", 4, NOW), (5, "n", 0, NOW), (5, "m", 0, NOW + timedelta(1))], schema)
    stored, conflicts = tables.versioned_upsert(base, changes, ["k"])
    assert {(r.k, r.version) for r in stored.collect()} == {(1, 5), (5, 0)}
    assert len(conflicts.collect()) == 2


def test_patches_and_created_rows(spark):
    base = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k int, v string, n int")
    patches = spark.createDataFrame([(1, None, 7, 1), (1, "z", 9, 2), (8, "q", 1, 1)], "k int, v string, n int, sent int")
    got = tables.apply_patch(base, patches, ["k"], [F.asc("sent")]).collect()
    assert {tuple(r) for r in got} == {(1, "a", 7), (2, "b", 3)}
    rows = spark.createDataFrame([(2, "c", 0), (3, "d", 1)], "k int, v string, n int")
    assert {tuple(r) for r in tables.create_or_update(base, rows, ["k"]).collect()} == {(1, "a", 2), (2, "c", 0), (3, "d", 1)}


def test_whole_numbers_between_tabs_and_line_breaks(spark):
    df = spark.createDataFrame([("\t 5\n",), ("5 5",), (" \r\n",), (None,)], "t string")
    got = df.select(text.whole_number(F.col("t")).alias("n"), text.is_blank(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(5, False), (None, False), (None, True), (None, True)]


def test_tags_and_scope(spark):
    jobs = spark.createDataFrame([("a", "j", ["x", "y"], {"k": "v", "l": "w"}), ("b", "j", ["y"], {})],
                                 "tenant_id string, name string, tags array<string>, metadata map<string,string>")
    assert tables.jobs_by_tags(jobs, ["x", "q"]).count() == 1
    assert tables.jobs_by_tags(jobs, ["x", "y"], every=True).count() == 1
    assert [r.metadata["l"] for r in tables.scoped(jobs, "a").collect()] == ["w"]
    assert tables.scoped(jobs, "b", name="j").count() == 1


def test_row_rules_split_and_extend(spark):
    df = spark.createDataFrame([("EMAIL", "a@b", None, 5), (" ", "", "s" * 501, 0), ("SMS", "r" * 501, None, None)],
                               "channel string, recipient string, subject string, priority int")
    valid, invalid = quality.split_valid(df, [*quality.NOTIFICATION_RULES, quality.one_of("channel", ("EMAIL", "SMS"), "odd channel")])
    assert valid.count() == 1
    assert {tuple(r.violations) for r in invalid.collect()} == {
        ("Channel is required", "Recipient is required", "Subject must not exceed 500 characters", "Priority must be positive", "odd channel"),
        ("Recipient must not exceed 500 characters",)}


@pytest.mark.parametrize(
    "payload, violations",
    [('{"eventId":"550e8400-e29b-41d4-a716-446655440000","eventType":"QUEUE","timestamp":"2026-01-15T10:30:00Z","source":"job-queue-service","tenantId":"a","queuedJobId":"550e8400-e29b-41d4-a716-446655440000","action":"ENQUEUED","jobType":"x","priority":10}', []),
     ('{"eventId":"550e8400-e29b-41d4-a716-446655440000","eventType":"QUEUE","timestamp":"2026-01-15T10:30:00Z","source":"job-queue-service","tenantId":"a","queuedJobId":"550e8400-e29b-41d4-a716-446655440000","action":"NO","jobType":"x","priority":11,"attemptNumber":0}',
      ["bad action", "bad attemptNumber", "bad priority"]),
     ('{"eventId":"550e8400-e29b-41d4-a716-446655440000","eventType":"ALERT","timestamp":"2026-01-15T10:30:00Z","source":"alerting-service","tenantId":"a","alertId":"550e8400-e29b-41d4-a716-446655440000","ruleId":"550e8400-e29b-41d4-a716-446655440000","action":"RESOLVED","severity":"INFO","alertName":"n","context":{"a":"b"},"extra":1}', ["unknown extra"]),
     ('{"eventId":"550e8400-e29b-41d4-a716-446655440000","eventType":"NOTIFICATION","timestamp":"2026-01-15T10:30:00Z","source":"x","tenantId":"a","notificationId":"550e8400-e29b-41d4-a716-446655440000","action":"SENT","channel":"FAX"}',
      ["bad channel", "missing recipient", "source"]),
     ('{"eventId":"1","eventType":"JOB","timestamp":"not a time","source":"job-monitoring-service","tenantId":"a","jobId":"7","action":"FAILED","jobName":"j","exitCode":"oops","executionEndTime":"2026-13-01T00:00:00Z"}',
      ["bad eventId", "bad executionEndTime", "bad exitCode", "bad jobId", "bad timestamp"]),
     ('{"eventType":"JOB"}', ["missing action", "missing eventId", "missing jobId", "missing jobName", "missing source", "missing tenantId", "missing timestamp"]),
     ("[1", ["eventType", "missing eventId", "missing source", "missing tenantId", "missing timestamp", "not a JSON object"])],
)
def test_event_contract(spark, payload, violations):
    df = spark.createDataFrame([(payload,)], "payload string")
    assert quality.event_contract(df).collect()[0].violations == violations


def test_histogram_quantile_interpolates(spark):
    rows = [("j", 1.0, 10), ("j", 2.0, 90), ("j", float("inf"), 100), ("k", 1.0, 0), ("k", float("inf"), 5)]
    df = spark.createDataFrame(rows, "job string, le double, count long")
    got = {r.job: r.quantile for r in metrics.histogram_quantile(df, ["job"], 0.5).collect()}
    assert got == {"j": 1.5, "k": 1.0}


def test_counter_reset_counts_the_new_value(spark):
    rows = [("s", NOW + timedelta(seconds=60 * i), float(v)) for i, v in enumerate([5, 8, 2, 4])]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")
    (row,) = metrics.metric_rate(df, ["series"], ["series"], 300, 300).collect()
    assert (row["at"], row.rate) == (NOW + timedelta(minutes=5), (3 + 2 + 2) / 300)


def test_retry_delays_double(spark):
    df = spark.createDataFrame([(1, NOW, 3), (2, NOW, 0)], "id int, failed_at timestamp_ntz, tries int")
    rows = queueops.retry_schedule(df, "failed_at", "tries").orderBy("attempt").collect()
    assert [(r.delay_ms, r.total_delay_ms) for r in rows] == [(1000, 1000), (2000, 3000), (4000, 7000)]
    assert rows[2].due_at == NOW + timedelta(seconds=7)


def test_log_entries_from_json(spark):
    texts = ['{"id":"1","tenantId":"t","level":"WARN","message":"m","metadata":{"k":"v"},"timestamp":"2024-01-05T10:00:00Z"}',
             '{"tenantId":"t","message":"no id"}', '{"message":"no tenant"}', "{broken"]
    raw = spark.createDataFrame([(x,) for x in texts], "value string")
    got = {r.message: r for r in events.decode_logs(raw, F.lit(NOW).cast("timestamp")).collect()}
    assert set(got) == {"m", "no id"}
    assert got["m"].ts == datetime(2024, 1, 5, 10) and got["m"].metadata == {"k": "v"}
    assert len(got["no id"].id) == 64 and got["no id"].ts == NOW


def test_table_constraints(spark):
    users = spark.createDataFrame([("a", "x@y", "ADMIN"), ("a", "z@y", "GUEST"), (None, "x@y", "VIEWER")],
                                  "username string, email string, role string")
    report = quality.constraint_report(users, "users", {"username": ["username"], "email": ["email"]}, ["username"],
                                       {"role": schemas.ROLES})
    assert {r.rule: r.violations for r in report.collect()} == {
        "not_null:username": 1, "allowed:role": 1, "unique:username": 1, "unique:email": 1}


def test_metric_alert_needs_the_full_hold_time(spark):
    rows = [("ServiceDown", j, NOW + timedelta(seconds=s), v) for j, s, v in
            [("a", 0, 0.0), ("a", 59, 0.0), ("a", 70, 1.0), ("b", 0, 0.0), ("b", 60, 0.0), ("c", 0, 1.0)]]
    values = spark.createDataFrame(rows, "alertname string, job string, ts timestamp_ntz, value double")
    got = metrics.metric_alerts(values, ["job"]).collect()
    assert [(r.job, r.severity, r.samples) for r in got] == [("b", "critical", 2)]
