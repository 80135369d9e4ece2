"""What the physical plans must and must not contain."""

import subprocess
import sys
from datetime import datetime, timedelta

import pytest

from opslake.operators import evaluators, logindex, logs, querylog, rollups
from opslake.plans import registry
from opslake.sources import archive, jdbc
from opslake.sources.fixtures import Domain

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return Domain(spark, DATA)


# The two sequential rules.
PYTHON = {"cooldown_alerts", "alert_feed", "alert_fanout", "alert_repeats", "publish_alerts", "rate_limit_accepted"}
QUERIES = registry.all_queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "InPandas" not in text


def test_newest_rows_are_pruned_before_the_shuffle(t):
    for df in (evaluators.latest_execution(t.job_executions), querylog.top_slow_queries(t.query_log)):
        text = plan(df)
        assert text.index("WindowGroupLimit") < text.rindex("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_filters_and_columns_reach_the_scan(spark, t, tmp_path):
    path = str(tmp_path / "runs")
    t.job_executions.write.parquet(path)
    runs = spark.read.parquet(path)
    text = plan(rollups.failure_counts(runs, datetime(2024, 1, 20)))
    assert "PushedFilters: [IsNotNull(status), IsNotNull(started_at), EqualTo(status,FAILED), GreaterThanOrEqual(started_at" in text
    assert "ReadSchema: struct<job_id:bigint,status:string,started_at:timestamp_ntz>" in text
    fresh = rollups.refreshed_buckets(runs, datetime(2024, 1, 20, 12))
    assert "GreaterThanOrEqual(started_at,2024-01-20T09:00)" in plan(fresh)


def test_logs_prune_partitions(spark, t, tmp_path):
    path = str(tmp_path / "logs")
    logs.write_logs(logs.prepare_logs(t.logs, datetime(2024, 1, 31)), path)
    start, end = datetime(2024, 1, 2), datetime(2024, 1, 4)
    found = logs.log_search(logs.read_logs(spark, path, "t1", start, end), "t1", None, "INFO", start, end)
    assert "PartitionFilters: [isnotnull(tenant_id" in plan(found)
    assert "log_date" in plan(found).split("PartitionFilters")[1].split("]")[0]
    assert found.count() == logs.log_search(t.logs, "t1", None, "INFO", start, end).count() > 0


def test_term_index_prunes_files_and_changes_no_result(spark, tmp_path):
    words = ["alpha", "beta", "Gamma", "日本", "über", "x-ray", "naïve", "m²"]
    path, index = str(tmp_path / "logs"), str(tmp_path / "terms")
    kind = "id long, tenant_id string, level string, ts timestamp_ntz, message string"

    def add(day, numbers):
        for n in numbers:  # a file for each word
            row = (n, "t 1", "INFO", datetime(2024, 1, day, n % 24), f"it said {words[n % len(words)]} again")
            logs.write_logs(logs.prepare_logs(spark.createDataFrame([row], kind), datetime(2024, 1, 31)).coalesce(1), path)

    add(2, range(8))
    logindex.extend_index(spark, path, index)
    asked = ("ALPHA", "alpha gamma", "日本", "ÜBER", "ray", "nai", "m²", "!!", "", "said")

    def check():
        for query in asked:
            plain = logs.log_search(logs.read_logs(spark, path, "t 1"), "t 1", query)
            found = logindex.indexed_search(spark, path, index, "t 1", query)
            assert found.schema == plain.schema
            assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())), query

    check()
    chosen, every = logindex.files_to_read(spark, path, index, "t 1", "alpha gamma", None, None)
    assert len(every) == 8 and len(chosen) == 2
    assert len(logindex.indexed_search(spark, path, index, "t 1", "alpha").inputFiles()) == 1
    # Files that the index does not know yet are read whole.
    add(3, range(8, 12))
    check()
    assert len(logindex.files_to_read(spark, path, index, "t 1", "beta", None, None)[0]) == 5
    logindex.extend_index(spark, path, index)
    logindex.extend_index(spark, path, index)
    check()
    assert len(logindex.files_to_read(spark, path, index, "t 1", "beta", None, None)[0]) == 2
    assert logindex.files_to_read(spark, path, index, "t 1", "beta", datetime(2024, 1, 3), None)[0][0].count("2024-01-03")
    entries = logindex.read_index(spark, index)
    assert entries.count() == entries.distinct().count()


def test_archive_uses_any_address_and_prunes(spark, t, tmp_path):
    uri = f"file://{tmp_path}/2024-01-31/archive"
    archive.archive_logs(t.logs, uri)
    one = archive.read_archive(spark, uri, t.logs.schema).filter("service = 'src1'")
    assert "PartitionFilters: [isnotnull(service" in plan(one)
    assert one.count() == t.logs.filter("service = 'src1'").count() > 0
    assert list(tmp_path.rglob("*.json.gz"))


def test_missing_ids_and_times_are_filled(spark):
    rows = [(None, "t", None, "a"), ("x", "t", datetime(2024, 1, 5), "b")]
    df = spark.createDataFrame(rows, "id string, tenant_id string, ts timestamp_ntz, message string")
    got = {r.message: r for r in logs.prepare_logs(df, datetime(2024, 1, 31)).collect()}
    assert len(got["a"].id) == 64 and got["a"].log_date.day == 31 and got["b"].id == "x"


def test_one_read_for_the_rollup(spark, t, tmp_path):
    path = str(tmp_path / "runs")
    t.job_executions.write.parquet(path)
    text = plan(rollups.hourly_rollup(spark.read.parquet(path)))
    assert text.count("Scan parquet") == 1 and text.count("Exchange hashpartitioning") == 1
    # Two running values over the same keys and order share one shuffle.
    streaks = plan(rollups.failure_streaks(spark.read.parquet(path)))
    assert streaks.count("Exchange hashpartitioning") == 1 and streaks.count("Scan parquet") == 1


def test_database_reader_asks_for_little():
    sql = jdbc.statements_query(1000, 100)
    assert "mean_exec_time > 1000.0" in sql and sql.endswith("ORDER BY mean_exec_time DESC LIMIT 100")


def test_operators_do_not_read_the_clock(t):
    a = evaluators.missed_heartbeats(t.jobs, t.job_executions, datetime(2024, 1, 31))
    b = evaluators.missed_heartbeats(t.jobs, t.job_executions, datetime(2024, 1, 1) - timedelta(days=1))
    assert a.count() > 0 and b.count() == 0


def test_task_functions_do_not_need_the_package_on_workers():
    from pyspark import cloudpickle

    from opslake.functions import greedy
    from opslake.streaming import jobs

    script = "import pickle, sys; pickle.loads(sys.stdin.buffer.read()); assert 'opslake' not in sys.modules"
    for fn in (greedy._pick_spaced, greedy._summarise_block, greedy._accept_within_limit, jobs.CooldownProcessor()):
        subprocess.run([sys.executable, "-c", script], input=cloudpickle.dumps(fn), cwd="/", check=True, timeout=60)


def test_counters_of_a_large_bucket_are_counted_in_slices(spark, tmp_path, monkeypatch):
    from opslake.plans import metrics as plans

    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 97 % 9000) AS ts"
    events = spark.range(3000).selectExpr("id AS event_id", at, "3L AS user_id")
    events.selectExpr("*", "'view' AS event_type", "CAST(event_id % 40 AS double) AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got, sliced, plain = [], [], plans.scan
    monkeypatch.setattr(plans, "scan", lambda *a, **k: sliced.append(a[4] is not None) or plain(*a, **k))
    for hot_rows in (200, 1_000_000):
        monkeypatch.setattr(plans, "HOT_ROWS", hot_rows)
        got.append(sorted(map(str, plans.response_p95(Domain(spark, str(tmp_path))).collect())))
    assert got[0] == got[1] and len(got[0]) > 1 and sliced == [True, False]
