"""The ordered building blocks against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslake.functions import greedy
from opslake.functions.skew import Running, exact_quantile, fits_broadcast, plain_join, salted_join, scan, trailing_count
from opslake.operators import evaluators
from opslake.sources.fixtures import Domain

START = datetime(2024, 1, 1)


def skewed_rows(n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        rows.append((key, START + timedelta(seconds=rng.randrange(40_000)), i, rng.randrange(200)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v bigint").repartition(5)


@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_scan_matches_a_plain_pass(spark, hot_rows):
    rows = skewed_rows()
    got = {
        r.id: (r.total, r.top, r.prev)
        for r in scan(
            frame(spark, rows),
            ["k"],
            ["ts", "id"],
            hot_rows,
            total=Running("sum", F.col("v")),
            top=Running("max", F.col("v")),
            prev=Running("last", F.when(F.col("v") % 2 == 0, F.col("v")), exclusive=True),
        ).collect()
    }
    state = {}
    for k, ts, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        total, top, prev = state.get(k, (0, None, None))
        total, top_now = total + v, v if top is None else max(top, v)
        assert got[i] == (total, top_now, prev)
        state[k] = (total, top_now, v if v % 2 == 0 else prev)
    assert len(got) == len(rows)


def test_slices_hold_on_outliers_and_bursts(spark):
    """One time decades away and a burst at one second must not put all rows into one slice."""
    rows = [("hot", datetime(1970, 1, 1), -1, 1)]
    rows += [("hot", START + timedelta(seconds=7), 10_000 + i, 1) for i in range(300)]
    rows += [("hot", START + timedelta(milliseconds=i), i, 1) for i in range(2000)]
    got = {r.id: r.total for r in scan(frame(spark, rows), ["k"], ["ts", "id"], 100, total=Running("sum", F.col("v"))).collect()}
    for n, (_, _, i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), start=1):
        assert got[i] == n


@pytest.mark.parametrize("hot_rows", [50, 1_000_000])
def test_trailing_count_half_open_window(spark, hot_rows):
    rows = skewed_rows(800)
    got = {
        (r.k, r.ts): r.in_window
        for r in trailing_count(frame(spark, rows), ["k"], "ts", 900, F.col("v") > 50, hot_rows=hot_rows).collect()
    }
    for k, ts, _, _ in rows:
        want = sum(1 for q, t, _, v in rows if q == k and v > 50 and ts - timedelta(seconds=900) < t <= ts)
        assert got[(k, ts)] == want


def test_quantile_matches_numpy(spark):
    rows = [(k, v * 977 % 50_021) for k, _, _, v in skewed_rows(3000)]
    df = spark.createDataFrame(rows, "k string, v bigint").filter("k is not null")
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.p for r in exact_quantile(counts, ["k"], "v", "n", q, "p", band_bits=6).collect()}
        for key in ("hot", "a", "b", "c"):
            want = np.quantile([v for k, v in rows if k == key], q)
            assert abs(got[key] - want) < 1e-6


def spaced_by_hand(times, gap):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t > last + gap:
            kept.append(t)
            last = t
    return kept


def test_spacing_same_result_on_hot_and_plain_path(spark):
    rows = skewed_rows(4000)
    rows += [("even", START + timedelta(seconds=60 * i), 10_000 + i, 0) for i in range(600)]
    df = frame(spark, rows).filter("k is not null").withColumn("gap", F.when(F.col("k") == "a", 0).otherwise(300))
    for hot_points in (10, 1_000_000):
        got = greedy.keep_spaced(df, "k", "ts", "id", "gap", hot_points).collect()
        for key in ("hot", "a", "b", "even"):
            times = {r[1] for r in rows if r[0] == key}
            want = spaced_by_hand(times, timedelta(seconds=0 if key == "a" else 300))
            assert sorted(r.ts for r in got if r.k == key) == want
            for r in got:
                if r.k == key:
                    assert r.id == min(x[2] for x in rows if x[0] == key and x[1] == r.ts)


def test_spacing_blocks_are_bounded_by_rows(spark):
    """A month of silence and then a burst: no block holds more than its share of the rows."""
    times = [START, START + timedelta(days=30)] + [START + timedelta(days=31, milliseconds=i) for i in range(3000)]
    df = frame(spark, [("k", t, i, 0) for i, t in enumerate(times)]).withColumn("gap", F.lit(2 * 86_400))
    points = df.select(F.col("k").alias("_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    hot = greedy.hot_keys(points.select("_key"), ["_key"], 200)
    sizes = greedy._row_blocks(points, hot, 200).groupBy("_block").count().collect()
    assert max(r["count"] for r in sizes) <= 200 and len(sizes) > 15
    got = greedy.keep_spaced(df, "k", "ts", "id", "gap", 200).collect()
    assert sorted(r.ts for r in got) == spaced_by_hand(times, timedelta(days=2))


def test_spacing_is_strict_at_the_boundary(spark):
    rows = [("k", START + timedelta(seconds=s), s, 0) for s in (0, 300, 301, 601, 602)]
    df = frame(spark, rows).withColumn("gap", F.lit(300))
    for hot_points in (1, 1000):
        got = sorted(r.id for r in greedy.keep_spaced(df, "k", "ts", "id", "gap", hot_points).collect())
        assert got == [0, 301, 602]


def test_rolling_limit_matches_a_plain_pass(spark):
    rows = skewed_rows(3000)
    df = frame(spark, rows).filter("k is not null").withColumn("cap", F.when(F.col("k") == "hot", 7).otherwise(2))
    want, accepted = set(), {}
    for k, ts, i, _ in sorted((r for r in rows if r[0]), key=lambda r: (r[1], r[2])):
        window = [t for t in accepted.setdefault(k, []) if t > ts - timedelta(seconds=3600)]
        if len(window) < (7 if k == "hot" else 2):
            accepted[k].append(ts)
            want.add(i)
    # The later runs cut the large keys where they are quiet.
    for hot_points in (1_000_000, 500, 20):
        got = greedy.keep_within_limit(df, ["k"], "ts", "id", "cap", 3600, hot_points)
        assert {r.id for r in got.collect()} == want


def test_limit_segments_begin_where_a_window_is_quiet(spark):
    minutes = [0, 1, 59, 118, 119, 179, 400, 401, 461, 600]
    points = spark.createDataFrame([("k", m * 60_000_000) for m in minutes], "_key string, _at bigint")
    for hot_rows in (3, 1_000_000):
        got = greedy._quiet_segments(points, 3_600_000_000, hot_rows).collect()
        assert {r._at // 60_000_000: r._segment for r in got} == dict(zip(minutes, [1, 1, 1, 1, 1, 2, 3, 3, 4, 5], strict=True))


def test_salted_join_keeps_every_pair_once(spark):
    rows = skewed_rows(500)
    small = spark.sql("SELECT * FROM VALUES ('hot', 1), ('hot', 2), ('a', 3) AS s(k, w)")
    left = frame(spark, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            assert fits_broadcast(small) == (threshold != "-1")
            for how in ("inner", "left", "left_anti", "left_semi"):
                plain = left.join(small, ["k"], how)
                salted = salted_join(left, small, ["k"], "id", how, hot_rows=20)
                assert ("_salt" in salted._jdf.queryExecution().toString()) == (threshold == "-1")
                assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_side_that_only_its_estimate_makes_small_is_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "small")
    spark.range(20_000).selectExpr("id % 500 AS k", "repeat('x', 50) AS w").write.parquet(path)
    small, left = spark.read.parquet(path), spark.range(600).selectExpr("id % 600 AS k", "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")
        assert fits_broadcast(small)
        for hot_rows in (1_000_000, 0):
            got = salted_join(left, small, ["k"], "id", hot_rows=hot_rows or 1)
            text = got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in text and got.count() == 20_000
            assert "BroadcastExchange" not in text or not hot_rows
        assert "BroadcastHashJoin" in salted_join(left, small.limit(100), ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def threshold(spark):
    """Sets the size up to which Spark broadcasts."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


def test_views_merge_a_lookup_that_only_its_estimate_makes_small(spark, tmp_path, threshold):
    events = "id AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, id AS user_id, 'error' AS event_type, 1D AS value, 'x' AS props"
    spark.range(30_000).selectExpr(*events.split(", ")).write.parquet(str(tmp_path / "events.parquet"))
    customer = "id AS c_custkey, 'c' AS c_name, 3 AS c_nationkey, 0D AS c_acctbal, 'm' AS c_mktsegment"
    spark.range(20_000).selectExpr(*customer.split(", ")).write.parquet(str(tmp_path / "customer.parquet"))
    for size, merged in (("400k", True), ("100m", False)):
        threshold(size)
        t = Domain(spark, str(tmp_path))
        assert fits_broadcast(t.base("customer"))
        for view in (t.job_executions, t.ingest_requests, t.notifications):
            assert ("BroadcastExchange" not in plan_of(view)) == merged == ("SortMergeJoin" in plan_of(view))
            assert view.count() == 20_000
        assert t.jobs.count() == 20_000


def test_joins_of_jobs_merge_sides_that_only_their_estimate_makes_small(spark, tmp_path, threshold):
    paths = [str(tmp_path / name) for name in ("jobs", "runs")]
    jobs = "id AS job_id|'t' AS tenant_id|'n' AS name|'ACTIVE' AS status|1 AS sla_seconds|'x' AS cron_expression|60 AS expected_runtime_seconds|60 AS grace_period_seconds"
    spark.range(20_000).selectExpr(*jobs.split("|")).write.parquet(paths[0])
    runs = "id AS job_id|id|TIMESTAMP_NTZ '2024-01-01 00:00:00' AS started_at|TIMESTAMP_NTZ '2024-01-01 00:00:09' AS completed_at|9000L AS duration_ms"
    spark.range(20_000).selectExpr(*runs.split("|")).write.parquet(paths[1])
    jobs, latest = (spark.read.parquet(p) for p in paths)
    for size, merged in (("400k", True), ("100m", False)):
        threshold(size)
        assert fits_broadcast(jobs) and fits_broadcast(latest)
        for got in (evaluators.sla_violations(jobs, latest, latest), evaluators.missed_heartbeats(jobs, latest, START + timedelta(days=9), latest)):
            assert ("BroadcastExchange" not in plan_of(got)) == merged and got.count() == 20_000
    threshold("400k")
    for how, rows in (("left", 20_000), ("left_anti", 19_900)):
        got = plain_join(jobs, latest.limit(100), ["job_id"], how)
        assert "BroadcastHashJoin" in plan_of(got) and got.count() == rows


def test_accepted_times_that_only_their_estimate_makes_few_are_not_broadcast(spark, threshold):
    rows = spark.range(40_000).selectExpr("id % 400 AS k", "CAST(timestamp_seconds(60 * (id div 400)) AS timestamp_ntz) AS ts", "id", "1 AS gap")
    for size, merged in (("900k", True), ("100m", False)):
        threshold(size)
        got = greedy.keep_spaced(rows, "k", "ts", "id", "gap")
        assert ("BroadcastHashJoin" not in plan_of(got)) == merged and got.count() == 40_000
