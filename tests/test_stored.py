"""Stored tables: versions, chunks, cursors, log batches."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslake.functions import folders
from opslake.operators import logindex, logs, tables
from opslake.sources import archive, versions
from opslake.streaming import logstore

NOW = datetime(2024, 6, 1)
KIND = "id long, name string, version int, updated_at timestamp_ntz"


def model(rows, changes):
    """The table and the refused changes after a batch, row by row."""
    table, refused, taken = {r[0]: r for r in rows}, [], set()
    for c in sorted(changes, key=lambda c: c[3]):
        stored = table.get(c[0])
        if c[0] not in taken and (stored is None or stored[2] == c[2]):
            table[c[0]] = (c[0], c[1], 0 if stored is None else stored[2] + 1, c[3])
            taken.add(c[0])
        else:
            refused.append(c)
    return sorted(table.values()), sorted(refused)


@pytest.fixture()
def stored(spark, tmp_path):
    rows = [(i, f"n{i}", 1, NOW) for i in range(200)]
    table = versions.VersionedTable(spark, str(tmp_path / "table"))
    table.create(spark.createDataFrame(rows, KIND), ["id"], parts=8)
    return table, rows


def test_batches_rewrite_only_the_parts_they_change(spark, stored):
    table, rows = stored
    rng = random.Random(1)
    for n in range(3):
        changes = [(rng.randrange(210), f"c{n}-{k}", rng.choice([1, 1, 2]), NOW + timedelta(minutes=60 * n + k)) for k in range(3)]
        before = table.head()["folders"]
        refused = table.upsert(spark.createDataFrame(changes, KIND))
        rows, want_refused = model(rows, changes)
        assert sorted(map(tuple, refused.collect())) == want_refused
        assert sorted(map(tuple, table.read().collect())) == rows
        after = table.head()["folders"]
        same = [p for p in before if before[p] == after[p]]
        assert len(same) >= len(before) - 3
    # Versions before are still there until they are cleared away.
    assert table.versions() == list(range(table.head()["version"] + 1))
    assert sorted(map(tuple, table.read(0).collect())) == [(i, f"n{i}", 1, NOW) for i in range(200)]
    table.vacuum(keep=1)
    assert sorted(map(tuple, table.read().collect())) == rows and len(table.versions()) == 1


def test_a_batch_without_a_fitting_change_writes_nothing(spark, stored):
    table, rows = stored
    refused = table.upsert(spark.createDataFrame([(1, "x", 9, NOW)], KIND))
    assert refused.count() == 1 and table.versions() == [0]


def test_a_failed_write_leaves_the_version_before(spark, stored):
    table, rows = stored
    bad = spark.createDataFrame([(1, "x", 1, NOW)], KIND).withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        table.upsert(bad)
    assert table.versions() == [0] and sorted(map(tuple, table.read().collect())) == rows


def test_of_two_writers_one_is_told_to_read_again(spark, stored):
    table, rows = stored
    head = table.head()
    table.upsert(spark.createDataFrame([(1, "first", 1, NOW)], KIND))
    with pytest.raises(versions.StaleVersion):
        table._commit({**head, "version": 1})
    assert {r.name for r in table.read().where("id = 1").collect()} == {"first"}


def test_retention_drops_whole_chunks_by_table(spark, tmp_path):
    as_of = datetime(2024, 6, 5, 12)
    days = [as_of - timedelta(days=d) for d in range(0, 300, 2)]
    paths = {name: str(tmp_path / name) for name in tables.RETENTION_DAYS}
    rows = spark.createDataFrame(list(enumerate(days)), "id long, ts timestamp_ntz")
    for path in paths.values():
        tables.write_chunks(rows, path, "ts", ["id"])
    dropped = tables.drop_expired_chunks(spark, paths, as_of)
    for name, keep in tables.RETENTION_DAYS.items():
        kept = tables.retained_chunks(rows, "ts", as_of, keep)
        assert sorted(r.id for r in spark.read.parquet(paths[name]).collect()) == sorted(r.id for r in kept.collect())
        assert kept.agg(F.min("ts")).first()[0] <= as_of - timedelta(days=keep)  # the chunk across the cutoff is whole
        assert dropped[name]
    assert dropped["alert_history"][-1] < dropped["notifications"][-1] < date(2024, 3, 8)
    assert not any(tables.drop_expired_chunks(spark, paths, as_of).values())
    assert tables.drop_expired_chunks(spark, {"notifications": str(tmp_path / "nowhere")}, as_of) == {"notifications": []}


@pytest.mark.parametrize("down", [(False, False), (True, False), (True, True)])
def test_pages_by_cursor_cover_the_listing_once(spark, down):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, id long")
    order = [("a", down[0]), ("b", down[1]), ("id", False)]
    want = [tuple(r) for r in df.orderBy(*(F.desc(c) if d else F.asc(c) for c, d in order)).collect()]
    got, cursor = [], None
    while True:
        page = tables.page_after(df, order, 7, cursor).collect()
        if not page:
            break
        got += [tuple(r) for r in page]
        cursor = tables.cursor_of(page, order)
    assert got == want and tables.cursor_of([], order) is None


def test_a_cursor_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100_000).withColumnRenamed("id", "n").write.parquet(path)
    page = tables.page_after(spark.read.parquet(path), [("n", False)], 10, {"n": 90_000})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,90000)" in plan and "TakeOrderedAndProject" in plan
    assert [r.n for r in page.collect()] == list(range(90_001, 90_011))


LOGS = "id string, tenant_id string, ts timestamp_ntz, message string"


def log_rows(spark, batch, days=3, per_day=4):
    rows = [
        (f"{batch}-{d}-{i}", f"t {i % 2}", datetime(2024, 1, 1 + d, batch % 24, i), f"m{i}")
        for d in range(days)
        for i in range(per_day)
    ]
    return spark.createDataFrame(rows, LOGS)


def test_packing_bounds_the_files_and_keeps_every_row(spark, tmp_path):
    store = logstore.LogStore(spark, str(tmp_path / "logs"))
    for batch in range(25):
        store.write(log_rows(spark, batch), batch)
    schema = spark.createDataFrame([], LOGS).schema
    before = store.read(schema)
    want = sorted(map(str, before.collect()))
    assert len(want) == 25 * 12 and len(before.inputFiles()) >= 150
    assert store.pack(date(2024, 1, 3)) == 4  # two tenants, two closed days
    assert sorted(map(str, before.collect())) == want  # a reader that listed the old files goes on
    after = store.read(schema)
    assert sorted(map(str, after.collect())) == want
    assert len([f for f in after.inputFiles() if "log_date=2024-01-03" not in f]) == 4
    # A replayed batch adds none; a new one does, and is packed with the rest.
    store.write(log_rows(spark, 7), 7)
    assert sorted(map(str, store.read(schema).collect())) == want
    store.write(log_rows(spark, 25), 25)
    assert store.read(schema).count() == len(want) + 12
    assert store.clear() >= 100 and store.pack(date(2024, 1, 3)) == 4 and store.pack(date(2024, 1, 3)) == 0
    store.clear()
    assert store.read(schema).count() == len(want) + 12
    assert len(store.read(schema, "t 1", date(2024, 1, 1), date(2024, 1, 1)).inputFiles()) == 1
    store.write(log_rows(spark, 25), 25)
    store.write(log_rows(spark, 3), 3)
    assert store.read(schema).count() == len(want) + 12


def test_large_days_get_files_by_their_bytes(spark, tmp_path):
    store = logstore.LogStore(spark, str(tmp_path / "logs"))
    for batch in range(2):
        store.write(log_rows(spark, batch, days=1, per_day=59), batch)
    store.pack(date(2024, 2, 1), file_bytes=1000)
    rows = store.read(spark.createDataFrame([], LOGS).schema)
    assert rows.count() == 118 and len(rows.inputFiles()) > 4


def test_live_parts():
    assert logstore.live_parts([2, 0, 1]) == [0, 1, 2]
    assert logstore.live_parts([-3, 0, 1, 2, 3]) == [-3, 3]
    assert logstore.live_parts([-3, -6, 4, 5, 6]) == [-6, 6]
    assert [logstore.covered_upto(p) for p in (4, -1, -6)] == [4, 0, 5]


def test_a_listing_of_many_folders_takes_no_more_tasks_than_cores(spark, tmp_path):
    rows = [(i, "s", f"m{i}", NOW + timedelta(days=i)) for i in range(60)]
    entries = spark.createDataFrame(rows, "id long, service string, message string, ts timestamp_ntz")
    path, key = str(tmp_path / "archive"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    archive.archive_logs(entries, path)
    before, tracker = spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    found = archive.read_archive(spark, path, entries.schema)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
    assert sorted(map(tuple, found.select(*entries.columns).collect())) == rows


def test_the_term_index_is_the_same_however_its_files_are_dealt_out(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"t{i % 3}", " ".join(rng.choices(["a", "b", "c", "dd", ""], k=9)), NOW + timedelta(hours=i)) for i in range(300)]
    entries = spark.createDataFrame(rows + [(300, "t0", None, NOW)], "id long, tenant_id string, message string, ts timestamp_ntz")
    path = str(tmp_path / "rows")
    logs.write_logs(logs.prepare_logs(entries, NOW), path)
    got = []
    for chars in (100, logindex.TASK_CHARS):
        monkeypatch.setattr(logindex, "TASK_CHARS", chars)
        logindex.extend_index(spark, path, str(tmp_path / f"terms-{chars}"))
        got.append(sorted(map(tuple, logindex.read_index(spark, str(tmp_path / f"terms-{chars}")).collect())))
    assert got[0] == got[1] and len(set(got[0])) == len(got[0]) > 0


def folder_files(root):
    return sorted(f.relative_to(root) for f in root.rglob("*") if f.is_file() and not f.name.startswith((".", "_")))


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_folders_written_by_tasks_are_those_that_spark_writes(spark, tmp_path, monkeypatch, kind):
    keys = ["plain", "a/b=c", "x y", "50%", "{q}[z]^", "é'*\"", "", None, "tab\there", "back\\slash:?#"]
    rows = [(i, keys[i % len(keys)], f"m{i}\n\"ü" if i % 7 else None, NOW + timedelta(days=i % 3) if i % 11 else None) for i in range(200)]
    entries = spark.createDataFrame(rows, "id long, service string, message string, ts timestamp_ntz").withColumn("log_date", F.to_date("ts"))
    for name in ("tasks", "spark"):
        for _ in range(2):  # both append
            folders.append_folders(entries, str(tmp_path / name), ["service", "log_date"], kind)
        monkeypatch.setattr(folders, "mounted", lambda *_: None)
    made = [folder_files(tmp_path / name) for name in ("tasks", "spark")]
    assert {f.parent for f in made[0]} == {f.parent for f in made[1]} and len(made[0]) >= 2 * len({f.parent for f in made[0]})
    assert not list((tmp_path / "tasks").rglob(".part*"))
    schema = "id long, message string, ts timestamp_ntz, service string, log_date date"
    got = [sorted(map(str, spark.read.schema(schema).format(kind).load(str(tmp_path / n)).collect())) for n in ("tasks", "spark")]
    assert got[0] == got[1] and len(got[0]) == 400


def test_a_key_larger_than_a_task_holds_is_one_file_of_several_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "HELD_BYTES", 100)
    entries = spark.range(500).selectExpr("id", "'s' AS service", "DATE '2024-01-01' AS log_date").coalesce(1)
    for kind in ("json", "parquet"):
        folders.append_folders(entries, str(tmp_path / kind), ["service", "log_date"], kind)
        assert sorted(r.id for r in spark.read.schema("id long").format(kind).load(str(tmp_path / kind)).collect()) == list(range(500))


def test_a_failed_write_shows_no_file_and_names_are_given_once(spark, tmp_path):
    import pyarrow as pa

    entries = spark.range(50).selectExpr("if(id = 49, raise_error('no'), id) AS id", "id % 5 AS service", "id % 5 AS log_date").coalesce(1)
    with pytest.raises(Exception, match="no"):
        folders.append_folders(entries, str(tmp_path / "failed"), ["service", "log_date"], "json")
    assert not (tmp_path / "failed").exists() or not folder_files(tmp_path / "failed")
    (tmp_path / ".draft").write_text("x")
    batch = pa.RecordBatch.from_pydict({"draft": [str(tmp_path / ".draft")], "final": [str(tmp_path / "final")]})
    for _ in range(2):  # the second is a task that is run again
        assert [b.column(0).to_pylist() for b in folders._publish([batch])] == [[1]]
    (tmp_path / "final").unlink()
    with pytest.raises(FileNotFoundError):
        list(folders._publish([batch]))


def test_an_archive_is_opened_in_parts_and_read_in_few_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"s{i % 4}", f"m{i}", NOW + timedelta(days=i)) for i in range(600)]
    entries = spark.createDataFrame(rows, "id long, service string, message string, ts timestamp_ntz")
    path = str(tmp_path / "archive")
    archive.archive_logs(entries, path)
    for most, parts in ((10_000, 1), (300, 2), (40, 16)):
        monkeypatch.setattr(folders, "MOST_FOLDERS", most)
        found = archive.read_archive(spark, path, entries.schema)
        text = found.filter("service = 's1'")._jdf.queryExecution().executedPlan().toString()
        assert text.count("PartitionFilters: [isnotnull(service") == parts
        assert found._jdf.queryExecution().toRdd().getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism < 150
        assert sorted(map(tuple, found.select(*entries.columns).collect())) == rows
        assert found.columns == ["id", "message", "ts", "service", "log_date"]


def test_the_term_index_has_folders_by_month_and_any_number_of_parts_gives_the_same(spark, tmp_path, monkeypatch):
    words = ["disk", "full", "Node7", "für"]
    rows = [(i, f"t {i % 2}", "INFO", f"{words[i % 4]} {words[i % 3]} {i}", NOW + timedelta(hours=8 * i)) for i in range(400)]
    entries = spark.createDataFrame(rows, "id long, tenant_id string, level string, message string, ts timestamp_ntz")
    path = str(tmp_path / "rows")
    logs.write_logs(logs.prepare_logs(entries, NOW), path)
    got, ran = [], []
    for most in (10_000, 50):
        monkeypatch.setattr(folders, "MOST_FOLDERS", most)
        index = tmp_path / f"terms-{most}"
        spark.sparkContext.setJobGroup(f"index {most}", "")
        logindex.extend_index(spark, path, str(index))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"index {most}") for s in tracker.getJobInfo(j).stageIds]
        ran.append(max(i.numTasks for i in infos if i))
        # 134 days of two tenants lie in five months.
        assert len({f.parent for f in index.rglob("*.parquet")}) == 10
        got.append(sorted(map(str, logindex.read_index(spark, str(index)).collect())))
        for start, end in ((None, None), (NOW + timedelta(days=20), NOW + timedelta(days=45)), (NOW - timedelta(days=9), NOW - timedelta(days=3))):
            for tenant in ("t 1", "none"):
                found = logindex.indexed_search(spark, path, str(index), tenant, "NODE7 3", None, start, end)
                plain = logs.log_search(logs.read_logs(spark, path, tenant, start, end), tenant, "NODE7 3", None, start, end)
                assert found.schema == plain.schema and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert got[0] == got[1] and len(set(got[0])) == len(got[0]) > 400
    assert max(ran) <= 8 * spark.sparkContext.defaultParallelism
    one_day = logindex.files_to_read(spark, path, str(index), "t 1", "disk", NOW + timedelta(days=3), NOW + timedelta(days=3))
    assert len(one_day[1]) == 1 and "log_date=2024-06-04" in one_day[1][0]


def test_a_table_without_its_own_index_is_searched_whole_and_then_indexed(spark, tmp_path):
    path, index = str(tmp_path / "rows"), str(tmp_path / "terms")
    entries = spark.createDataFrame([(1, "t", "INFO", "disk full", NOW)], "id long, tenant_id string, level string, message string, ts timestamp_ntz")
    logs.write_logs(logs.prepare_logs(entries, NOW), path)
    # What an index by days has left there.
    spark.sql("SELECT 'x' AS term, 'y' AS file, 't' AS tenant_id, DATE '2024-06-01' AS log_date").write.partitionBy("tenant_id", "log_date").parquet(index)
    for _ in range(2):
        assert [r.id for r in logindex.indexed_search(spark, path, index, "t", "FULL").collect()] == [1]
        logindex.extend_index(spark, path, index)
    assert logindex.files_to_read(spark, path, index, "t", "empty", None, None)[0] == []
    assert sorted(r.term for r in logindex.read_index(spark, index).collect()) == ["", "disk", "full"]
