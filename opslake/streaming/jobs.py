"""Streaming twins of the batch operators.

Every function takes a streaming DataFrame and returns one, or a
``foreachBatch`` function.  Output of a batch is written under its batch id, so
replaying a batch after a failure replaces its files instead of adding to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from opslake.functions.text import is_blank
from opslake.operators import logs as log_ops
from opslake.operators import notify, rules
from opslake.streaming import events as event_ops
from opslake.streaming.logstore import LogStore


def deduplicated(stream: DataFrame, key: str = "eventId", ts: str = "timestamp", lateness: str = "1 hour") -> DataFrame:
    """First copy of every event; copies further apart than the lateness are not recognised."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def hourly_rollup(executions: DataFrame, lateness: str = "3 hours", accuracy: int = 10_000) -> DataFrame:
    """The roll-up as hours close.  The percentile is a bounded sketch; the batch roll-up has the exact one."""
    duration = F.col("duration_ms")
    return (
        executions.withWatermark("started_at", lateness)
        .groupBy(F.window("started_at", "1 hour").alias("w"), "job_id", "tenant_id")
        .agg(
            F.count("*").alias("total_runs"),
            F.count_if(F.col("status") == "SUCCESS").alias("success_count"),
            F.count_if(F.col("status") == "FAILED").alias("failure_count"),
            F.avg(duration).alias("avg_duration_ms"),
            F.max(duration).alias("max_duration_ms"),
            F.min(duration).alias("min_duration_ms"),
            F.percentile_approx(duration, 0.95, accuracy).alias("p95_duration_ms"),
        )
        .select("job_id", "tenant_id", F.col("w.start").alias("bucket"), F.expr("* except (job_id, tenant_id, w)"))
    )


class CooldownProcessor(StatefulProcessor):
    """Per rule: the time of the last alert."""

    def init(self, handle) -> None:
        self._last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["at_micros", "event_id"], kind="stable")
        last = self._last.get()[0] if self._last.exists() else None
        kept = []
        for i, (at, gap) in enumerate(zip(seen["at_micros"], seen["cooldown_seconds"], strict=True)):
            if last is None or at > last + int(gap) * 1_000_000:
                kept.append(i)
                last = int(at)
        if kept:
            self._last.update((last,))
            yield seen.iloc[kept][["rule_id", "event_id", "at_micros"]].reset_index(drop=True)

    def close(self) -> None:
        pass


def cooldown_alerts(firing: DataFrame) -> DataFrame:
    """Alerts left after each rule's cooldown.  Input: rule_id, event_id, triggered_at, cooldown_seconds.

    Only rows that fire reach the state, and of those one per rule and time;
    the state is one number per rule.
    """
    points = firing.select(
        "rule_id",
        "event_id",
        F.unix_micros("triggered_at").alias("at_micros"),
        F.col("cooldown_seconds").cast("bigint").alias("cooldown_seconds"),
    )
    return (
        points.groupBy("rule_id")
        .transformWithStateInPandas(
            CooldownProcessor(), "rule_id bigint, event_id string, at_micros bigint", "append", "none"
        )
        .select("rule_id", "event_id", F.timestamp_micros("at_micros").alias("triggered_at"))
    )


class RunHistoryProcessor(StatefulProcessor):
    """Per job: runs, successes and failures in a row so far, and what was known at each recent run.

    Events wait until the watermark has passed them and are then taken by time,
    so events that come late, but within the lateness, find their place.  One
    timer is set for each job, at its earliest waiting event.
    """

    def __init__(self, horizon_ms: int):
        self._horizon = horizon_ms

    def init(self, handle) -> None:
        long, text = T.LongType(), T.StringType()
        waiting = [("at", long), ("run", long), ("id", text), ("producer", text), ("action", text), ("body", text)]
        totals = [("runs", long), ("successes", long), ("streak", long), ("timer", long), ("done", long)]
        self._handle = handle
        self._waiting = handle.getListState("waiting", T.StructType([T.StructField(n, t) for n, t in waiting]))
        self._totals = handle.getValueState("totals", T.StructType([T.StructField(n, t) for n, t in totals]))
        known = T.StructType([T.StructField("at", long), T.StructField("streak", long), T.StructField("rate", long)])
        self._known = handle.getMapState("known", T.StructType([T.StructField("run", long)]), known)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["at_micros", "run", "event_id", "producer", "action", "body"]
        fresh = [
            (int(at), int(run), event_id, producer, action, body)
            for frame in rows
            for at, run, event_id, producer, action, body in frame[names].itertuples(index=False)
        ]
        # Spark lets some rows behind the watermark pass; what was told already cannot be told anew.
        done = self._totals.get()[4] if self._totals.exists() else -(1 << 62)
        if fresh := [r for r in fresh if r[0] >= done]:
            self._waiting.appendList(fresh)
            self._wake(min(r[0] for r in fresh))
        return
        yield  # a generator that yields nothing

    def _wake(self, at_micros: int) -> None:
        """Set the job's timer no later than just behind the given time."""
        wanted = at_micros // 1000 + 1
        runs, successes, streak, timer, done = self._totals.get() if self._totals.exists() else (0, 0, 0, -1, -(1 << 62))
        if 0 <= timer <= wanted:
            return
        if timer >= 0:
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(wanted)
        self._totals.update((runs, successes, streak, wanted, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        runs, successes, streak, _, _ = self._totals.get()
        rows = sorted(tuple(r) for r in self._waiting.get())
        # Of one instant runs come first, by number, and then what is said about runs.
        due = sorted((r for r in rows if r[0] < passed), key=lambda r: (r[0], r[3] != "executions", r[1], r[2]))
        out = []
        for at, run, _, producer, action, body in due:
            if producer == "executions":
                runs += 1
                successes += action == "COMPLETED"
                streak = 0 if action == "COMPLETED" else streak + (action == "FAILED")
                failures, rate = streak if action == "FAILED" else None, successes * 100 // runs
                self._known.updateValue((run,), (at, failures, rate))
            else:
                known = self._known.getValue((run,)) if run >= 0 and self._known.containsKey((run,)) else None
                failures = known[1] if known else None
                rate = known[2] if known else (successes * 100 // runs if runs else None)
            out.append((body, failures, rate))
        left = rows[len(due) :]
        if left:
            self._waiting.put(left)
        else:
            self._waiting.clear()
        self._totals.update((runs, successes, streak, -1, passed))
        if left:
            self._wake(left[0][0])
        old = [r for r, v in self._known.iterator() if v[0] < passed - self._horizon * 1000]
        for run in old:
            self._known.removeKey(run)
        if out:
            frame = pd.DataFrame(out, columns=["body", "consecutive_failures", "success_rate"])
            yield frame.astype({"consecutive_failures": "Int64", "success_rate": "Int64"})

    def close(self) -> None:
        pass


def with_run_history(events: DataFrame, lateness: str = "10 minutes", horizon_days: int = 30) -> DataFrame:
    """Job events with ``consecutive_failures`` and ``success_rate`` of their job by then, as the batch context has them.

    Runs are the events of the producer ``executions``.  An event of another
    producer that names a run started less than ``horizon_days`` ago has the
    values of that run, others the rate up to their own time.  Events come out
    once the watermark has passed them; those later than ``lateness`` are
    dropped, as are events without tenant, job, id or time.
    """
    columns = events.columns
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    keyed = events.where("tenant_id is not null and job_id is not null and event_id is not null and event_time is not null")
    rows = keyed.select(
        F.col("event_time").cast("timestamp").alias("_at"),
        "tenant_id",
        "job_id",
        "event_id",
        F.coalesce("producer", F.lit("")).alias("producer"),
        F.coalesce("action", F.lit("")).alias("action"),
        F.coalesce(F.col("execution_id").cast("bigint"), F.lit(-1).cast("bigint")).alias("run"),
        F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), times).alias("body"),
    )
    told = (
        rows.withWatermark("_at", lateness)
        .withColumn("at_micros", F.unix_micros("_at"))
        .groupBy("tenant_id", "job_id")
        .transformWithStateInPandas(
            RunHistoryProcessor(horizon_days * 86_400_000),
            "body string, consecutive_failures bigint, success_rate bigint",
            "append",
            "EventTime",
        )
    )
    event = F.from_json("body", events.select(*(F.col(f"`{c}`") for c in columns)).schema, times)
    return told.select(event.alias("event"), "consecutive_failures", "success_rate").select(
        "event.*", "consecutive_failures", "success_rate"
    )


def evaluate_events(events: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Job events to firing rules: gate, context, stream-static join, condition.

    Rules on failures in a row and on success rates need events that come
    ``with_run_history``; without it they never fire.
    """
    context = rules.event_context(rules.alertable_events(events))
    evaluated = rules.evaluate_rules(context, rule_table)
    return evaluated.filter("fires").select(
        "rule_id",
        "event_id",
        F.col("event_time").cast("timestamp").alias("triggered_at"),
        "cooldown_seconds",
        "tenant_id",
        "job_id",
        "severity",
    )


def rule_alerts(events: DataFrame, rule_table: DataFrame, lateness: str = "10 minutes", horizon_days: int = 30) -> DataFrame:
    """The whole rule engine on a stream of job events: run history, conditions of all types, cooldown."""
    return cooldown_alerts(evaluate_events(with_run_history(events, lateness, horizon_days), rule_table))


class HeartbeatProcessor(StatefulProcessor):
    """Per job: last sign of life, and a timer for when it is overdue."""

    def init(self, handle) -> None:
        self._handle = handle
        fields = [T.StructField("seen", T.LongType()), T.StructField("allowed", T.LongType())]
        self._state = handle.getValueState("state", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, allowed = None, 0
        for frame in rows:
            i = frame["seen_ms"].to_numpy().argmax()
            if seen is None or int(frame["seen_ms"].iloc[i]) > seen:
                seen, allowed = int(frame["seen_ms"].iloc[i]), int(frame["allowed_ms"].iloc[i])
        if self._state.exists():
            before = self._state.get()
            if before[0] >= seen:
                return
            self._handle.deleteTimer(before[0] + before[1] + 1)
        self._state.update((seen, allowed))
        self._handle.registerTimer(seen + allowed + 1)
        return
        yield  # a generator that yields nothing

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, allowed = self._state.get()
        if expiredTimerInfo.getExpiryTimeInMs() == seen + allowed + 1:
            yield pd.DataFrame({"job_id": [key[0]], "last_seen_ms": [seen], "allowed_ms": [allowed]})

    def close(self) -> None:
        pass


def heartbeat_timeouts(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that stay silent past their allowance, reported once per silence by processing time."""
    allowed = F.coalesce("expected_runtime_seconds", F.lit(3600)) + F.coalesce("grace_period_seconds", F.lit(300))
    watched = jobs.filter((F.col("status") == "ACTIVE") & ~is_blank(F.col("cron_expression"))).select(
        "job_id", (allowed.cast("bigint") * 1000).alias("allowed_ms")
    )
    signs = (
        runs.select("job_id", F.unix_millis(F.coalesce("completed_at", "started_at").cast("timestamp")).alias("seen_ms"))
        .join(watched, "job_id")
    )
    return (
        signs.groupBy("job_id")
        .transformWithStateInPandas(
            HeartbeatProcessor(), "job_id bigint, last_seen_ms bigint, allowed_ms bigint", "append", "ProcessingTime"
        )
        .select("job_id", F.timestamp_millis("last_seen_ms").alias("last_seen_at"), "allowed_ms")
    )


class RetryProcessor(StatefulProcessor):
    """Per record: how often it was tried.  A record that fails is tried again after a pause, in all three times."""

    def __init__(self, handle_record: Callable[[str], None], pause_ms: int, fatal: tuple[type[Exception], ...]):
        self._handle_record, self._pause, self._fatal = handle_record, pause_ms, fatal

    def init(self, handle) -> None:
        self._handle = handle
        fields = [T.StructField("payload", T.StringType()), T.StructField("tries", T.IntegerType())]
        self._state = handle.getValueState("record", T.StructType(fields))

    def _attempt(self, key, payload: str, tries: int, now_ms: int) -> pd.DataFrame | None:
        route, error = "handled", None
        try:
            self._handle_record(payload)
        except Exception as failure:  # what a record does to its handler must not end the stream
            error = f"{type(failure).__name__}: {failure}"
            final = isinstance(failure, self._fatal) or tries >= event_ops.MAX_ATTEMPTS
            route = "dead-letter" if final else "retry"
        if route == "retry":
            self._state.update((payload, tries))
            self._handle.registerTimer(now_ms + self._pause)
            return None
        self._state.clear()
        return pd.DataFrame({"id": [key[0]], "payload": [payload], "route": [route], "attempts": [tries], "error_message": [error]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        payloads = [p for frame in rows for p in frame["payload"]]
        if self._state.exists():
            return  # a copy of a record that waits for its next try
        out = self._attempt(key, payloads[0], 1, timerValues.getCurrentProcessingTimeInMs())
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        payload, tries = self._state.get()
        out = self._attempt(key, payload, tries + 1, timerValues.getCurrentProcessingTimeInMs())
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def with_retries(
    records: DataFrame, handle_record: Callable[[str], None], pause_ms: int = 1000, fatal: tuple[type[Exception], ...] = (ValueError,)
) -> DataFrame:
    """What became of every record (``id``, ``payload``): ``route`` handled or dead-letter, the number of tries and the last error.

    ``handle_record`` is called with the payload in the tasks.  A record for
    which it raises is called again after ``pause_ms``, up to three times; an
    error in ``fatal``, such as one of parsing, is not tried again.  Tries are
    state of the stream, so they outlast a restart.  Copies of a record that
    waits count as that record.
    """
    return (
        records.select(F.col("id").cast("string").alias("id"), F.col("payload").cast("string").alias("payload"))
        .groupBy("id")
        .transformWithStateInPandas(
            RetryProcessor(handle_record, pause_ms, fatal),
            "id string, payload string, route string, attempts int, error_message string",
            "append",
            "ProcessingTime",
        )
    )


@contextmanager
def _read_once(batch: DataFrame) -> Iterator[DataFrame]:
    """Keep a batch while several outputs are written from it."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def _replace(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def log_batch_writer(path: str, patterns: list[dict]) -> Callable[[DataFrame, int], None]:
    """Per batch: store the logs and the pattern hits.  ``logstore.LogStore`` packs the logs of closed days."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with _read_once(batch) as rows:
            # Tenant and day come first, so a reader prunes before it lists batches; a batch replaces only its own part.
            LogStore(rows.sparkSession, f"{path}/logs").write(rows, batch_id)
            _replace(log_ops.pattern_hits(rows, patterns), f"{path}/hits", batch_id)

    return write


def raw_log_batch_writer(path: str, value: str = "value", attempts: int = 1) -> Callable[[DataFrame, int], None]:
    """Per batch of raw texts: log entries into the store, records that are none into the dead letters.

    Entries without a time have the time the batch came.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        now = F.current_timestamp()
        with _read_once(batch) as raw, _read_once(event_ops.decode_logs(batch, now.cast("timestamp_ntz"), value)) as entries:
            LogStore(raw.sparkSession, f"{path}/logs").write(entries, batch_id)
            bad = event_ops.log_dead_letters(raw, value).withColumn("attempts", F.lit(attempts))
            bad = bad.withColumns({c: F.lit(None).cast("string") for c in ("tenant_id", "job_type")})
            stored = event_ops.dead_letter_records(
                bad, "id", "tenant_id", "logs", "job_type", value, "error_message", "attempts", now
            )
            _replace(stored, f"{path}/dead_letters", batch_id)

    return write


def decode_batch_writer(path: str, value: str = "value") -> Callable[[DataFrame, int], None]:
    """Per batch: decoded events and dead letters, each in its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with _read_once(event_ops.decode_events(batch, value)) as decoded:
            good = decoded.filter("valid").select("event.*").drop("_corrupt_record")
            _replace(good, f"{path}/events", batch_id)
            _replace(event_ops.dead_letters(decoded, value), f"{path}/dead_letters", batch_id)

    return write


Sink = Callable[[DataFrame, int], None]


def file_sink(path: str) -> Sink:
    """Default channel sink: payload rows as files."""

    def write(rows: DataFrame, batch_id: int) -> None:
        _replace(rows, path, batch_id)

    return write


def delivery_batch_writer(sinks: dict[str, Sink], sent_at: Column | str) -> Callable[[DataFrame, int], None]:
    """Per batch: build payloads of dispatch requests and hand each channel's rows to its sink.

    ``sinks`` maps channel (or route: failure, bounce, log, no_dispatcher) to a
    function; users plug in their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with _read_once(notify.delivery_routes(batch)) as routed:
            payloads = notify.channel_payloads(routed.filter(F.col("route") == "dispatch"), sent_at)
            for name, sink in sinks.items():
                if name in notify.DISPATCHABLE:
                    sink(payloads.filter(F.col("channel") == name), batch_id)
                else:
                    sink(routed.filter(F.col("route") == name), batch_id)

    return write


def publish(messages: DataFrame, path: str | None = None, servers: str | None = None, topic: str | None = None):
    """Writer for keyed messages: a topic (needs the Kafka connector) or JSON files."""
    if topic is not None:
        return messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return messages.writeStream.format("json").option("path", path)
