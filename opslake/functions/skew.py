"""Joins and ordered work that stay balanced when one key holds a large share of the rows.

Three building blocks cover every operator that would otherwise put a whole
key into one task.  Each first counts rows per key, which combines before its
shuffle.  Without a large key the plain Spark form is used; a large key is cut
into as many parts as its size asks for:

* ``salted_join`` spreads it over copies of its rows of the small side.
* ``scan`` computes running sums, maxima and last values in slices of equal row counts: a
  pass over one summary row per slice carries values in, and a local window
  does the rest.
* ``exact_quantile`` finds a percentile from value counts in bands of bounded
  width, so no task ever sees all values of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize

# More rows than this of one key are not left to one task.
HOT_ROWS = 1_000_000
# Approximate quantiles cut unevenly, so cut finer than the average asks for.
SLICES_PER_SHARE = 4
MOST_SLICES = 2000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int, *also: Column) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and their count ``_n``, or None.

    There are at most rows / hot_rows of them.  They are read back from a table
    of known size, so Spark broadcasts them only while they are small.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_n"), *also).filter(F.col("_n") > hot_rows)
    return None if large.isEmpty() else materialize(large, "hot-keys")


def with_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of ``hot`` to the rows of its keys, nulls to all others."""
    renamed = hot.select(*(F.col(k).alias(f"_hot_{k}") for k in keys), *(c for c in hot.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(renamed, same, "left").drop(*(f"_hot_{k}" for k in keys))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark, by its size estimate and threshold, would broadcast this side."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= int(threshold)


def outgrows_broadcast(df: DataFrame) -> bool:
    """Whether a side that Spark would broadcast is larger than its threshold.

    The estimate goes by the bytes of compressed files.  Here rows count, each with the default
    width of its columns; no more rows are counted than fit.
    """
    threshold = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    most = threshold // df._jdf.schema().defaultSize()
    return df.limit(most + 1).count() > most


def only_told_small(df: DataFrame) -> bool:
    """Whether Spark would send a side through the driver that is larger than its threshold."""
    return fits_broadcast(df) and outgrows_broadcast(df)


def plain_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of sides without large keys; where only Spark's estimate makes one of them small, both are sorted and merged."""
    if left.isStreaming or right.isStreaming:
        return left.join(right, on, how)
    merged = any(only_told_small(side) for side in ((left, right) if how == "inner" else (right,)))
    return left.join(right.hint("merge") if merged else right, on, how)


def salted_join(
    large: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Equi-join where a key with many rows in ``large`` is spread over several tasks.

    A small side under Spark's broadcast threshold needs no spreading; one that only its estimate
    puts there is sorted and merged.  Beyond it, rows of a large key go to ``n / hot_rows`` parts
    by ``spread`` (a column that varies within a key), and only the matching rows of the small side
    are repeated.  With a stream on either side it is the plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do a {how} join: rows of the small side are repeated")
    # A stream cannot be counted; its micro-batches are small, and the join is the same at any size.
    streaming = large.isStreaming or small.isStreaming
    if streaming:
        return large.join(small, on, how)
    told_small = fits_broadcast(small)
    if told_small and not outgrows_broadcast(small):
        return large.join(small, on, how)
    hot = hot_keys(large, on, hot_rows)
    if hot is None:
        return large.join(small.hint("merge") if told_small else small, on, how)
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(hot_rows)), F.lit(1)).cast("int")
    left = with_hot(large, hot, on).withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_n")
    right = with_hot(small, hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    return left.join(right.hint("merge") if told_small else right, [*on, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, max or last (last non-null)."""

    how: str
    value: Column
    exclusive: bool = False


def _running(how: str, value: Column, window) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True).over(window)
    return (F.sum(value) if how == "sum" else F.max(value)).over(window)


def _whole(how: str, value: Column, order: list[str]) -> Column:
    if how == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return F.sum(value) if how == "sum" else F.max(value)


#: For ``scan``: large keys are still to be found.
UNKNOWN = object()


def scan(
    points: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, hot=UNKNOWN, **running: Running
) -> DataFrame:
    """Add running values per key, ordered by ``order`` (first column a timestamp).

    Rows must be unique per (keys, order).  Keys of ordinary size are one
    window; a large key is one window per slice of its rows, with the values of
    earlier slices carried in from one summary row per slice.  ``hot`` is what
    ``hot_keys`` gave for these rows, where the caller has it from another scan.
    """
    micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
    hot = hot_keys(points, keys, hot_rows) if hot is UNKNOWN else hot
    rows = points
    for name, spec in running.items():
        rows = rows.withColumn(f"_in_{name}", spec.value)

    def results(window) -> list[Column]:
        out = [F.col(c) for c in points.columns]
        for name, spec in running.items():
            frame = window.rowsBetween(Window.unboundedPreceding, -1 if spec.exclusive else 0)
            value = _running(spec.how, F.col(f"_in_{name}"), frame)
            out.append((F.coalesce(value, F.lit(0)) if spec.how == "sum" else value).alias(name))
        return out

    if hot is None:
        return rows.select(*results(Window.partitionBy(*keys).orderBy(*order)))

    # Slices hold equal numbers of rows, however unevenly the times lie.
    most = hot.agg(F.max("_n")).collect()[0][0]
    slices = min(MOST_SLICES, SLICES_PER_SHARE * -(-most // hot_rows))
    cuts = F.percentile_approx(F.col("_at"), [k / slices for k in range(1, slices)], 10 * slices)
    timed = points.select(*keys, micros.alias("_at"))
    bounds = (
        with_hot(timed, hot, keys).filter("_n is not null").groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts"))
    )
    part = [*keys, "_slice"]
    sliced = (
        with_hot(rows.withColumn("_at", micros), materialize(bounds, "slices"), keys)
        .withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= F.col("_at"))), F.lit(-1)))
        .withColumn("_slice", F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(F.col("_slice")))
        .drop("_at", "_cuts")
        .withColumn("_row", F.lit(True))
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.filter("_slice >= 0")
        .groupBy(*part)
        .agg(*(_whole(s.how, F.col(f"_in_{n}"), order).alias(f"_of_{n}") for n, s in running.items()))
        .select(
            *part,
            F.lit(False).alias("_row"),
            *(_running(s.how, F.col(f"_of_{n}"), earlier).alias(f"_in_{n}") for n, s in running.items()),
        )
    )
    # The carried-in value enters each slice as its first row, so one local
    # window gives the final answer without a join.
    combined = sliced.unionByName(carried, allowMissingColumns=True)
    here = Window.partitionBy(*part).orderBy("_row", *order)
    return combined.select("_row", *results(here)).filter("_row").drop("_row")


def trailing_count(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    seconds: int,
    counted: Column | None = None,
    out: str = "in_window",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per (keys, ts): counted rows with timestamp in ``(ts - seconds, ts]``.

    Every row adds one at its own time and takes it back when it leaves the
    window, so a running sum of these changes is the answer and no frame is
    rescanned.  Rows with the same key and time collapse before the shuffle.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    at_time = rows.groupBy(*keys, ts).agg(F.sum(one).cast("bigint").alias("_n"))
    changes = (
        at_time.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col(ts).alias("at"), F.col("_n").alias("change"), F.lit(True).alias("own")),
                    F.struct(
                        (F.col(ts) + F.expr(f"interval {int(seconds)} seconds")).alias("at"),
                        (-F.col("_n")).alias("change"),
                        F.lit(False).alias("own"),
                    ),
                )
            ).alias("c"),
        )
        .groupBy(*keys, F.col("c.at").alias(ts))
        .agg(F.sum("c.change").alias("_change"), F.max("c.own").alias("_own"))
    )
    # Every time gives two changes at most, so counting the rows' keys finds all large ones without the aggregates.
    hot = hot_keys(rows, keys, max(1, hot_rows // 2))
    totals = scan(changes, keys, [ts], hot_rows, hot, **{out: Running("sum", F.col("_change"))})
    return totals.filter("_own").drop("_change", "_own")


def exact_quantile(
    counts: DataFrame,
    keys: list[str],
    value: str,
    n: str,
    q: float,
    out: str,
    band_bits: int = 12,
) -> DataFrame:
    """Continuous percentile per key from (keys, whole-number value, count) rows.

    A band spans 2**band_bits values, so a (key, band) holds at most that many
    rows whatever the size of the key.  Band totals locate the one or two bands
    with the wanted ranks; only those bands are then ranked value by value.
    """
    part = [*keys, "_band"]
    banded = counts.withColumn("_band", F.shiftright(F.col(value), band_bits))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    position = (F.col("_total") - 1) * F.lit(q)
    located = (
        banded.groupBy(*part)
        .agg(F.sum(n).alias("_band_n"))
        .withColumn("_total", F.sum("_band_n").over(by_key))
        .withColumn("_before", F.coalesce(F.sum("_band_n").over(before), F.lit(0)))
        .withColumn("_lo", F.floor(position))
        .withColumn("_hi", F.ceil(position))
        .withColumn("_frac", position - F.floor(position))
        .filter((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_band_n") > F.col("_lo")))
        .select(*part, "_before", "_lo", "_hi", "_frac")
    )
    inside = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_first")
    last = first + F.col(n)

    def at(rank: str) -> Column:
        return F.max(F.when((first <= F.col(rank)) & (F.col(rank) < last), F.col(value)))

    return (
        banded.join(located, part)
        .withColumn("_first", F.col("_before") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .groupBy(*keys)
        .agg(at("_lo").alias("_lo_value"), at("_hi").alias("_hi_value"), F.max("_frac").alias("_frac"))
        .select(
            *keys,
            ((1 - F.col("_frac")) * F.col("_lo_value") + F.col("_frac") * F.col("_hi_value")).alias(out),
        )
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in ``order``.

    Spark prunes to one row per key in every input partition before the
    shuffle (WindowGroupLimit), so a hot key sends one row per partition.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, pruned before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rank", F.row_number().over(window)).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")
