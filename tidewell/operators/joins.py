"""As-of, range and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _asof(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], forward: bool, span: str = "month") -> DataFrame:
    """Both sides in one time line per key, the value carried by a window: no pair of rows is ever
    formed. Right rows of equal time: the one whose values are largest. A left row without a time
    finds nothing, a right row without one is never found.

    Dates and timestamps are cut into spans, and a span is one window partition, so a hot key is many
    tasks. What a span inherits from those before it (after it, forward) is settled on one row a key
    and span and enters the line as its first row."""
    timed = isinstance(left.schema[left_ts].dataType, TIMES) and isinstance(right.schema[right_ts].dataType, TIMES)
    cut = (lambda c: F.trunc(c, span)) if timed else (lambda c: F.lit(None).cast("date"))
    side = F.struct(F.col(right_ts).alias("_at"), *values)
    lefts = left.select(F.col(key).alias("_key"), cut(left_ts).alias("_span"), F.col(left_ts).alias("_ts"), F.lit(0 if forward else 1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    rights = right.filter(F.col(right_ts).isNotNull()).select(F.col(key).alias("_key"), cut(right_ts).alias("_span"), F.col(right_ts).alias("_ts"), F.lit(1 if forward else 0).alias("_side"), F.lit(None).alias("_left"), side.alias("_right"))
    line = lefts.unionByName(rights)
    if timed:
        line = line.unionByName(_inherited(line, forward))
    if forward:
        # descending time: right rows of equal time come before the left row, the largest first
        order = [F.col("_ts").desc_nulls_first(), F.col("_side").desc(), F.col("_right").asc()]
    else:
        order = [F.col("_ts").asc_nulls_first(), F.col("_side"), F.col("_right")]
    w = Window.partitionBy("_key", "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("_hit", F.when(F.col("_ts").isNotNull(), F.last("_right", ignorenulls=True).over(w))).filter("_left is not null")
    return found.select("_left.*", F.col("_hit._at").alias("matched_ts"), *(F.col(f"_hit.{v}").alias(v) for v in values))


def _inherited(line: DataFrame, forward: bool) -> DataFrame:
    """For each key and span the right row that the spans before it (after it, forward) leave over."""
    if forward:
        at = line.groupBy("_key", "_span", "_ts").agg(F.max("_right").alias("_right"))
        tops = at.groupBy("_key", "_span").agg(F.min_by("_right", F.when(F.col("_right").isNotNull(), F.col("_ts"))).alias("_top"))
        order = F.col("_span").desc_nulls_first()
    else:
        tops = line.groupBy("_key", "_span").agg(F.max("_right").alias("_top"))
        order = F.col("_span").asc_nulls_first()
    w = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    types = dict(line.dtypes)
    null = lambda c: F.lit(None).cast(types[c]).alias(c)
    carried_ = tops.select("_key", "_span", F.last("_top", ignorenulls=True).over(w).alias("_right")).filter("_right is not null")
    return carried_.select("_key", "_span", null("_ts"), F.lit(1 if forward else 0).alias("_side"), null("_left"), "_right")


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before it; nulls where there is none."""
    return _asof(left, right, key, left_ts, right_ts, values, False)


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the earliest right row at or after it."""
    return _asof(left, right, key, left_ts, right_ts, values, True)


def asof_with_fallback(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], forward_first: bool = True) -> DataFrame:
    """The first direction where it finds a row, else the other."""
    first, second = (asof_forward, asof_backward) if forward_first else (asof_backward, asof_forward)
    names = ["matched_ts", *values]
    a = first(left, right, key, left_ts, right_ts, values).withColumnsRenamed({n: f"_a_{n}" for n in names})
    both = second(a, right, key, left_ts, right_ts, values)
    hit = F.col("_a_matched_ts").isNotNull()
    return both.select(*left.columns, *(F.when(hit, F.col(f"_a_{n}")).otherwise(F.col(n)).alias(n) for n in names), hit.alias("first_choice"))


def range_flag(left: DataFrame, right: DataFrame, key: str, date: str, other: str, before: int, after: int, name: str = "flagged") -> DataFrame:
    """``left`` with a flag: does ``right`` hold a date of the same key within the days around.

    The dates of a key travel as one sorted array, so rows are not multiplied by matches."""
    dates = right.groupBy(key).agg(F.collect_set(other).alias("_dates"))
    near = F.exists("_dates", lambda d: (d >= F.date_sub(F.col(date), before)) & (d <= F.date_add(F.col(date), after)))
    return left.join(dates, key, "left").withColumn(name, F.coalesce(near, F.lit(False))).drop("_dates")


def nearest(left: DataFrame, options: DataFrame, on: list[str], target: str, candidate: str) -> DataFrame:
    """The candidate nearest to the target, ties to the lower one."""
    gap = F.struct(F.abs(F.col(candidate) - F.col(target)).alias("gap"), F.col(candidate).alias("low"))
    return left.join(options, on).groupBy(*left.columns).agg(F.min_by(candidate, gap).alias("nearest"))


def first_touch(trades: DataFrame, bars: DataFrame, on: list[str], stop: str, target: str, start: str, cutoff: Column, inclusive: bool = True) -> DataFrame:
    """The first bar after entry that reaches stop or target of a long trade; a bar that reaches both
    is a STOP. A stop that opens below fills at the open. Without a touch the exit is the last bar's
    close (TIME)."""
    after = (F.col("ts") >= F.col(start)) if inclusive else (F.col("ts") > F.col(start))
    path = trades.join(bars, on).filter(after & (F.col("ts") <= cutoff))
    kind = F.when(F.col("low") <= F.col(stop), "STOP").when(F.col("high") >= F.col(target), "TARGET")
    fill = F.when(F.col("low") <= F.col(stop), F.least(F.col("open"), F.col(stop))).when(F.col("high") >= F.col(target), F.col(target))
    hit = F.when(kind.isNotNull(), F.struct("ts", kind.alias("kind"), fill.alias("fill")))
    out = path.groupBy(*trades.columns).agg(F.min(hit).alias("hit"), F.max_by("close", "ts").alias("_last"), F.max("ts").alias("_last_ts"))
    return out.select(*trades.columns, F.coalesce("hit.kind", F.lit("TIME")).alias("exit_kind"), F.coalesce("hit.ts", "_last_ts").alias("exit_ts"), F.coalesce("hit.fill", "_last").alias("exit_price"))


def carried(line: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last known value of a column along a key's time line."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn(out, F.last(value, ignorenulls=True).over(w))
