"""Lists, probes, picks, schedules and ladders: small selections that studies are built from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rows_in(df: DataFrame, column: str, values: Sequence, most: int = 200) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; none, with the same columns, for an empty list.

    Up to ``most`` values are a filter that reaches the scan, more are a semi join."""
    wanted = [v for v in dict.fromkeys(values) if v is not None]
    if not wanted:
        return df.filter(F.lit(False))
    if len(wanted) <= most:
        return df.filter(F.col(column).isin(wanted))
    frame = df.sparkSession.createDataFrame([(v,) for v in wanted], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(frame, column, "left_semi").select(*df.columns)


def prefixed(column: str, starts: Sequence[str], but: Sequence[str] = ()) -> Column:
    """Starts with one of ``starts`` and matches none of the LIKE patterns ``but``."""
    hit = F.lit(False)
    for s in starts:
        hit = hit | F.col(column).startswith(s)
    for pattern in but:
        hit = hit & ~F.col(column).like(pattern)
    return hit


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Does a message hold one of ``words``, whatever the case? A missing message holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.greatest(F.lit(False), F.lit(False), *(low.contains(w.lower()) for w in words)), F.lit(False))


def rows_of_pairs(df: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key (an entity and a session) is listed; a pair listed twice counts once."""
    return df.join(pairs.select(*keys).distinct(), keys, "left_semi").select(*df.columns)


def probed(asks: DataFrame, rows: DataFrame, keys: list[str], out: str = "present") -> DataFrame:
    """``asks`` with a flag: is there any row of the key? All probes at once."""
    there = rows.select(*keys).distinct().withColumn(out, F.lit(True))
    return asks.join(there, keys, "left").select(*asks.columns, F.coalesce(out, F.lit(False)).alias(out))


def at_time(asks: DataFrame, bars: DataFrame, key: str, ts: str, bar_ts: str, values: list[str]) -> DataFrame:
    """Each ask with the values of the bar that starts at exactly its time; nulls without one."""
    found = bars.select(F.col(key), F.col(bar_ts).alias(ts), *(F.col(v).alias(f"at_{v}") for v in values))
    return asks.join(found, [key, ts], "left")


def first_sessions(days: DataFrame, date: str = "trade_date") -> DataFrame:
    """The first session of each month."""
    return days.filter(F.col(date).isNotNull()).groupBy(F.trunc(date, "month").alias("month")).agg(F.min(date).alias(date))


def spaced_schedule(spark: SparkSession, horizons: Sequence[int], anchor: int, last: int, rest: int = 5) -> DataFrame:
    """horizon, minute: signal minutes ``rest`` minutes over a horizon apart from ``anchor``, as long as
    the horizon ends by ``last`` (minutes of the day)."""
    h = spark.createDataFrame([(int(x),) for x in horizons], "horizon int")
    ends = F.lit(last) - F.col("horizon")
    minutes = F.when(ends >= anchor, F.sequence(F.lit(anchor), ends, F.col("horizon") + rest))
    return h.select("horizon", F.explode(minutes).alias("minute"))


def extreme_picks(df: DataFrame, band: str, ident: str, first: str, second: str, each: int = 2) -> DataFrame:
    """From each band the ``each`` rows highest and lowest in ``first``, then of those left the highest
    and the lowest in ``second``, with the reason. A row lacking either value is not eligible."""
    place = lambda *order: F.row_number().over(Window.partitionBy(band).orderBy(*order))
    whole = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    ranked = whole.withColumns({"_h": place(F.col(first).desc(), F.col(ident)), "_l": place(F.col(first), F.col(ident).desc())})
    chosen = (F.col("_h") <= each) | (F.col("_l") <= each)
    # those chosen sort behind the others, so one pass ranks those left
    ranked = ranked.withColumns({"_ph": place(chosen, F.col(second).desc(), F.col(ident)), "_pl": place(chosen, F.col(second), F.col(ident).desc())})
    reason = F.when(F.col("_h") <= each, "high").when(F.col("_l") <= each, "low").when((F.col("_ph") == 1) | (F.col("_pl") == 1), "second")
    return ranked.withColumn("reason", reason).filter("reason is not null").drop("_h", "_l", "_ph", "_pl")


def largest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n`` rows largest in ``order``: a top-k per task, then one of those."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def padded(levels: Column, n: int = 5) -> Column:
    """The first ``n`` entries of an array, filled up with nulls; all nulls for a missing array."""
    none = F.array_repeat(F.lit(None), n)
    return F.slice(F.concat(F.coalesce(levels, F.slice(none, 1, 0)), none), 1, n)


def equal_weight_returns(prices: DataFrame, date: str = "trade_date", entity: str = "entity_id", price: str = "close") -> DataFrame:
    """Mean return from each date to an entity's next row over all entities that have both."""
    nxt = F.lead(price).over(Window.partitionBy(entity).orderBy(date))
    ret = prices.select(date, (F.try_divide(nxt, F.col(price)) - 1).alias("ret")).filter("ret is not null")
    return ret.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("ret"))
