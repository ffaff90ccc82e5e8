"""Candle roll-ups and intraday aggregates. ``ts`` is the start of the bar or the time of the tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def ohlcv(df: DataFrame, keys: list[Column | str], order: list[str], price: str = "price", volume: str = "volume") -> DataFrame:
    """First, highest, lowest, last price and summed volume of each group. First and last go by
    ``order`` (price breaks ties), never by arrival, so the result survives any shuffle."""
    by = F.struct(*order, price)
    return df.groupBy(*keys).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("n_ticks")
    )


def time_bars(ticks: DataFrame, width: str, offset: str = "0 minutes", entity: str = "entity_id") -> DataFrame:
    """Bars of ``width`` anchored at ``offset``; works on batches and streams alike."""
    w = F.window("ts", width, width, offset)
    bars = ohlcv(ticks, [entity, w.alias("w")], ["ts"])
    return bars.select(entity, F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "n_ticks").withColumns(
        {"is_green": F.col("close") > F.col("open"), "is_red": F.col("close") < F.col("open")}
    )


def session_bars(ticks: DataFrame, minutes: int, first_minute: int, last_minute: int, entity: str = "entity_id") -> DataFrame:
    """Bars within a session that starts at ``first_minute`` of the day; the last one may be partial,
    its end is a minute after its last tick's minute."""
    m = minute_of_day(F.col("ts"))
    inside = ticks.filter((m >= first_minute) & (m <= last_minute))
    bucket = F.floor((m - first_minute) / minutes).cast("int")
    by = F.struct("ts", "price")
    bars = inside.groupBy(F.col(entity), F.to_date("ts").alias("session"), bucket.alias("bucket")).agg(
        F.min_by("price", by).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", by).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_ticks"), F.max(m).alias("last_minute")
    )
    return bars.withColumn("start_minute", F.col("bucket") * minutes + first_minute).withColumn("end_minute", F.least(F.col("start_minute") + minutes, F.col("last_minute") + 1))


def weekly_bars(daily: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Weeks labelled by their Monday, from daily bars."""
    return daily.groupBy(entity, F.date_trunc("week", "trade_date").cast("date").alias("week")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.count(F.lit(1)).alias("sessions"),
    )


def session_audit(ticks: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Quality counts of each session in one pass."""
    m = minute_of_day(F.col("ts"))
    return ticks.groupBy(entity, F.to_date("ts").alias("session")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ts").alias("distinct_ts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by("price", F.struct("ts", "price")).alias("last_price"), F.count_if(F.col("price") <= 0).alias("bad_price"), F.count_if(F.col("price").isNull()).alias("null_price"),
        F.count_if((m < 9 * 60 + 15) | (m >= 15 * 60 + 30)).alias("outside_hours"), F.sum(F.when(m < 12 * 60, F.col("volume")).otherwise(F.lit(0))).alias("morning_volume"),
    )


def volume_profile(ticks: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """The price bucket with the most volume, ties to the lowest bucket."""
    bucket = F.floor(F.col("price") / F.lit(width)).cast("bigint")
    sums = ticks.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("volume").alias("volume"))
    return sums.groupBy(*keys).agg(F.max(F.struct("volume", (-F.col("bucket")).alias("low"))).alias("top"), F.sum("volume").alias("total")).select(
        *keys, (-F.col("top.low")).alias("poc_bucket"), F.col("top.volume").alias("poc_volume"), "total"
    )


def bar_category() -> Column:
    """Validity of a bar as a category, in order of precedence."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    prices = (o, h, low, c)
    missing = F.greatest(*(F.coalesce(x.isNull() | F.isnan(x), F.lit(True)).cast("int") for x in (*prices, v))) == 1
    infinite = F.greatest(*((F.abs(x) == F.lit(float("inf"))).cast("int") for x in (*prices, v))) == 1
    return (
        F.when(missing, "missing").when(infinite, "infinite").when(F.least(*prices) <= 0, "non_positive").when(v < 0, "negative_volume")
        .when(h < low, "high_below_low").when((o > h) | (o < low) | (c > h) | (c < low), "outside_range")
        .when((v == 0) & (h != low), "moved_without_volume").when(v == 0, "flat").otherwise("valid")
    )


def breadth(bars: DataFrame, key: str) -> DataFrame:
    """Share of advancing and declining entities at each bar."""
    return bars.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col("close") > F.col("open")) / F.count(F.lit(1))).alias("advancing"), (F.count_if(F.col("close") < F.col("open")) / F.count(F.lit(1))).alias("declining")
    )
