"""Event studies, audits and evaluation reports built from the basic operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import full, line
from .xsection import first_rank


def event_sessions(events: DataFrame, calendar: DataFrame, ts: str = "ts", cutoff_minute: int = 930, entry_after: int = 3) -> DataFrame:
    """Day 0 of each event: the session of its own day if it comes before the cutoff on a trading day,
    else the next session; entry is ``entry_after`` sessions later.

    Calendar days map to the session at or after them in one small table."""
    days = calendar.select("trade_date").distinct()
    order = Window.orderBy("trade_date")
    index = days.withColumns({"session": F.row_number().over(order) - 1, "next_date": F.lead("trade_date").over(order)})
    until = F.coalesce(F.date_sub("next_date", 1), F.col("trade_date"))
    span = index.select(F.explode(F.sequence("trade_date", until)).alias("day"), "trade_date", "session")
    lookup = span.select("day", F.when(F.col("day") == F.col("trade_date"), F.col("session")).otherwise(F.col("session") + 1).alias("at_or_after"), (F.col("day") == F.col("trade_date")).alias("open"))
    minute = F.hour(ts) * 60 + F.minute(ts)
    out = events.join(F.broadcast(lookup), F.to_date(ts) == F.col("day"))
    day0 = F.when(F.col("open") & (minute >= cutoff_minute), F.col("at_or_after") + 1).otherwise(F.col("at_or_after"))
    out = out.withColumn("day0", day0).drop("day", "at_or_after", "open")
    names = index.select("session", "trade_date")
    out = out.join(F.broadcast(names.withColumnsRenamed({"session": "day0", "trade_date": "day0_date"})), "day0", "left")
    entry = F.broadcast(names.select((F.col("session") - entry_after).alias("day0"), F.col("trade_date").alias("entry_date")))
    return out.join(entry, "day0", "left")


def event_windows(panel: DataFrame, events: DataFrame, offsets: list[int], entity: str = "entity_id", date: str = "trade_date", price: str = "close") -> DataFrame:
    """Closes at row offsets around each event's date; events without all of them drop."""
    w = line(entity, date)
    wide = panel.select(entity, date, *((F.lag(price, -k) if k < 0 else F.lead(price, k)).over(w).alias(f"p{k}".replace("-", "m")) for k in offsets))
    return events.join(wide, [entity, date]).dropna(subset=[f"p{k}".replace("-", "m") for k in offsets])


def uncontaminated(events: DataFrame, jumps: DataFrame, start: str, end: str, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Events without a jump in (start, end]; a key's jump dates travel as one array."""
    dates = jumps.groupBy(entity).agg(F.collect_set(date).alias("_d"))
    hit = F.exists("_d", lambda d: (d > F.col(start)) & (d <= F.col(end)))
    return events.join(dates, entity, "left").filter(~F.coalesce(hit, F.lit(False))).drop("_d")


def drawdown_episodes(df: DataFrame, value: str, depth: float, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Spans below a running peak that fall by ``depth`` or more: peak, first breach, trough, recovery."""
    w = line(entity, date).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_peak", F.max(value).over(w)).withColumn("_dd", F.try_divide(F.col(value), F.col("_peak")) - 1)
    rows = rows.withColumn("_id", F.sum((F.col("_dd") == 0).cast("int")).over(w))
    out = rows.groupBy(entity, "_id").agg(
        F.min(date).alias("peak_date"), F.first("_peak").alias("peak"), F.min(F.when(F.col("_dd") <= -depth, F.col(date))).alias("breach_date"),
        F.min_by(date, F.struct("_dd", date)).alias("trough_date"), F.min("_dd").alias("depth"), F.max(date).alias("last_date"),
    )
    return out.filter("breach_date is not null").drop("_id")


def decile_ladder(df: DataFrame, keys: list[str], factor: str, target: str, tie: str, bins: int = 10) -> DataFrame:
    """Mean target of each factor bin per group, ranks without ties."""
    pairs = df.filter(F.col(factor).isNotNull() & F.col(target).isNotNull())
    rank, n = first_rank(keys, factor, tie), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    binned = pairs.withColumn("bin", (F.floor((rank - 1) * bins / n) + 1).cast("int"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"))


def top_minus_rest(ladder: DataFrame, keys: list[str], top: int) -> DataFrame:
    rest = F.col("bin") < top
    return ladder.groupBy(*keys).agg((F.max(F.when(F.col("bin") == top, F.col("mean"))) - F.sum(F.when(rest, F.col("mean") * F.col("n"))) / F.sum(F.when(rest, F.col("n")))).alias("spread"))


def frozen_runs(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Rows whose payload equals the row before, nulls alike."""
    before = F.lag(F.struct(*payload)).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_b", before).filter(F.col("_b").isNotNull() & F.struct(*payload).eqNullSafe(F.col("_b"))).drop("_b")


def reconciliation(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float) -> DataFrame:
    """How two sources of a value differ: pairs, share outside the tolerance, quantiles of the ratio."""
    pairs = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    gap = F.abs(F.try_divide(F.col("_a"), F.col("_b")) - 1)
    q = F.percentile(gap, F.array(*map(F.lit, (0.5, 0.9, 0.99))))
    out = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg((gap > tolerance).cast("double")).alias("outside"), q.alias("q"), F.max(gap).alias("worst"))
    return out.select("pairs", "outside", F.col("q")[0].alias("median"), F.col("q")[1].alias("q90"), F.col("q")[2].alias("q99"), "worst")


def log_audit(log: DataFrame, key: str, ident: str, kind: str, ts: str, first: str, then: str) -> DataFrame:
    """Counts of an event log's faults: repeated ids, steps back in time, outcomes without a signal."""
    back = F.col(ts) < F.lag(ts).over(Window.partitionBy(key).orderBy(ident))
    rows = log.withColumns({"_back": F.coalesce(back.cast("int"), F.lit(0)), "_twice": (F.count(F.lit(1)).over(Window.partitionBy(key, ident)) > 1).cast("int")})
    faults = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum("_back").alias("back_in_time"), F.sum("_twice").alias("repeated_ids"))
    signals = log.filter(F.col(kind) == first).select(key).distinct()
    orphans = log.filter(F.col(kind) == then).join(signals, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("orphans"))
    return faults.join(orphans, key, "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))


def level_touches(trades: DataFrame, panel: DataFrame, levels: list[float], rows: int, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """For each trade and level (a share of the entry price) the number of rows until a high reaches
    it, within ``rows``; null where it does not."""
    # the highs of the next rows travel with each day, so a trade meets its own day's row and no other
    ahead = F.collect_list(F.coalesce("high", F.lit(float("-inf")))).over(line(entity, date).rowsBetween(1, rows))
    path = trades.join(panel.select(entity, date, ahead.alias("_ahead")), [entity, date]).filter(F.size("_ahead") > 0)
    marks = path.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    mark = F.col("entry") * (1 + F.col("level"))
    place = F.filter(F.sequence(F.lit(1), F.size("_ahead")), lambda i: F.get(F.col("_ahead"), i - 1) >= mark)
    return marks.select(*trades.columns, "level", F.get(place, 0).alias("rows_to_touch")).distinct()


def purged_folds(dates: DataFrame, folds: int, purge: int, embargo: int, date: str = "trade_date") -> DataFrame:
    """Contiguous test folds over ordered dates, and for each date how many folds may train on it: not
    its own, none whose test span it precedes by ``purge`` rows or follows by ``embargo`` rows."""
    order = Window.orderBy(date)
    rows = dates.select(date).distinct().withColumn("i", F.row_number().over(order) - 1)
    n = rows.count()
    size = [n // folds + (k < n % folds) for k in range(folds)]
    edges = np.concatenate([[0], np.cumsum(size)]).tolist()
    fold = F.lit(folds - 1)
    for k in range(folds - 2, -1, -1):
        fold = F.when(F.col("i") < edges[k + 1], k).otherwise(fold)
    usable = sum(((F.col("i") < edges[k] - purge) | (F.col("i") >= edges[k + 1] + embargo)).cast("int") for k in range(folds))
    return rows.select(date, fold.alias("fold"), usable.alias("training_folds"))


def bar_gaps_filled(bars: DataFrame, most_seconds: int, keys: list[str], ts: str = "ts", value: str = "price") -> DataFrame:
    """Missing values take the last one of the same session if the valid ticks around them are less
    than ``most_seconds`` apart; tier says how each value came about."""
    w = Window.partitionBy(*keys).orderBy(ts)
    good = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    rows = bars.withColumns({"_p": F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.first(good, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    near = F.unix_timestamp(F.col("_n.t").cast("timestamp")) - F.unix_timestamp(F.col("_p.t").cast("timestamp")) < most_seconds
    tier = F.when(F.col(value).isNotNull(), "OBSERVED").when(F.coalesce(near, F.lit(False)), "FILLED").otherwise("MISSING")
    return rows.withColumn("tier", tier).withColumn("filled", F.when(F.col("tier") == "FILLED", F.col("_p.v")).otherwise(F.col(value))).drop("_p", "_n")


def abnormal_volume(df: DataFrame, short: int, long: int, least: int = 5, volume: str = "volume", entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Mean volume of up rows in the ``short`` rows before each row less that in the ``long`` rows before
    those; null unless both hold ``least`` up rows."""
    w = line(entity, date)
    rows = df.withColumn("_up", F.when(F.col("close") > F.lag("close").over(w), F.col(volume)))
    recent, before = w.rowsBetween(-short, -1), w.rowsBetween(-(short + long), -short - 1)
    return rows.withColumn("abnormal", full(F.avg("_up"), F.col("_up"), recent, least) - full(F.avg("_up"), F.col("_up"), before, least)).drop("_up")


def weekly_reversal(weekly: DataFrame, weeks: int, times: float, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Weeks that fall by more than ``times`` the volatility of the ``weeks`` weeks before, and the
    following week's return from its open."""
    w = line(entity, date)
    rows = weekly.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    before = w.rowsBetween(-weeks, -1)
    rows = rows.withColumns({"sigma": full(F.stddev_samp("ret"), F.col("ret"), before, weeks), "next_return": F.try_divide(F.lead("close").over(w), F.lead("open").over(w)) - 1})
    return rows.filter(F.col("ret") < -times * F.col("sigma"))


def performance(df: DataFrame, ret: str, periods: int, keys: list[str] | None = None) -> DataFrame:
    """CAGR and Sharpe ratio of periodic returns."""
    r = F.col(ret)
    growth = F.exp(F.sum(F.log1p(r)))
    return df.groupBy(*(keys or [])).agg(F.count(r).alias("n"), (F.pow(growth, F.lit(float(periods)) / F.count(r)) - 1).alias("cagr"), (F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * periods**0.5).alias("sharpe"))


def beta_bootstrap(df: DataFrame, y: str, x: str, day: str, length: int, resamples: int, seed: int = 1) -> DataFrame:
    """Slope with a percentile interval from moving blocks of days.

    Each day becomes five sums, so a resample adds small vectors and never sees the rows again."""
    sums = df.dropna(subset=[x, y]).groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"))
    m = sums.orderBy(day).select("n", "sx", "sy", "sxy", "sxx").toPandas().to_numpy(float)
    spark = df.sparkSession
    if len(m) < 2:
        return spark.createDataFrame([], "days long, beta double, low double, high double, p double")
    length = max(1, min(length, len(m)))

    def slope(s: np.ndarray) -> float:
        n, sx, sy, sxy, sxx = s
        return (n * sxy - sx * sy) / (n * sxx - sx * sx)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                starts = np.random.default_rng([seed, int(i)]).integers(0, len(m) - length + 1, -(-len(m) // length))
                out.append(slope(m[(starts[:, None] + np.arange(length)).ravel()[: len(m)]].sum(axis=0)))
            yield pd.DataFrame({"beta": out})

    draws = spark.range(resamples).mapInPandas(draw, "beta double")
    below = F.avg((F.col("beta") <= 0).cast("double"))
    out = draws.agg(F.percentile("beta", F.lit(0.025)).alias("low"), F.percentile("beta", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * F.least(below, 1 - below)).alias("p"))
    return out.select(F.lit(len(m)).cast("long").alias("days"), F.lit(float(slope(m.sum(axis=0)))).alias("beta"), "low", "high", "p")


def residual_bootstrap(df: DataFrame, y: str, x: str, day: str, anchor: str, resamples: int, seed: int = 1) -> DataFrame:
    """p-value of a slope under the imposed null: residuals about each anchor's mean move between days
    of the same anchor, the slope is fitted anew. An observation is a day's anchor (the mean of its
    rows), so days times anchors reach the driver, however many rows; seeds are spread over tasks."""
    cells = df.dropna(subset=[day, anchor, x, y]).groupBy(day, anchor).agg(F.avg(F.col(x).cast("double")).alias("x"), F.avg(F.col(y).cast("double")).alias("y"))
    rows = cells.select(day, anchor, F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).orderBy(day, anchor).toPandas()
    spark = df.sparkSession
    if len(rows) < 3:
        return spark.createDataFrame([], "n long, beta double, p double")
    xs, mean = rows["x"].to_numpy(), rows.groupby(anchor)["y"].transform("mean").to_numpy()
    left, groups = rows["y"].to_numpy() - mean, [np.asarray(g) for g in rows.groupby(anchor).indices.values()]
    centred = xs - xs.mean()

    def beta(v: np.ndarray) -> float:
        return float(centred @ v / (centred @ centred))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                gen, v = np.random.default_rng([seed, int(i)]), np.empty(len(left))
                for g in groups:
                    v[g] = mean[g] + left[gen.choice(g, len(g))]
                out.append(beta(v))
            yield pd.DataFrame({"b": out})

    seen = beta(rows["y"].to_numpy())
    null = spark.range(resamples).mapInPandas(draw, "b double").agg(F.sum((F.abs("b") >= abs(seen)).cast("int")).alias("k"))
    return null.select(F.lit(len(rows)).cast("long").alias("n"), F.lit(seen).alias("beta"), ((F.col("k") + 1) / (resamples + 1)).alias("p"))


def missing_at_random(df: DataFrame, keys: list[str], ident: list[str], share: float, seeds: int) -> DataFrame:
    """How often a group loses a member when each row goes missing with probability ``share``."""
    lost = F.pmod(F.xxhash64("seed", *ident), F.lit(1_000_003)) / 1_000_003 < share
    drawn = df.select(*keys, *[c for c in ident if c not in keys]).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    whole = drawn.groupBy("seed", *keys).agg(F.bool_and(~lost).alias("whole"))
    return whole.groupBy("seed").agg(F.avg((~F.col("whole")).cast("double")).alias("discarded"), F.count(F.lit(1)).alias("groups"))


