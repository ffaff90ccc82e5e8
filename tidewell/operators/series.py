"""Row-window operators over one entity's time line: guarded rollings, returns, smoothing, extrema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def line(entity: str = "entity_id", date: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def full(agg: Column, value: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over a frame, null until the frame holds ``n`` values."""
    return F.when(F.count(value).over(w) >= n, agg.over(w))


def gap_flag(w: WindowSpec, date: str = "trade_date", days: int = 5) -> Column:
    """1 where the previous row is more than ``days`` calendar days back."""
    return F.coalesce((F.datediff(F.col(date), F.lag(date).over(w)) > days).cast("int"), F.lit(0))


def momentum(df: DataFrame, lookback: int, skip: int, price: str = "close", days: int = 5, out: str = "momentum", entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """price[t-skip] / price[t-skip-lookback] - 1, null where a gap lies in the rows it spans."""
    w = line(entity, date)
    df = df.withColumn("_gap", gap_flag(w, date, days))
    broken = F.max("_gap").over(w.rowsBetween(-(lookback + skip - 1), 0))
    value = F.try_divide(F.lag(price, skip).over(w), F.lag(price, skip + lookback).over(w)) - 1
    return df.withColumn(out, F.when(broken == 0, value)).drop("_gap")


def forward_return(df: DataFrame, horizon: int, price: str = "close", days: int = 5, out: str = "fwd_return", entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """price[t+h] / price[t] - 1 and the date it is known, null where a gap lies in rows t+1 .. t+h."""
    w = line(entity, date)
    df = df.withColumn("_gap", gap_flag(w, date, days))
    broken = F.coalesce(F.max("_gap").over(w.rowsBetween(1, horizon)), F.lit(0))
    value = F.try_divide(F.lead(price, horizon).over(w), F.col(price)) - 1
    return df.withColumns({out: F.when(broken == 0, value), "eval_date": F.lead(date, horizon).over(w)}).drop("_gap")


def rolling(df: DataFrame, n: int, price: str = "close", entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Median, mean, volatility of log returns, and extrema of the n rows before today."""
    w = line(entity, date)
    df = df.withColumn("ret", F.log(F.try_divide(F.col(price), F.lag(price).over(w))))
    now, before = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-n, -1)
    return df.withColumns(
        {
            "median": full(F.percentile(price, F.lit(0.5)), F.col(price), now, n),
            "sma": full(F.avg(price), F.col(price), now, n),
            "volatility": full(F.stddev_samp("ret"), F.col("ret"), now, n),
            "prior_high": full(F.max(price), F.col(price), before, n),
            "prior_low": full(F.min(price), F.col(price), before, n),
            "above_sma": F.coalesce(F.col(price) > full(F.avg(price), F.col(price), now, n), F.lit(False)),
        }
    )


def rolling_beta(df: DataFrame, n: int, ret: str = "ret", market: str = "market", entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Covariance with the market over its variance; complete pairs are counted, the variance takes
    every market value of the frame."""
    w = line(entity, date).rowsBetween(-(n - 1), 0)
    pair = F.when(F.col(ret).isNotNull() & F.col(market).isNotNull(), F.lit(1))
    return df.withColumn("beta", F.when(F.count(pair).over(w) >= n, F.try_divide(F.covar_samp(ret, market).over(w), F.var_samp(market).over(w))))


def fractals(df: DataFrame, wing: int = 2, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Strict highs and lows over ``wing`` rows on either side, all present."""
    w = line(entity, date)
    left, right = w.rowsBetween(-wing, -1), w.rowsBetween(1, wing)
    whole = (F.count("high").over(left) == wing) & (F.count("high").over(right) == wing)
    up = whole & (F.col("high") > F.max("high").over(left)) & (F.col("high") > F.max("high").over(right))
    down = whole & (F.col("low") < F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))
    return df.withColumns({"up_fractal": up, "down_fractal": down})


def last_confirmed(df: DataFrame, wing: int = 2, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """The latest up fractal's high and down fractal's low, known ``wing`` rows after they occur."""
    w = line(entity, date)
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    df = fractals(df, wing, entity, date)
    df = df.withColumns({"_up": F.lag(F.when(F.col("up_fractal"), F.col("high")), wing).over(w), "_down": F.lag(F.when(F.col("down_fractal"), F.col("low")), wing).over(w)})
    return df.withColumns({"swing_high": F.last("_up", True).over(seen), "swing_low": F.last("_down", True).over(seen)}).drop("_up", "_down")


def smoothed(df: DataFrame, value: str, period: int, out: str, entity: str = "entity_id", date: str = "trade_date", block: int = 256) -> DataFrame:
    """Smoothed moving average: the mean of the values in the first ``period`` rows, then
    (previous * (period - 1) + value) / period; nulls keep the previous one.

    The recurrence is linear, so within a block of rows it is a weighted running sum of r**-k, r =
    (period - 1) / period; each block starts from the one before by an array fold over the few block
    ends, so that powers never overflow however long the line is."""
    r = (period - 1) / period
    w = line(entity, date)
    df = df.withColumn("_n", F.row_number().over(w))
    seed = F.avg(F.when(F.col("_n") <= period, F.col(value))).over(Window.partitionBy(entity))
    later = F.when(F.col("_n") > period, F.col(value))
    df = df.withColumns({"_seed": seed, "_k": F.count(later).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    df = df.withColumn("_block", F.when(F.col("_k") > 0, F.floor((F.col("_k") - 1) / block)).otherwise(F.lit(-1)))
    df = df.withColumn("_i", F.col("_k") - F.col("_block") * block)
    term = F.when((F.col("_n") > period) & F.col(value).isNotNull(), F.col(value) / period * F.pow(F.lit(r), -F.col("_i")))
    inner = Window.partitionBy(entity, "_block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_part", F.coalesce(F.sum(term).over(inner), F.lit(0.0)))
    ends = df.filter("_block >= 0").groupBy(entity, "_block").agg(F.max_by(F.struct("_i", "_part"), F.struct("_i", date)).alias("_end"))
    ends = ends.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("_block", "_end"))).alias("_ends"))
    df = df.join(ends, entity, "left")
    before = F.filter("_ends", lambda e: e["_block"] < F.col("_block"))
    carry = F.aggregate(F.coalesce(before, F.array().cast(df.schema["_ends"].dataType)), F.col("_seed"), lambda s, e: F.pow(F.lit(r), e["_end"]["_i"]) * (s + e["_end"]["_part"]))
    result = F.when(F.col("_n") < period, F.lit(None)).when(F.col("_k") == 0, F.col("_seed")).otherwise(F.pow(F.lit(r), F.col("_i")) * (carry + F.col("_part")))
    return df.withColumn(out, result).drop("_n", "_seed", "_k", "_block", "_i", "_part", "_ends")


def true_range(df: DataFrame, days: int = 5, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Largest of high - low and the moves from yesterday's close; null after a gap."""
    w = line(entity, date)
    prior = F.lag("close").over(w)
    value = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    return df.withColumn("true_range", F.when(gap_flag(w, date, days) == 0, value))


def alligator(df: DataFrame, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Jaw 13/8, teeth 8/5 and lips 5/3 on the median price, shifted forward."""
    w = line(entity, date)
    df = df.withColumn("_mid", (F.col("high") + F.col("low")) / 2)
    for name, period, shift in (("jaw", 13, 8), ("teeth", 8, 5), ("lips", 5, 3)):
        df = smoothed(df, "_mid", period, "_s", entity, date).withColumn(name, F.lag("_s", shift).over(w)).drop("_s")
    return df.drop("_mid")


def regimes(df: DataFrame, value: str, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Runs of equal sign: number, sign, first and last date, rows."""
    w = line(entity, date)
    df = df.filter(F.col(value).isNotNull()).withColumn("_sign", F.signum(value).cast("int"))
    df = df.withColumn("_new", F.coalesce((F.col("_sign") != F.lag("_sign").over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("regime", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(entity, "regime").agg(F.first("_sign").alias("sign"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n"))


def blocks(df: DataFrame, size: int, value: str, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Means of non-overlapping blocks of ``size`` rows; a partial tail is dropped."""
    number = F.floor((F.row_number().over(line(entity, date)) - 1) / size)
    out = df.withColumn("block", number).groupBy(entity, "block").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(date).alias("last_date"))
    return out.filter(F.col("n") == size)


def rolling_blocks(blocks_: DataFrame, window: int, z: float = 1.96, value: str = "mean", order: str = "block") -> DataFrame:
    """Of the means of non-overlapping blocks the trailing mean over ``window`` of them, its standard error,
    interval and label; only where the window is full. One row a block of a whole study."""
    w = Window.orderBy(order).rowsBetween(1 - window, 0)
    out = blocks_.withColumns({"rolling_mean": F.avg(value).over(w), "se": F.stddev_samp(value).over(w) / window**0.5, "_n": F.count(value).over(w)}).filter(F.col("_n") == window).drop("_n")
    out = out.withColumns({"ci_low": F.col("rolling_mean") - z * F.col("se"), "ci_high": F.col("rolling_mean") + z * F.col("se")})
    return out.withColumn("label", F.when(F.col("ci_low") > 0, "positive").when(F.col("ci_high") < 0, "negative").otherwise("indistinguishable from zero"))


def drawdown(df: DataFrame, value: str, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Running peak and fall from it."""
    seen = line(entity, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(value).over(seen)).withColumn("drawdown", F.try_divide(F.col(value), F.col("peak")) - 1)


def roll_spread(df: DataFrame, price: str = "close", least: int = 20, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Roll's spread estimate, as a share of the price, from the covariance of neighbouring log returns;
    null, not 0, where that is not negative or fewer than ``least`` returns are known. n: returns."""
    w = line(entity, date)
    df = df.withColumn("_d", F.log(F.try_divide(F.col(price), F.lag(price).over(w)))).filter("_d is not null")
    df = df.withColumn("_p", F.lag("_d").over(w))
    cov = F.covar_samp("_d", "_p")
    n = F.count("_d")
    return df.groupBy(entity).agg(n.alias("n"), F.when((n >= least) & (cov < 0), 2 * F.sqrt(F.abs(cov))).alias("spread"))


def corwin_schultz(df: DataFrame, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Two-day high-low spread estimate, negative ones floored at 0."""
    w = line(entity, date)
    hl = F.pow(F.log(F.try_divide(F.col("high"), F.col("low"))), 2)
    beta = hl + F.lag(hl).over(w)
    gamma = F.pow(F.log(F.try_divide(F.greatest("high", F.lag("high").over(w)), F.least("low", F.lag("low").over(w)))), 2)
    k = 3 - 2 * 2**0.5
    df = df.withColumns({"_b": beta, "_g": F.when(F.lag("high").over(w).isNotNull(), gamma)})
    alpha = (F.sqrt(2 * F.col("_b")) - F.sqrt("_b")) / k - F.sqrt(F.col("_g") / k)
    return df.withColumn("spread", F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))).withColumn("spread", F.when(F.col("_b").isNotNull() & F.col("_g").isNotNull(), F.col("spread"))).drop("_b", "_g")
