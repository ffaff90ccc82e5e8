"""Universes, portfolios, trades and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitemporal import pick_first


def annual_universe(daily: DataFrame, n: int, entity: str = "entity_id", value: str = "turnover", last_month: int = 11) -> DataFrame:
    """The ``n`` entities with the largest median turnover of each complete year, for the year after.

    A year is complete if its last row lies in ``last_month`` or later; ties go by entity."""
    rows = daily.withColumn("year", F.year("trade_date"))
    whole = rows.groupBy("year").agg(F.max(F.month("trade_date")).alias("m")).filter(F.col("m") >= last_month).select("year")
    medians = rows.join(F.broadcast(whole), "year").groupBy("year", entity).agg(F.percentile(value, F.lit(0.5)).alias("median_turnover"))
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.col("median_turnover").desc(), entity))
    return medians.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("for_year", F.col("year") + 1)


def membership_changes(universe: DataFrame, entity: str = "entity_id", year: str = "for_year") -> DataFrame:
    """Entities that enter or leave between neighbouring years."""
    now = universe.select(entity, F.col(year).alias("year"))
    before = universe.select(entity, (F.col(year) + 1).alias("year"))
    years = now.select("year").distinct().join(before.select("year").distinct(), "year")
    came = now.join(before, [entity, "year"], "left_anti").withColumn("change", F.lit("enter"))
    left = before.join(now, [entity, "year"], "left_anti").withColumn("change", F.lit("leave"))
    return came.unionByName(left).join(F.broadcast(years), "year")


def violations(evaluated: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Evaluated keys that were never declared: must be empty."""
    return evaluated.select(*keys).distinct().join(declared.select(*keys), keys, "left_anti")


def holdings(df: DataFrame, score: str, n: int, date: str = "trade_date", entity: str = "entity_id", linear: bool = False) -> DataFrame:
    """The top ``n`` by score on each date with equal or linearly falling weights; ties by entity."""
    w = Window.partitionBy(date).orderBy(F.col(score).desc(), entity)
    top = df.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy(date))
    weight = (size - F.col("rank") + 1) / (size * (size + 1) / 2) if linear else 1 / size
    return top.withColumn("weight", weight)


def turnover(held: DataFrame, dates: DataFrame, date: str = "trade_date", entity: str = "entity_id") -> DataFrame:
    """Half the summed absolute change of weights against the previous rebalance, the first against none."""
    order = Window.orderBy(date)  # rebalance dates: a short calendar
    index = dates.select(date).distinct().withColumn("i", F.row_number().over(order))
    now = held.select(date, entity, "weight").join(F.broadcast(index), date)
    before = now.select(entity, (F.col("i") + 1).alias("i"), F.col("weight").alias("old"))
    moved = now.select("i", entity, "weight").join(before.join(F.broadcast(index.select("i")), "i"), ["i", entity], "full_outer")
    sums = moved.groupBy("i").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("turnover"))
    return sums.join(F.broadcast(index), "i").select(date, "turnover")


def nav(returns: DataFrame, gross: str, cost: str, date: str = "trade_date") -> DataFrame:
    """Compounded value and drawdown of a strategy's rebalance returns (one row a date)."""
    seen = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("nav", F.exp(F.sum(F.log1p(F.col(gross) - F.col(cost))).over(seen)))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(seen), F.lit(1.0)) - 1)


def concurrency(trades: DataFrame, entry: str = "entry_date", exit_: str = "exit_date") -> DataFrame:
    """Open trades after each date's entries and exits."""
    events = trades.select(F.col(entry).alias("date"), F.lit(1).alias("d")).unionByName(trades.select(F.col(exit_).alias("date"), F.lit(-1).alias("d")))
    daily = events.groupBy("date").agg(F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("entries"))
    return daily.select("date", "entries", F.sum("d").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("open_trades"))


def trade_statistics(trades: DataFrame, ret: str, keys: list[str] | None = None) -> DataFrame:
    """Count, hit rate, mean, both standard deviations, profit factor."""
    r = F.col(ret)
    return trades.groupBy(*(keys or [])).agg(
        F.count(r).alias("n"), (F.count_if(r > 0) / F.count(r)).alias("hit_rate"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd_sample"), F.stddev_pop(r).alias("sd_population"),
        F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("profit_factor"),
    )


def swing_signals(df: DataFrame, momentum: str, turnover_: str, short_return: str, volume_ratio: str, market_ok: str, date: str = "trade_date") -> DataFrame:
    """Momentum in the top decile, median turnover in the upper two thirds, five-day return in the bottom
    third, each of the whole cross-section, volume above 1.5 times its mean, and the market above its
    average."""
    w = Window.partitionBy(date)
    edge = lambda c, p: F.percentile(c, F.lit(p)).over(w)
    return df.withColumn(
        "signal",
        F.coalesce((F.col(momentum) >= edge(momentum, 0.9)) & (F.col(turnover_) > edge(turnover_, 1 / 3)) & (F.col(short_return) <= edge(short_return, 1 / 3)) & (F.col(volume_ratio) > 1.5) & F.col(market_ok), F.lit(False)),
    )


def brokerage(turnover_: Column) -> Column:
    """0.1 % of a leg's value, at least 5 and at most 20."""
    return F.greatest(F.lit(5.0), F.least(F.lit(20.0), turnover_ * 0.001))


def delivery_costs(buy: Column, sell: Column) -> Column:
    """Round-trip costs of a delivery trade: brokerage and tax on it, transaction tax (both sides', on the
    sale), exchange and stamp charges, and the depository's flat fee. Rates are fixed values."""
    broker = brokerage(buy) + brokerage(sell)
    exchange = (buy + sell) * 0.0000297
    sebi = (buy + sell) * 0.000001
    return broker + sell * 0.002 + exchange + sebi + buy * 0.00015 + (broker + exchange + sebi) * 0.18 + 23.60


def banded_spread(rank: Column) -> Column:
    """Spread in basis points by liquidity rank; unranked names bear the worst. Fixed values."""
    return F.when(rank.between(1, 50), 2.0).when(rank.between(51, 100), 4.0).otherwise(7.0)


def rebalance_costs(weights: DataFrame, period: str = "period", entity: str = "entity_id") -> DataFrame:
    """``weights`` (period number, entity, weight, tercile; one row a holding) to turnover and cost of each
    period against the one before: half the sum of the changes, and of every increase its tercile's cost
    in basis points, the worst where the tercile is unknown. Fixed values: high 23, mid 32.5, low 118.

    A holding meets its own next period by one aggregate over (entity, period), no join of periods."""
    bps = F.when(F.col("tercile") == "high_liq", 23.0).when(F.col("tercile") == "mid_liq", 32.5).otherwise(118.0)
    now = weights.select(F.col(period), F.col(entity), F.col("weight").alias("new"), F.lit(0.0).alias("old"), bps.alias("bps"))
    then = weights.select((F.col(period) + 1).alias(period), F.col(entity), F.lit(0.0).alias("new"), F.col("weight").alias("old"), F.lit(None).cast("double").alias("bps"))
    last = weights.agg(F.max(period).alias("_last"))
    moves = now.unionByName(then).groupBy(period, entity).agg((F.sum("new") - F.sum("old")).alias("delta"), F.max("bps").alias("bps"))
    out = moves.groupBy(period).agg((F.sum(F.abs("delta")) * 0.5).alias("turnover"), F.sum(F.when(F.col("delta") > 0, F.col("delta") * F.col("bps") / 10_000).otherwise(0.0)).alias("cost"))
    return out.join(F.broadcast(last), F.col(period) <= F.col("_last")).drop("_last")


def whole_shares(risk: float, stop_distance: Column) -> Column:
    """floor(risk / distance to the stop); null for a distance of 0 or less."""
    return F.when(stop_distance > 0, F.floor(F.lit(risk) / stop_distance))


def picks_by_percentile(df: DataFrame, order: list[str], n: int, buckets: int = 256) -> DataFrame:
    """``n`` rows spread evenly over the order, both ends included; none from an empty table.

    Approximate quantiles of the first column (a number or a date) cut the rows into buckets, the
    buckets are counted, and rows are numbered only in those few that hold a place."""
    cuts = df.agg(F.percentile_approx(order[0], [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    edges = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else None
    # a null compares with no edge: it is in bucket 0, where it sorts first
    bucket = F.size(F.filter(edges, lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    placed = df.withColumn("_b", bucket)
    sizes = {r["_b"]: r["count"] for r in placed.groupBy("_b").count().collect()}
    total, before, ranks = sum(sizes.values()), 0, {}
    places = {round(k * (total - 1) / max(1, n - 1)) for k in range(n)} if total else set()
    for b in sorted(sizes):
        inside = sorted(p - before + 1 for p in places if before <= p < before + sizes[b])
        if inside:
            ranks[b] = inside
        before += sizes[b]
    if not ranks:
        return df.filter(F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    wanted = F.create_map(*(x for b, rs in ranks.items() for x in (F.lit(b), F.array(*(F.lit(r) for r in rs)))))
    numbered = placed.filter(F.col("_b").isin(list(ranks))).withColumn("_i", rank)
    return numbered.filter(F.array_contains(wanted[F.col("_b")], F.col("_i"))).drop("_b", "_i")


def stratified_sample(df: DataFrame, keys: list[str], n: int, seed: int, ident: list[str]) -> DataFrame:
    """``n`` rows of each stratum in the order of a seeded hash: the same on every run."""
    return pick_first(df, keys, [F.xxhash64(F.lit(seed), *ident), *ident], n)
