"""Bootstraps, null models and power. Draws come from hashes or per-seed generators: a seed gives the
same result on every run, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def clustered_bootstrap(rows: DataFrame, cluster: str, value: str, resamples: int = 10_000, low: float = 0.0125, high: float = 0.9875, seed: int = 1) -> DataFrame:
    """Mean with a percentile interval from resampling whole clusters, and the smallest effect that
    would be seen. Clusters become (sum, count) first; what is resampled is one row a cluster (days of
    a study), spread over the seeds."""
    sums = rows.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")).orderBy(cluster).toPandas()
    s, n = sums["s"].to_numpy(float), sums["n"].to_numpy(float)
    spark = rows.sparkSession

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means = []
            for i in b["id"]:
                pick = np.random.default_rng([seed, int(i)]).integers(0, len(s), len(s))
                means.append(s[pick].sum() / n[pick].sum())
            yield pd.DataFrame({"resample": b["id"], "mean": means})

    if not len(s):
        return spark.createDataFrame([], "n_clusters long, mean double, se double, low double, high double, mde double")
    draws = spark.range(0, resamples, 1, max(1, min(resamples // 500, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(draw, "resample long, mean double")
    out = draws.agg(F.stddev_samp("mean").alias("se"), F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"))
    return out.select(F.lit(len(s)).cast("long").alias("n_clusters"), F.lit(float(s.sum() / n.sum())).alias("mean"), "se", "low", "high", (F.col("se") * 2.2414).alias("mde"))


def block_bootstrap(values: DataFrame, order: str, value: str, length: int, resamples: int = 2000, seed: int = 1) -> DataFrame:
    """Percentile interval of a mean from moving blocks of a series of one row a day."""
    x = values.filter(F.col(value).isNotNull()).orderBy(order).select(value).toPandas()[value].to_numpy(float)
    spark = values.sparkSession
    if not len(x):
        return spark.createDataFrame([], "n long, mean double, low double, high double")
    length = max(1, min(length, len(x)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                starts = np.random.default_rng([seed, int(i)]).integers(0, len(x) - length + 1, -(-len(x) // length))
                out.append(x[(starts[:, None] + np.arange(length)).ravel()[: len(x)]].mean())
            yield pd.DataFrame({"mean": out})

    draws = spark.range(0, resamples).mapInPandas(draw, "mean double")
    return draws.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high")).select(F.lit(len(x)).cast("long").alias("n"), F.lit(float(x.mean())).alias("mean"), "low", "high")


def numbered(df: DataFrame, on: list[str], spread: int = 1) -> DataFrame:
    """``_i``: 0, 1, ... within each group, and ``_n``, its size. A group is numbered in ``spread``
    parts (by a hash of its rows), each shifted by the sizes of the parts before it."""
    rest = [c for c in df.columns if c not in on]
    part = df.withColumn("_part", F.pmod(F.xxhash64(*rest), F.lit(spread)))
    w = Window.partitionBy(*on)
    sizes = part.groupBy(*on, "_part").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.select(*on, "_part", (F.sum("_c").over(w.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    rows = part.withColumn("_r", F.row_number().over(Window.partitionBy(*on, "_part").orderBy(*rest)))
    # merged, as planned sizes take the numbered rows for a table that can be broadcast
    return rows.hint("merge").join(sizes, [*on, "_part"]).withColumn("_i", F.col("_before") + F.col("_r") - 1).drop("_part", "_before", "_r")


def timing_null(trades: DataFrame, candidates: DataFrame, on: list[str], value: str, seeds: int, ident: list[str], spread: int = 1) -> DataFrame:
    """Mean outcome of each seed when every trade's entry is moved to a random candidate of its day.

    A day's candidates are numbered; each (seed, trade) draws a number by a hash and meets the
    candidate by an equi join."""
    pool = numbered(candidates, on, spread)
    sized = pool.groupBy(*on).agg(F.max("_n").alias("_n"))
    drawn = trades.select(*on, *[c for c in ident if c not in on]).join(sized, on).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    drawn = drawn.withColumn("_i", F.pmod(F.xxhash64("seed", *ident), F.col("_n")))
    return drawn.join(pool.drop("_n"), [*on, "_i"]).groupBy("seed").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash64(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of int32 or int64 numbers, ``before`` being the hash of the columns before."""
    if x.dtype == np.int32:
        h = (before + _P5 + np.uint64(4)) ^ (x.view(np.uint32).astype(np.uint64) * _P1)
        h = _turn(h, 23) * _P2 + _P3
    else:
        h = (before + _P5 + np.uint64(8)) ^ (_turn(x.view(np.uint64) * _P2, 31) * _P1)
        h = _turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _as_number(df: DataFrame, c: str) -> Column:
    """A column as the int or long that Spark hashes for it; of other types, its hash."""
    kind = dict(df.dtypes)[c]
    if kind in ("int", "bigint"):
        return F.col(c)
    if kind in ("tinyint", "smallint", "boolean"):
        return F.col(c).cast("int")
    return {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, lambda x: F.when(x.isNotNull(), F.xxhash64(x)))(F.col(c))


def selection_null(trades: DataFrame, pool: DataFrame, on: list[str], value: str, seeds: int, ident: list[str], block: int = 1 << 20) -> DataFrame:
    """As :func:`timing_null`, with the pool of a whole month (or other stratum) to draw from; a pool
    is numbered in 64 parts.

    Draws are not rows: a stratum's outcomes lie in an array beside its trades, and each task draws for
    all seeds and hands on one sum a seed. Strata of over ``block`` rows are cut into blocks of trades
    and of outcomes, and every block of trades meets every block of outcomes."""
    known = " and ".join(f"`{c}` is not null" for c in on)  # as in an equi join
    trades, pool = trades.filter(known), pool.filter(known)
    both = trades.select(*on, F.lit(1).alias("_m"), F.lit(0).alias("_n")).unionAll(pool.select(*on, F.lit(0).alias("_m"), F.lit(1).alias("_n")))
    # few: a block's rows stand behind each
    large = both.groupBy(*on).agg(*(F.ceil(F.sum(c) / block).alias(c) for c in ("_m", "_n"))).filter("_m > 1 or _n > 1").select(*on, F.col("_m").alias("_ms"), F.col("_n").alias("_ns"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("int") - 1))
    keys, by = [f"_k{i}" for i in range(len(ident))], [*(f"_g{i}" for i in range(len(on))), "_t", "_p"]
    strata = [F.col(c).alias(g) for c, g in zip(on, by, strict=False)]  # new columns, as both sides may come of one table
    left = trades.join(F.broadcast(large), on, "left").withColumn("_t", F.pmod(F.xxhash64(F.lit("block"), *ident), F.greatest(F.coalesce("_ms", F.lit(1)), F.lit(1))).cast("int")).withColumn("_p", upto("_ns"))
    left = left.select(*strata, "_t", "_p", *(_as_number(trades, c).alias(k) for c, k in zip(ident, keys, strict=True)))
    right = numbered(pool, on, 64).join(F.broadcast(large), on, "left").withColumn("_p", F.expr(f"cast(_i div {block} as int)")).withColumn("_t", upto("_ms"))
    right = right.select(*strata, "_t", "_p", (F.col("_i") % block).cast("int").alias("_i"), "_n", F.col(value).cast("double").alias("_v"))
    names = ["seed", "_sum", "_known", "n"]

    def drawn(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if a.num_rows and b.num_rows:
            size, first = b["_n"][0].as_py(), b["_p"][0].as_py() * block
            values, known = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            at = b["_i"].to_numpy()
            values[at], known[at] = b["_v"].fill_null(0.0).to_numpy(), b["_v"].is_valid().to_numpy()
            columns = [(a[k].fill_null(0).to_numpy(), a[k].is_valid().to_numpy() if a[k].null_count else None) for k in keys]
            for seed in range(1, seeds + 1):
                h = np.broadcast_to(_xxhash64(np.array([seed], np.int32), np.array([42], np.uint64)), a.num_rows)
                for x, there in columns:
                    h = _xxhash64(x, h) if there is None else np.where(there, _xxhash64(x, h), h)
                i = h.view(np.int64) % size - first
                if size > block:
                    i = i[(i >= 0) & (i < b.num_rows)]
                rows.append((seed, float(values[i].sum()), int(known[i].sum()), len(i)))
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(names, (pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True))})

    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(drawn, "seed int, _sum double, _known long, n long")
    return sums.groupBy("seed").agg(F.try_divide(F.sum("_sum"), F.sum("_known")).alias("mean"), F.sum("n").alias("n")).filter("n > 0")


def circular_shift(df: DataFrame, value: str, by: int, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Each entity's series turned by ``by`` rows."""
    rows = df.withColumns({"_r": F.row_number().over(Window.partitionBy(entity).orderBy(date)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(entity))})
    turned = rows.select(entity, F.pmod(F.col("_r") + by, F.col("_n")).alias("_r"), F.col(value).alias("shifted"))
    return rows.join(turned, [entity, "_r"]).drop("_r", "_n")


def shuffled(df: DataFrame, keys: list[str], value: str, seed: int, ident: list[str]) -> DataFrame:
    """``value`` permuted within each group."""
    a = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*ident)))
    b = df.select(*keys, F.col(value).alias("shuffled"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *ident), *ident)).alias("_i"))
    return a.join(b, [*keys, "_i"]).drop("_i")


def acf(df: DataFrame, value: str, lags: int, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Autocorrelation of each lag from complete pairs, with the band 2 / sqrt(pairs)."""
    w = Window.partitionBy(entity).orderBy(date)
    lagged = df.select(F.col(value).alias("_x"), *(F.lag(value, k).over(w).alias(f"_y{k}") for k in range(1, lags + 1)))
    pairs = lagged.select("_x", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_y{k}").alias("y")) for k in range(1, lags + 1)))).alias("_p"))
    out = pairs.filter("_x is not null and _p.y is not null").groupBy(F.col("_p.lag").alias("lag")).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_p.y").alias("acf"))
    return out.withColumn("band", 2 / F.sqrt("n"))


def bonferroni(p: float, tests: int) -> float:
    return min(1.0, p * tests)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def power(effect: float, sd: float, n: int, alpha: float = 0.05) -> float:
    """Of a two-sided z test of a mean."""
    if n <= 0 or sd <= 0:
        return 0.0
    z, d = normal_quantile(1 - alpha / 2), abs(effect) / sd * n**0.5
    return NormalDist().cdf(d - z) + NormalDist().cdf(-d - z)


def sample_size(effect: float, sd: float, alpha: float = 0.05, want: float = 0.8) -> int:
    z = normal_quantile(1 - alpha / 2) + normal_quantile(want)
    return int(np.ceil((z * sd / abs(effect)) ** 2))


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t by numerical integration of its density."""
    if df <= 0:
        return float("nan")
    from math import lgamma, pi

    # substitute t = sqrt(df) * tan(a): the tail becomes an integral of cos(a)**(df - 1) over an interval
    a = np.linspace(np.arctan(abs(t) / df**0.5), np.pi / 2, 4001)
    y = np.cos(a) ** (df - 1)
    area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (a[1] - a[0]) / 3
    return float(min(1.0, 2 * area * np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / pi**0.5))
