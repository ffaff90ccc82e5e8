"""Cross-sections: ranks, bins, rank correlation, multiple testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(keys: list[str], value: str) -> Column:
    """Ranks from 1, ties share their mean rank; nulls get none."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)


def percent_rank(keys: list[str], value: str) -> Column:
    """Average rank over the number of values."""
    return average_rank(keys, value) / F.count(value).over(Window.partitionBy(*keys))


def first_rank(keys: list[str], value: str, tie: str) -> Column:
    """Ranks without ties: equal values go by ``tie``."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last(), tie))


def quantile_bin(keys: list[str], value: str, bins: int) -> Column:
    """Right-closed bins 1 .. ``bins`` at interpolated quantiles; null for groups of fewer values than
    bins and where edges coincide."""
    w = Window.partitionBy(*keys)
    edges = [F.percentile(value, F.lit(i / bins)).over(w) for i in range(bins + 1)]
    out = F.lit(bins)
    for i in range(bins - 1, 0, -1):
        out = F.when(F.col(value) <= edges[i], F.lit(i)).otherwise(out)
    distinct = F.lit(True)
    for a, b in zip(edges, edges[1:], strict=False):
        distinct = distinct & (a < b)
    return F.when(F.col(value).isNotNull() & (F.count(value).over(w) >= bins) & distinct, out)


def top_share(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Rows at or above the group's (1 - share) quantile, ties included."""
    edge = F.percentile(value, F.lit(1 - share)).over(Window.partitionBy(*keys))
    return df.withColumn("_edge", edge).filter(F.col(value) >= F.col("_edge")).drop("_edge")


def winsorised(keys: list[str], value: str, low: float, high: float) -> Column:
    w = Window.partitionBy(*keys)
    return F.greatest(F.least(F.col(value), F.percentile(value, F.lit(high)).over(w)), F.percentile(value, F.lit(low)).over(w))


def rank_ic(df: DataFrame, keys: list[str], factor: str, target: str, least: int = 5) -> DataFrame:
    """Spearman correlation of complete pairs per group; null below ``least`` pairs or without two
    different factor values."""
    pairs = df.filter(F.col(factor).isNotNull() & F.col(target).isNotNull())
    pairs = pairs.withColumns({"_rf": average_rank(keys, factor), "_rt": average_rank(keys, target)})
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(factor).alias("_d"), F.countDistinct(target).alias("_t"), F.corr("_rf", "_rt").alias("_ic"))
    return out.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("_d") >= 2) & (F.col("_t") >= 2), F.col("_ic")).alias("ic"))


def partial_corr(xy: Column, xz: Column, yz: Column) -> Column:
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


def bh_qvalues(df: DataFrame, p: str, out: str = "q", tie: str | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values of a table of tests (a few hundred at most: tests of one study)."""
    rank = Window.orderBy(p, *([tie] if tie else []))
    below = Window.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    m = df.filter(F.col(p).isNotNull()).withColumn("_rank", F.row_number().over(rank))
    total = m.agg(F.count(F.lit(1)).alias("_m"))
    m = m.crossJoin(F.broadcast(total))
    return m.withColumn(out, F.least(F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(below), F.lit(1.0))).drop("_rank", "_m")


def ols(df: DataFrame, y: str, xs: list[str], keys: list[str] | None = None) -> DataFrame:
    """Cross products of a least-squares fit with intercept, one pass and one small row per key:
    solve them with :func:`solve_ols`."""
    cols = {"one": F.lit(1.0)} | {x: F.col(x).cast("double") for x in xs} | {"y": F.col(y).cast("double")}
    whole = df.dropna(subset=[y, *xs])
    names = list(cols)
    return whole.groupBy(*(keys or [])).agg(*(F.sum(cols[a] * cols[b]).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]))


def nested_r2(df: DataFrame, y: str, reduced: list[str], full: list[str], keys: list[str] | None = None) -> DataFrame:
    """R squared of the fits on ``reduced`` and on ``full`` (which holds them), and what the further
    columns add, over rows complete in ``full``: one pass, then one small row per key is solved."""
    import numpy as np

    keys = keys or []
    sums = ols(df, y, full, keys)
    out = ", ".join([*(f"{k} {t}" for k, t in sums.select(*keys).dtypes), "n long, r2_reduced double, r2_full double, r2_added double"])

    def r2(row: dict, xs: list[str]) -> float:
        names = ["one", *xs]
        fit = np.dot(solve_ols(row, xs), [row[f"{a}__y"] for a in names])
        total = row["y__y"] - row["one__y"] ** 2 / row["one__one"]
        return 1 - (row["y__y"] - fit) / total if total > 0 else float("nan")

    def solve(batches):
        for b in batches:
            rows = b.to_dict("records")
            for row, (a, c) in zip(rows, [(r2(r, reduced), r2(r, full)) if r["one__one"] else (float("nan"),) * 2 for r in rows], strict=True):
                row |= {"n": int(row["one__one"] or 0), "r2_reduced": a, "r2_full": c, "r2_added": c - a}
            yield b.assign(**{c: [r[c] for r in rows] for c in ("n", "r2_reduced", "r2_full", "r2_added")})[[*keys, "n", "r2_reduced", "r2_full", "r2_added"]]

    whole = sums.na.fill(0.0) if not keys else sums
    return whole.mapInPandas(solve, out)


def solve_ols(row: dict, xs: list[str]) -> list[float]:
    """Coefficients, intercept first; the least-norm solution where columns are dependent."""
    import numpy as np

    names = ["one", *xs]
    get = lambda a, b: row[f"{a}__{b}"] if f"{a}__{b}" in row else row[f"{b}__{a}"]
    xtx = np.array([[get(a, b) for b in names] for a in names], float)
    return (np.linalg.pinv(xtx) @ np.array([get(a, "y") for a in names], float)).tolist()
