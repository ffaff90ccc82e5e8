"""Identity, corporate actions, price adjustment and data guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_flag


def lineage_links(spans: DataFrame) -> DataFrame:
    """Successive identifiers of a symbol, linked or refused with the first reason that applies.

    ``spans``: symbol, isin, first_date, last_date. An identifier reads prefix (1-3), issuer (4-7),
    type (8-9), serial (10-11).
    """
    w = Window.partitionBy("symbol").orderBy("first_date", "isin")
    nxt = spans.withColumns({"next_isin": F.lead("isin").over(w), "next_first": F.lead("first_date").over(w)}).filter("next_isin is not null")
    part = lambda c, a, n: F.substring(c, a, n)
    serial = lambda c: F.expr(f"try_cast(substring({c}, 10, 2) as int)")
    reason = (
        F.when(part("isin", 1, 3) != part("next_isin", 1, 3), "prefix")
        .when(part("isin", 4, 4) != part("next_isin", 4, 4), "issuer")
        .when(part("isin", 8, 2) != part("next_isin", 8, 2), "type")
        .when(F.coalesce(serial("next_isin") <= serial("isin"), F.lit(True)), "serial")
        .when(F.col("next_first") <= F.col("last_date"), "overlap")
    )
    return nxt.select("symbol", F.col("isin").alias("predecessor_isin"), F.col("next_isin").alias("isin"), F.col("next_first").alias("known_date"), F.coalesce(reason, F.lit("linked")).alias("status"))


def lineage_roots(isins: DataFrame, links: DataFrame, rounds: int = 24) -> DataFrame:
    """isin, entity_id: the first identifier of each chain, by pointer doubling: a chain of length n
    takes log2(n) joins."""
    up = isins.select("isin").distinct().join(links.filter("status = 'linked'").select("isin", "predecessor_isin"), "isin", "left").select("isin", F.coalesce("predecessor_isin", "isin").alias("entity_id"))
    for _ in range(rounds):
        step = up.alias("a").join(up.alias("b"), F.col("a.entity_id") == F.col("b.isin")).select(F.col("a.isin").alias("isin"), F.col("b.entity_id").alias("entity_id"), (F.col("a.entity_id") != F.col("b.entity_id")).alias("moved")).cache()
        moved = step.filter("moved").limit(1).count()
        up = step.drop("moved")
        if not moved:
            return up
    raise RuntimeError("a chain of identifiers is a cycle")


def resolver_as_of(isins: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """isin, entity_id from the links known on ``as_of`` alone."""
    return lineage_roots(isins, links.filter(F.col("known_date") <= F.lit(as_of).cast("date")))


def jump_map(prices: DataFrame, actions: DataFrame, links: DataFrame, roots: DataFrame, limit: float = 1.5) -> DataFrame:
    """entity_id, trade_date of every unexplained jump: at a change of identifier, or under one
    identifier without an action near. ``prices`` and ``actions`` bear ``isin``."""
    same = jumps(prices, actions, limit, entity="isin").filter("not near_action").select("isin", "trade_date")
    ends = boundary_jumps(prices, links, limit).select("isin", F.col("known_date").alias("trade_date"))
    return same.unionByName(ends).join(roots, "isin").select("entity_id", "trade_date").distinct()


def adjustment_factors(days: DataFrame, actions: DataFrame, entity: str = "entity_id") -> DataFrame:
    """``days`` plus factor: the product of 1 / ratio over the entity's actions after the day.

    Actions of a day multiply first; the suffix products of an entity travel as one short sorted
    array, so rows of ``days`` are never multiplied by actions."""
    daily = actions.groupBy(entity, "ex_date").agg(F.product("ratio").alias("ratio"))
    listed = daily.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("ex_date", "ratio"))).alias("_actions"))
    later = F.filter("_actions", lambda a: a["ex_date"] > F.col("trade_date"))
    factor = F.aggregate(later, F.lit(1.0), lambda f, a: F.try_divide(f, a["ratio"]))
    return days.join(listed, entity, "left").withColumn("factor", F.coalesce(factor, F.lit(1.0))).drop("_actions")


def adjusted_prices(days: DataFrame, actions: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    out = adjustment_factors(days, actions)
    return out.withColumns({f"adjusted_{c}": F.col(c) * F.col("factor") for c in columns if c in days.columns})


def jumps(prices: DataFrame, actions: DataFrame | None = None, limit: float = 1.5, price: str = "close", entity: str = "entity_id", around: int = 10) -> DataFrame:
    """Rows whose price moved by more than ``limit`` times since the previous row, and whether an
    action lies within ``around`` days."""
    w = Window.partitionBy(entity).orderBy("trade_date")
    out = prices.withColumn("ratio", F.try_divide(F.col(price), F.lag(price).over(w))).filter((F.col("ratio") > limit) | (F.col("ratio") < 1 / limit))
    return range_flag(out, actions, entity, "trade_date", "ex_date", around, around, "near_action") if actions is not None else out


def boundary_jumps(prices: DataFrame, links: DataFrame, limit: float = 1.5, price: str = "close", isin: str = "isin") -> DataFrame:
    """First price under a new identifier over the last under the old one, where outside the limit."""
    ends = prices.groupBy(isin).agg(F.min_by(price, "trade_date").alias("first_price"), F.max_by(price, "trade_date").alias("last_price"))
    old, new = ends.select(F.col(isin).alias("predecessor_isin"), "last_price"), ends.select(F.col(isin).alias("isin"), "first_price")
    out = links.filter("status = 'linked'").join(old, "predecessor_isin").join(new, "isin").withColumn("ratio", F.try_divide(F.col("first_price"), F.col("last_price")))
    return out.filter((F.col("ratio") > limit) | (F.col("ratio") < 1 / limit))


def missing_days(rows: DataFrame, holidays: DataFrame | None = None, entity: str = "entity_id", date: str = "trade_date") -> DataFrame:
    """Weekdays between an entity's first and last row that have no row and are no holiday."""
    span = rows.groupBy(entity).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = span.select(entity, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date)).filter(F.weekday(date) < 5)
    out = days.join(rows.select(entity, date).distinct(), [entity, date], "left_anti")
    return out.join(holidays.select(date), [date], "left_anti").select(entity, date) if holidays is not None else out


def gap_policy(gaps: DataFrame, blocked: DataFrame, today: str, alert_days: int = 30, date: str = "trade_date") -> DataFrame:
    """blocked where a closed window covers the day, else alert for old gaps, else fill."""
    closed = blocked.filter("start <= end").select(F.explode(F.sequence("start", "end")).alias(date)).distinct().withColumn("_b", F.lit(True))
    out = gaps.join(closed, date, "left").select(*gaps.columns, "_b")
    return out.withColumn("action", F.when(F.col("_b"), "blocked").when(F.datediff(F.lit(today).cast("date"), F.col(date)) > alert_days, "alert").otherwise("fill")).drop("_b")


def freshness(df: DataFrame, today: str, most: int = 3, date: str = "trade_date") -> DataFrame:
    return df.agg(F.max(date).alias("latest")).withColumn("age_days", F.datediff(F.lit(today).cast("date"), "latest")).withColumn("fresh", F.coalesce(F.col("age_days") <= most, F.lit(False)))


def table_fingerprint(df: DataFrame, revision: str | None = None) -> DataFrame:
    """Row count, an order-free digest and the highest revision: equal before and after, or something
    touched a frozen table."""
    digest = F.sum(F.xxhash64(*df.columns).bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"), (F.max(revision) if revision else F.lit(None).cast("int")).alias("top_revision"))


def scale_probe(a: DataFrame, b: DataFrame, on: list[str], tolerance: float = 0.001, near: float = 0.01) -> DataFrame:
    """Is source ``b`` (high, low) the same series as ``a``, a constant multiple of it, or neither."""
    both = a.select(*on, F.col("high").alias("ah"), F.col("low").alias("al")).join(b.select(*on, F.col("high").alias("bh"), F.col("low").alias("bl")), on)
    both = both.withColumns({"r_high": F.try_divide(F.col("ah"), F.col("bh")), "r_low": F.try_divide(F.col("al"), F.col("bl"))})
    agree = F.abs(F.try_divide(F.col("r_high"), F.col("r_low")) - 1) <= tolerance
    scale = (F.col("r_high") + F.col("r_low")) / 2
    status = F.when(F.col("r_high").isNull() | F.col("r_low").isNull() | ~agree, "UNRESOLVED").when(F.abs(scale - 1) <= near, "RAW").otherwise("SCALED")
    return both.select(*on, "r_high", "r_low", F.when(agree, scale).alias("scale"), status.alias("status"))


def session_index(calendar: DataFrame, date: str = "trade_date") -> DataFrame:
    """Trading days numbered from 0. A calendar is a few thousand days: one small partition."""
    return calendar.select(date).distinct().withColumn("session", F.row_number().over(Window.orderBy(date)) - 1)


def shifted_session(df: DataFrame, calendar: DataFrame, by: int, date: str = "trade_date", out: str = "shifted") -> DataFrame:
    """The trading day ``by`` sessions after (or before) each row's trading day."""
    index = session_index(calendar, date)
    there = index.select((F.col("session") - by).alias("session"), F.col(date).alias(out))
    return df.join(F.broadcast(index), date, "left").join(F.broadcast(there), "session", "left").drop("session")
