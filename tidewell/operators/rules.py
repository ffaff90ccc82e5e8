"""Intraday and daily trade rules. Bars carry ``bar_no`` within (entity_id, session)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ["entity_id", "session"]


def opening_range(bars: DataFrame, first: int = 0, last: int = 0) -> DataFrame:
    """High and low of the session's opening bars."""
    return bars.filter(F.col("bar_no").between(first, last)).groupBy(*DAY).agg(F.max("high").alias("or_high"), F.min("low").alias("or_low"))


def breakout_entries(bars: DataFrame, ranges: DataFrame, first: int, last: int) -> DataFrame:
    """The first bar that closes above the opening range, with stop at the range's low and target at
    twice the risk."""
    b = bars.join(ranges, DAY).filter(F.col("bar_no").between(first, last) & (F.col("close") > F.col("or_high")))
    hit = b.groupBy(*DAY, "or_high", "or_low").agg(F.min(F.struct("bar_no", "close")).alias("e"))
    return hit.select(*DAY, F.col("e.bar_no").alias("entry_bar"), F.col("e.close").alias("entry"), F.col("or_low").alias("stop"), (F.col("e.close") + 2 * (F.col("e.close") - F.col("or_low"))).alias("target"))


def resolve(trades: DataFrame, bars: DataFrame, last: int, inclusive: bool = False) -> DataFrame:
    """First touch of stop or target after the entry bar; both in one bar is a STOP, a stop that gaps
    fills at the open, no touch ends at the last bar's close."""
    after = (F.col("bar_no") >= F.col("entry_bar")) if inclusive else (F.col("bar_no") > F.col("entry_bar"))
    path = trades.join(bars.select(*DAY, "bar_no", "open", "high", "low", "close"), DAY).filter(after & (F.col("bar_no") <= last))
    stopped, reached = F.col("low") <= F.col("stop"), F.col("high") >= F.col("target")
    hit = F.when(stopped, F.struct("bar_no", F.lit("STOP").alias("kind"), F.least("open", "stop").alias("fill"))).when(reached, F.struct("bar_no", F.lit("TARGET").alias("kind"), F.col("target").alias("fill")))
    out = path.groupBy(*trades.columns).agg(F.min(hit).alias("hit"), F.max(F.struct("bar_no", "close")).alias("end"))
    return out.select(*trades.columns, F.coalesce("hit.kind", F.lit("TIME")).alias("exit_kind"), F.coalesce("hit.bar_no", "end.bar_no").alias("exit_bar"), F.coalesce("hit.fill", "end.close").alias("exit_price"))


def sweep_reclaims(bars: DataFrame, levels: DataFrame, least: float, most: float, within: int = 3) -> DataFrame:
    """A bar dips below the level by ``least`` to ``most`` (of the level) and one of the next
    ``within`` bars, or itself, closes back above; a deeper dip ends the day's search. The sweep low
    is the lowest low up to the reclaim."""
    day = Window.partitionBy(*DAY)
    at = F.col("bar_no")
    b = bars.join(levels, DAY).withColumn("_d", F.try_divide(F.col("level") - F.col("low"), F.col("level")))
    b = b.withColumn("_broken", F.min(F.when(F.col("_d") > most, at)).over(day))
    swept = F.col("_d").between(least, most) & (F.col("_broken").isNull() | (at < F.col("_broken")))
    b = b.withColumn("sweep_bar", F.min(F.when(swept, at)).over(day))
    back = at.between(F.col("sweep_bar"), F.col("sweep_bar") + within) & (F.col("close") > F.col("level"))
    b = b.withColumn("_r", F.min(F.when(back, F.struct("bar_no", "close"))).over(day)).filter(at.between(F.col("sweep_bar"), F.col("_r.bar_no")))
    return b.groupBy(*DAY, "level", "sweep_bar", F.col("_r.bar_no").alias("entry_bar"), F.col("_r.close").alias("entry")).agg(F.min("low").alias("sweep_low"))


def fair_value_gaps(bars: DataFrame, live: int = 30) -> DataFrame:
    """high[i] < low[i + 2] in one session, the bar between not inside the first; the gap lives for
    ``live`` bars after its third, or until a later gap's third bar (``live_until``, exclusive)."""
    w = Window.partitionBy(*DAY).orderBy("bar_no")
    three = bars.withColumns({"_l2": F.lead("low", 2).over(w), "third_bar": F.lead("bar_no", 2).over(w), "_inside": (F.lead("high").over(w) <= F.col("high")) & (F.lead("low").over(w) >= F.col("low"))})
    gaps = three.filter((F.col("high") < F.col("_l2")) & ~F.col("_inside")).select(*DAY, F.col("bar_no").alias("first_bar"), "third_bar", F.col("high").alias("gap_low"), F.col("_l2").alias("gap_high"))
    # the least passes over a missing successor
    return gaps.withColumn("live_until", F.least(F.lead("third_bar").over(Window.partitionBy(*DAY).orderBy("first_bar")), F.col("third_bar") + live + 1))


def gap_retests(bars: DataFrame, gaps: DataFrame) -> DataFrame:
    """After a gap: the first bar that touches it, then the first close above its top within its life."""
    b = gaps.join(bars.select(*DAY, "bar_no", "low", "close"), DAY).filter((F.col("bar_no") > F.col("third_bar")) & (F.col("bar_no") < F.col("live_until")))
    w = Window.partitionBy(*DAY, "first_bar")
    touched = b.withColumn("touch_bar", F.min(F.when(F.col("low") <= F.col("gap_high"), F.col("bar_no"))).over(w))
    out = touched.filter((F.col("bar_no") >= F.col("touch_bar")) & (F.col("close") > F.col("gap_high")))
    return out.groupBy(*gaps.columns, "touch_bar").agg(F.min("bar_no").alias("entry_bar"))


def hammer() -> Column:
    """A lower wick of twice the body and an upper one of no more than it; without a body a lower wick of
    a fifth of the bar's span. Fixed values."""
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    lower, upper = F.least("open", "close") - F.col("low"), F.col("high") - F.greatest("open", "close")
    return F.when(body > 0, (lower >= 2 * body) & (upper <= body)).otherwise((span > 0) & (lower >= 0.2 * span))


def level_touches(bars: DataFrame, levels: DataFrame, confirm: int = 2) -> DataFrame:
    """The first bar that trades through the level, then of the ``confirm`` bars strictly after it the
    first that decides: green or a hammer confirms, red with a close below the level fails; any other
    leaves the setup as it is. One window pass over the session."""
    day = Window.partitionBy(*DAY)
    at = F.col("bar_no")
    b = bars.join(levels, DAY).withColumn("touch_bar", F.min(F.when((F.col("low") <= F.col("level")) & (F.col("high") >= F.col("level")), at)).over(day))
    good = (F.col("close") > F.col("open")) | hammer()
    bad = (F.col("close") < F.col("open")) & (F.col("close") < F.col("level")) & ~hammer()
    after = at.between(F.col("touch_bar") + 1, F.col("touch_bar") + confirm)
    first = F.min(F.when(after & (good | bad), F.struct(at.alias("bar"), good.alias("good"))))
    out = b.filter("touch_bar is not null").groupBy(*DAY, "level", "touch_bar").agg(first.alias("f"))
    status = F.when(F.col("f").isNull(), "UNCONFIRMED").when(F.col("f.good"), "CONFIRMED").otherwise("FAILED")
    return out.select(*DAY, "level", "touch_bar", status.alias("status"), F.when(F.col("f.good"), F.col("f.bar")).alias("g"))


def box_entries(bars: DataFrame, levels: DataFrame, green: int = 1) -> DataFrame:
    """Touch of the previous low, then the first green bar (or the first of two greens running, the
    second closing higher)."""
    w = Window.partitionBy(*DAY).orderBy("bar_no")
    is_green = F.col("close") > F.col("open")
    run = is_green if green == 1 else is_green & (F.lag("close").over(w) > F.lag("open").over(w)) & (F.col("close") > F.lag("close").over(w))
    b = bars.withColumn("_go", F.coalesce(run, F.lit(False))).join(levels, DAY)
    b = b.withColumn("touch_bar", F.min(F.when(F.col("low") <= F.col("level"), F.col("bar_no"))).over(Window.partitionBy(*DAY)))
    first = F.col("touch_bar") + (green - 1)
    return b.filter(F.col("_go") & (F.col("bar_no") > first)).groupBy(*DAY, "level", "touch_bar").agg(F.min(F.struct("bar_no", "close")).alias("e")).select(*DAY, "level", "touch_bar", F.col("e.bar_no").alias("entry_bar"), F.col("e.close").alias("entry"))


def two_leg_exits(trades: DataFrame, bars: DataFrame, near: float, far: float, last: int) -> DataFrame:
    """Half the position leaves at ``near`` times the risk, the rest at ``far`` times, the stop serves
    both; a bar may hit both targets, a bar that hits the stop is a stop first."""
    risk = F.col("entry") - F.col("stop")
    legs = [("near", near), ("far", far)]
    out = trades
    for name, times in legs:
        leg = resolve(trades.withColumn("target", F.col("entry") + times * risk), bars, last).select(*DAY, "entry_bar", F.col("exit_kind").alias(f"{name}_kind"), F.col("exit_price").alias(f"{name}_price"))
        out = out.join(leg, [*DAY, "entry_bar"])
    return out.withColumn("net", (F.col("near_price") + F.col("far_price")) / 2 - F.col("entry"))


def first_bar_trades(bars: DataFrame, stop: float = 0.05, target: float = 0.125) -> DataFrame:
    """Listing-day rule: a green first bar is bought at the next bar's open."""
    w = Window.partitionBy(*DAY).orderBy("bar_no")
    b = bars.withColumn("entry", F.lead("open").over(w))
    b = b.filter((F.col("bar_no") == 0) & (F.col("close") > F.col("open")) & F.col("entry").isNotNull())
    return b.select(*DAY, F.col("bar_no").alias("entry_bar"), "entry", (F.col("entry") * (1 - stop)).alias("stop"), (F.col("entry") * (1 + target)).alias("target"))


def _boxes(pdf: pd.DataFrame, lookback: int, trend: int, confirm: int) -> pd.DataFrame:
    """Darvas boxes of one entity in date order, one phase at a time."""
    pdf = pdf.sort_values("trade_date")
    high, low, close, dates = (pdf[c].to_numpy() for c in ("high", "low", "close", "trade_date"))
    peak = pdf["high"].rolling(lookback, min_periods=lookback).max().to_numpy()
    mean = pdf["close"].rolling(trend, min_periods=trend).mean().to_numpy()
    rows, phase = [], "SEEK"
    top = bottom = quiet_top = quiet_bottom = 0
    top_set = bottom_set = None

    def ends(outcome: str, day: int | None) -> str:
        day_of = lambda i: None if i is None else dates[i]
        rows.append((dates[top], float(high[top]), day_of(top_set), None if top_set is None or outcome == "TREND_REJECTED" else float(low[bottom]), day_of(bottom_set), outcome, day_of(day)))
        return "SEEK"

    for i in range(len(pdf)):
        if phase == "SEEK":
            if high[i] >= peak[i]:  # never where the lookback is not full
                phase, top, bottom, quiet_top, quiet_bottom, top_set, bottom_set = "TOP", i, i, 0, 0, None, None
            continue
        if phase == "BOX":
            if close[i] > high[top]:
                phase = ends("BREAKOUT", i)
            elif close[i] <= low[bottom]:
                phase = ends("BREAKDOWN", i)
            continue
        if phase == "TOP" and high[i] >= high[top]:
            top = bottom = i
            quiet_top = quiet_bottom = 0
            continue
        if phase == "BOTTOM" and close[i] > high[top]:
            phase = ends("EARLY_BREAKOUT", i)
            continue
        bottom, quiet_bottom = (i, 0) if low[i] < low[bottom] else (bottom, quiet_bottom + 1)
        if phase == "TOP":
            quiet_top += 1
            if quiet_top < confirm:
                continue
            top_set = i
            if not close[i] > mean[i]:
                phase = ends("TREND_REJECTED", None)
                continue
            phase = "BOTTOM"
        if quiet_bottom == confirm:
            bottom_set, phase = i, "BOX"
    if phase != "SEEK":
        ends({"TOP": "TOP_OPEN", "BOTTOM": "BOTTOM_OPEN", "BOX": "UNRESOLVED"}[phase], None)
    out = pd.DataFrame(rows, columns=["top_date", "box_high", "top_set_date", "box_low", "bottom_set_date", "outcome", "end_date"])
    out.insert(0, "entity_id", pdf["entity_id"].iloc[0])
    return out


def darvas(daily: DataFrame, lookback: int = 200, trend: int = 50, confirm: int = 3) -> DataFrame:
    """Darvas boxes of each entity, each begun by a high of ``lookback`` rows: the top is set after
    ``confirm`` rows below it, the bottom after as many that make no new low, both counted from the peak.
    Outcomes: TOP_OPEN, TREND_REJECTED (the close that sets the top is not above the mean of ``trend``
    closes), EARLY_BREAKOUT (before a bottom), BOTTOM_OPEN, BREAKOUT, BREAKDOWN, UNRESOLVED. The state
    depends on its whole past, so an entity is one task's work: some thousand rows however many
    entities there are."""
    schema = f"entity_id {daily.schema['entity_id'].dataType.simpleString()}, top_date date, box_high double, top_set_date date, box_low double, bottom_set_date date, outcome string, end_date date"
    return daily.select("entity_id", "trade_date", "high", "low", "close").groupBy("entity_id").applyInPandas(lambda p: _boxes(p, lookback, trend, confirm), schema)


def zone_sweeps(bars: DataFrame, zones: DataFrame, after: int) -> DataFrame:
    """The first bar from ``after`` on whose low lies below the session's zone, with that low."""
    hit = bars.join(zones, DAY).filter((F.col("bar_no") >= after) & (F.col("low") < F.col("zone")))
    return hit.groupBy(*DAY, "zone").agg(F.min(F.struct("bar_no", "low")).alias("s")).select(*DAY, "zone", F.col("s.bar_no").alias("sweep_bar"), F.col("s.low").alias("sweep_low"))


def ascending_lows(bars: DataFrame, sweeps: DataFrame, n: int = 3) -> DataFrame:
    """After a sweep (zone, sweep_bar, sweep_low of a session) local lows at or below the zone, each above
    the last counted one; a lower one starts the count anew. CONFIRMED on the bar after the ``n``-th,
    BROKEN by a low beyond the sweep's before or on that bar, else INCOMPLETE. Windows over the session;
    a low is local if both neighbouring bars' lows are above it."""
    w = Window.partitionBy(*DAY).orderBy("bar_no")
    at = F.col("bar_no")
    b = bars.select(*DAY, "bar_no", "low").withColumns({"_before": F.lag("low").over(w), "_after": F.lead("low").over(w), "_next": F.lead("bar_no").over(w)}).join(sweeps, DAY).filter(at > F.col("sweep_bar"))
    local = (F.col("low") < F.col("_before")) & (F.col("low") < F.col("_after")) & (F.col("low") <= F.col("zone"))
    b = b.withColumn("_low", F.when(F.coalesce(local, F.lit(False)), F.col("low")))
    held = b.withColumn("_last", F.last("_low", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("_low").isNotNull(), (F.col("_last").isNull() | (F.col("_low") <= F.col("_last"))).cast("int"))
    held = held.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumn("_count", F.when(F.col("_low").isNotNull(), F.count("_low").over(Window.partitionBy(*DAY, "_run").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0))))
    done = F.min(F.when(F.col("_count") >= n, F.struct(F.col("_next").alias("bar"), F.col("_low").alias("low"), F.col("_count").alias("count"))))
    broken = F.min(F.when(F.col("low") < F.col("sweep_low"), at))
    out = held.groupBy(*sweeps.columns).agg(done.alias("d"), broken.alias("b"), F.max_by("_count", F.when(F.col("_count").isNotNull(), at)).alias("c"))
    is_broken = F.col("b").isNotNull() & (F.col("d").isNull() | (F.col("b") <= F.col("d.bar")))
    status = F.when(is_broken, "BROKEN").when(F.col("d").isNotNull(), "CONFIRMED").otherwise("INCOMPLETE")
    confirmed = status == "CONFIRMED"
    count = F.when(confirmed, F.col("d.count")).when(status == "INCOMPLETE", F.coalesce("c", F.lit(0)))
    return out.select(*sweeps.columns, status.alias("status"), F.when(is_broken, F.col("b")).when(confirmed, F.col("d.bar")).alias("at_bar"), F.when(confirmed, F.col("d.low")).alias("last_low"), count.alias("lows"))


def conditions(checks: list[tuple[str, Column]]) -> Column:
    """The first failing check's name, or ok: a row's reason to be skipped."""
    out = F.lit("ok")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def verdict(checks: Column) -> Column:
    """FAIL, else INSUFFICIENT DATA, else FINANCIALS-PARTIAL, else PASS, of an array of statuses."""
    has = lambda s: F.exists(checks, lambda c: c == s)
    return F.when(has("FAIL"), "FAIL").when(has("NA"), "INSUFFICIENT DATA").when(has("PARTIAL"), "FINANCIALS-PARTIAL").otherwise("PASS")
