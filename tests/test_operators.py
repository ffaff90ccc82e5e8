"""Hand-computed cases for the rules that SQL comparisons do not pin."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import bitemporal, inference, joins, portfolio, rules, series, warehouse
from tidewell.sources import text

D = dt.date


def test_guard_raises_inside_the_seal():
    bitemporal.guard_range("2023-12-29", "2024-01-01")
    with pytest.raises(PermissionError):
        bitemporal.guard_range("2024-01-01", "2024-01-01")
    bitemporal.guard_range("2024-01-01", "2024-01-01", authorised=True)


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 5, 3.0)], "k string, u int, v double")
    back = {(r.k, r.t): r.v for r in joins.asof_backward(left, right, "k", "t", "u", ["v"]).collect()}
    assert back == {("a", 5): 3.0, ("a", 1): None, ("b", 3): None}
    ahead = {(r.k, r.t): (r.v, r.first_choice) for r in joins.asof_with_fallback(left, right, "k", "t", "u", ["v"]).collect()}
    assert ahead[("a", 1)] == (1.0, True) and ahead[("b", 3)] == (None, False)


def test_factor_multiplies_same_day_actions(spark):
    days = spark.createDataFrame([(1, D(2020, 1, 1)), (1, D(2020, 1, 2)), (2, D(2020, 1, 1))], "entity_id int, trade_date date")
    acts = spark.createDataFrame([(1, D(2020, 1, 2), 2.0), (1, D(2020, 1, 2), 5.0)], "entity_id int, ex_date date, ratio double")
    got = {(r.entity_id, r.trade_date.day): r.factor for r in warehouse.adjustment_factors(days, acts).collect()}
    assert got == {(1, 1): pytest.approx(0.1), (1, 2): 1.0, (2, 1): 1.0}


@pytest.mark.parametrize("n", [3, 40, 700])
def test_smoothing_across_blocks(spark, n):
    x = np.random.default_rng(n).normal(100, 5, n)
    x[5::17] = np.nan
    rows = [("e", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    got = [r.s for r in series.smoothed(spark.createDataFrame(rows, "entity_id string, trade_date int, x double"), "x", 5, "s", block=16).orderBy("trade_date").collect()]
    want, s = [], None
    for i, v in enumerate(x):
        s = np.nanmean(x[:5]) if i == 4 else (s * 4 + v) / 5 if i > 4 and not np.isnan(v) else s
        want.append(s)
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-9)


def test_stop_wins_a_tie_and_gaps_fill_at_the_open(spark):
    bars = spark.createDataFrame([("e", D(2024, 1, 1), 1, 90.0, 120.0, 85.0, 100.0), ("e", D(2024, 1, 1), 2, 1.0, 1.0, 1.0, 1.0)], "entity_id string, session date, bar_no int, open double, high double, low double, close double")
    trades = spark.createDataFrame([("e", D(2024, 1, 1), 0, 100.0, 95.0, 110.0)], "entity_id string, session date, entry_bar int, entry double, stop double, target double")
    r = rules.resolve(trades, bars, 9).first()
    assert (r.exit_kind, r.exit_bar, r.exit_price) == ("STOP", 1, 90.0)


def test_darvas_box_by_hand(spark):
    """A lookback of 2 and a trend of 2: a box that breaks out, one that is rejected, one left open."""
    high = [10, 12, 11, 11, 11, 10, 10, 10, 13, 14, 13, 13, 9, 9]
    low = [9, 10, 9, 8, 9, 9, 9, 9, 12, 13, 12, 12, 7, 7]
    close = [9.5, 11, 9, 9, 10, 9.5, 9.5, 9.5, 12.5, 13.5, 12.5, 12.5, 7.5, 8.5]
    rows = [("e", D(2024, 1, i + 1), float(h), float(a), float(c)) for i, (h, a, c) in enumerate(zip(high, low, close))]
    got = rules.darvas(spark.createDataFrame(rows, "entity_id string, trade_date date, high double, low double, close double"), 2, 2, 3).orderBy("top_date").collect()
    assert [tuple(r)[1:] for r in got] == [
        (D(2024, 1, 2), 12.0, D(2024, 1, 5), 8.0, D(2024, 1, 7), "BREAKOUT", D(2024, 1, 9)),
        (D(2024, 1, 10), 14.0, D(2024, 1, 13), None, None, "TREND_REJECTED", None),
        (D(2024, 1, 14), 9.0, None, None, None, "TOP_OPEN", None),
    ]


def test_ascending_lows_by_hand(spark):
    def day(n, lows):
        return [("e", D(2024, 1, n), i, float(x)) for i, x in enumerate(lows)]

    rows = day(1, [9, 5, 7, 6, 8, 6.5, 9]) + day(2, [9, 5, 7, 6, 8, 4, 9]) + day(3, [9, 5, 7, 6, 8, 5.5, 9]) + day(4, [9, 5, 6])
    bars = spark.createDataFrame(rows, "entity_id string, session date, bar_no int, low double")
    sweeps = bars.select("entity_id", "session").distinct().select("*", F.lit(8.5).alias("zone"), F.lit(1).alias("sweep_bar"), F.lit(5.0).alias("sweep_low"))
    got = [tuple(r)[5:] for r in rules.ascending_lows(bars, sweeps, 2).orderBy("session").collect()]
    assert got == [("CONFIRMED", 6, 6.5, 2), ("BROKEN", 5, None, None), ("INCOMPLETE", None, None, 1), ("INCOMPLETE", None, None, 0)]


def test_ttm_counts_only_what_was_known(spark):
    q = spark.createDataFrame([("a", D(2023, 3 * k, 28), D(2023, 3 * k, 28) if k != 2 else D(2025, 1, 1), float(k)) for k in range(1, 5)], "isin string, period_end date, known_date date, value double")
    asks = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2025, 1, 1)), ("a", D(2022, 1, 1))], "isin string, at date")
    got = [tuple(r)[1:4] for r in bitemporal.ttm_as_of(q, asks).orderBy("at").collect()]
    assert got == [(D(2024, 1, 1), 8.0, 3), (D(2025, 1, 1), 3.0, 2)]


def test_concurrency_ends_at_zero(spark):
    t = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 3)), (D(2024, 1, 2), D(2024, 1, 4))], "entry_date date, exit_date date")
    assert [r.open_trades for r in portfolio.concurrency(t).orderBy("date").collect()] == [1, 2, 1, 0]


def test_power_and_t():
    assert inference.student_p(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert inference.student_p(0.0, 5) == pytest.approx(1.0)
    assert inference.power(0.5, 1.0, inference.sample_size(0.5, 1.0)) == pytest.approx(0.8, abs=0.02)


def test_bootstrap_of_constant(spark):
    rows = spark.createDataFrame([(i % 7, 2.0) for i in range(40)], "day int, x double")
    r = inference.clustered_bootstrap(rows, "day", "x", 200).first()
    assert (r.mean, r.low, r.high, r.n_clusters) == (2.0, 2.0, 2.0, 7)


def test_price_file_layouts(spark, tmp_path):
    (tmp_path / "old.csv").write_text("SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,\nAB,EQ,1,2,0.5,1.5,1.5,1,10,15,05-JAN-2020,3,INE000A01011,\nCD,N1,1,2,0.5,1.5,1.5,1,10,15,05-JAN-2020,3,INE000B01011,\n")
    rows = text.price_file(spark, str(tmp_path / "old.csv"), "2020-01-05").collect()
    assert [(r.symbol, r.trade_date, r.volume) for r in rows] == [("AB", D(2020, 1, 5), 10)]
    with pytest.raises(Exception, match="another day"):
        text.price_file(spark, str(tmp_path / "old.csv"), "2020-01-06").collect()


def test_event_log_keeps_the_first(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event_id":"a","ts":"1","kind":"x"}\n{"event_id":"a","ts":"2","kind":"y"}\n{"ts":"3","kind":"x"}\nbroken\n')
    got = text.event_log(spark, str(tmp_path / "log.jsonl"), "event_id string, ts string, kind string").collect()
    assert [(r.event_id, r.kind) for r in got] == [("a", "x")]


def test_symbol_list(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# none\n abc \nABC # twice\n\nx-1\n")
    assert sorted(r.symbol for r in text.symbol_list(spark, str(tmp_path / "s.txt")).collect()) == ["ABC", "X-1"]
    (tmp_path / "e.txt").write_text("# none\n")
    with pytest.raises(ValueError):
        text.symbol_list(spark, str(tmp_path / "e.txt"))


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert text.content_hash(a) == text.content_hash(a.orderBy(F.desc("i"))) != text.content_hash(a.filter("i = 1"))


def test_overwrite_of_days(spark, tmp_path):
    p = str(tmp_path / "t")
    f = lambda rows: spark.createDataFrame(pd.DataFrame(rows, columns=["trade_date", "v"]))
    text.overwrite_days(f([("d1", 1), ("d2", 2)]), p)
    text.overwrite_days(f([("d2", 5)]), p)
    assert sorted((r.trade_date, r.v) for r in spark.read.parquet(p).collect()) == [("d1", 1), ("d2", 5)]


def test_asof_across_spans_and_without_times(spark):
    rng = np.random.default_rng(3)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(int(n))
    left = [("ab"[i % 2], day(n) if n % 11 else None, i) for i, n in enumerate(rng.integers(0, 900, 120))]
    right = [("ab"[i % 2], day(n) if n % 7 else None, float(i)) for i, n in enumerate(rng.integers(100, 800, 25))]
    lf, rf = spark.createDataFrame(left, "k string, t date, i int"), spark.createDataFrame(right, "k string, u date, v double")
    for forward, found in ((False, joins.asof_backward(lf, rf, "k", "t", "u", ["v"])), (True, joins.asof_forward(lf, rf, "k", "t", "u", ["v"]))):
        got = {r.i: (r.matched_ts, r.v) for r in found.collect()}
        for k, t, i in left:
            near = [(u, v) for kk, u, v in right if kk == k and u and t and (u >= t if forward else u <= t)]
            at = (min if forward else max)((u for u, _ in near), default=None)
            assert got[i] == (at, max((v for u, v in near if u == at), default=None))


@pytest.mark.parametrize("spread", [1, 5])
def test_numbers_of_a_group_are_whole(spark, spread):
    df = spark.createDataFrame([("ab"[i % 3 == 0], i) for i in range(60)], "k string, v int")
    rows = inference.numbered(df, ["k"], spread).collect()
    for k, n in (("a", 40), ("b", 20)):
        assert sorted(r._i for r in rows if r.k == k) == list(range(n)) and {r._n for r in rows if r.k == k} == {n}


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_selection_null_draws_as_by_rows(spark, block):
    """The same draws as one row each would give, in strata of one block and of many."""
    pool = spark.createDataFrame([(("a", "b", "c", None)[min(i % 5, 3)], i, i * 0.5 if i % 6 else None) for i in range(90)], "k string, v int, x double")
    trades = spark.createDataFrame([(("a", "b", "d", None)[i % 4], i, D(2020, 1, 1) + dt.timedelta(i) if i % 7 else None, i << 33) for i in range(70)], "k string, i int, d date, l long")
    trades = trades.withColumn("t", F.expr("timestamp_seconds(i * 1001)"))
    ident = ["k", "i", "d", "l", "t"]
    plain = {r.seed: r for r in inference.timing_null(trades, pool, ["k"], "x", 8, ["i", "d", "l", "t"], 64).collect()}
    got = {r.seed: r for r in inference.selection_null(trades, pool, ["k"], "x", 8, ["i", "d", "l", "t"], block).collect()}
    assert set(got) == set(plain) == set(range(1, 9))
    for seed, r in plain.items():
        assert got[seed].n == r.n == 36 and got[seed]["mean"] == pytest.approx(r["mean"], abs=1e-12)
    assert inference.selection_null(trades, pool, ["k"], "x", 2, ident, block).count() == 2
    assert inference.selection_null(trades, pool.filter("v < 0"), ["k"], "x", 2, ident, block).collect() == []


def test_selection_null_broadcasts_no_trades(spark):
    """Nothing but large strata is broadcast: neither trades nor draws nor the pool, whatever sizes are planned."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.rand(1).alias("x"))
    plan = inference.selection_null(rows.select("k", "i"), rows, ["k"], "x", 5, ["i"])._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    built = [lines[i + 1] + lines[i + 2] for i, line in enumerate(lines) if "BroadcastExchange" in line]
    assert len(built) == 2 and all("Filter" in x and "> 1)" in x for x in built)


def test_picks_with_nulls_ties_and_no_rows(spark):
    rows = [(None if i % 9 == 0 else float(i % 4), i) for i in range(80)]
    df = spark.createDataFrame(rows, "x double, i int")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    want = [ordered[round(k * 79 / 4)][1] for k in range(5)]
    assert sorted(r.i for r in portfolio.picks_by_percentile(df, ["x", "i"], 5, 16).collect()) == sorted(want)
    assert portfolio.picks_by_percentile(df.filter("i < 0"), ["x", "i"], 5).collect() == []
