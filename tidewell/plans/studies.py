"""Queries of event studies, audits and evaluation; registered with the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import inference as I
from tidewell.operators import portfolio as P
from tidewell.operators import series as S
from tidewell.operators import studies as U
from tidewell.operators import warehouse as W
from tidewell.operators import xsection as X
from tidewell.sources import text as TX
from tidewell.streaming import live as L

from . import standin as D
from .catalogue import _W, GAP, _gaps, query, rounded
from .standin import ctes

_SESS = "c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS s FROM (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events WHERE isodow(ts) < 6))"


@query(
    f"""WITH {_SESS}, e AS (SELECT event_id, ts, (SELECT min(s) FROM c WHERE trade_date >= CAST(ts AS DATE)) AS a, EXISTS (SELECT 1 FROM c WHERE trade_date = CAST(ts AS DATE)) AS o FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT min(trade_date) FROM c) AND (SELECT max(trade_date) FROM c)),
d AS (SELECT event_id, ts, CASE WHEN o AND hour(ts) * 60 + minute(ts) >= 930 THEN a + 1 ELSE a END AS day0 FROM e) SELECT event_id, ts, day0, x.trade_date AS day0_date, y.trade_date AS entry_date FROM d LEFT JOIN c x ON x.s = day0 LEFT JOIN c y ON y.s = day0 + 3"""
)
def event_day0(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select("event_id", "ts")
    days = e.select(F.to_date("ts").alias("trade_date")).distinct().filter(F.weekday("trade_date") < 5)
    return U.event_sessions(e, days)


@query(
    f"""{ctes('weekly')}, w AS (SELECT entity_id, trade_date, lag(close, 1) OVER ({_W}) AS pm1, close AS p0, lead(close, 1) OVER ({_W}) AS p1, lead(close, 5) OVER ({_W}) AS p5 FROM weekly)
SELECT entity_id, trade_date, pm1, p0, p1, p5 FROM w WHERE day(trade_date) = 1 AND pm1 IS NOT NULL AND p1 IS NOT NULL AND p5 IS NOT NULL"""
)
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf)
    return U.event_windows(w, w.filter(F.dayofmonth("trade_date") == 1).select("entity_id", "trade_date"), [-1, 0, 1, 5])


@query(f"{ctes('weekly', 'actions')}, e AS (SELECT entity_id, trade_date AS a, CAST(trade_date + 60 AS DATE) AS b FROM weekly) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM actions x WHERE x.entity_id = e.entity_id AND x.ex_date > a AND x.ex_date <= b)")
def uncontaminated_events(spark: SparkSession, sf: str) -> DataFrame:
    e = D.weekly(spark, sf).select("entity_id", F.col("trade_date").alias("a"), F.date_add("trade_date", 60).alias("b"))
    return U.uncontaminated(e, D.actions(spark, sf).withColumnRenamed("ex_date", "trade_date"), "a", "b")


@query(
    f"""{ctes('weekly')}, p AS (SELECT *, max(close) OVER ({_W}) AS pk FROM weekly), d AS (SELECT *, close / pk - 1 AS dd, sum(CASE WHEN close / pk - 1 = 0 THEN 1 ELSE 0 END) OVER ({_W}) AS id FROM p)
SELECT entity_id, min(trade_date) AS peak_date, any_value(pk) AS peak, min(trade_date) FILTER (dd <= -0.15) AS breach_date, first(trade_date ORDER BY dd, trade_date) AS trough_date, round(min(dd), 9) AS depth, max(trade_date) AS last_date FROM d GROUP BY entity_id, id HAVING count(*) FILTER (dd <= -0.15) > 0"""
)
def drawdown_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return U.drawdown_episodes(D.weekly(spark, sf), "close", 0.15).withColumn("depth", F.round("depth", 9))


def _volume_and_next(spark: SparkSession, sf: str) -> DataFrame:
    return D.weekly(spark, sf).withColumn("nxt", F.log(F.try_divide(F.lead("close").over(S.line()), F.col("close")))).select("entity_id", "trade_date", "volume", "nxt")


_VN = f"vn AS (SELECT entity_id, trade_date, volume, ln(lead(close) OVER ({_W}) / close) AS nxt FROM weekly), lad AS (SELECT trade_date, CAST(floor((rk - 1) * 5 / n) + 1 AS INTEGER) AS bin, count(*) AS n, avg(nxt) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY volume, entity_id) AS rk, count(*) OVER (PARTITION BY trade_date) AS n FROM vn WHERE nxt IS NOT NULL) GROUP BY 1, 2)"


@query(f"{ctes('weekly')}, {_VN} SELECT trade_date, bin, n, round(mean, 7) AS mean FROM lad")
def decile_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.decile_ladder(_volume_and_next(spark, sf), ["trade_date"], "volume", "nxt", "entity_id", 5), 7)


@query(f"{ctes('weekly')}, {_VN} SELECT trade_date, round(max(mean) FILTER (bin = 5) - sum(mean * n) FILTER (bin < 5) / sum(n) FILTER (bin < 5), 7) AS spread FROM lad GROUP BY 1")
def top_minus_rest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.top_minus_rest(U.decile_ladder(_volume_and_next(spark, sf), ["trade_date"], "volume", "nxt", "entity_id", 5), ["trade_date"], 5), 7)


@query("SELECT * FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type = p")
def frozen_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return U.frozen_runs(D.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type", F.col("event_type").alias("p"))


@query(f"{ctes('weekly')}, b AS (SELECT entity_id, trade_date, close AS a, close * (1 + (entity_id % 7) * 0.0004) AS b FROM weekly), g AS (SELECT abs(a / b - 1) AS g FROM b) SELECT count(*) AS pairs, round(avg(CASE WHEN g > 0.001 THEN 1.0 ELSE 0 END), 7) AS outside, round(quantile_cont(g, 0.5), 9) AS median, round(quantile_cont(g, 0.9), 9) AS q90, round(quantile_cont(g, 0.99), 9) AS q99, round(max(g), 9) AS worst FROM g")
def source_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    a = D.weekly(spark, sf).select("entity_id", "trade_date", "close")
    b = a.withColumn("close", F.col("close") * (1 + (F.col("entity_id") % 7) * 0.0004))
    out = U.reconciliation(a, b, ["entity_id", "trade_date"], "close", 0.001)
    return out.select("pairs", F.round("outside", 7).alias("outside"), *(F.round(c, 9).alias(c) for c in ("median", "q90", "q99", "worst")))


@query(
    f"""{ctes('weekly')}, m AS (SELECT entity_id, count(*) AS sessions, count(*) FILTER (greatest(abs(high * 1.0005 / high - 1), CASE WHEN entity_id % 5 = 0 THEN 0.01 ELSE 0 END) > 0.001) AS bad FROM weekly GROUP BY 1) SELECT entity_id, sessions, round(bad / sessions, 9) AS mismatch FROM m"""
)
def vendor_check(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf)
    bad = F.greatest(F.abs(F.col("high") * 1.0005 / F.col("high") - 1), F.when(F.col("entity_id") % 5 == 0, 0.01).otherwise(0.0)) > 0.001
    return w.groupBy("entity_id").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg(bad.cast("double")), 9).alias("mismatch"))


@query(
    """WITH b AS (SELECT *, turn < lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS back, count(*) OVER (PARTITION BY conv_id, turn) > 1 AS twice FROM conversations), f AS (SELECT conv_id, count(*) AS rows, sum(CASE WHEN back THEN 1 ELSE 0 END) AS back_in_time, sum(CASE WHEN twice THEN 1 ELSE 0 END) AS repeated_ids FROM b GROUP BY 1)
SELECT f.conv_id, rows, CAST(back_in_time AS BIGINT) AS back_in_time, CAST(repeated_ids AS BIGINT) AS repeated_ids, coalesce((SELECT count(*) FROM conversations c WHERE c.conv_id = f.conv_id AND role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'user')), 0) AS orphans FROM f"""
)
def log_audit(spark: SparkSession, sf: str) -> DataFrame:
    return U.log_audit(D.table(spark, sf, "conversations"), "conv_id", "turn", "role", "turn", "user", "assistant")


@query("SELECT p_brand, count(*) AS rows, count(*) FILTER (p_retailprice <= 0) AS bad_price, count(*) FILTER (p_size IS NULL OR p_size < 1) AS bad_strike, count(*) FILTER (p_retailprice < p_size) AS below_strike FROM part GROUP BY 1")
def row_checks(spark: SparkSession, sf: str) -> DataFrame:
    p, size = F.col("p_retailprice"), F.col("p_size")
    return D.table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows"), F.count_if(p <= 0).alias("bad_price"), F.count_if(size.isNull() | (size < 1)).alias("bad_strike"), F.count_if(p < size).alias("below_strike"))


@query(
    f"""{ctes('weekly')}, n AS (SELECT *, row_number() OVER ({_W}) AS i FROM weekly), t AS (SELECT entity_id, trade_date, close AS entry, i AS e FROM n WHERE day(trade_date) <= 2),
l AS (SELECT t.entity_id, t.trade_date, entry, level, min(CASE WHEN n.high >= entry * (1 + level) THEN n.i - e END) AS rows_to_touch FROM t JOIN n ON n.entity_id = t.entity_id AND n.i > e AND n.i <= e + 5, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) v(level) GROUP BY ALL) SELECT * FROM l"""
)
def excursions(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf)
    t = w.filter(F.dayofmonth("trade_date") <= 2).select("entity_id", "trade_date", F.col("close").alias("entry"))
    return U.level_touches(t, w, [0.5, 1.0], 5).withColumn("rows_to_touch", F.col("rows_to_touch").cast("bigint"))


@query(
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events), i AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM d), f AS (SELECT k, CAST(sum(s) OVER (ORDER BY k) - s AS BIGINT) AS a, CAST(sum(s) OVER (ORDER BY k) AS BIGINT) AS b FROM (SELECT k, n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT n FROM i), generate_series(0, 4) g(k)))
SELECT trade_date, CAST(max(k) FILTER (i >= a AND i < b) AS INTEGER) AS fold, CAST(count(*) FILTER (i < a - 2 OR i >= b + 1) AS INTEGER) AS training_folds FROM i, f GROUP BY 1"""
)
def purged_folds(spark: SparkSession, sf: str) -> DataFrame:
    return U.purged_folds(D.table(spark, sf, "events").select(F.to_date("ts").alias("trade_date")), 5, 2, 1)


@query(
    """WITH t AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS price FROM events), b AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS pt, last_value(price IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN price IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS nt FROM t
WINDOW p AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, CASE WHEN price IS NOT NULL THEN 'OBSERVED' WHEN coalesce(floor(epoch(nt)) - floor(epoch(pt)) < 40000, false) THEN 'FILLED' ELSE 'MISSING' END AS tier FROM b) SELECT user_id, event_id, price, tier, CASE WHEN tier = 'FILLED' THEN pv ELSE price END AS filled FROM k"""
)
def endpoint_fill(spark: SparkSession, sf: str) -> DataFrame:
    t = D.table(spark, sf, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("price"))
    return U.bar_gaps_filled(t, 40_000, ["user_id", "day"]).drop("ts", "day")


@query(
    f"""{ctes('weekly')}, u AS (SELECT *, CASE WHEN close > lag(close) OVER ({_W}) THEN volume END AS up FROM weekly)
SELECT entity_id, trade_date, round(CASE WHEN count(up) OVER a >= 5 THEN avg(up) OVER a END - CASE WHEN count(up) OVER b >= 5 THEN avg(up) OVER b END, 5) AS abnormal FROM u WINDOW a AS ({_W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), b AS ({_W} ROWS BETWEEN 81 PRECEDING AND 22 PRECEDING)"""
)
def abnormal_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.abnormal_volume(D.weekly(spark, sf), 21, 60).select("entity_id", "trade_date", "abnormal"), 5)


@query(
    f"""{ctes('weekly')}, r AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS ret, lead(close) OVER ({_W}) / lead(open) OVER ({_W}) - 1 AS nx FROM weekly), s AS (SELECT *, CASE WHEN count(ret) OVER w >= 26 THEN stddev_samp(ret) OVER w END AS sigma FROM r WINDOW w AS ({_W} ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING))
SELECT entity_id, trade_date, round(ret, 7) AS ret, round(nx, 7) AS next_return FROM s WHERE ret < -0.2 * sigma"""
)
def weekly_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.weekly_reversal(D.weekly(spark, sf), 26, 0.2).select("entity_id", "trade_date", "ret", "next_return"), 7)


@query("WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey % 5 AS g, round(avg(o_totalprice % 100 - 49) / 10000, 8) AS r FROM orders GROUP BY 1, 2) SELECT g, count(r) AS n, round(pow(exp(sum(ln(1 + r))), 252.0 / count(r)) - 1, 6) AS cagr, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe FROM d GROUP BY 1")
def performance(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 5).alias("g")).agg(F.round(F.avg(F.col("o_totalprice") % 100 - 49) / 10000, 8).alias("r"))
    return U.performance(d, "r", 252, ["g"]).select("g", "n", F.round("cagr", 6).alias("cagr"), F.round("sharpe", 5).alias("sharpe"))


@query(f"{ctes('weekly')}, x AS (SELECT entity_id, trade_date, close, volume, turnover, count(*) OVER p AS n FROM weekly WINDOW p AS (PARTITION BY trade_date)), c AS (SELECT trade_date, corr(close, volume) AS a, corr(close, turnover) AS b, corr(volume, turnover) AS c FROM x WHERE n >= 10 GROUP BY 1) SELECT trade_date, round((a - b * c) / nullif(sqrt((1 - b * b) * (1 - c * c)), 0), 5) AS partial FROM c")
def partial_correlation(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trade_date"))).filter("n >= 10")
    c = w.groupBy("trade_date").agg(F.corr("close", "volume").alias("a"), F.corr("close", "turnover").alias("b"), F.corr("volume", "turnover").alias("c"))
    return c.select("trade_date", F.round(X.partial_corr(F.col("a"), F.col("b"), F.col("c")), 5).alias("partial"))


@query(f"{ctes('weekly')}, l AS (SELECT entity_id, max(trade_date) AS last_date FROM weekly GROUP BY 1), {_gaps(GAP)} SELECT g.entity_id, g.trade_date, g.trade_date < last_date AS has_future, gap FROM g JOIN l USING (entity_id)")
def survivorship(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf)
    last = F.max("trade_date").over(Window.partitionBy("entity_id"))
    return w.select("entity_id", "trade_date", (F.col("trade_date") < last).alias("has_future"), S.gap_flag(S.line(), days=GAP).alias("gap"))


@query(
    f"""{ctes('weekly')}, m AS (SELECT *, close / lag(close, 8) OVER ({_W}) - 1 AS mom, close / lag(close) OVER ({_W}) - 1 AS r1, volume / nullif(CASE WHEN count(volume) OVER v >= 4 THEN avg(volume) OVER v END, 0) AS vr, CASE WHEN count(turnover) OVER l >= 20 THEN quantile_cont(turnover, 0.5) OVER l END AS liq FROM weekly WINDOW v AS ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), l AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, quantile_cont(mom, 0.9) OVER p AS a, quantile_cont(liq, 1/3.0) OVER p AS b, quantile_cont(r1, 1/3.0) OVER p AS c FROM m WINDOW p AS (PARTITION BY trade_date)) SELECT entity_id, trade_date FROM e WHERE mom >= a AND liq > b AND r1 <= c AND vr > 1.5"""
)
def swing_signals(spark: SparkSession, sf: str) -> DataFrame:
    w = S.line()
    v = w.rowsBetween(-4, -1)
    m = D.weekly(spark, sf).withColumns({"mom": F.try_divide(F.col("close"), F.lag("close", 8).over(w)) - 1, "r1": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, "vr": F.try_divide(F.col("volume"), S.full(F.avg("volume"), F.col("volume"), v, 4)), "ok": F.lit(True), "liq": S.full(F.percentile("turnover", F.lit(0.5)), F.col("turnover"), w.rowsBetween(-19, 0), 20)})
    return P.swing_signals(m, "mom", "liq", "r1", "vr", "ok").filter("signal").select("entity_id", "trade_date")


@query("WITH i AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_totalprice FROM i WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT) FROM (SELECT DISTINCT n FROM i), generate_series(0, 6) g(k))")
def percentile_picks(spark: SparkSession, sf: str) -> DataFrame:
    return P.picks_by_percentile(D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 7)


@query()
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return P.stratified_sample(D.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], 5, 11, ["o_orderkey"])


@query()
def beta_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"))
    return U.beta_bootstrap(o, "y", "x", "day", 6, 300)


@query()
def residual_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.hour("ts").alias("anchor"), (F.col("event_id") % 13).cast("double").alias("x"), F.col("value").alias("y"))
    return U.residual_bootstrap(e, "y", "x", "day", "anchor", 200)


@query()
def missingness(spark: SparkSession, sf: str) -> DataFrame:
    return U.missing_at_random(D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 0.02, 20)


@query()
def shuffled_control(spark: SparkSession, sf: str) -> DataFrame:
    v = _volume_and_next(spark, sf).filter("nxt is not null")
    s = I.shuffled(v, ["trade_date"], "nxt", 3, ["entity_id"])
    return rounded(X.rank_ic(s, ["trade_date"], "volume", "shuffled"))


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'refund' AND t.user_id = e.user_id)")
def tombstoned(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events")
    return TX.without_tombstones(e.select("event_id", "user_id"), e.filter("event_type = 'refund'"), ["user_id"])


@query("SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = CAST(ts + INTERVAL 90 MINUTE AS DATE)")
def fresh_ticks(spark: SparkSession, sf: str) -> DataFrame:
    def build(s):
        return L.fresh_only(s.withColumn("seen", F.col("ts") + F.expr("interval 90 minutes")), "ts", "seen").select("event_id", "ts")

    return L.replay(spark, sf, "events", build, "fresh")


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def refusal_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    return TX.first_events(e, ["user_id", "event_type", "day"], ["event_id"])


@query("WITH n AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1) SELECT user_id, n, CASE WHEN n >= 100 THEN round(m, 6) END AS mean FROM n")
def gated_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    n = D.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return n.select("user_id", "n", F.when(F.col("n") >= 100, F.round("m", 6)).alias("mean"))


@query(f"{ctes('weekly')}, e AS (SELECT entity_id, last(close ORDER BY trade_date) AS last_close FROM weekly GROUP BY 1), v AS (SELECT entity_id, last_close * CASE WHEN entity_id % 4 = 0 THEN 0.5 ELSE 1.01 END AS vendor FROM e) SELECT entity_id, CASE WHEN abs(last_close / vendor - 1) > 0.02 THEN round(last_close / vendor, 9) ELSE 1.0 END AS rescale FROM e JOIN v USING (entity_id)")
def listing_rescale(spark: SparkSession, sf: str) -> DataFrame:
    e = D.weekly(spark, sf).groupBy("entity_id").agg(F.max_by("close", "trade_date").alias("last_close"))
    r = F.col("last_close") / (F.col("last_close") * F.when(F.col("entity_id") % 4 == 0, 0.5).otherwise(1.01))
    return e.select("entity_id", F.when(F.abs(r - 1) > 0.02, F.round(r, 9)).otherwise(1.0).alias("rescale"))
