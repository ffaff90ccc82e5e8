"""Registered queries of the engine and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import bars as B
from tidewell.operators import bitemporal as T
from tidewell.operators import inference as I
from tidewell.operators import joins as J
from tidewell.operators import portfolio as P
from tidewell.operators import rules as R
from tidewell.operators import series as S
from tidewell.operators import warehouse as W
from tidewell.operators import xsection as X
from tidewell.sources import text as TX
from tidewell.streaming import live as L

from . import standin as D
from .standin import ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

AS_OF = "1998-06-30"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6, *but: str) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes))


# ---- bitemporal reads


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def revision_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return T.read_latest(D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(f"{ctes('filings')} SELECT isin, period_end, consolidated, value, known_date, seq_number FROM filings WHERE known_date <= DATE '{AS_OF}'")
def as_of_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return T.verify_as_of(T.visible_as_of(D.filings(spark, sf), AS_OF), AS_OF)


@query(
    f"""{ctes('filings')}, a AS (SELECT * FROM filings WHERE known_date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY isin, period_end, consolidated ORDER BY known_date DESC, seq_number DESC) = 1)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY isin, period_end ORDER BY CASE WHEN consolidated = 'Consolidated' THEN 0 ELSE 1 END, seq_number DESC) = 1"""
)
def pit_strict(spark: SparkSession, sf: str) -> DataFrame:
    return T.pit_strict(D.filings(spark, sf), AS_OF)


_COLLAPSED = """collapsed AS (SELECT * EXCLUDE (c) FROM (SELECT *, max(consolidated = 'Consolidated') OVER (PARTITION BY isin, period_end) AS c FROM filings)
WHERE (consolidated = 'Consolidated') = c QUALIFY row_number() OVER (PARTITION BY isin, period_end ORDER BY known_date DESC, seq_number DESC) = 1)"""


@query(f"{ctes('filings')}, {_COLLAPSED} SELECT * FROM collapsed")
def pit_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return T.pit_collapsed(D.filings(spark, sf))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return T.duplicates(D.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 1)")
def append_new(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    old = o.filter("o_orderkey % 7 = 1")
    return o.join(old.select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey", "o_custkey").distinct()


@query("SELECT c.c_custkey, c.c_name, CASE WHEN c.c_custkey % 10 = 3 THEN 'FIXED' ELSE c.c_mktsegment END AS c_mktsegment FROM customer c")
def corrected_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return T.corrected(c, c.filter("c_custkey % 10 = 3").select("c_custkey", F.lit("FIXED").alias("c_mktsegment")), ["c_custkey"], "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) < DATE '1996-01-01'")
def sealed_reads(spark: SparkSession, sf: str) -> DataFrame:
    T.guard_range("1995-12-31", "1996-01-01")
    rows = D.table(spark, sf, "lineitem").filter("l_shipdate < timestamp '1996-01-01'").select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("trade_date"))
    return T.sealed(rows, "1996-01-01").drop("trade_date")


# ---- identity, adjustment, guards


@query(
    f"""{ctes('daily')} SELECT d.entity_id, d.trade_date, d.close, n.n_name FROM daily d JOIN supplier s ON s.s_suppkey = d.entity_id JOIN nation n ON n.n_nationkey = s.s_nationkey"""
)
def entity_panel(spark: SparkSession, sf: str) -> DataFrame:
    s, n = D.table(spark, sf, "supplier"), D.table(spark, sf, "nation")
    named = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("entity_id"), "n_name")
    return D.daily(spark, sf).join(named, "entity_id").select("entity_id", "trade_date", "close", "n_name")


_FACTORS = """factors AS (SELECT d.entity_id, d.trade_date, coalesce(product(1 / a.ratio), 1.0) AS factor FROM {t} d LEFT JOIN actions a ON a.entity_id = d.entity_id AND a.ex_date > d.trade_date GROUP BY 1, 2)"""


@query(f"{ctes('daily', 'actions')}, {_FACTORS.format(t='daily')} SELECT entity_id, trade_date, round(factor, 10) AS factor, close * round(factor, 10) AS adjusted_close FROM daily JOIN factors USING (entity_id, trade_date)")
def adjust_factor(spark: SparkSession, sf: str) -> DataFrame:
    out = W.adjustment_factors(D.daily(spark, sf), D.actions(spark, sf)).withColumn("factor", F.round("factor", 10))
    return out.select("entity_id", "trade_date", "factor", (F.col("close") * F.col("factor")).alias("adjusted_close"))


@query(
    f"""{ctes('daily', 'actions')}, r AS (SELECT entity_id, trade_date, close, close / lag(close) OVER (PARTITION BY entity_id ORDER BY trade_date) AS ratio FROM daily)
SELECT entity_id, trade_date, round(ratio, 6) AS ratio, EXISTS (SELECT 1 FROM actions a WHERE a.entity_id = r.entity_id AND a.ex_date BETWEEN r.trade_date - 10 AND r.trade_date + 10) AS near_action
FROM r WHERE ratio > 1.5 OR ratio < 1 / 1.5"""
)
def jump_same_id(spark: SparkSession, sf: str) -> DataFrame:
    out = W.jumps(D.daily(spark, sf), D.actions(spark, sf))
    return out.select("entity_id", "trade_date", F.round("ratio", 6).alias("ratio"), "near_action")


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("s"), F.year("o_orderdate").alias("y"), F.to_date("o_orderdate").alias("d"))
    code = F.concat(F.when(F.col("s") % 9 == 8, F.concat(F.lit("X"), F.lpad((F.col("y") % 100).cast("string"), 2, "0"))).otherwise("INE"), F.lpad((F.col("s") + F.when(F.col("s") % 7 == 0, F.col("y") % 3).otherwise(0)).cast("string"), 4, "0"), F.lit("01"), F.lpad((F.col("y") - 1990).cast("string"), 2, "0"))
    return rows.groupBy(F.concat(F.lit("S"), F.col("s")).alias("symbol"), code.alias("isin")).agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"))


_SPANS = """spans AS (SELECT 'S' || s AS symbol, CASE WHEN s % 9 = 8 THEN 'X' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') ELSE 'INE' END || lpad(CAST(s + CASE WHEN s % 7 = 0 THEN y % 3 ELSE 0 END AS VARCHAR), 4, '0') || '01' || lpad(CAST(y - 1990 AS VARCHAR), 2, '0') AS isin,
min(d) AS first_date, max(d) AS last_date FROM (SELECT o_custkey % 40 AS s, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1, 2),
links AS (SELECT symbol, isin AS predecessor_isin, nx AS isin, nf AS known_date, CASE WHEN substr(isin, 1, 3) <> substr(nx, 1, 3) THEN 'prefix' WHEN substr(isin, 4, 4) <> substr(nx, 4, 4) THEN 'issuer' WHEN substr(isin, 8, 2) <> substr(nx, 8, 2) THEN 'type'
WHEN coalesce(TRY_CAST(substr(nx, 10, 2) AS INTEGER) <= TRY_CAST(substr(isin, 10, 2) AS INTEGER), true) THEN 'serial' WHEN nf <= last_date THEN 'overlap' ELSE 'linked' END AS status
FROM (SELECT *, lead(isin) OVER w AS nx, lead(first_date) OVER w AS nf FROM spans WINDOW w AS (PARTITION BY symbol ORDER BY first_date, isin)) WHERE nx IS NOT NULL)"""


@query(f"WITH {_SPANS} SELECT * FROM links")
def lineage_links(spark: SparkSession, sf: str) -> DataFrame:
    return W.lineage_links(_spans(spark, sf))


@query(
    f"""WITH RECURSIVE {_SPANS}, up AS (SELECT DISTINCT s.isin, coalesce(l.predecessor_isin, s.isin) AS parent FROM spans s LEFT JOIN links l ON l.isin = s.isin AND l.status = 'linked'),
walk(isin, node) AS (SELECT isin, isin FROM up UNION SELECT w.isin, u.parent FROM walk w JOIN up u ON u.isin = w.node)
SELECT isin, node AS entity_id FROM walk WHERE node IN (SELECT isin FROM up WHERE parent = isin)"""
)
def lineage_roots(spark: SparkSession, sf: str) -> DataFrame:
    spans = _spans(spark, sf)
    return W.lineage_roots(spans, W.lineage_links(spans))


@query(f"{ctes('daily')}, s AS (SELECT entity_id, min(trade_date) a, max(trade_date) b FROM daily GROUP BY 1), d AS (SELECT entity_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM s) SELECT * FROM d WHERE isodow(trade_date) < 6 AND NOT EXISTS (SELECT 1 FROM daily x WHERE x.entity_id = d.entity_id AND x.trade_date = d.trade_date)")
def missing_days(spark: SparkSession, sf: str) -> DataFrame:
    return W.missing_days(D.daily(spark, sf))


@query(
    f"""{ctes('daily')}, s AS (SELECT entity_id, min(trade_date) a, max(trade_date) b FROM daily GROUP BY 1), d AS (SELECT entity_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM s),
g AS (SELECT * FROM d WHERE isodow(trade_date) < 6 AND NOT EXISTS (SELECT 1 FROM daily x WHERE x.entity_id = d.entity_id AND x.trade_date = d.trade_date))
SELECT entity_id, trade_date, CASE WHEN trade_date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30' THEN 'blocked' WHEN DATE '2001-11-01' - trade_date > 30 THEN 'alert' ELSE 'fill' END AS action FROM g"""
)
def gap_policy(spark: SparkSession, sf: str) -> DataFrame:
    blocked = spark.sql("select date '1996-03-01' as start, date '1996-06-30' as end")
    return W.gap_policy(W.missing_days(D.daily(spark, sf)), blocked, "2001-11-01")


@query(f"{ctes('daily')} SELECT max(trade_date) AS latest, CAST(DATE '2001-11-06' - max(trade_date) AS INTEGER) AS age_days, DATE '2001-11-06' - max(trade_date) <= 3 AS fresh FROM daily")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return W.freshness(D.daily(spark, sf), "2001-11-06")


@query()
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return W.table_fingerprint(D.table(spark, sf, "orders"), "o_orderkey")


@query(
    f"""{ctes('weekly')}, b AS (SELECT entity_id, trade_date, high * CASE entity_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0.5 + entity_id * 0.01 END AS bh, low * CASE entity_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0.6 END AS bl FROM weekly),
r AS (SELECT entity_id, trade_date, high / bh AS rh, low / bl AS rl FROM weekly JOIN b USING (entity_id, trade_date))
SELECT entity_id, trade_date, round(rh, 6) AS r_high, round(rl, 6) AS r_low, CASE WHEN abs(rh / rl - 1) <= 0.001 THEN round((rh + rl) / 2, 6) END AS scale, CASE WHEN abs(rh / rl - 1) > 0.001 THEN 'UNRESOLVED' WHEN abs((rh + rl) / 2 - 1) <= 0.01 THEN 'RAW' ELSE 'SCALED' END AS status FROM r"""
)
def scale_probe(spark: SparkSession, sf: str) -> DataFrame:
    a = D.weekly(spark, sf)
    k = lambda other: F.when(F.col("entity_id") % 3 == 0, 1.0).when(F.col("entity_id") % 3 == 1, 2.0).otherwise(other)
    b = a.withColumns({"high": F.col("high") * k(0.5 + F.col("entity_id") * 0.01), "low": F.col("low") * k(F.lit(0.6))})
    return rounded(W.scale_probe(a, b, ["entity_id", "trade_date"]))


@query(f"{ctes('daily')}, c AS (SELECT DISTINCT trade_date, dense_rank() OVER (ORDER BY trade_date) AS i FROM daily) SELECT a.trade_date, b.trade_date AS shifted FROM c a LEFT JOIN c b ON b.i = a.i + 3")
def session_offset(spark: SparkSession, sf: str) -> DataFrame:
    days = D.daily(spark, sf).select("trade_date").distinct()
    return W.shifted_session(days, days, 3)


# ---- joins


_OBS = "obs AS (SELECT l_suppkey % 10 AS entity_id, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"


def _obs(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("entity_id"), F.to_date("l_shipdate").alias("d")).agg(F.max("l_extendedprice").alias("v"))


def _asks(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("entity_id"), "o_orderkey", F.to_date("o_orderdate").alias("at"))


_ASKS = "asks AS (SELECT o_custkey % 10 AS entity_id, o_orderkey, CAST(o_orderdate AS DATE) AS at_ FROM orders)"


@query(f"WITH {_OBS}, {_ASKS} SELECT a.entity_id, a.o_orderkey, a.at_ AS at, o.d AS matched_ts, o.v FROM asks a ASOF LEFT JOIN obs o ON a.entity_id = o.entity_id AND a.at_ >= o.d")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    return J.asof_backward(_asks(spark, sf), _obs(spark, sf), "entity_id", "at", "d", ["v"])


@query(
    f"""WITH {_OBS}, {_ASKS} SELECT a.entity_id, a.o_orderkey, a.at_ AS at, coalesce(f.d, b.d) AS matched_ts, coalesce(f.v, b.v) AS v, f.d IS NOT NULL AS first_choice
FROM asks a ASOF LEFT JOIN obs f ON a.entity_id = f.entity_id AND a.at_ <= f.d ASOF LEFT JOIN obs b ON a.entity_id = b.entity_id AND a.at_ >= b.d"""
)
def asof_forward_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return J.asof_with_fallback(_asks(spark, sf), _obs(spark, sf), "entity_id", "at", "d", ["v"])


@query(
    """WITH spot AS (SELECT p_brand, avg(p_retailprice) AS spot FROM part GROUP BY 1), o AS (SELECT DISTINCT p_brand, round(p_retailprice / 50) * 50 AS strike FROM part)
SELECT p_brand, round(spot, 4) AS spot, first(strike ORDER BY abs(strike - spot), strike) AS nearest FROM spot JOIN o USING (p_brand) GROUP BY p_brand, spot"""
)
def nearest_strike(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part")
    spot = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("spot"))
    strikes = p.select("p_brand", (F.round(F.col("p_retailprice") / 50) * 50).alias("strike")).distinct()
    return J.nearest(spot, strikes, ["p_brand"], "spot", "strike").withColumn("spot", F.round("spot", 4))


@query(f"{ctes('weekly', 'actions')} SELECT entity_id, trade_date, EXISTS (SELECT 1 FROM actions a WHERE a.entity_id = w.entity_id AND a.ex_date BETWEEN w.trade_date - 10 AND w.trade_date + 10) AS flagged FROM weekly w")
def range_exists(spark: SparkSession, sf: str) -> DataFrame:
    return J.range_flag(D.weekly(spark, sf).select("entity_id", "trade_date"), D.actions(spark, sf), "entity_id", "trade_date", "ex_date", 10, 10)


@query("SELECT c_custkey, c.o AS before_n, d.o AS after_n FROM customer LEFT JOIN (SELECT o_custkey, count(*) o FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) c ON c.o_custkey = c_custkey FULL OUTER JOIN (SELECT o_custkey, count(*) o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) d ON d.o_custkey = c_custkey WHERE c.o IS DISTINCT FROM d.o")
def outer_diff(spark: SparkSession, sf: str) -> DataFrame:
    o, c = D.table(spark, sf, "orders"), D.table(spark, sf, "customer").select("c_custkey")
    cut = F.lit("1997-01-01").cast("timestamp")
    n = lambda cond, name: o.filter(cond).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias(name))
    return c.join(n(F.col("o_orderdate") < cut, "before_n"), "c_custkey", "left").join(n(F.col("o_orderdate") >= cut, "after_n"), "c_custkey", "full_outer").filter(~F.col("before_n").eqNullSafe(F.col("after_n")))


# ---- bars


def _bars_sql(minutes: int, offset: int = 0) -> str:
    start = f"time_bucket(INTERVAL {minutes} MINUTE, ts, INTERVAL {offset} MINUTE)"
    return f"""{ctes('ticks')} SELECT entity_id, {start} AS bar_start, {start} + INTERVAL {minutes} MINUTE AS bar_end, first(price ORDER BY ts, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, price) AS close,
sum(volume) AS volume, count(*) AS n_ticks, last(price ORDER BY ts, price) > first(price ORDER BY ts, price) AS is_green, last(price ORDER BY ts, price) < first(price ORDER BY ts, price) AS is_red FROM ticks GROUP BY 1, 2"""


@query(_bars_sql(5))
def bars_5m(spark: SparkSession, sf: str) -> DataFrame:
    return B.time_bars(D.ticks(spark, sf), "5 minutes")


@query(_bars_sql(15))
def bars_15m(spark: SparkSession, sf: str) -> DataFrame:
    return B.time_bars(D.ticks(spark, sf), "15 minutes")


@query(_bars_sql(60, 15))
def bars_1h_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return B.time_bars(D.ticks(spark, sf), "60 minutes", "15 minutes")


@query(
    f"""{ctes('ticks')}, t AS (SELECT *, CAST(ts AS DATE) AS session, hour(ts) * 60 + minute(ts) AS m FROM ticks), u AS (SELECT *, CAST(floor((m - 555) / 60) AS INTEGER) AS bucket FROM t WHERE m BETWEEN 555 AND 929)
SELECT entity_id, session, bucket, first(price ORDER BY ts, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, price) AS close, sum(volume) AS volume, count(*) AS n_ticks, max(m) AS last_minute, bucket * 60 + 555 AS start_minute, least(bucket * 60 + 615, max(m) + 1) AS end_minute FROM u GROUP BY 1, 2, 3"""
)
def bars_session(spark: SparkSession, sf: str) -> DataFrame:
    return B.session_bars(D.ticks(spark, sf), 60, 555, 929)


@query(f"{ctes('daily')} SELECT entity_id, trade_date, open, high, low, close, volume, round(turnover, 2) AS turnover FROM daily")
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return D.daily(spark, sf).withColumn("turnover", F.round("turnover", 2))


@query(f"{ctes('daily')} SELECT entity_id, CAST(date_trunc('week', trade_date) AS DATE) AS week, first(open ORDER BY trade_date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY trade_date) AS close, sum(volume) AS volume, round(sum(turnover), 2) AS turnover, count(*) AS sessions FROM daily GROUP BY 1, 2")
def bars_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.weekly_bars(D.daily(spark, sf)), 2, "open", "high", "low", "close")


@query(
    f"""{ctes('ticks')} SELECT entity_id, CAST(ts AS DATE) AS session, count(*) AS rows, count(DISTINCT ts) AS distinct_ts, min(ts) AS first_ts, max(ts) AS last_ts, last(price ORDER BY ts, price) AS last_price, count(*) FILTER (price <= 0) AS bad_price, count(*) FILTER (price IS NULL) AS null_price,
count(*) FILTER (hour(ts) * 60 + minute(ts) < 555 OR hour(ts) * 60 + minute(ts) >= 930) AS outside_hours, sum(CASE WHEN hour(ts) < 12 THEN volume ELSE 0 END) AS morning_volume FROM ticks GROUP BY 1, 2"""
)
def session_audit(spark: SparkSession, sf: str) -> DataFrame:
    return B.session_audit(D.ticks(spark, sf))


@query(
    f"""{ctes('ticks')}, b AS (SELECT entity_id, CAST(floor(price / 25) AS BIGINT) AS bucket, sum(volume) AS v FROM ticks GROUP BY 1, 2)
SELECT entity_id, first(bucket ORDER BY v DESC, bucket) AS poc_bucket, max(v) AS poc_volume, sum(v) AS total FROM b GROUP BY 1"""
)
def poc_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return B.volume_profile(D.ticks(spark, sf), 25.0, ["entity_id"])


@query(
    f"""{ctes('weekly')}, x AS (SELECT entity_id, trade_date, CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN 'NaN'::DOUBLE ELSE open END AS open, CASE WHEN k = 3 THEN 'inf'::DOUBLE WHEN k = 4 THEN low - 1 ELSE high END AS high, low, CASE WHEN k = 5 THEN high + 1 WHEN k = 6 THEN -1 ELSE close END AS close, CASE WHEN k = 7 THEN -volume WHEN k IN (8, 9) THEN 0 ELSE volume END AS volume
FROM (SELECT *, (entity_id * 7 + year(trade_date) + month(trade_date)) % 12 AS k FROM weekly))
SELECT entity_id, trade_date, CASE WHEN open IS NULL OR isnan(open) OR high IS NULL OR isnan(high) OR isnan(low) OR isnan(close) OR isnan(volume) THEN 'missing' WHEN isinf(open) OR isinf(high) OR isinf(low) OR isinf(close) THEN 'infinite' WHEN least(open, high, low, close) <= 0 THEN 'non_positive' WHEN volume < 0 THEN 'negative_volume'
WHEN high < low THEN 'high_below_low' WHEN open > high OR open < low OR close > high OR close < low THEN 'outside_range' WHEN volume = 0 AND high <> low THEN 'moved_without_volume' WHEN volume = 0 THEN 'flat' ELSE 'valid' END AS category FROM x"""
)
def bar_validity(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf).withColumn("k", (F.col("entity_id") * 7 + F.year("trade_date") + F.month("trade_date")) % 12)
    k = F.col("k")
    bad = w.withColumns(
        {
            "open": F.when(k == 1, F.lit(None)).when(k == 2, float("nan")).otherwise(F.col("open")),
            "high": F.when(k == 3, float("inf")).when(k == 4, F.col("low") - 1).otherwise(F.col("high")),
            "close": F.when(k == 5, F.col("high") + 1).when(k == 6, -1.0).otherwise(F.col("close")),
            "volume": F.when(k == 7, -F.col("volume")).when(k.isin(8, 9), 0.0).otherwise(F.col("volume")),
        }
    )
    return bad.select("entity_id", "trade_date", B.bar_category().alias("category"))


@query(f"{ctes('weekly')} SELECT trade_date, count(*) AS n, round(count(*) FILTER (close > open) / count(*), 9) AS advancing, round(count(*) FILTER (close < open) / count(*), 9) AS declining FROM weekly GROUP BY 1")
def breadth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.breadth(D.weekly(spark, sf), "trade_date"), 9)


# ---- series


def _gaps(days: int) -> str:
    return f"g AS (SELECT *, CASE WHEN trade_date - lag(trade_date) OVER (PARTITION BY entity_id ORDER BY trade_date) > {days} THEN 1 ELSE 0 END AS gap FROM weekly)"


_W = "PARTITION BY entity_id ORDER BY trade_date"
LOOKBACK, SKIP, HORIZON, GAP = 12, 2, 3, 15

_MOM = f"CASE WHEN max(gap) OVER ({_W} ROWS BETWEEN {LOOKBACK + SKIP - 1} PRECEDING AND CURRENT ROW) = 0 THEN lag(close, {SKIP}) OVER ({_W}) / lag(close, {SKIP + LOOKBACK}) OVER ({_W}) - 1 END"
_FWD = f"CASE WHEN coalesce(max(gap) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING), 0) = 0 THEN lead(close, {HORIZON}) OVER ({_W}) / close - 1 END"


@query(f"{ctes('weekly')}, {_gaps(GAP)} SELECT entity_id, trade_date, round({_MOM}, 9) AS momentum FROM g")
def momentum_skip(spark: SparkSession, sf: str) -> DataFrame:
    return S.momentum(D.weekly(spark, sf), LOOKBACK, SKIP, days=GAP).select("entity_id", "trade_date", F.round("momentum", 9).alias("momentum"))


@query(f"{ctes('weekly')}, {_gaps(GAP)} SELECT entity_id, trade_date, round({_FWD}, 9) AS fwd_return, lead(trade_date, {HORIZON}) OVER ({_W}) AS eval_date FROM g")
def forward_return(spark: SparkSession, sf: str) -> DataFrame:
    return S.forward_return(D.weekly(spark, sf), HORIZON, days=GAP).select("entity_id", "trade_date", F.round("fwd_return", 9).alias("fwd_return"), "eval_date")


def _adjusted_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return W.adjusted_prices(D.weekly(spark, sf), D.actions(spark, sf), ("close",)).withColumn("close", F.col("adjusted_close"))


_ADJ = f"{ctes('weekly', 'actions')}, {_FACTORS.format(t='weekly')}, adj AS (SELECT w.* REPLACE (close * factor AS close) FROM weekly w JOIN factors USING (entity_id, trade_date)), {_gaps(GAP).replace('FROM weekly', 'FROM adj')}, fm AS (SELECT entity_id, trade_date, round({_MOM}, 9) AS m, round({_FWD}, 9) AS f FROM g)"
_RANKS = "r AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY m) + (count(*) OVER (PARTITION BY trade_date, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY trade_date ORDER BY f) + (count(*) OVER (PARTITION BY trade_date, f) - 1) / 2.0 AS rf FROM fm WHERE m IS NOT NULL AND f IS NOT NULL)"
_IC = f"{_ADJ}, {_RANKS}, ic AS (SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 5 AND count(DISTINCT m) >= 2 AND count(DISTINCT f) >= 2 THEN corr(rm, rf) END AS ic FROM r GROUP BY 1)"


def _ic(spark: SparkSession, sf: str) -> DataFrame:
    df = S.forward_return(S.momentum(_adjusted_weekly(spark, sf), LOOKBACK, SKIP, days=GAP), HORIZON, days=GAP)
    df = df.select("entity_id", "trade_date", F.round("momentum", 9).alias("m"), F.round("fwd_return", 9).alias("f"))
    return X.rank_ic(df, ["trade_date"], "m", "f")


@query(f"{_IC} SELECT trade_date, n, round(ic, 6) AS ic FROM ic")
def rank_ic(spark: SparkSession, sf: str) -> DataFrame:
    """Adjusted weekly closes -> gap-guarded momentum and forward return -> Spearman per date."""
    return rounded(_ic(spark, sf))


@query(f"{_IC} SELECT year(trade_date) AS year, count(ic) AS dates, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic FROM ic GROUP BY 1")
def ic_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return _ic(spark, sf).groupBy(F.year("trade_date").alias("year")).agg(F.count("ic").alias("dates"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.stddev_samp("ic"), 6).alias("sd_ic"))


@query(f"{_IC}, s AS (SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM ic WHERE ic IS NOT NULL) SELECT trade_date, round(ic, 6) AS ic FROM s WHERE i % {HORIZON} = 0")
def ic_non_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    s = _ic(spark, sf).filter("ic is not null").withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)
    return rounded(s.filter(F.col("i") % HORIZON == 0).select("trade_date", "ic"))


@query(f"{_IC}, s AS (SELECT 1 AS entity_id, trade_date, ic, floor((row_number() OVER (ORDER BY trade_date) - 1) / 26) AS b FROM ic WHERE ic IS NOT NULL) SELECT CAST(b AS BIGINT) AS block, count(*) AS n, round(avg(ic), 6) AS mean, max(trade_date) AS last_date FROM s GROUP BY 1 HAVING count(*) = 26")
def ic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    s = _ic(spark, sf).filter("ic is not null").withColumn("entity_id", F.lit(1))
    return rounded(S.blocks(s, 26, "ic")).select("block", "n", "mean", "last_date")


@query(
    f"""{_IC}, s AS (SELECT trade_date, ic, floor((row_number() OVER (ORDER BY trade_date) - 1) / 13) AS b FROM ic WHERE ic IS NOT NULL), k AS (SELECT CAST(b AS BIGINT) AS block, avg(ic) AS mean, max(trade_date) AS last_date FROM s GROUP BY 1 HAVING count(*) = 13),
rolled AS (SELECT block, last_date, avg(mean) OVER w AS m, stddev_samp(mean) OVER w / sqrt(12) AS se, count(mean) OVER w AS n FROM k WINDOW w AS (ORDER BY block ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT block, last_date, round(m, 6) AS rolling_mean, round(se, 6) AS se, CASE WHEN m - 1.96 * se > 0 THEN 'positive' WHEN m + 1.96 * se < 0 THEN 'negative' ELSE 'indistinguishable from zero' END AS label FROM rolled WHERE n = 12"""
)
def ic_rolling_blocks(spark: SparkSession, sf: str) -> DataFrame:
    s = _ic(spark, sf).filter("ic is not null").withColumn("entity_id", F.lit(1))
    return S.rolling_blocks(S.blocks(s, 13, "ic"), 12).select("block", "last_date", F.round("rolling_mean", 6).alias("rolling_mean"), F.round("se", 6).alias("se"), "label")


@query(
    f"""{ctes('weekly')}, y AS (SELECT year(trade_date) AS period, entity_id, median(turnover) AS liq FROM weekly GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY liq DESC, entity_id) AS r FROM y),
h AS (SELECT period, entity_id, 1 / 30.0::DOUBLE AS weight, CASE WHEN r <= 10 THEN 23.0 WHEN r <= 20 THEN 32.5 ELSE 118.0 END AS bps FROM r WHERE r <= 30),
m AS (SELECT coalesce(a.period, b.period + 1) AS period, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS delta, a.bps FROM h a FULL JOIN h b ON a.entity_id = b.entity_id AND a.period = b.period + 1)
SELECT period, round(sum(abs(delta)) / 2, 8) AS turnover, round(sum(CASE WHEN delta > 0 THEN delta * bps / 10000 ELSE 0 END), 8) AS cost FROM m WHERE period <= (SELECT max(period) FROM h) GROUP BY 1"""
)
def rebalance_costs(spark: SparkSession, sf: str) -> DataFrame:
    y = D.weekly(spark, sf).groupBy(F.year("trade_date").alias("period"), "entity_id").agg(F.median("turnover").alias("liq"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("liq"), "entity_id"))
    held = y.withColumn("r", rank).filter("r <= 30").withColumns({"weight": F.lit(1 / 30.0), "tercile": F.when(F.col("r") <= 10, "high_liq").when(F.col("r") <= 20, "mid_liq").otherwise("low_liq")})
    return P.rebalance_costs(held).select("period", F.round("turnover", 8).alias("turnover"), F.round("cost", 8).alias("cost"))


@query(
    f"""{_IC}, s AS (SELECT trade_date, ic, CAST(sign(round(ic, 6)) AS INTEGER) AS sg FROM ic WHERE ic IS NOT NULL), c AS (SELECT *, CASE WHEN sg = lag(sg) OVER (ORDER BY trade_date) THEN 0 ELSE 1 END AS n FROM s), rg AS (SELECT *, sum(n) OVER (ORDER BY trade_date) AS regime FROM c)
SELECT CAST(regime AS BIGINT) AS regime, any_value(sg) AS sign, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS n FROM rg GROUP BY regime"""
)
def ic_regimes(spark: SparkSession, sf: str) -> DataFrame:
    s = rounded(_ic(spark, sf)).withColumn("entity_id", F.lit(1))
    return S.regimes(s, "ic").drop("entity_id")


def _full(expr: str, col: str, n: int, a: int, b: int) -> str:
    frame = f"({_W} ROWS BETWEEN {a} PRECEDING AND {'CURRENT ROW' if b == 0 else f'{b} PRECEDING'})"
    return f"CASE WHEN count({col}) OVER {frame} >= {n} THEN {expr} OVER {frame} END"


@query(
    f"""{ctes('weekly')}, r AS (SELECT *, ln(close / lag(close) OVER ({_W})) AS ret FROM weekly)
SELECT entity_id, trade_date, round({_full('quantile_cont(close, 0.5)', 'close', 20, 19, 0)}, 8) AS median, round({_full('avg(close)', 'close', 20, 19, 0)}, 7) AS sma, round({_full('stddev_samp(ret)', 'ret', 20, 19, 0)}, 7) AS volatility,
{_full('max(close)', 'close', 20, 20, 1)} AS prior_high, {_full('min(close)', 'close', 20, 20, 1)} AS prior_low FROM r"""
)
def rolling_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = S.rolling(D.weekly(spark, sf), 20)
    return out.select("entity_id", "trade_date", F.round("median", 8).alias("median"), *(F.round(c, 7).alias(c) for c in ("sma", "volatility")), "prior_high", "prior_low")


@query(
    f"""{ctes('weekly')}, r AS (SELECT entity_id, trade_date, ln(close / lag(close) OVER ({_W})) AS ret FROM weekly), m AS (SELECT trade_date, avg(ret) AS market FROM r GROUP BY 1), j AS (SELECT r.*, market FROM r JOIN m USING (trade_date)),
b AS (SELECT entity_id, trade_date, CASE WHEN count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER w >= 20 THEN covar_samp(ret, market) OVER w / var_samp(market) OVER w END AS beta FROM j WINDOW w AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT entity_id, trade_date, round(beta, 5) AS beta FROM b"""
)
def rolling_beta(spark: SparkSession, sf: str) -> DataFrame:
    r = D.weekly(spark, sf).withColumn("ret", F.log(F.try_divide(F.col("close"), F.lag("close").over(S.line())))).select("entity_id", "trade_date", "ret")
    m = r.groupBy("trade_date").agg(F.avg("ret").alias("market"))
    return S.rolling_beta(r.join(m, "trade_date"), 20).select("entity_id", "trade_date", F.round("beta", 5).alias("beta"))


@query(
    f"""{ctes('weekly')}, f AS (SELECT entity_id, trade_date, high, low, count(high) OVER l = 2 AND count(high) OVER r = 2 AND high > max(high) OVER l AND high > max(high) OVER r AS u, count(high) OVER l = 2 AND count(high) OVER r = 2 AND low < min(low) OVER l AND low < min(low) OVER r AS d
FROM weekly WINDOW l AS ({_W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)), c AS (SELECT *, lag(CASE WHEN u THEN high END, 2) OVER ({_W}) AS cu, lag(CASE WHEN d THEN low END, 2) OVER ({_W}) AS cd FROM f)
SELECT entity_id, trade_date, coalesce(u, false) AS up_fractal, coalesce(d, false) AS down_fractal, last_value(cu IGNORE NULLS) OVER ({_W}) AS swing_high, last_value(cd IGNORE NULLS) OVER ({_W}) AS swing_low FROM c"""
)
def fractal_swings(spark: SparkSession, sf: str) -> DataFrame:
    out = S.last_confirmed(D.weekly(spark, sf))
    return out.select("entity_id", "trade_date", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("up_fractal", "down_fractal")), "swing_high", "swing_low")


def _smma_sql(value: str, p: int, name: str) -> str:
    return f"""n_{name} AS (SELECT entity_id, trade_date, {value} AS x, row_number() OVER ({_W}) AS k FROM v), s_{name}(entity_id, k, s) AS (SELECT entity_id, CAST({p} AS BIGINT), avg(x) FROM n_{name} WHERE k <= {p} GROUP BY 1 HAVING count(*) = {p}
UNION ALL SELECT n.entity_id, n.k, coalesce((s.s * {p - 1} + n.x) / {p}, s.s) FROM s_{name} s JOIN n_{name} n ON n.entity_id = s.entity_id AND n.k = s.k + 1)"""


@query(f"{ctes('weekly')}, v AS (SELECT * FROM weekly), {_smma_sql('close', 14, 'a')} SELECT n.entity_id, n.trade_date, round(s.s, 5) AS smma FROM n_a n LEFT JOIN s_a s USING (entity_id, k)")
def smma(spark: SparkSession, sf: str) -> DataFrame:
    return S.smoothed(D.weekly(spark, sf), "close", 14, "smma").select("entity_id", "trade_date", F.round("smma", 5).alias("smma"))


@query(
    f"""{ctes('weekly')}, t AS (SELECT *, CASE WHEN coalesce(trade_date - lag(trade_date) OVER ({_W}) > {GAP}, false) THEN NULL ELSE greatest(high - low, coalesce(abs(high - lag(close) OVER ({_W})), 0), coalesce(abs(low - lag(close) OVER ({_W})), 0)) END AS tr FROM weekly),
v AS (SELECT * FROM t), {_smma_sql('tr', 14, 'a')} SELECT n.entity_id, n.trade_date, round(s.s, 5) AS atr FROM n_a n LEFT JOIN s_a s USING (entity_id, k)"""
)
def atr(spark: SparkSession, sf: str) -> DataFrame:
    out = S.smoothed(S.true_range(D.weekly(spark, sf), GAP), "true_range", 14, "atr")
    return out.select("entity_id", "trade_date", F.round("atr", 5).alias("atr"))


@query(
    f"""{ctes('weekly')}, v AS (SELECT * FROM weekly), {_smma_sql('(high + low) / 2', 13, 'a')}, {_smma_sql('(high + low) / 2', 8, 'b')}, {_smma_sql('(high + low) / 2', 5, 'c')}
SELECT n.entity_id, n.trade_date, round(lag(a.s, 8) OVER (PARTITION BY n.entity_id ORDER BY n.k), 5) AS jaw, round(lag(b.s, 5) OVER (PARTITION BY n.entity_id ORDER BY n.k), 5) AS teeth, round(lag(c.s, 3) OVER (PARTITION BY n.entity_id ORDER BY n.k), 5) AS lips
FROM n_a n LEFT JOIN s_a a USING (entity_id, k) LEFT JOIN s_b b ON b.entity_id = n.entity_id AND b.k = n.k LEFT JOIN s_c c ON c.entity_id = n.entity_id AND c.k = n.k"""
)
def alligator(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.alligator(D.weekly(spark, sf)).select("entity_id", "trade_date", "jaw", "teeth", "lips"), 5)


@query(f"{ctes('weekly')}, d AS (SELECT *, ln(close / lag(close) OVER ({_W})) AS x FROM weekly), p AS (SELECT *, lag(x) OVER ({_W}) AS y FROM d WHERE x IS NOT NULL) SELECT entity_id, count(x) AS n, round(CASE WHEN count(x) >= 20 AND covar_samp(x, y) < 0 THEN 2 * sqrt(abs(covar_samp(x, y))) END, 7) AS spread FROM p GROUP BY 1")
def roll_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.roll_spread(D.weekly(spark, sf)), 7)


@query(
    f"""{ctes('weekly')}, h AS (SELECT *, pow(ln(high / low), 2) AS hl, lag(high) OVER ({_W}) AS ph, lag(low) OVER ({_W}) AS pl FROM weekly), b AS (SELECT *, hl + lag(hl) OVER ({_W}) AS b, pow(ln(greatest(high, ph) / least(low, pl)), 2) AS g FROM h),
a AS (SELECT *, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) AS a FROM b) SELECT entity_id, trade_date, CASE WHEN ph IS NOT NULL THEN round(greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0), 7) END AS spread FROM a"""
)
def corwin_schultz(spark: SparkSession, sf: str) -> DataFrame:
    return S.corwin_schultz(D.weekly(spark, sf)).select("entity_id", "trade_date", F.round("spread", 7).alias("spread"))


# ---- cross-sections


@query(f"{ctes('weekly')}, e AS (SELECT *, count(close) OVER p AS n, quantile_cont(close, 0) OVER p AS e0, quantile_cont(close, 1/3.0) OVER p AS e1, quantile_cont(close, 2/3.0) OVER p AS e2, quantile_cont(close, 1) OVER p AS e3 FROM weekly WINDOW p AS (PARTITION BY trade_date)) SELECT entity_id, trade_date, CASE WHEN n >= 3 AND e0 < e1 AND e1 < e2 AND e2 < e3 THEN CASE WHEN close <= e1 THEN 1 WHEN close <= e2 THEN 2 ELSE 3 END END AS tercile FROM e")
def terciles(spark: SparkSession, sf: str) -> DataFrame:
    return D.weekly(spark, sf).select("entity_id", "trade_date", X.quantile_bin(["trade_date"], "close", 3).alias("tercile"))


@query(f"{ctes('weekly')} SELECT entity_id, trade_date, volume FROM weekly QUALIFY volume >= quantile_cont(volume, 0.9) OVER (PARTITION BY trade_date)")
def top_decile_ties(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_share(D.weekly(spark, sf).select("entity_id", "trade_date", "volume"), ["trade_date"], "volume", 0.1)


@query(f"{ctes('weekly')} SELECT entity_id, trade_date, round((rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date), 9) AS pct, row_number() OVER (PARTITION BY trade_date ORDER BY volume, entity_id) AS first_rank, rank() OVER (PARTITION BY trade_date ORDER BY volume DESC) AS min_rank FROM weekly")
def pct_rank(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf)
    return w.select("entity_id", "trade_date", F.round(X.percent_rank(["trade_date"], "volume"), 9).alias("pct"), X.first_rank(["trade_date"], "volume", "entity_id").alias("first_rank"), F.rank().over(Window.partitionBy("trade_date").orderBy(F.col("volume").desc())).alias("min_rank"))


@query("WITH p AS (SELECT p_brand AS test, round(pow(fmod(sum(p_retailprice), 997) / 997, 3), 6) AS p FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM p) SELECT test, p, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 6) AS q FROM r")
def bh_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").groupBy(F.col("p_brand").alias("test")).agg(F.round(F.pow((F.sum("p_retailprice") % 997) / 997, 3), 6).alias("p"))
    return rounded(X.bh_qvalues(p, "p", tie="test").select("test", "p", "q"))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def ols_beta(spark: SparkSession, sf: str) -> DataFrame:
    fit = X.ols(D.table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    n, sx, sy, sxy, sxx = (F.col(c) for c in ("one__one", "one__l_quantity", "one__y", "l_quantity__y", "l_quantity__l_quantity"))
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return fit.select("l_returnflag", n.cast("bigint").alias("n"), F.round(slope, 5).alias("slope"), F.round((sy - slope * sx) / n, 3).alias("intercept"))


@query(f"{ctes('weekly')}, e AS (SELECT *, quantile_cont(close, 0.05) OVER p AS a, quantile_cont(close, 0.95) OVER p AS b FROM weekly WINDOW p AS (PARTITION BY trade_date)) SELECT entity_id, trade_date, CASE WHEN greatest(least(close, b), a) < close THEN 'high' WHEN greatest(least(close, b), a) > close THEN 'low' ELSE 'in' END AS side FROM e")
def winsorised(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf).withColumn("clipped", X.winsorised(["trade_date"], "close", 0.05, 0.95))
    return w.select("entity_id", "trade_date", F.when(F.col("clipped") < F.col("close"), "high").when(F.col("clipped") > F.col("close"), "low").otherwise("in").alias("side"))


# ---- fundamentals


@query(
    f"""{ctes('filings')}, {_COLLAPSED}, q AS (SELECT isin, period_end, known_date, value, count(*) OVER w AS n, sum(value) OVER w AS ttm, lag(value, 4) OVER (PARTITION BY isin ORDER BY period_end) AS year_ago FROM collapsed WINDOW w AS (PARTITION BY isin ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT isin, period_end, n AS quarters, CASE WHEN n = 4 THEN round(ttm, 2) END AS ttm, round(value / nullif(year_ago, 0) - 1, 6) AS growth FROM q"""
)
def quarter_growth(spark: SparkSession, sf: str) -> DataFrame:
    q = T.pit_collapsed(D.filings(spark, sf))
    w = S.line("isin", "period_end")
    four = w.rowsBetween(-3, 0)
    return q.select(
        "isin", "period_end", F.count("value").over(four).alias("quarters"), F.round(S.full(F.sum("value"), F.col("value"), four, 4), 2).alias("ttm"),
        F.round(F.try_divide(F.col("value"), F.lag("value", 4).over(w)) - 1, 6).alias("growth"),
    )


@query(
    f"""{ctes('filings')}, {_COLLAPSED}, q AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY period_end) AS i FROM collapsed), a AS (SELECT DISTINCT o_custkey AS isin, CAST(date_trunc('year', o_orderdate) AS DATE) AS at_ FROM orders),
l AS (SELECT a.isin, a.at_, max(struct_pack(k := known_date, i := i, p := period_end)) AS m FROM a JOIN q ON a.isin = q.isin AND q.known_date <= a.at_ GROUP BY 1, 2)
SELECT l.isin, l.at_ AS at, round(sum(q.value), 2) AS ttm_value, count(q.value) AS quarters, any_value(m.p) AS latest_period_end, any_value(m.k) AS latest_known_date FROM l JOIN q ON q.isin = l.isin AND q.i BETWEEN m.i - 3 AND m.i AND q.known_date <= l.at_ GROUP BY 1, 2"""
)
def ttm_asof(spark: SparkSession, sf: str) -> DataFrame:
    asks = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("isin"), F.date_trunc("year", "o_orderdate").cast("date").alias("at")).distinct()
    return T.ttm_as_of(T.pit_collapsed(D.filings(spark, sf)), asks).withColumn("ttm_value", F.round("ttm_value", 2))


@query(
    f"""{ctes('filings')}, {_COLLAPSED}, t AS (SELECT isin, avg(value) AS m, count(*) AS n, min(value) AS low FROM collapsed GROUP BY 1),
c AS (SELECT isin, n, CASE WHEN n < 4 THEN 'NA' WHEN low < 3000 THEN 'FAIL' ELSE 'PASS' END AS c1, CASE WHEN n < 8 THEN 'PARTIAL' ELSE 'PASS' END AS c2 FROM t)
SELECT isin, n, CASE WHEN c1 = 'FAIL' THEN 'FAIL' WHEN c1 = 'NA' THEN 'INSUFFICIENT DATA' WHEN c2 = 'PARTIAL' THEN 'FINANCIALS-PARTIAL' ELSE 'PASS' END AS verdict FROM c"""
)
def screener(spark: SparkSession, sf: str) -> DataFrame:
    t = T.pit_collapsed(D.filings(spark, sf)).groupBy("isin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"))
    checks = F.array(F.when(F.col("n") < 4, "NA").when(F.col("low") < 3000, "FAIL").otherwise("PASS"), F.when(F.col("n") < 8, "PARTIAL").otherwise("PASS"))
    return t.select("isin", "n", R.verdict(checks).alias("verdict"))


@query("SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS urgent, round(sum(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 2) AS low FROM orders GROUP BY 1")
def tag_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.round(F.sum("o_totalprice"), 2))
    return p.select("o_custkey", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


# ---- portfolios


_UNIVERSE = "u AS (SELECT y + 1 AS for_year, entity_id, m FROM (SELECT year(trade_date) AS y, entity_id, quantile_cont(turnover, 0.5) AS m FROM daily GROUP BY 1, 2) WHERE y IN (SELECT year(trade_date) FROM daily GROUP BY 1 HAVING max(month(trade_date)) >= 11) QUALIFY row_number() OVER (PARTITION BY y ORDER BY m DESC, entity_id) <= 20)"


@query(f"{ctes('daily')}, {_UNIVERSE} SELECT for_year, entity_id, round(m, 4) AS median_turnover FROM u")
def universe_topn(spark: SparkSession, sf: str) -> DataFrame:
    return P.annual_universe(D.daily(spark, sf), 20).select("for_year", "entity_id", F.round("median_turnover", 4).alias("median_turnover"))


@query(
    f"""{ctes('daily')}, {_UNIVERSE}, ys AS (SELECT DISTINCT for_year AS year FROM u WHERE for_year - 1 IN (SELECT for_year FROM u))
SELECT entity_id, for_year AS year, 'enter' AS change FROM u WHERE for_year IN (SELECT year FROM ys) AND NOT EXISTS (SELECT 1 FROM u b WHERE b.entity_id = u.entity_id AND b.for_year = u.for_year - 1)
UNION ALL SELECT entity_id, for_year + 1, 'leave' FROM u WHERE for_year + 1 IN (SELECT year FROM ys) AND NOT EXISTS (SELECT 1 FROM u b WHERE b.entity_id = u.entity_id AND b.for_year = u.for_year + 1)"""
)
def membership_change(spark: SparkSession, sf: str) -> DataFrame:
    return P.membership_changes(P.annual_universe(D.daily(spark, sf), 20)).select("entity_id", F.col("year").cast("bigint").alias("year"), "change")


@query(f"{ctes('daily')}, {_UNIVERSE} SELECT DISTINCT d.entity_id, year(trade_date) AS for_year FROM daily d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.entity_id = d.entity_id AND u.for_year = year(trade_date))")
def universe_violation(spark: SparkSession, sf: str) -> DataFrame:
    d = D.daily(spark, sf)
    return P.violations(d.withColumn("for_year", F.year("trade_date")), P.annual_universe(d, 20), ["entity_id", "for_year"])


_HELD = "held AS (SELECT trade_date, entity_id, 1.0 / 10 AS weight FROM weekly WHERE day(trade_date) <= 7 AND trade_date IN (SELECT trade_date FROM weekly GROUP BY 1 HAVING count(*) >= 10) QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, entity_id) <= 10)"


@query(
    f"""{ctes('weekly')}, {_HELD}, i AS (SELECT trade_date, dense_rank() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM held)), n AS (SELECT i, entity_id, weight FROM held JOIN i USING (trade_date)), o AS (SELECT i + 1 AS i, entity_id, weight AS old FROM n WHERE i + 1 IN (SELECT i FROM i))
SELECT trade_date, round(sum(abs(coalesce(weight, 0) - coalesce(old, 0))) / 2, 9) AS turnover FROM n FULL JOIN o USING (i, entity_id) JOIN i USING (i) GROUP BY 1"""
)
def portfolio_turnover(spark: SparkSession, sf: str) -> DataFrame:
    w = D.weekly(spark, sf).filter(F.dayofmonth("trade_date") <= 7)
    w = w.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("trade_date"))).filter("k >= 10")
    held = P.holdings(w, "close", 10)
    return rounded(P.turnover(held, held), 9)


@query(
    f"""{ctes('weekly')}, r AS (SELECT trade_date, avg(ln(close / open)) / 50 AS g FROM weekly GROUP BY 1), n AS (SELECT trade_date, exp(sum(ln(1 + g - 0.0001)) OVER (ORDER BY trade_date)) AS nav FROM r)
SELECT trade_date, round(nav, 6) AS nav, round(nav / greatest(max(nav) OVER (ORDER BY trade_date), 1) - 1, 6) AS drawdown FROM n"""
)
def nav_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    r = D.weekly(spark, sf).groupBy("trade_date").agg((F.avg(F.log(F.try_divide(F.col("close"), F.col("open")))) / 50).alias("gross")).withColumn("cost", F.lit(0.0001))
    return rounded(P.nav(r, "gross", "cost").select("trade_date", "nav", "drawdown"))


_TRADES = "tr AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS entry_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 + 1 AS INTEGER) AS exit_date, round((o_totalprice % 1000 - 500) / 10000, 6) AS ret, o_custkey % 10 AS grp FROM orders)"


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return D.table(spark, sf, "orders").select("o_orderkey", day.alias("entry_date"), F.date_add(day, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("exit_date"), F.round((F.col("o_totalprice") % 1000 - 500) / 10000, 6).alias("ret"), (F.col("o_custkey") % 10).alias("grp"))


@query(f"WITH {_TRADES}, e AS (SELECT entry_date AS d, 1 AS x FROM tr UNION ALL SELECT exit_date, -1 FROM tr), s AS (SELECT d, sum(x) AS x, count(*) FILTER (x > 0) AS entries FROM e GROUP BY 1) SELECT CAST(d AS DATE) AS date, entries, CAST(sum(x) OVER (ORDER BY d) AS BIGINT) AS open_trades FROM s")
def concurrency(spark: SparkSession, sf: str) -> DataFrame:
    return P.concurrency(_trades(spark, sf))


@query(f"WITH {_TRADES} SELECT grp, count(ret) AS n, round(count(*) FILTER (ret > 0) / count(ret), 6) AS hit_rate, round(avg(ret), 7) AS mean, round(stddev_samp(ret), 7) AS sd_sample, round(stddev_pop(ret), 7) AS sd_population, round(sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0), 5) AS profit_factor FROM tr GROUP BY 1")
def trade_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = P.trade_statistics(_trades(spark, sf), "ret", ["grp"])
    return out.select("grp", "n", F.round("hit_rate", 6).alias("hit_rate"), *(F.round(c, 7).alias(c) for c in ("mean", "sd_sample", "sd_population")), F.round("profit_factor", 5).alias("profit_factor"))


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS b, l_extendedprice * 1.01 AS s FROM lineitem), k AS (SELECT *, greatest(5, least(20, b * 0.001)) + greatest(5, least(20, s * 0.001)) AS br, (b + s) * 0.0000297 AS ex, (b + s) * 0.000001 AS se FROM v)
SELECT l_orderkey, l_linenumber, round(br + s * 0.002 + ex + se + b * 0.00015 + (br + ex + se) * 0.18 + 23.60, 4) AS cost, CASE WHEN l_linenumber * 40 BETWEEN 1 AND 50 THEN 2.0 WHEN l_linenumber * 40 BETWEEN 51 AND 100 THEN 4.0 ELSE 7.0 END AS spread_bps, CAST(floor(500 / (b * 0.02)) AS BIGINT) AS shares FROM k"""
)
def costs_grid(spark: SparkSession, sf: str) -> DataFrame:
    b, s = F.col("l_extendedprice"), F.col("l_extendedprice") * 1.01
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.delivery_costs(b, s), 4).alias("cost"), P.banded_spread(F.col("l_linenumber") * 40).alias("spread_bps"), P.whole_shares(500.0, b * 0.02).alias("shares"))


# ---- rules


_OR = "o AS (SELECT entity_id, session, max(high) AS or_high, min(low) AS or_low FROM intraday WHERE bar_no BETWEEN 0 AND 7 GROUP BY 1, 2), e AS (SELECT entity_id, session, or_low, min(bar_no) AS entry_bar FROM intraday JOIN o USING (entity_id, session) WHERE bar_no BETWEEN 8 AND 40 AND close > or_high GROUP BY 1, 2, 3), t AS (SELECT e.entity_id, e.session, entry_bar, i.close AS entry, or_low AS stop, i.close + 2 * (i.close - or_low) AS target FROM e JOIN intraday i ON i.entity_id = e.entity_id AND i.session = e.session AND i.bar_no = entry_bar)"
_RESOLVE = """x AS (SELECT t.*, b.bar_no, b.close, CASE WHEN b.low <= stop THEN 'STOP' WHEN b.high >= target THEN 'TARGET' END AS kind, CASE WHEN b.low <= stop THEN least(b.open, stop) WHEN b.high >= target THEN target END AS fill FROM t JOIN intraday b ON b.entity_id = t.entity_id AND b.session = t.session AND b.bar_no > entry_bar AND b.bar_no <= 45)
SELECT entity_id, session, entry_bar, entry, stop, target, coalesce(first(kind ORDER BY bar_no) FILTER (kind IS NOT NULL), 'TIME') AS exit_kind, coalesce(min(bar_no) FILTER (kind IS NOT NULL), max(bar_no)) AS exit_bar, coalesce(first(fill ORDER BY bar_no) FILTER (kind IS NOT NULL), last(close ORDER BY bar_no)) AS exit_price FROM x GROUP BY 1, 2, 3, 4, 5, 6"""


@query(f"{ctes('ticks', 'intraday')}, {_OR}, {_RESOLVE}")
def orb_rule(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    return R.resolve(R.breakout_entries(b, R.opening_range(b, 0, 7), 8, 40), b, 45)


@query(
    f"""{ctes('ticks', 'intraday')}, l AS (SELECT entity_id, session, min(low) AS level FROM intraday WHERE bar_no < 16 GROUP BY 1, 2), p AS (SELECT i.*, level, (level - low) / nullif(level, 0) AS d FROM intraday i JOIN l USING (entity_id, session)),
k AS (SELECT entity_id, session, min(bar_no) AS k FROM p WHERE d > 0.9 GROUP BY 1, 2), s AS (SELECT p.entity_id, p.session, level, min(bar_no) AS sweep_bar FROM p LEFT JOIN k USING (entity_id, session) WHERE d BETWEEN 0.01 AND 0.9 AND (k IS NULL OR bar_no < k) GROUP BY 1, 2, 3),
r AS (SELECT s.*, min(bar_no) AS entry_bar, first(close ORDER BY bar_no) AS entry FROM s JOIN intraday i USING (entity_id, session) WHERE bar_no BETWEEN sweep_bar AND sweep_bar + 3 AND close > level GROUP BY ALL)
SELECT r.*, (SELECT min(low) FROM intraday i WHERE i.entity_id = r.entity_id AND i.session = r.session AND i.bar_no BETWEEN sweep_bar AND entry_bar) AS sweep_low FROM r"""
)
def sweep_reclaim(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    levels = b.filter("bar_no < 16").groupBy("entity_id", "session").agg(F.min("low").alias("level"))
    return R.sweep_reclaims(b, levels, 0.01, 0.9)


_FVG = "f AS (SELECT entity_id, session, bar_no AS first_bar, lead(bar_no, 2) OVER w AS third_bar, high AS gap_low, lead(low, 2) OVER w AS gap_high, lead(high) OVER w <= high AND lead(low) OVER w >= low AS inside FROM intraday WINDOW w AS (PARTITION BY entity_id, session ORDER BY bar_no)), gaps AS (SELECT * EXCLUDE (inside), least(lead(third_bar) OVER (PARTITION BY entity_id, session ORDER BY first_bar), third_bar + 31) AS live_until FROM f WHERE gap_low < gap_high AND NOT inside)"


@query(f"{ctes('ticks', 'intraday')}, {_FVG} SELECT * FROM gaps")
def fair_value_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return R.fair_value_gaps(D.intraday(spark, sf))


@query(
    f"""{ctes('ticks', 'intraday')}, {_FVG}, p AS (SELECT g.*, b.bar_no, b.low, b.close FROM gaps g JOIN intraday b USING (entity_id, session) WHERE b.bar_no > third_bar AND b.bar_no < live_until), q AS (SELECT *, min(CASE WHEN low <= gap_high THEN bar_no END) OVER (PARTITION BY entity_id, session, first_bar) AS touch_bar FROM p)
SELECT entity_id, session, first_bar, third_bar, gap_low, gap_high, live_until, touch_bar, min(bar_no) AS entry_bar FROM q WHERE bar_no >= touch_bar AND close > gap_high GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""
)
def gap_retests(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    return R.gap_retests(b, R.fair_value_gaps(b))


def _level(b: DataFrame) -> DataFrame:
    return b.groupBy("entity_id", "session").agg(((F.min("low") + F.max("high")) / 2).alias("level"))


@query(
    f"""{ctes('ticks', 'intraday')}, l AS (SELECT entity_id, session, (min(low) + max(high)) / 2 AS level FROM intraday GROUP BY 1, 2), t AS (SELECT entity_id, session, level, min(bar_no) AS touch_bar FROM intraday JOIN l USING (entity_id, session) WHERE low <= level AND high >= level GROUP BY 1, 2, 3),
a AS (SELECT t.*, bar_no, open, close, CASE WHEN close <> open THEN least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= abs(close - open) ELSE high - low > 0 AND least(open, close) - low >= 0.2 * (high - low) END AS h FROM t LEFT JOIN intraday i ON i.entity_id = t.entity_id AND i.session = t.session AND bar_no BETWEEN touch_bar + 1 AND touch_bar + 2),
s AS (SELECT entity_id, session, level, touch_bar, min(CASE WHEN close > open OR h THEN bar_no END) AS g, min(CASE WHEN close < open AND close < level AND NOT h THEN bar_no END) AS f FROM a GROUP BY 1, 2, 3, 4)
SELECT entity_id, session, level, touch_bar, CASE WHEN f IS NOT NULL AND (g IS NULL OR f < g) THEN 'FAILED' WHEN g IS NULL THEN 'UNCONFIRMED' ELSE 'CONFIRMED' END AS status, CASE WHEN f IS NULL OR g < f THEN g END AS g FROM s"""
)
def poc_touches(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    return R.level_touches(b, _level(b))


def _box_sql(green: int) -> str:
    go = "close > open" if green == 1 else "close > open AND lag(close) OVER w > lag(open) OVER w AND close > lag(close) OVER w"
    return f"""{ctes('ticks', 'intraday')}, l AS (SELECT entity_id, session, (min(low) + max(high)) / 2 AS level FROM intraday GROUP BY 1, 2), b AS (SELECT *, coalesce({go}, false) AS go_ FROM intraday WINDOW w AS (PARTITION BY entity_id, session ORDER BY bar_no)),
p AS (SELECT b.*, level, min(CASE WHEN low <= level THEN bar_no END) OVER (PARTITION BY entity_id, session) AS touch_bar FROM b JOIN l USING (entity_id, session)) SELECT entity_id, session, level, touch_bar, min(bar_no) AS entry_bar, first(close ORDER BY bar_no) AS entry FROM p WHERE go_ AND bar_no > touch_bar + {green - 1} GROUP BY 1, 2, 3, 4"""


@query(_box_sql(1))
def box_fast(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    return R.box_entries(b, _level(b), 1)


@query(_box_sql(2))
def box_slow(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    return R.box_entries(b, _level(b), 2)


@query()
def two_leg_exits(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    return R.two_leg_exits(R.breakout_entries(b, R.opening_range(b, 0, 7), 8, 40), b, 1.5, 3.0, 45)


@query(
    f"""{ctes('ticks', 'intraday')}, n AS (SELECT *, lead(open) OVER (PARTITION BY entity_id, session ORDER BY bar_no) AS e FROM intraday), t AS (SELECT entity_id, session, bar_no AS entry_bar, e AS entry, e * (1 - 0.05) AS stop, e * (1 + 0.125) AS target FROM n WHERE bar_no = 0 AND close > open AND e IS NOT NULL), {_RESOLVE}"""
)
def listing_day(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    return R.resolve(R.first_bar_trades(b), b, 45)


@query()
def darvas_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return R.darvas(D.weekly(spark, sf))


@query(
    f"""{ctes('ticks', 'intraday')}, z AS (SELECT entity_id, session, quantile_cont(low, 0.5) AS zone FROM intraday WHERE bar_no < 8 GROUP BY 1, 2), h AS (SELECT entity_id, session, zone, min(bar_no) AS sweep_bar, arg_min(low, bar_no) AS sweep_low FROM intraday JOIN z USING (entity_id, session) WHERE bar_no >= 8 AND low < zone GROUP BY 1, 2, 3),
b AS (SELECT i.entity_id, i.session, bar_no, low, lag(low) OVER w AS p, lead(low) OVER w AS x, lead(bar_no) OVER w AS nx FROM intraday i WINDOW w AS (PARTITION BY entity_id, session ORDER BY bar_no)),
c AS (SELECT b.*, zone, sweep_bar, sweep_low, low < p AND low < x AND low <= zone AS local FROM b JOIN h USING (entity_id, session) WHERE bar_no > sweep_bar),
l AS (SELECT *, CASE WHEN low > lag(low) OVER (PARTITION BY entity_id, session ORDER BY bar_no) THEN 0 ELSE 1 END AS fresh FROM c WHERE local),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, session, run ORDER BY bar_no) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY entity_id, session ORDER BY bar_no) AS run FROM l)),
d AS (SELECT entity_id, session, arg_max(n, bar_no) AS c, min(CASE WHEN n >= 2 THEN nx END) AS d_bar, arg_min(low, CASE WHEN n >= 2 THEN bar_no END) AS d_low, arg_min(n, CASE WHEN n >= 2 THEN bar_no END) AS d_n FROM k GROUP BY 1, 2),
r AS (SELECT entity_id, session, min(CASE WHEN low < sweep_low THEN bar_no END) AS b_bar FROM c GROUP BY 1, 2),
o AS (SELECT h.*, d.*, r.b_bar, CASE WHEN b_bar IS NOT NULL AND (d_bar IS NULL OR b_bar <= d_bar) THEN 'BROKEN' WHEN d_bar IS NOT NULL THEN 'CONFIRMED' ELSE 'INCOMPLETE' END AS status FROM r JOIN h ON r.entity_id = h.entity_id AND r.session = h.session LEFT JOIN d ON r.entity_id = d.entity_id AND r.session = d.session)
SELECT h.entity_id, h.session, h.zone, h.sweep_bar, h.sweep_low, status, CASE status WHEN 'BROKEN' THEN b_bar WHEN 'CONFIRMED' THEN d_bar END AS at_bar, CASE WHEN status = 'CONFIRMED' THEN d_low END AS last_low, CASE status WHEN 'CONFIRMED' THEN d_n WHEN 'INCOMPLETE' THEN coalesce(c, 0) END AS lows FROM o h"""
)
def ascending_lows(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    zones = b.filter("bar_no < 8").groupBy("entity_id", "session").agg(F.percentile("low", F.lit(0.5)).alias("zone"))
    return R.ascending_lows(b, R.zone_sweeps(b, zones, 8), 2)


# ---- inference


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return I.clustered_bootstrap(_trades(spark, sf), "entry_date", "ret", 500)


@query()
def block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    days = _trades(spark, sf).groupBy("entry_date").agg(F.avg("ret").alias("ret"))
    return I.block_bootstrap(days, "entry_date", "ret", 5, 400)


@query()
def timing_null(spark: SparkSession, sf: str) -> DataFrame:
    b = D.intraday(spark, sf)
    t = R.breakout_entries(b, R.opening_range(b, 0, 7), 8, 40)
    moves = b.select("entity_id", "session", "bar_no", (F.try_divide(F.col("close"), F.col("open")) - 1).alias("move"))
    return I.timing_null(t, moves, ["entity_id", "session"], "move", 50, ["entity_id", "session", "entry_bar"])


@query()
def selection_null(spark: SparkSession, sf: str) -> DataFrame:
    t = _trades(spark, sf).withColumn("month", F.date_trunc("month", "entry_date"))
    pool = t.select("month", "o_orderkey", "ret")
    return I.selection_null(t.select("month", "o_orderkey"), pool, ["month"], "ret", 30, ["month", "o_orderkey"])


@query(f"{ctes('weekly')}, r AS (SELECT entity_id, trade_date, close, row_number() OVER ({_W}) - 1 AS r, count(*) OVER (PARTITION BY entity_id) AS n FROM weekly) SELECT a.entity_id, a.trade_date, a.close, b.close AS shifted FROM r a JOIN r b ON a.entity_id = b.entity_id AND a.r = (b.r + 5) % b.n")
def circular_shift(spark: SparkSession, sf: str) -> DataFrame:
    return I.circular_shift(D.weekly(spark, sf).select("entity_id", "trade_date", "close"), "close", 5)


@query(f"{ctes('weekly')}, p AS (SELECT k AS lag, close AS x, lag(close, k) OVER (PARTITION BY k, entity_id ORDER BY trade_date) AS y FROM weekly, generate_series(1, 3) g(k)) SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(corr(x, y), 7) AS acf, round(2 / sqrt(count(*)), 7) AS band FROM p WHERE y IS NOT NULL GROUP BY 1")
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.acf(D.weekly(spark, sf), "close", 3), 7)


# ---- text sources, logs, streams


@query("SELECT event_id, props, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events")
    return e.select("event_id", "props", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


@query(r"""WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages) SELECT page_id, href, label, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def markup_facts(spark: SparkSession, sf: str) -> DataFrame:
    return TX.tagged_facts(D.table(spark, sf, "pages"), "page_id", "html", r'<a href="([^"]*)">([^<]*)</a>', ["href", "label"]).groupBy("page_id", "href", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT o_orderkey, 'Bonus ' || (o_orderkey % 4 + 1) || ':' || (o_orderkey % 3 + 1) || CASE WHEN o_orderkey % 5 = 0 THEN ' / Face Value Split From Rs 10 To Rs ' || (o_orderkey % 2 + 1) ELSE '' END AS t FROM orders)
SELECT o_orderkey, t AS subject, round((o_orderkey % 4 + 1 + o_orderkey % 3 + 1) / (o_orderkey % 3 + 1)::DOUBLE * CASE WHEN o_orderkey % 5 = 0 THEN 10.0 / (o_orderkey % 2 + 1) ELSE 1 END, 6) AS ratio FROM s"""
)
def parse_subject(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Bonus "), k % 4 + 1, F.lit(":"), k % 3 + 1, F.when(k % 5 == 0, F.concat(F.lit(" / Face Value Split From Rs 10 To Rs "), k % 2 + 1)).otherwise(""))
    return D.table(spark, sf, "orders").select("o_orderkey", text.alias("subject")).withColumn("ratio", F.round(TX.subject_ratio(F.col("subject")), 6))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1")
def log_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return TX.first_events(D.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "role"], ["turn", "text"])


@query("SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    return L.replay(spark, sf, "events", lambda s: L.first_by_id(s, "event_id", "ts"), "dedup").select("event_id", "user_id", "event_type", "value")


@query(_bars_sql(60))
def bars_stream(spark: SparkSession, sf: str) -> DataFrame:
    def bars(s):
        t = s.select((F.col("user_id") % 10).alias("entity_id"), "ts", F.col("value").alias("price"), (F.col("event_id") % 50).cast("double").alias("volume"))
        return B.time_bars(t, "60 minutes")

    return L.replay(spark, sf, "events", bars, "bars", "complete")


@query()
def trigger_state(spark: SparkSession, sf: str) -> DataFrame:
    return L.replay(spark, sf, "events", lambda s: L.triggers(s, 20.0, 90.0), "triggers", "append")


from . import selections, studies  # noqa: E402,F401  register their queries
