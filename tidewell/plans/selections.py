"""Queries of selections, identity as of a day and small ladders; registered with the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import bars as B
from tidewell.operators import bitemporal as T
from tidewell.operators import joins as J
from tidewell.operators import selections as Z
from tidewell.operators import warehouse as W
from tidewell.operators import xsection as X

from . import standin as D
from .catalogue import _ASKS, _COLLAPSED, _OBS, _SPANS, AS_OF, _asks, _obs, _spans, query, rounded
from .standin import ctes

# ---- lists, probes and exact times


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 30) AND p_brand IN ('Brand#1', 'Brand#4', 'Brand#17')")
def listed_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return Z.rows_in(Z.rows_in(p, "p_size", [1, 5, 9, 30]), "p_brand", ["Brand#1", "Brand#4", "Brand#17", None], most=2)


@query("SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'small%' OR p_name LIKE 'red%' OR p_name LIKE 'hot%') AND p_name NOT LIKE '%gear'")
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "part").select("p_partkey", "p_name").filter(Z.prefixed("p_name", ["small", "red", "hot"], ["%gear"]))


@query("SELECT page_id, contains(lower(html), 'privacy') OR contains(lower(html), 'cookie') OR contains(lower(html), 'subscribe') AS flagged FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)")
def keyword_flags(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").select("page_id", Z.mentions(F.col("html"), ["Privacy", "cookie", "subscribe"]).alias("flagged"))


@query("SELECT event_id, user_id, CAST(ts AS DATE) AS session FROM events WHERE (user_id, CAST(ts AS DATE)) IN (SELECT (user_id, CAST(ts AS DATE)) FROM events WHERE event_type = 'error')")
def session_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("session"), "event_type")
    return Z.rows_of_pairs(e.drop("event_type"), e.filter("event_type = 'error'"), ["user_id", "session"])


@query("SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM events e WHERE e.user_id = o_custkey) AS present FROM orders")
def existence_probe(spark: SparkSession, sf: str) -> DataFrame:
    seen = D.table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return Z.probed(D.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), seen, ["o_custkey"])


@query(f"{ctes('ticks')}, b AS (SELECT entity_id, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, first(price ORDER BY ts, event_id) AS open FROM ticks GROUP BY 1, 2) SELECT a.entity_id, a.ts + INTERVAL 5 MINUTE AS ts, b.open AS at_open FROM b a LEFT JOIN b ON b.entity_id = a.entity_id AND b.ts = a.ts + INTERVAL 5 MINUTE")
def exact_time(spark: SparkSession, sf: str) -> DataFrame:
    bars = B.time_bars(D.ticks(spark, sf), "5 minutes")
    at = next(c for c, t in bars.dtypes if t.startswith("timestamp"))
    closes = bars.select("entity_id", (F.col(at) + F.expr("interval 5 minutes")).alias("ts"))
    return Z.at_time(closes, bars, "entity_id", "ts", at, ["open"])


@query(
    f"""WITH {_OBS}, {_ASKS} SELECT a.entity_id, a.o_orderkey, a.at_ AS at, coalesce(b.d, f.d) AS matched_ts, coalesce(b.v, f.v) AS v, b.d IS NOT NULL AS first_choice
FROM asks a ASOF LEFT JOIN obs f ON a.entity_id = f.entity_id AND a.at_ <= f.d ASOF LEFT JOIN obs b ON a.entity_id = b.entity_id AND a.at_ >= b.d"""
)
def asof_backward_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return J.asof_with_fallback(_asks(spark, sf), _obs(spark, sf), "entity_id", "at", "d", ["v"], forward_first=False)


# ---- days, schedules, picks


@query(f"{ctes('daily')} SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, min(trade_date) AS trade_date FROM daily GROUP BY 1")
def month_first_session(spark: SparkSession, sf: str) -> DataFrame:
    return Z.first_sessions(D.daily(spark, sf))


@query("SELECT CAST(h AS INTEGER) AS horizon, CAST(unnest(generate_series(570, 930 - h, h + 5)) AS INTEGER) AS minute FROM (SELECT unnest([5, 15, 30, 60, 400]) AS h)")
def spaced_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return Z.spaced_schedule(spark, [5, 15, 30, 60, 400], 570, 930)


@query(
    f"""{ctes('weekly')}, e AS (SELECT entity_id % 3 AS band, entity_id, round(stddev_samp(close), 6) AS vol, last(close ORDER BY trade_date) AS close FROM weekly GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY vol DESC, entity_id) AS h, row_number() OVER (PARTITION BY band ORDER BY vol, entity_id DESC) AS l FROM e WHERE vol IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY close DESC, entity_id) AS ph, row_number() OVER (PARTITION BY band ORDER BY close, entity_id DESC) AS pl FROM r WHERE h > 2 AND l > 2)
SELECT band, entity_id, vol, close, CASE WHEN h <= 2 THEN 'high' ELSE 'low' END AS reason FROM r WHERE h <= 2 OR l <= 2 UNION ALL SELECT band, entity_id, vol, close, 'second' FROM p WHERE ph = 1 OR pl = 1"""
)
def extreme_picks(spark: SparkSession, sf: str) -> DataFrame:
    e = D.weekly(spark, sf).groupBy((F.col("entity_id") % 3).alias("band"), "entity_id").agg(F.round(F.stddev_samp("close"), 6).alias("vol"), F.max_by("close", "trade_date").alias("close"))
    return Z.extreme_picks(e, "band", "entity_id", "vol", "close")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def largest_orders(spark: SparkSession, sf: str) -> DataFrame:
    return Z.largest(D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, ["o_totalprice", "o_orderkey"])


@query(
    """WITH l AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS p, list(l_quantity ORDER BY l_linenumber, l_extendedprice, l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, p[1] AS p1, p[2] AS p2, p[3] AS p3, p[4] AS p4, p[5] AS p5, p[1] AS first_price, p[-1] AS last_price FROM l"""
)
def depth_levels(spark: SparkSession, sf: str) -> DataFrame:
    l = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("_l"))  # noqa: E741
    five = Z.padded(F.col("_l.l_extendedprice"))
    ends = [F.element_at("_l", i)["l_extendedprice"].alias(n) for i, n in ((1, "first_price"), (-1, "last_price"))]
    return l.select("l_orderkey", *(five[i].alias(f"p{i + 1}") for i in range(5)), *ends)


# ---- returns and fits


@query(f"{ctes('weekly')}, r AS (SELECT trade_date, lead(close) OVER (PARTITION BY entity_id ORDER BY trade_date) / close - 1 AS ret FROM weekly) SELECT trade_date, count(*) AS n, round(avg(ret), 8) AS ret FROM r WHERE ret IS NOT NULL GROUP BY 1")
def equal_weight_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Z.equal_weight_returns(D.weekly(spark, sf)), 8)


@query(
    """WITH c AS (SELECT l_returnflag, count(*) AS n, corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(a * a, 6) AS r2_reduced, round((a * a + b * b - 2 * a * b * r) / (1 - r * r), 6) AS r2_full, round((a * a + b * b - 2 * a * b * r) / (1 - r * r) - a * a, 6) AS r2_added FROM c"""
)
def nested_r2(spark: SparkSession, sf: str) -> DataFrame:
    l = D.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_discount")  # noqa: E741
    return rounded(X.nested_r2(l, "l_extendedprice", ["l_quantity"], ["l_quantity", "l_discount"], ["l_returnflag"]))


@query(
    f"""{ctes('filings')}, {_COLLAPSED}, face AS (SELECT isin, period_end, CAST(seq_number % 5 AS DOUBLE) AS f FROM collapsed)
SELECT c.isin, c.period_end, c.known_date, c.value / f AS shares_outstanding FROM collapsed c JOIN face USING (isin, period_end) WHERE f > 0"""
)
def shares_outstanding(spark: SparkSession, sf: str) -> DataFrame:
    f = D.filings(spark, sf)
    return T.shares_outstanding(f, f.withColumn("value", (F.col("seq_number") % 5).cast("double")))


# ---- identity as of a day, jumps


def _held(spark: SparkSession, sf: str, spans: DataFrame) -> DataFrame:
    """The day's highest price of a symbol, under the identifier that it bore."""
    days = D.table(spark, sf, "orders").groupBy(F.concat(F.lit("S"), F.col("o_custkey") % 40).alias("symbol"), F.to_date("o_orderdate").alias("trade_date")).agg(F.max("o_totalprice").alias("close"))
    return days.join(spans, "symbol").filter(F.col("trade_date").between(F.col("first_date"), F.col("last_date"))).groupBy("isin", "trade_date").agg(F.max("close").alias("close"))


_HELD = """held AS (SELECT s.isin, CAST(o_orderdate AS DATE) AS trade_date, max(o_totalprice) AS close FROM orders JOIN spans s ON s.symbol = 'S' || o_custkey % 40 AND CAST(o_orderdate AS DATE) BETWEEN s.first_date AND s.last_date GROUP BY 1, 2),
ends AS (SELECT isin, first(close ORDER BY trade_date) AS a, last(close ORDER BY trade_date) AS b FROM held GROUP BY 1),
bj AS (SELECT l.*, n.a AS first_price, o.b AS last_price, n.a / o.b AS ratio FROM links l JOIN ends o ON o.isin = l.predecessor_isin JOIN ends n ON n.isin = l.isin WHERE l.status = 'linked' AND (n.a / o.b > 1.5 OR n.a / o.b < 1 / 1.5))"""


@query(f"WITH {_SPANS}, {_HELD} SELECT predecessor_isin, isin, symbol, known_date, status, first_price, last_price, round(ratio, 9) AS ratio FROM bj")
def boundary_jumps(spark: SparkSession, sf: str) -> DataFrame:
    spans = _spans(spark, sf)
    return W.boundary_jumps(_held(spark, sf, spans), W.lineage_links(spans)).withColumn("ratio", F.round("ratio", 9))


_WALK = """up AS (SELECT DISTINCT s.isin, coalesce(l.predecessor_isin, s.isin) AS parent FROM spans s LEFT JOIN links l ON l.isin = s.isin AND l.status = 'linked'{known}),
walk(isin, node) AS (SELECT isin, isin FROM up UNION SELECT w.isin, u.parent FROM walk w JOIN up u ON u.isin = w.node),
roots AS (SELECT isin, node AS entity_id FROM walk WHERE node IN (SELECT isin FROM up WHERE parent = isin))"""


@query(f"WITH RECURSIVE {_SPANS}, {_WALK.format(known=f' AND l.known_date <= DATE {chr(39)}{AS_OF}{chr(39)}')} SELECT * FROM roots")
def resolver_as_of(spark: SparkSession, sf: str) -> DataFrame:
    spans = _spans(spark, sf)
    return W.resolver_as_of(spans, W.lineage_links(spans), AS_OF)


@query(
    f"""WITH RECURSIVE {_SPANS}, {_HELD}, {_WALK.format(known='')}, acts AS (SELECT DISTINCT isin, trade_date AS ex_date FROM held WHERE day(trade_date) = 15),
r AS (SELECT isin, trade_date, close / lag(close) OVER (PARTITION BY isin ORDER BY trade_date) AS ratio FROM held),
j AS (SELECT isin, trade_date FROM r WHERE (ratio > 1.5 OR ratio < 1 / 1.5) AND NOT EXISTS (SELECT 1 FROM acts a WHERE a.isin = r.isin AND a.ex_date BETWEEN r.trade_date - 10 AND r.trade_date + 10) UNION ALL SELECT isin, known_date FROM bj)
SELECT DISTINCT entity_id, trade_date FROM j JOIN roots USING (isin)"""
)
def jump_map(spark: SparkSession, sf: str) -> DataFrame:
    spans = _spans(spark, sf)
    links, held = W.lineage_links(spans), _held(spark, sf, spans)
    acts = held.filter(F.dayofmonth("trade_date") == 15).select("isin", F.col("trade_date").alias("ex_date"))
    return W.jump_map(held, acts, links, W.lineage_roots(spans, links))
