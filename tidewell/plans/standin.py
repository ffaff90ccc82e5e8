"""Market concepts over the star-schema test tables, and the same as SQL common table expressions.

A supplier is an instrument, its lines of a day are the day's trades; a customer's orders are filings
by quarter; events are ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import bars as B


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("trade_date"), F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("value"), "l_orderkey", "l_linenumber"
    )


def _panel(spark: SparkSession, sf: str, date) -> DataFrame:
    t = trades(spark, sf).withColumn("trade_date", date)
    by = F.struct("l_orderkey", "l_linenumber", "price")
    return t.groupBy("entity_id", "trade_date").agg(
        F.min_by("price", by).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", by).alias("close"), F.sum("volume").alias("volume"), F.sum("value").alias("turnover")
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return _panel(spark, sf, F.col("trade_date"))


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return _panel(spark, sf, F.date_trunc("week", "trade_date").cast("date"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse corporate actions: some orders, hung on a supplier."""
    return table(spark, sf, "orders").filter("o_orderkey % 97 = 0").select((F.col("o_custkey") % 100 + 1).alias("entity_id"), F.to_date("o_orderdate").alias("ex_date"), (F.col("o_orderkey") % 3 + 1).cast("double").alias("ratio"))


def filings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("isin"), F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2)).alias("period_end"),
        F.when(F.col("o_orderstatus") == "F", "Consolidated").otherwise("Standalone").alias("consolidated"), F.col("o_totalprice").alias("value"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 120).cast("int")).alias("known_date"), F.col("o_orderkey").alias("seq_number"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 10).alias("entity_id"), "ts", "event_id", F.col("value").alias("price"), (F.col("event_id") % 50).cast("double").alias("volume"))


def intraday(spark: SparkSession, sf: str) -> DataFrame:
    """Half-hour bars of each (entity, day) of ticks, numbered from 0."""
    t = ticks(spark, sf).withColumns({"session": F.to_date("ts"), "bar_no": F.floor(B.minute_of_day(F.col("ts")) / 30).cast("int")})
    by = F.struct("ts", "event_id")
    return t.groupBy("entity_id", "session", "bar_no").agg(F.min_by("price", by).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", by).alias("close"), F.sum("volume").alias("volume"))


_OHLC = "first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, price) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover"
_BASE = "SELECT l_suppkey AS entity_id, {date} AS trade_date, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice, l_orderkey, l_linenumber FROM lineitem"
SQL = {
    "daily": f"daily AS (SELECT entity_id, trade_date, {_OHLC} FROM ({_BASE.format(date='CAST(l_shipdate AS DATE)')}) GROUP BY 1, 2)",
    "weekly": f"weekly AS (SELECT entity_id, trade_date, {_OHLC} FROM ({_BASE.format(date='CAST(date_trunc(' + chr(39) + 'week' + chr(39) + ', CAST(l_shipdate AS DATE)) AS DATE)')}) GROUP BY 1, 2)",
    "actions": "actions AS (SELECT o_custkey % 100 + 1 AS entity_id, CAST(o_orderdate AS DATE) AS ex_date, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS ratio FROM orders WHERE o_orderkey % 97 = 0)",
    "filings": "filings AS (SELECT o_custkey AS isin, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS period_end, CASE WHEN o_orderstatus = 'F' THEN 'Consolidated' ELSE 'Standalone' END AS consolidated, o_totalprice AS value, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) AS DATE) AS known_date, o_orderkey AS seq_number FROM orders)",
    "ticks": "ticks AS (SELECT user_id % 10 AS entity_id, ts, event_id, value AS price, CAST(event_id % 50 AS DOUBLE) AS volume FROM events)",
    "intraday": "intraday AS (SELECT entity_id, CAST(ts AS DATE) AS session, CAST(floor((hour(ts) * 60 + minute(ts)) / 30) AS INTEGER) AS bar_no, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2, 3)",
}


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
