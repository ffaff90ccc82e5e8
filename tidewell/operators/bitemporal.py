"""Append-only facts: latest revision, as-of visibility and point-in-time picks."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def read_latest(df: DataFrame, keys: list[str], revision: str = "revision_seq") -> DataFrame:
    """One row for each key: the highest revision."""
    return pick_first(df, keys, [F.col(revision).desc_nulls_last()])


def visible_as_of(df: DataFrame, as_of: datetime.date | str, known: str = "known_date") -> DataFrame:
    """Rows known on or before ``as_of``; a filter that reaches the scan."""
    return df.filter(F.col(known) <= F.lit(as_of).cast("date"))


def verify_as_of(df: DataFrame, as_of: datetime.date | str, known: str = "known_date") -> DataFrame:
    """Raises where a row was not yet known: a check against accessors that forget the filter."""
    late = F.col(known) > F.lit(as_of).cast("date")
    return df.withColumn(known, F.when(late, F.raise_error(F.lit("row known after the as-of date")).cast("date")).otherwise(F.col(known)))


def pit_strict(filings: DataFrame, as_of: str, entity: str = "isin") -> DataFrame:
    """What a reader saw on ``as_of``: visible rows first, then the latest filing of each (entity,
    period, kind), then consolidated before standalone."""
    seen = pick_first(visible_as_of(filings, as_of), [entity, "period_end", "consolidated"], [F.col("known_date").desc(), F.col("seq_number").desc()])
    return pick_first(seen, [entity, "period_end"], [F.when(F.col("consolidated") == "Consolidated", 0).otherwise(1), F.col("seq_number").desc()])


def pit_collapsed(filings: DataFrame, entity: str = "isin") -> DataFrame:
    """One row a quarter over all history: consolidated if the quarter has any, then the latest known."""
    is_cons = (F.col("consolidated") == "Consolidated").cast("int")
    any_cons = F.max(is_cons).over(Window.partitionBy(entity, "period_end"))
    return pick_first(filings.withColumn("_any", any_cons).filter(is_cons == F.col("_any")).drop("_any"), [entity, "period_end"], [F.col("known_date").desc(), F.col("seq_number").desc()])


def shares_outstanding(paid_up: DataFrame, face_value: DataFrame, entity: str = "isin") -> DataFrame:
    """Paid-up capital over face value per entity and period, each picked point in time; known when
    the capital is. A face value of 0 or less gives no row."""
    cap = pit_collapsed(paid_up, entity).select(entity, "period_end", "known_date", F.col("value").alias("_cap"))
    face = pit_collapsed(face_value, entity).select(entity, "period_end", F.col("value").alias("_face")).filter("_face > 0")
    return cap.join(face, [entity, "period_end"]).select(entity, "period_end", "known_date", (F.col("_cap") / F.col("_face")).alias("shares_outstanding"))


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet: what an idempotent load appends."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def corrected(df: DataFrame, fixes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` replaced where ``fixes`` (keys, new value) says so."""
    new = fixes.select(*keys, F.col(column).alias("_new"))
    return df.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def sealed(df: DataFrame, seal: str, date: str = "trade_date", authorised: bool = False) -> DataFrame:
    """Rows before the seal; with authority all rows."""
    return df if authorised else df.filter(F.col(date) < F.lit(seal).cast("date"))


def guard_range(end: str, seal: str, authorised: bool = False) -> None:
    """Raises if a range that ends at ``end`` touches the sealed window."""
    if end >= seal and not authorised:
        raise PermissionError(f"{end} lies in the window sealed from {seal}")


def ttm_as_of(quarters: DataFrame, asks: DataFrame, count: int = 4) -> DataFrame:
    """For each (isin, at) the sum of the last ``count`` quarters by period, counted back from the quarter
    that became known last, each only if it was known by then: ttm_value, quarters (how many were),
    latest_period_end, latest_known_date. Asks that nothing was known for give no row.

    An isin's quarters, few however large the table, travel as one sorted array."""
    listed = quarters.groupBy("isin").agg(F.sort_array(F.collect_list(F.struct("period_end", "known_date", "value"))).alias("_all"))
    known = F.filter(F.transform("_all", lambda x, i: F.struct(x["known_date"].alias("k"), i.alias("i"), x["period_end"].alias("p"))), lambda x: x["k"] <= F.col("at"))
    held = asks.join(listed, "isin").withColumn("_last", F.array_max(known)).filter("_last is not null")
    first = F.greatest(F.col("_last.i") - (count - 1), F.lit(0))
    held = held.withColumn("_four", F.filter(F.slice("_all", first + 1, F.col("_last.i") - first + 1), lambda x: x["known_date"] <= F.col("at")))
    total = F.aggregate("_four", F.lit(0.0), lambda a, x: a + F.coalesce(x["value"], F.lit(0.0)))
    n = F.size(F.filter("_four", lambda x: x["value"].isNotNull())).cast("bigint")
    return held.select("isin", "at", total.alias("ttm_value"), n.alias("quarters"), F.col("_last.p").alias("latest_period_end"), F.col("_last.k").alias("latest_known_date"))
