"""Readers of text layouts: price files, notices, tagged facts, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column layouts of the daily price files, old and new. Fixed values of the formats.
LEGACY = {"ISIN": "isin", "SYMBOL": "symbol", "SERIES": "series", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close", "LAST": "last", "PREVCLOSE": "prev_close", "TOTTRDQTY": "volume", "TOTTRDVAL": "turnover", "TOTALTRADES": "n_trades", "TIMESTAMP": "stamp"}
UDIFF = {"ISIN": "isin", "TckrSymb": "symbol", "SctySrs": "series", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close", "LastPric": "last", "PrvsClsgPric": "prev_close", "TtlTradgVol": "volume", "TtlTrfVal": "turnover", "TtlNbOfTxsExctd": "n_trades", "TradDt": "stamp"}
LAYOUT_CHANGE = "2024-01-01"


def price_file(spark: SparkSession, path: str, date: str, series: tuple[str, ...] = ("EQ", "BE")) -> DataFrame:
    """A day's prices from CSV in the layout of its date. The trade date is the one asked for; a file
    whose own stamp names another day or month raises."""
    new = date >= LAYOUT_CHANGE
    names = UDIFF if new else LEGACY
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.filter("Sgmt = 'CM'") if new else raw
    rows = raw.select(*(F.trim(F.col(a)).alias(b) for a, b in names.items())).filter(F.col("series").isin(*series))
    stamp = F.coalesce(F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.initcap("stamp"), F.lit("dd-MMM-yyyy")), F.try_to_timestamp(F.initcap("stamp"), F.lit("dd-MMM-yy")))
    asked = F.lit(date).cast("date")
    same = (F.month(stamp) == F.month(asked)) & (F.dayofmonth(stamp) == F.dayofmonth(asked))
    checked = F.when(F.coalesce(same, F.lit(False)), asked).otherwise(F.raise_error(F.lit("the file is of another day")).cast("date"))
    number = lambda c, t="double": F.expr(f"try_cast({c} as {t})").alias(c)
    return rows.select("isin", checked.alias("trade_date"), "symbol", "series", *(number(c) for c in ("open", "high", "low", "close", "last", "prev_close")), number("volume", "bigint"), number("turnover"), number("n_trades", "bigint"))


def subject_ratio(subject: Column) -> Column:
    """Product over all bonuses (a:b gives (a + b) / b) and splits (from x to y gives x / y) that a
    notice names; 1 where it names none."""
    both = lambda pattern: F.arrays_zip(F.regexp_extract_all(subject, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(subject, F.lit(pattern), F.lit(2)).alias("b"))
    num = lambda x, c: x[c].cast("double")
    bonus = F.aggregate(both(r"(?i)bonus\s+(\d+)\s*:\s*(\d+)"), F.lit(1.0), lambda p, x: p * (num(x, "a") + num(x, "b")) / num(x, "b"))
    split = F.aggregate(both(r"(?i)from\s+rs\.?\s*(\d+(?:\.\d+)?).*?to\s+r[se]\.?\s*(\d+(?:\.\d+)?)"), F.lit(1.0), lambda p, x: p * num(x, "a") / num(x, "b"))
    return bonus * split


def tagged_facts(df: DataFrame, key: str, text: str, pattern: str, names: list[str]) -> DataFrame:
    """A row for each match of ``pattern``: key and its groups, in order of the text."""
    groups = F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)))
    rows = df.select(key, F.posexplode(groups).alias("fact_no", "f"))
    parts = [f.name for f in rows.schema["f"].dataType.fields]
    return rows.select(key, "fact_no", *(F.col("f").getField(p).alias(n) for p, n in zip(parts, names, strict=True)))


def xbrl_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(name, context, value) of the tagged facts of an XBRL document, prefixes dropped."""
    return tagged_facts(df, key, text, r'<(?:[\w-]+:)?([\w.-]+)\s[^>]*?contextRef="([^"]*)"[^>]*>([^<]*)</', ["name", "context", "value"])


def first_events(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key are dropped."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    whole = df.filter(F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) == 0) if len(keys) > 1 else df.filter(F.col(keys[0]).isNotNull())
    return whole.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def event_log(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """JSON lines, first of each event_id by file and time; broken lines and lines without id drop."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    out = first_events(rows, ["event_id"], ["ts"])
    return out.filter(F.col("kind") == kind) if kind else out


def append_events(events: DataFrame, path: str) -> None:
    """Append rows as JSON lines, each with an id where it has none."""
    with_id = events.withColumn("event_id", F.coalesce("event_id", F.expr("uuid()"))) if "event_id" in events.columns else events.withColumn("event_id", F.expr("uuid()"))
    with_id.write.mode("append").json(path)


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text file: upper case, without comments and blanks. An empty list raises."""
    rows = spark.read.text(path).select(F.upper(F.trim(F.regexp_replace("value", "#.*", ""))).alias("symbol")).filter("symbol <> ''").distinct()
    if rows.limit(1).count() == 0:
        raise ValueError(f"no symbols in {path}")
    return rows


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: what an artefact is checked against."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    found = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return "-".join(str(x) for x in found)


def overwrite_days(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """Replace just the days that ``df`` holds in a table partitioned by day."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def without_tombstones(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def redacted(text: Column) -> Column:
    """Token-like runs replaced."""
    return F.regexp_replace(text, r"[A-Za-z0-9_\-]{24,}", "<redacted>")


def work_list(spark: SparkSession, first: str, last: str, done: DataFrame | None = None) -> DataFrame:
    """Weekdays still to load."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as trade_date").filter(F.weekday("trade_date") < 5)
    return days.join(done.select("trade_date"), "trade_date", "left_anti") if done is not None else days


def trimmed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as strings, blanks around header names and values dropped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*(c.strip() for c in raw.columns)).select(*(F.trim(F.col(f"`{c.strip()}`")).alias(c.strip()) for c in raw.columns))


def index_file(spark: SparkSession, path: str, date: str, name: str, columns: dict[str, str], label: str = "Index Name") -> DataFrame:
    """The day's row of one index from a file of all: ``columns`` maps the file's names to ours, as
    numbers; no row where the file does not list the index."""
    rows = trimmed_csv(spark, path).filter(F.col(f"`{label}`") == name)
    return rows.select(F.lit(name).alias("index_name"), F.lit(date).cast("date").alias("trade_date"), *(F.col(f"`{a}`").try_cast("double").alias(b) for a, b in columns.items())).limit(1)


def csv_log(spark: SparkSession, path: str, times: list[str]) -> DataFrame:
    """A log in CSV, ``times`` as timestamps; null where a time cannot be read."""
    return trimmed_csv(spark, path).withColumns({c: F.try_to_timestamp(c) for c in times})


def holidays(spark: SparkSession, path: str) -> DataFrame:
    """year, trade_date (null for a year that lists none) of a JSON file {year: [dates]}."""
    whole = spark.read.option("wholetext", True).text(path)
    years = whole.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("year", "days"))
    return years.select(F.col("year").cast("int").alias("year"), F.explode_outer("days").alias("day")).select("year", F.to_date("day").alias("trade_date"))


def with_holidays(df: DataFrame, calendar: DataFrame, date: str = "trade_date", out: str = "holiday") -> DataFrame:
    """``df`` with a flag. A year that the calendar lacks raises: an unknown day is never called open."""
    years = calendar.groupBy("year").agg(F.collect_set("trade_date").alias("_days"))
    found = df.withColumn("_year", F.year(date)).join(F.broadcast(years.withColumnRenamed("year", "_year")), "_year", "left")
    flag = F.when(F.col(date).isNull(), F.lit(None).cast("boolean")).when(F.col("_days").isNull(), F.raise_error(F.concat(F.lit("no holidays known for "), F.col("_year").cast("string"))).cast("boolean"))
    return found.withColumn(out, flag.otherwise(F.array_contains("_days", F.col(date)))).drop("_year", "_days")


def save_frozen(df: DataFrame, path: str) -> str:
    """Write a table once, with the digest of its rows beside it. An artefact that is there raises."""
    df.write.mode("error").parquet(f"{path}/rows")
    spark = df.sparkSession
    digest = content_hash(spark.read.parquet(f"{path}/rows"))
    spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("error").json(f"{path}/digest")
    return digest


def load_frozen(spark: SparkSession, path: str) -> DataFrame:
    """A table of :func:`save_frozen`. A missing one raises, as does one whose rows no longer give
    their digest; it is never computed anew."""
    rows = spark.read.parquet(f"{path}/rows")
    if content_hash(rows) != spark.read.schema("digest string").json(f"{path}/digest").first()["digest"]:
        raise ValueError(f"rows of {path} differ from their digest")
    return rows


def insert_rows(df: DataFrame, path: str) -> None:
    """Append to a table in its own column order and types; a missing or unknown column raises."""
    spark = df.sparkSession
    there = spark.read.parquet(path).schema
    if set(df.columns) != set(there.fieldNames()):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(there.fieldNames()))}")
    df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in there)).write.mode("append").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a folder of CSV files, each with its one header."""
    df.write.mode("append").option("header", True).csv(path)


def records(spark: SparkSession, path: str, schema: str, columns: dict[str, str], dates: dict[str, str] | None = None) -> DataFrame:
    """Rows of a JSON array file or pages of them (filings, corporate actions): ``columns`` maps the
    file's names to ours, ``dates`` the format of those of ours that are dates. Pages that repeat a
    row give it once."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(*(F.col(f"`{a}`").alias(b) for a, b in columns.items()))
    return rows.withColumns({c: F.try_to_timestamp(c, F.lit(f)).cast("date") for c, f in (dates or {}).items()}).distinct()
