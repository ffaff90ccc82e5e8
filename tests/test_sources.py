"""Files read and written: hand-made cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import selections
from tidewell.sources import text

D = dt.date


def test_index_row_of_a_file_with_blanks(spark, tmp_path):
    (tmp_path / "i.csv").write_text("Index Name , Open Index Value,Closing Index Value\nBroad 50, 10.5 ,11\nOther,1,-\n")
    names = {"Open Index Value": "open", "Closing Index Value": "close"}
    r = text.index_file(spark, str(tmp_path / "i.csv"), "2024-01-02", "Broad 50", names).first()
    assert (r.trade_date, r.open, r.close) == (D(2024, 1, 2), 10.5, 11.0)
    assert text.index_file(spark, str(tmp_path / "i.csv"), "2024-01-02", "Other", names).first().close is None
    assert text.index_file(spark, str(tmp_path / "i.csv"), "2024-01-02", "None", names).count() == 0


def test_holidays_of_unknown_years_raise(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"2023": ["2023-01-26", "2023-08-15"], "2024": []}))
    cal = text.holidays(spark, str(tmp_path / "h.json"))
    days = spark.createDataFrame([(D(2023, 1, 26),), (D(2023, 1, 27),), (D(2024, 1, 26),), (None,)], "trade_date date")
    assert {r.trade_date: r.holiday for r in text.with_holidays(days, cal).collect()} == {D(2023, 1, 26): True, D(2023, 1, 27): False, D(2024, 1, 26): False, None: None}
    with pytest.raises(Exception, match="no holidays known for 2025"):
        text.with_holidays(days.limit(1).select(F.lit("2025-01-01").cast("date").alias("trade_date")), cal).collect()


def test_frozen_rows_refuse_changes(spark, tmp_path):
    path, df = str(tmp_path / "f"), spark.range(5)
    text.save_frozen(df, path)
    assert text.load_frozen(spark, path).count() == 5
    with pytest.raises(Exception, match="(?i)exists"):
        text.save_frozen(df, path)
    df.write.mode("append").parquet(path + "/rows")
    with pytest.raises(ValueError, match="differ"):
        text.load_frozen(spark, path)
    with pytest.raises(Exception, match="(?i)not exist"):
        text.load_frozen(spark, str(tmp_path / "none"))


def test_insert_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "n long, s string").write.parquet(path)
    text.insert_rows(spark.createDataFrame([("b", 2)], "s string, n int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="columns differ"):
        text.insert_rows(spark.createDataFrame([("b",)], "s string"), path)
    for i in range(2):
        text.append_csv(spark.createDataFrame([(i, f"2024-01-0{i + 1} 09:15:00")], "n int, ts string"), str(tmp_path / "c"))
    log = text.csv_log(spark, str(tmp_path / "c"), ["ts"]).collect()
    assert sorted((r.n, r.ts) for r in log) == [("0", dt.datetime(2024, 1, 1, 9, 15)), ("1", dt.datetime(2024, 1, 2, 9, 15))]


def test_records_of_repeated_pages(spark, tmp_path):
    rows = [{"symbol": "A", "exDate": "05-Jan-2024"}, {"symbol": "B", "exDate": "-"}]
    for i in range(2):
        (tmp_path / f"p{i}.json").write_text(json.dumps(rows))
    got = text.records(spark, str(tmp_path), "symbol string, exDate string", {"symbol": "symbol", "exDate": "ex_date"}, {"ex_date": "dd-MMM-yyyy"})
    assert {(r.symbol, r.ex_date) for r in got.collect()} == {("A", D(2024, 1, 5)), ("B", None)} and got.count() == 2


def test_lists_and_padding(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (2, [7]), (3, None)], "i int, l array<int>")
    assert {r.i: r.p for r in df.select("i", selections.padded(F.col("l")).alias("p")).collect()} == {1: [1, 2, 3, 4, 5], 2: [7, None, None, None, None], 3: [None] * 5}
    assert selections.rows_in(df, "i", []).columns == df.columns and selections.rows_in(df, "i", []).count() == 0
    assert selections.rows_in(df, "i", [1, 3, 9, None], most=2).count() == selections.rows_in(df, "i", [1, 3, 9, None]).count() == 2
    words = df.select(selections.mentions(F.lit("Too Many requests"), ["too many"]).alias("a"), selections.mentions(F.lit(None), ["x"]).alias("b"), selections.mentions(F.lit("x"), []).alias("c")).first()
    assert tuple(words) == (True, False, False)
