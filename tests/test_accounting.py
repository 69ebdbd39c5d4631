from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import accounting, inference, timing


def ledger(spark):
    rows = [(datetime(2024, 1, 31, 12), "a", "chars", 100.0, 50.0), (datetime(2024, 2, 1), "a", "chars", 30.0, 20.0), (datetime(2024, 2, 2), "b", "chars", 7.0, 1.0)]
    return spark.createDataFrame(rows, "ts timestamp, provider string, kind string, units double, usd double")


def test_guard(spark):
    own = ledger(spark)
    assert accounting.guard(own, 30.0, "a") == 90.0 and accounting.guard(own, 120.0, "a") == 0.0
    assert accounting.guard(own, 190.0, "nobody") == 0.0
    with pytest.raises(accounting.BudgetExceeded, match="a: 120.01"):
        accounting.guard(own, 120.01, "a")


def test_guard_of_a_monthly_quota(spark):
    own = ledger(spark)
    assert accounting.guard_units(own, 70.0, "a", "chars", "2024-02", 100.0) == 0.0
    assert accounting.guard_units(own, 5.0, "a", "chars", "2024-03", 100.0) == 95.0
    with pytest.raises(accounting.BudgetExceeded, match="30 of 100"):
        accounting.guard_units(own, 70.5, "a", "chars", "2024-02", 100.0)


def test_times_by_share(spark):
    df = spark.createDataFrame([(0, 10, 5.0), (3, 10, 5.0), (0, 0, 5.0)], "at int, n int, seconds double")
    assert [r.t for r in df.select(timing.proportional(F.col("at"), F.col("n"), F.col("seconds")).alias("t")).collect()] == [0.0, 1.5, 0.0]


def test_first_value_from_a_row_on(spark):
    df = spark.createDataFrame([("k", 0, None), ("k", 1, 7), ("k", 2, None), ("k", 3, 9), ("k", 4, None), ("m", 0, None)], "k string, at int, v int")
    got = timing.first_at_or_after(df, ["k"], ["at"], F.col("v"), "next")
    assert [r.next for r in got.orderBy("k", "at").collect()] == [7, 7, 9, 9, None, None]


def test_documents_without_a_title_belong_to_the_book_before(spark):
    df = spark.createDataFrame([("w", 0, None), ("w", 1, "gn"), ("w", 2, None), ("w", 3, "ex"), ("v", 4, None)], "w string, at int, book string")
    got = inference.books_of_documents(df, ["w"], "at", "book")
    assert [r.book for r in got.orderBy("at").collect()] == [None, "gn", "gn", "ex", None]


def test_chapter_marks_with_verses(spark):
    rows = [("b", "h2", 0), ("b", "sup", 1), ("b", "h2", 2), ("b", "h2", 3), ("b", "sup", 4), ("b", "p", 5), ("c", "sup", 0), ("c", "h2", 1)]
    df = spark.createDataFrame(rows, "book string, signature string, position int")
    got = {r.book: (r.marks, r.filled) for r in inference.filled_chapters(df, ["book"], "h2", "sup").collect()}
    assert got == {"b": (3, 2), "c": (1, 0)}
