"""Clocks: simulated word times, cumulative starts, context, and the first aligned word at or after a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the simulated voice, in seconds.
LEAD_IN, WORD, LETTER, GAP = 0.20, 0.12, 0.05, 0.06


def spoken_seconds(words: Column) -> Column:
    """How long the simulated voice takes for an array of words."""
    letters = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return LEAD_IN + F.size(words) * (WORD + GAP) + LETTER * letters


def word_times(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, position, word, start, end): the simulated timeline, a running sum over the words."""
    rows = df.select(*keys, F.posexplode(words).alias("position", "word"))
    upto = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    took = WORD + LETTER * F.length("word")
    start = LEAD_IN + F.coalesce(F.sum(took + GAP).over(upto), F.lit(0.0))
    return rows.select(*keys, "position", "word", F.round(start, 3).alias("start"), F.round(start + took, 3).alias("end"))


def clock(df: DataFrame, keys: list[str], order: list[str], seconds: Column, pause_ms: Column, out: str = "start") -> DataFrame:
    """Adds the second at which each row begins: what is before it with the pauses after each."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.round(F.coalesce(F.sum(seconds + pause_ms / 1000.0).over(upto), F.lit(0.0)), 3))


def context(df: DataFrame, keys: list[str], order: list[str], text: str, most: int = 600) -> DataFrame:
    """Adds before and after: the end of the text before and the beginning of that after."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"before": F.right(F.lag(text).over(line), F.lit(most)), "after": F.left(F.lead(text).over(line), F.lit(most))})


def first_at_or_after(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the first value that isn't null in this row or a later one."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(ahead))


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of the first row of right with the same keys at or after its time (null if none).

    One sort by key and time over both sides; of rows of right at one time the least values are taken.
    """
    values = F.struct(F.col(right_at).alias("_at"), *take)
    both = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(left_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_value")).unionByName(
        right.select(F.lit(None).alias("_row"), *keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), values.alias("_value"))
    )
    ahead = Window.partitionBy(*keys).orderBy("_at", "_side", "_value").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("_found", F.first("_value", ignorenulls=True).over(ahead)).where("_side = 0")
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in take])


def proportional(keys_at: Column, n: Column, seconds: Column) -> Column:
    """The time of the word at a place when nothing was heard: its share of the whole."""
    return F.round(seconds * keys_at / F.greatest(n, F.lit(1)), 3)


def marks_with_content(df: DataFrame, keys: list[str], at: str, is_mark: Column, is_content: Column) -> DataFrame:
    """(keys, marks, filled): marks, and those with content before the next mark."""
    line = Window.partitionBy(*keys).orderBy(at)
    part = df.withColumn("_part", F.sum(is_mark.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_has", is_content)
    parts = part.where("_part > 0").groupBy(*keys, "_part").agg(F.bool_or("_has").alias("_has"))
    return parts.groupBy(*keys).agg(F.count("*").alias("marks"), F.count_if("_has").alias("filled"))
