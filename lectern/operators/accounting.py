"""The ledger of external work: totals, monthly units, estimates, and the guard before any call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prices, and the rate of speech that estimates use.
USD_PER_1000_CHARS, USD_PER_MINUTE, CHARS_PER_SECOND = 0.030, 0.0043, 14.0
CREDIT, RESERVE = 200.0, 10.0


class BudgetExceeded(RuntimeError):
    """More would be spent than is left."""


def spent(ledger: DataFrame) -> DataFrame:
    """(provider, usd)"""
    return ledger.groupBy("provider").agg(F.sum("usd").alias("usd"))


def units_by_month(ledger: DataFrame) -> DataFrame:
    """(provider, kind, month, units), months in UTC."""
    return ledger.groupBy("provider", "kind", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("units").alias("units"))


def synthesis_usd(chars: Column) -> Column:
    return chars / 1000.0 * USD_PER_1000_CHARS


def recognition_usd(seconds: Column) -> Column:
    return seconds / 60.0 * USD_PER_MINUTE


def estimate(chunks: DataFrame, audio_cached: str, transcript_cached: str, keys: list[str] = ()) -> DataFrame:
    """What is to do of chunks (text, and whether its audio and transcript are there), and what it costs."""
    chars = F.length("text").cast("long")
    open_ = lambda c, v: F.coalesce(F.sum(F.when(~F.col(c), v)), F.lit(0))
    out = chunks.groupBy(*keys).agg(
        F.count("*").alias("chunks"),
        F.sum(chars).alias("chars"),
        F.count_if(~F.col(audio_cached)).alias("to_speak"),
        open_(audio_cached, chars).alias("chars_to_speak"),
        F.count_if(~F.col(transcript_cached)).alias("to_hear"),
        (open_(transcript_cached, chars) / CHARS_PER_SECOND).alias("seconds_to_hear"),
    )
    return out.withColumns({"usd_speak": synthesis_usd(F.col("chars_to_speak")), "usd_hear": recognition_usd(F.col("seconds_to_hear"))})


def guard(ledger: DataFrame, estimated_usd: float, provider: str, credit: float = CREDIT, reserve: float = RESERVE) -> float:
    """What is left after estimated_usd, before anything is called; raises if that is less than nothing."""
    row = ledger.where(F.col("provider") == provider).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd")).first()
    left = credit - reserve - row.usd - estimated_usd
    if left < 0:
        raise BudgetExceeded(f"{provider}: {estimated_usd:.2f} USD are estimated and {credit - reserve - row.usd:.2f} are left")
    return left


def guard_units(ledger: DataFrame, units: float, provider: str, kind: str, month: str, most: float) -> float:
    """The same for a monthly quota of units."""
    row = units_by_month(ledger).where((F.col("provider") == provider) & (F.col("kind") == kind) & (F.col("month") == month)).agg(F.coalesce(F.sum("units"), F.lit(0.0)).alias("n")).first()
    if row.n + units > most:
        raise BudgetExceeded(f"{provider}: {row.n:.0f} of {most:.0f} units of {month} are used and {units:.0f} more are asked")
    return most - row.n - units


def running_guard(rows: DataFrame, keys: list[str], order: list[str], usd: str, credit: float, reserve: float = RESERVE, bucket: Column | None = None) -> DataFrame:
    """Adds spent_before and allowed: whether each row still fits what is left, in order.

    bucket is a value that never falls in that order, as the day of a time: then no task sorts more than the rows of one
    bucket, or one row for each bucket.
    """
    lower = lambda by, value, *of: F.coalesce(F.sum(value).over(Window.partitionBy(*of).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    if bucket is None:
        rows = rows.withColumn("spent_before", lower(order, usd, *keys))
    else:
        rows = rows.withColumn("_bucket", bucket)
        sums = rows.groupBy(*keys, "_bucket").agg(F.sum(usd).alias("_sum")).withColumn("_before", lower(["_bucket"], "_sum", *keys)).drop("_sum")
        rows = rows.join(sums, [*keys, "_bucket"]).withColumn("spent_before", F.col("_before") + lower(order, usd, *keys, "_bucket")).drop("_bucket", "_before")
    return rows.withColumn("allowed", F.col("spent_before") + F.col(usd) <= credit - reserve)
