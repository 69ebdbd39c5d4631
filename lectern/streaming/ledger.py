"""The ledger as a stream: monthly totals, and work done at most once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "ts timestamp, provider string, kind string, units double, usd double, ref string"


def read(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The appended JSON lines under path as a stream; lines that can't be read are left out."""
    rows = spark.readStream.schema(LEDGER + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_at_once).json(path)
    return rows.where("_corrupt IS NULL AND provider IS NOT NULL").drop("_corrupt")


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LEDGER + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL AND provider IS NOT NULL").drop("_corrupt")


def append(rows: DataFrame, path: str) -> None:
    """Rows are noted before the work they stand for is stored."""
    rows.select("ts", "provider", "kind", "units", F.round("usd", 6).alias("usd"), "ref").write.mode("append").json(path)


def monthly(ledger: DataFrame, late: str = "2 days") -> DataFrame:
    """(month, provider, kind, units, usd), kept up while rows come; rows later than `late` are left out of closed months."""
    month = F.date_trunc("month", "ts").alias("month")
    return ledger.withWatermark("ts", late).groupBy(month, "provider", "kind").agg(F.sum("units").alias("units"), F.sum("usd").alias("usd"))


def hourly_windows(ledger: DataFrame, late: str = "2 hours", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Spending by tumbling or sliding windows of event time."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return ledger.withWatermark("ts", late).groupBy(window.alias("window"), "provider").agg(F.sum("usd").alias("usd"), F.count("*").alias("calls"))


def once(work: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key of a stream of work once within the watermark."""
    return work.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
