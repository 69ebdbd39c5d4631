"""Notes: references of a group, the first few by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_refs(df: DataFrame, keys: list[str], ref: str, most: int) -> DataFrame:
    """(keys, n, refs): how many rows, and the first `most` references in order. No group is gathered whole."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ref))).where(F.col("_r") <= most)
    said = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(ref).cast("string").alias("_ref")))), lambda x: x["_ref"]))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(first.groupBy(*keys).agg(said.alias("refs")), keys)
