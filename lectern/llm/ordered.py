"""Ranks in a global order, made over many tasks with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .sharding import before

PLACE = (1 << 33) - 1


def ranked(df: DataFrame, order: list[str], within: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """Adds rank (long, from 0) in the order of columns `order`, nulls first; with `within`, the first columns of the order, in each group.

    The rows are dealt by ranges of the whole order and sorted there once; a rank is the place in the range plus the rows
    of earlier ranges. A group of any size is spread over as many ranges as it fills, so give an order without long ties.
    df must give the same rows when it is computed again (a written table): its ranges come from a sample.
    """
    keys = within or []
    here = df.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in order])
    here = written(here.withColumn("_x_id", F.monotonically_increasing_id()), "ranked")
    # The id is the number of the partition and the place in it.
    here = here.withColumns({"_x_range": F.shiftright("_x_id", 33), "_x_place": F.col("_x_id").bitwiseAND(F.lit(PLACE))})
    starts = before(here, keys, "_x_range").join(here.groupBy(*keys, "_x_range").agg(F.min("_x_place").alias("_x_first")), [*keys, "_x_range"])
    out = here.join(starts, [*keys, "_x_range"]).withColumn(rank, F.col("_x_place") - F.col("_x_first") + F.col("_x_before"))
    return out.drop("_x_id", "_x_range", "_x_place", "_x_first", "_x_before")
