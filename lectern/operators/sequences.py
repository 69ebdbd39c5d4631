"""Windows over ordered numbers: islands, gaps, reversals, likeness scores, suffixes for repeats."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import covered


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, first, last, n): runs of consecutive distinct integers."""
    distinct = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return distinct.withColumn("_run", F.col(value) - place).groupBy(*keys, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_run")


def global_islands(df: DataFrame, value: str, span: int = 1 << 16) -> DataFrame:
    """islands() without a key: made in spans of the values, then joined where one span goes on in the next."""
    spans = df.select(value).withColumn("_span", F.floor(F.col(value) / span))
    parts = islands(spans, ["_span"], value)
    # A part that fills a span to its edge goes on with the part that begins at the next; such parts are few.
    line = Window.orderBy("first")
    edge = parts.where((F.col("first") % span == 0) | (F.col("last") % span == span - 1))
    inner = parts.join(edge.select("first"), "first", "left_anti")
    new = (F.col("first") != F.lag("last").over(line) + 1) | F.lag("last").over(line).isNull()
    runs = edge.withColumn("_run", F.sum(new.cast("int")).over(line)).groupBy("_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return inner.select("first", "last", "n").unionByName(runs.select("first", "last", "n"))


def missing(df: DataFrame, keys: list[str], value: str, upto) -> DataFrame:
    """(keys, value) for the numbers from 1 to upto (a column of df, the greatest of each key) that no row has."""
    whole = df.groupBy(*keys).agg(F.max(upto).alias("_upto"), F.collect_set(value).alias("_have"))
    gone = F.array_except(F.sequence(F.lit(1), F.greatest(F.col("_upto").cast("int"), F.lit(1))), F.col("_have"))
    return whole.select(*keys, F.explode(gone).alias(value))


def missing_labels(df: DataFrame, keys: list[str], label: str, absent: str | None = None) -> DataFrame:
    """missing() for labels that may stand for several numbers; those in the array column absent don't count as missing."""
    numbers = df.select(*keys, F.explode(covered(F.col(label))).alias("_n"))
    upto = numbers.groupBy(*keys).agg(F.max("_n").alias("_upto"), F.collect_set("_n").alias("_have"))
    gone = F.array_except(F.sequence(F.lit(1), F.greatest("_upto", F.lit(1))), F.col("_have"))
    if absent:
        upto = upto.join(df.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(absent))).alias("_absent")), keys)
        gone = F.array_except(gone, F.col("_absent"))
    return upto.select(*keys, F.explode(gone).alias("number"))


def order_faults(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, reversals, repeated): how often a number is less than that before it, and how many numbers come again."""
    back = F.col(value) < F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_back", back).groupBy(*keys).agg(F.count_if("_back").alias("reversals"), (F.count(value) - F.countDistinct(value)).alias("repeated"))


def verse_likeness(df: DataFrame, keys: list[str], order: list[str], value: str, least: int = 5) -> DataFrame:
    """(keys, n, likeness): the share of steps that verse numbers make: to the same, the next, or back to 1 or 2; over one, half."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    back = F.col(value).isin(1, 2) & (before >= F.col(value))
    step = F.when((F.col(value) - before).isin(0, 1) | back, 1.0).when(F.col(value) - before == 2, 0.5).otherwise(0.0)
    scored = df.withColumn("_step", F.when(before.isNotNull(), step))
    return scored.groupBy(*keys).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, F.avg("_step")).otherwise(0.0).alias("likeness"))


def jumps(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, jumps, restarts) of the sequence without repeats of the number just before: steps over numbers, steps back."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(value) != F.col("_before")))
    return kept.groupBy(*keys).agg(F.count_if(F.col(value) > F.col("_before") + 1).alias("jumps"), F.count_if(F.col(value) < F.col("_before")).alias("restarts"))


def rising(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, rising): the length of the longest strictly increasing subsequence.

    Rows come sorted, and of a group only the least last value for each length is kept, never its rows.
    """
    rows = df.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("long").alias("_v")).where("_v IS NOT NULL")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))]).select(*keys, "_v")

    def run(batches):
        of, tails = None, []
        done: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            new = np.zeros(len(values), bool)
            for c in columns:
                new[1:] |= np.fromiter((x != y for x, y in zip(c, c[1:])), bool, len(c) - 1)
            new[0] = of is None or tuple(c[0] for c in columns) != of
            edges = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(values)]
            for a, b in zip(edges, edges[1:]):
                if new[a]:
                    if of is not None:
                        done.append((*of, len(tails)))
                    of, tails = tuple(c[a] for c in columns), []
                for v in values[a:b].tolist():
                    at = bisect_left(tails, v)
                    tails[at : at + 1] = [v]
            if len(done) >= 10_000:
                yield batch_of(done)
                done = []
        if of is not None:
            done.append((*of, len(tails)))
        if done:
            yield batch_of(done)

    kinds = rows.select(*keys).schema

    def batch_of(found):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in kinds.fields] + [pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), types)], names=[*keys, "rising"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields], "rising int"]))


class Tails:
    """Of a stretch of a sequence of numbers from 1 to most: the least last number of a rising run of each length over each start.

    Row a has runs of numbers over a; column l those of l numbers, most + 1 where there is none. Tails of two stretches
    after each other join to those of both, so that a long sequence can be summed up in parts.
    """

    def __init__(self, most: int, at: np.ndarray | None = None):
        self.most = most
        self.at = np.full((most + 2, most + 1), most + 1, np.int32) if at is None else at
        if at is None:
            self.at[:, 0] = np.arange(most + 2)

    def add(self, value: int) -> None:
        own = self.at[:value]
        length = (own < value).sum(axis=1)
        own[np.arange(value), length] = value

    def then(self, later: Tails) -> Tails:
        out = np.full_like(self.at, self.most + 1)
        for length in range(self.most + 1):
            out[:, length:] = np.minimum(out[:, length:], later.at[self.at[:, length]][:, : self.most + 1 - length])
        return Tails(self.most, out)

    def longest(self) -> int:
        return int((self.at[0] <= self.most).sum()) - 1


#: Numbers of a group that are held before they are summed up.
HELD = 1 << 16


def rising_within(df: DataFrame, keys: list[str], order: list[str], value: str, most: str) -> DataFrame:
    """(keys, rising): the length of the longest strictly increasing subsequence of the values from 1 to most, a column that a group has one value of.

    Rows are dealt by ranges of keys and order, so that a long group is many tasks' work; what its parts emit are Tails,
    which are joined in the order of the parts.
    """
    import pandas as pd
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = [*keys, *[f"_o{i}" for i in range(len(order))]]
    rows = df.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("int").alias("_v"), F.col(most).cast("int").alias("_m")).where("_v BETWEEN 1 AND _m")
    rows = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).select(*keys, "_v", "_m")
    kinds = rows.select(*keys).schema
    names = [*keys, "part", "rising", "most", "tails"]
    types = [to_arrow_type(f.dataType) for f in kinds.fields] + [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        part, done = TaskContext.get().partitionId(), []
        of, tops, held, tails, edge = None, 0, [], None, True

        def summed(tails, held):
            tails = tails or Tails(tops)
            for v in held:
                tails.add(v)
            return tails

        def closed(edge):
            if edge or tails is not None:
                done.append((*of, part, None, tops, summed(tails, held).at.tobytes()))
            else:
                ends: list[int] = []
                for v in held:
                    at = bisect_left(ends, v)
                    ends[at : at + 1] = [v]
                done.append((*of, part, len(ends), tops, None))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, v, m in zip(*columns):
                if key != of:
                    if of is not None:
                        closed(edge)
                        edge = False
                    of, tops, held, tails = key, m, [], None
                held.append(v)
                if len(held) >= HELD:
                    tails, held = summed(tails, held), []
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)
                done = []
        if of is not None:
            closed(True)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)

    parts = rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields], "part bigint, rising int, most int, tails binary"]))

    def joined(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        tails = [Tails(m, np.frombuffer(t, np.int32).reshape(m + 2, m + 1)) for m, t in zip(own["most"], own["tails"])]
        whole = tails[0]
        for t in tails[1:]:
            whole = whole.then(t)
        return own.head(1)[keys].assign(rising=whole.longest())

    edges = parts.where("tails IS NOT NULL").groupBy(*keys).applyInPandas(joined, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields], "rising int"]))
    return parts.where("tails IS NULL").select(*keys, "rising").unionByName(edges)


def chapter_likeness(df: DataFrame, keys: list[str], order: list[str], value: str, expected: str) -> DataFrame:
    """(keys, likeness): the longest rising run of numbers from 1 to expected over expected, the number of chapters.

    None for a book of one chapter, and where more than max(3, expected / 4) marks are not in that run.
    """
    every = df.groupBy(*keys).agg(F.max(expected).alias("_n"), F.count(value).alias("_marks"))
    up = rising_within(df, keys, order, value, expected)
    rising_ = F.coalesce(F.col("rising"), F.lit(0))
    none = (F.col("_n") <= 1) | (F.col("_marks") - rising_ > F.greatest(F.lit(3), F.floor(F.col("_n") / 4)))
    return every.join(up, keys, "left").select(*keys, F.when(none, 0.0).otherwise(rising_ / F.col("_n")).alias("likeness"))


def unique_labels(df: DataFrame, keys: list[str], order: list[str], label: str, out: str = "key") -> DataFrame:
    """Adds the label, with #2, #3 ... from its second row on."""
    again = F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order))
    return df.withColumn(out, F.when(again > 1, F.concat(F.col(label).cast("string"), F.lit("#"), again.cast("string"))).otherwise(F.col(label).cast("string")))


def label_runs(df: DataFrame, keys: list[str], order: list[str], label: str, most: int = 6) -> DataFrame:
    """(keys, runs): labels in order with runs as first–last, at most so many and then an ellipsis.

    7, 8, 2, 3, 4 is '7–8, 2–4'; the next of 1a is 1b.
    """
    number = F.regexp_extract(label, r"^(\d+)", 1)
    letter = F.regexp_extract(label, r"^\d+([a-z]*)$", 1)
    follows = F.when(letter == "", F.concat((number.cast("int") + 1).cast("string"), F.lit(""))).otherwise(F.concat(number, F.chr(F.ascii(letter) + 1)))
    line = Window.partitionBy(*keys).orderBy(*order)
    new = F.lag("_next").over(line).isNull() | (F.lag("_next").over(line) != F.col(label))
    runs = df.withColumn("_next", follows).withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(line))
    place = F.row_number().over(line)
    runs = runs.withColumn("_place", place).groupBy(*keys, "_run").agg(F.min_by(label, "_place").alias("_first"), F.max_by(label, "_place").alias("_last"))
    said = F.when(F.col("_first") == F.col("_last"), F.col("_first")).otherwise(F.concat("_first", F.lit("–"), "_last"))
    every = runs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_run", said.alias("_said")))), lambda x: x["_said"]).alias("_all"))
    return every.select(*keys, F.concat(F.concat_ws(", ", F.slice("_all", 1, most)), F.when(F.size("_all") > most, "…").otherwise("")).alias("runs"))


def gap_reasons(df: DataFrame, keys: list[str], order: list[str], label: str, text: str, least: int = 150) -> DataFrame:
    """(keys, first, last, n, reason) for each run of missing numbers: 'number lost', 'unclear' or 'not in this edition'.

    Where n numbers are missing after a verse whose length is n + 1 times the median and more (and at least `least`),
    their text stands there without a number; from 1 + 0.4 n times on it may.
    """
    lengths = df.groupBy(*keys, label).agg(F.sum(F.length(text)).alias("_len"))
    middle = lengths.groupBy(*keys).agg(F.median("_len").alias("_mid"))
    gaps = islands(missing_labels(df, keys, label), keys, "number")
    numbered = lengths.withColumn("_n", F.element_at(covered(F.col(label)), -1))
    before = numbered.groupBy(*keys, "_n").agg(F.sum("_len").alias("_len"))
    joined = gaps.join(middle, keys).join(before.withColumn("first", F.col("_n") + 1).drop("_n"), [*keys, "first"], "left")
    ratio = F.col("_len") / F.greatest(F.col("_mid"), F.lit(1))
    reason = F.when((ratio >= F.col("n") + 1) & (F.col("_len") >= least), "number lost").when(ratio >= 1 + 0.4 * F.col("n"), "unclear").otherwise("not in this edition")
    return joined.select(*keys, "first", "last", "n", reason.alias("reason"))
