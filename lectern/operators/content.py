"""Content-addressed work: keys, what is pending, conditional upserts, and ordered first rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What JSON writes otherwise in a text.
SPECIAL = "".join(["\\", '"', *map(chr, range(32))])


def json_text(text: Column, escaped: str = SPECIAL) -> Column:
    """A text as JSON has it, letters of all scripts as they are and control characters in lower-case digits. escaped: a backslash first, if at all."""
    for special in escaped:
        text = F.replace(text, F.lit(special), F.lit(json.dumps(special)[1:-1]))
    return F.concat(F.lit('"'), text, F.lit('"'))


def cache_key(signature: Column, text: Column, variant: Column, in_signature: str = SPECIAL, in_text: str = SPECIAL) -> Column:
    """The first 32 hex digits of the hash of the JSON of all three, keys sorted. A null part makes a null key. in_signature, in_text: what is escaped in them."""
    said = F.concat(F.lit('{"firma": '), json_text(signature, in_signature), F.lit(', "texto": '), json_text(text, in_text), F.lit(', "variante": '), variant.cast("string"), F.lit("}"))
    return F.substring(F.sha2(said.cast("binary"), 256), 1, 32)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def pending(work: DataFrame, cache: DataFrame, on: list[str], each: list[str] | None = None) -> DataFrame:
    """One row of each key of work that isn't in the cache; each: what makes rows that are pending differ, if more than the key."""
    return work.join(cache.select(*on).distinct(), on, "left_anti").dropDuplicates(each or on)


def none_if_unknown(work: DataFrame, cache: DataFrame, on: str) -> DataFrame:
    """The rows of work that NOT IN can keep: none beside a null in the cache, and a null of work only beside an empty cache."""
    known = cache.agg(F.count("*").alias("_all"), F.count(on).alias("_known"))
    kept = (F.col("_all") == 0) | ((F.col("_all") == F.col("_known")) & F.col(on).isNotNull())
    return work.join(F.broadcast(known), kept).drop("_all", "_known")


def upsert_actions(new: DataFrame, there: DataFrame, prints: DataFrame, key: list[str], text: str = "text", force: bool = False) -> DataFrame:
    """(key, action): write, same, overwrite, keep or none.

    A key that isn't there is written. Equal content is the same. Other content is overwritten if what is there has the
    fingerprint it was written with, so that nobody has edited it, or by force; otherwise it is kept and reported.
    """
    both = new.select(*key, F.col(text).alias("_new")).join(there.select(*key, F.col(text).alias("_old")), key, "full_outer")
    both = both.join(prints.select(*key, F.col("fingerprint").alias("_print")), key, "left")
    untouched = F.coalesce(fingerprint(F.col("_old")) == F.col("_print"), F.lit(False)) | F.lit(force)
    action = F.when(F.col("_new").isNull(), "none").when(F.col("_old").isNull(), "write").when(F.col("_new") == F.col("_old"), "same").when(untouched, "overwrite").otherwise("keep")
    return both.select(*key, action.alias("action"))


def upserted(new: DataFrame, there: DataFrame, prints: DataFrame, key: list[str], text: str = "text", force: bool = False) -> DataFrame:
    """(key, text, fingerprint, action): the content after the upsert. What isn't written keeps the fingerprint that it has."""
    actions = upsert_actions(new, there, prints, key, text, force)
    both = actions.join(new.select(*key, F.col(text).alias("_new")), key, "left").join(there.select(*key, F.col(text).alias("_old")), key, "left")
    both = both.join(prints.select(*key, F.col("fingerprint").alias("_print")), key, "left")
    taken = F.col("action").isin("write", "overwrite", "same")
    return both.select(*key, F.when(taken, F.col("_new")).otherwise(F.col("_old")).alias(text), F.when(taken, fingerprint(F.col("_new"))).otherwise(F.col("_print")).alias("fingerprint"), "action")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_attempts(attempts: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """Of several attempts that of the least longest run, then of the fewest faults, then of the least error rate; the earliest of equals."""
    worst = F.greatest("omission_run", "insertion_run")
    return first_rows(attempts, keys, [worst.asc(), (F.col("omissions") + F.col("insertions")).asc(), F.col("wer").asc(), F.col(attempt).asc()])


def top(df: DataFrame, keys: list[str], value: str, k: int, seen: str) -> DataFrame:
    """(keys, value, n): the k most frequent values of each key; of equals that seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seen).alias("_seen"))
    line = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("_seen"), F.col(value))
    return counts.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= k).drop("_r", "_seen")


def overlap_accepted(df: DataFrame, seen: str, new: str) -> DataFrame:
    """Adds common, fresh and accepted: a piece whose labels are disjoint from those seen, or overlap in few and bring more."""
    both, own = F.size(F.array_intersect(seen, new)), F.size(F.array_distinct(new))
    df = df.withColumns({"common": both, "fresh": F.size(F.array_except(new, seen))})
    few = F.col("common") <= F.greatest(F.lit(1), F.floor(own / 10))
    return df.withColumn("accepted", (F.col("common") == 0) | (few & (F.col("fresh") > F.col("common"))))
