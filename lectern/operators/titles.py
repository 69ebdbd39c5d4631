"""Titles resolved to a dimension of names: overrides, whole titles, then names within a title with their ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ACCENTED, PLAIN

SECTION = "seccion"


def plain(title: Column) -> Column:
    """Lower case, without accents or punctuation, single spaces."""
    bare = F.regexp_replace(F.translate(F.lower(title), ACCENTED, PLAIN), r"(?U)[^\w\s]|_", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def resolved(titles: DataFrame, key: str, title: str, names: DataFrame, ordinals: dict[int, list[str]], overrides: dict[str, str] | None = None) -> DataFrame:
    """(key, book, mode) for each row: the id of the name that a title has, or null.

    names has ord, id, number, bases and exact. Modes: config (an override; the id SECTION is no book), exact (the whole
    title), ordinal (a numbered name with its ordinal somewhere before it), name (one without a number, and no ordinal before
    it), first of its series (the first of numbered names, without any ordinal), empty, unknown. Of several names that
    with its ordinal is first, then one without a number; then the longer; then the first in order.
    Titles meet names by the runs of words that they have, never pair by pair.
    """
    rows = titles.select(key, plain(F.col(title)).alias("_t"))
    # Each title once, however many rows have it and whatever their keys are.
    t = rows.where("_t <> ''").select("_t").distinct()
    bases = names.select("ord", "id", "number", F.explode("bases").alias("base")).where(F.length("base") >= 3)
    longest = bases.agg(F.max(F.size(F.split("base", " ")))).first()[0] or 1
    whole = names.select(F.explode("exact").alias("_t"), "ord", F.col("id").alias("_exact")).groupBy("_t").agg(F.min_by("_exact", "ord").alias("_exact"))
    size = F.size("_w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda n: F.struct(i.alias("at"), F.array_join(F.slice("_w", i, n), " ").alias("base")))))
    found = t.withColumn("_w", F.split("_t", " ")).select("_t", "_w", F.inline(runs)).join(bases, "base")
    # The first place of a name counts.
    first = F.row_number().over(Window.partitionBy("_t", "id", "base").orderBy("at"))
    found = found.withColumn("_n", first).where("_n = 1")
    before = F.slice("_w", 1, F.col("at") - 1)
    said = F.array_compact(F.array(*[F.when(F.arrays_overlap(before, F.array(*map(F.lit, forms))), n) for n, forms in ordinals.items()]))
    found = found.withColumn("_said", said)
    rank = (
        F.when(F.col("number").isNull(), F.when(F.size("_said") == 0, 2))
        .when(F.array_contains("_said", F.col("number")), 3)
        .when((F.size("_said") == 0) & (F.col("number") == 1), 1)
    )
    best = Window.partitionBy("_t").orderBy(F.col("_rank").desc(), F.length("base").desc(), "ord")
    within = found.withColumn("_rank", rank).where("_rank IS NOT NULL").withColumn("_n", F.row_number().over(best)).where("_n = 1").select("_t", F.col("id").alias("_within"), "_rank")
    out = rows.join(t.join(whole, "_t", "left").join(within, "_t", "left"), "_t", "left")
    forced = F.lit(None).cast("string")
    if overrides:
        forced = F.element_at(F.create_map(*[x for k, v in overrides.items() for x in (plain(F.lit(k)), F.lit(v))]), F.col("_t"))
    mode = (
        F.when(F.col("_t") == "", "empty")
        .when(forced == SECTION, SECTION)
        .when(forced.isNotNull(), "config")
        .when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_rank") == 3, "ordinal")
        .when(F.col("_rank") == 2, "name")
        .when(F.col("_rank") == 1, "first of its series")
        .otherwise("unknown")
    )
    book = F.when(F.col("_t") == "", None).when(forced == SECTION, None).otherwise(F.coalesce(forced, "_exact", "_within"))
    return out.select(key, book.alias("book"), mode.alias("mode"))
