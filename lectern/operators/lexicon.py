"""Lexicon: whole words replaced in one pass, longest first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_IPA = 128


def load(spark: SparkSession, path: str) -> DataFrame:
    """(word, rewrite, ipa) of a tab-separated lexicon: # begins comments, - and nothing are null, the last row of a word wins.

    Rows need a rewrite or an IPA form of at most MOST_IPA characters.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("line"))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)"))
    field = lambda i: F.nullif(F.nullif(F.trim(F.try_element_at(F.split("value", "\t"), F.lit(i))), F.lit("")), F.lit("-"))
    rows = rows.select(field(1).alias("word"), field(2).alias("rewrite"), field(3).alias("ipa"), "line")
    rows = rows.where("word IS NOT NULL AND (rewrite IS NOT NULL OR ipa IS NOT NULL)").where(F.coalesce(F.length("ipa"), F.lit(0)) <= MOST_IPA)
    last = F.row_number().over(Window.partitionBy("word").orderBy(F.col("line").desc()))
    return rows.withColumn("_n", last).where("_n = 1").select("word", "rewrite", "ipa")


def as_words(lexicon: DataFrame, column: str = "rewrite", most: int = 10_000) -> dict[str, str]:
    """The lexicon as a dictionary; a lexicon is written by hand, and one of more than `most` words is refused."""
    rows = lexicon.where(F.col(column).isNotNull()).select("word", column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has more than {most} words")
    return {r[0]: r[1] for r in rows}


def pattern(words: dict[str, str]) -> str:
    """Any of the words as a whole word, the longest first."""
    return r"(?U)(?<!\w)(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?!\w)"


def rewritten(text: Column, words: dict[str, str]) -> Column:
    """Each whole word of the lexicon replaced, in one pass: what was put in isn't looked at again."""
    if not words:
        return text
    between, found = F.split(text, pattern(words), -1), F.regexp_extract_all(text, F.lit(pattern(words)), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    # One more stretch between than found: the last has nothing after it.
    return F.array_join(F.zip_with(between, F.transform(found, lambda w: table[w]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def occurrences(text: Column, words: dict[str, str]) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern(words)), F.lit(0)))
