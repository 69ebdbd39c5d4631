"""What a run leaves behind: chapter indexes and verification reports as JSON, cached work by content, reports of an extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TITLES, DISCARDED = 60, 40


def cached(new: DataFrame, path: str, key: str = "key") -> DataFrame:
    """Appends the rows whose key isn't at the path yet to it, in folders by the first two digits of the key and by run; returns those rows.

    A key is written once; of several rows with it the least as JSON. The path may not exist yet.
    """
    spark, run = new.sparkSession, uuid.uuid4().hex
    line = Window.partitionBy(key).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in new.columns])))
    rows = new.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n").withColumns({"run": F.lit(run), "shard": F.substring(key, 1, 2)})
    try:
        old = spark.read.schema(rows.schema).parquet(path).select(key)
        old.isEmpty()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], f"{key} string")
    rows.join(old, key, "left_anti").write.mode("append").partitionBy("shard", "run").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).where(F.col("run") == run).select(*new.columns)


def chapter_index(verses: DataFrame, keys: list[str], sections: DataFrame, seconds: DataFrame) -> DataFrame:
    """(keys, json): the index of each chapter: its length, the second of each verse in order, the second of each heading.

    verses has (keys, position, verse, start), sections (keys, position, title, start), seconds (keys, seconds).
    """
    listed = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(name).alias("name"), "start"))), lambda x: F.struct(x["name"].alias("name"), F.round(x["start"], 3).alias("start"))).alias(f"_{name}"))
    rows = seconds.join(listed(verses, "verse"), keys, "left").join(listed(sections, "title"), keys, "left")
    none = F.array().cast("array<struct<name:string,start:double>>")
    said = F.to_json(F.struct(*keys, F.round("seconds", 3).alias("seconds"), F.coalesce("_verse", none).alias("verses"), F.coalesce("_title", none).alias("sections")))
    return rows.select(*keys, said.alias("json"))


def write_json(rows: DataFrame, path: str, folders: list[str]) -> None:
    """Rows with json as text files in folders by some of their columns; none are written if there are none."""
    if not rows.isEmpty():
        rows.select(*folders, F.col("json").alias("value")).write.mode("append").partitionBy(*folders).text(path)


def verification_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json) of the chunks of each chapter that were verified, in order; chapters without any have no row."""
    values = [c for c in results.columns if c not in keys]
    chunks = F.array_sort(F.collect_list(F.struct("chunk", *[c for c in values if c != "chunk"])))
    return results.groupBy(*keys).agg(F.to_json(chunks).alias("json"))


def report(totals: DataFrame, titles: DataFrame, discarded: DataFrame, warnings: DataFrame, notes: DataFrame) -> DataFrame:
    """(part, place, line) of an extraction: totals by book, doubtful titles and discarded pieces (the first ones), warnings, notes."""
    cut = lambda df, name, most: df.select(F.lit(name).alias("part"), F.col("place").cast("long"), "line").orderBy("place").limit(most) if most else df.select(F.lit(name).alias("part"), F.col("place").cast("long"), "line")
    parts = [cut(totals, "totals", 0), cut(titles, "titles", TITLES), cut(discarded, "discarded", DISCARDED), cut(warnings, "warnings", 0), cut(notes, "notes", 0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
