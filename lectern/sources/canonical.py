"""Chapters in the canonical text form, one file each, as a table of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABEL = r"\d{1,3}[a-z]{0,2}(?:-\d{1,3}[a-z]{0,2})?"
NONE, LINE, VERSE, PARAGRAPH, SECTION = range(5)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of each line of the files under path, numbered from 1."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def units(lines: DataFrame) -> DataFrame:
    """(path, book, chapter, unit, verse, text, brk, starts, sections) of the lines.

    # book n is the header, ## a heading, % a comment, an empty line a paragraph; a number begins a verse, / a line of
    verse, + a continuation; a line without any of these goes on with the text before.
    """
    said = F.trim("value")
    kind = (
        F.when(said == "", "blank")
        .when(said.startswith("%"), "comment")
        .when(said.startswith("##"), "section")
        .when(said.startswith("#"), "header")
        .when(said.rlike(rf"^{LABEL}(\s|$)"), "verse")
        .when(said.rlike(r"^/(\s|$)"), "line")
        .when(said.rlike(r"^\+(\s|$)"), "on")
        .otherwise("bare")
    )
    rows = lines.withColumns({"kind": kind, "said": said}).where("kind <> 'comment'")
    text = F.when(F.col("kind") == "verse", F.regexp_replace("said", rf"^{LABEL}\s*", "")).when(F.col("kind").isin("line", "on"), F.regexp_replace("said", r"^[/+]\s*", "")).otherwise(F.col("said"))
    line = Window.partitionBy("path").orderBy("line")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    starts_unit = F.col("kind").isin("verse", "line", "on")
    rows = rows.withColumns({"_text": text, "_unit": F.sum(starts_unit.cast("int")).over(upto), "header": F.first(F.when(F.col("kind") == "header", F.col("said")), ignorenulls=True).over(upto)})
    # Blank lines and headings belong to the unit after them.
    rows = rows.withColumn("_of", F.when(F.col("kind").isin("blank", "section"), F.col("_unit") + 1).otherwise(F.col("_unit"))).where("kind <> 'header'")
    strength = F.when(F.col("kind") == "section", SECTION).when(F.col("kind") == "blank", PARAGRAPH).when(F.col("kind") == "verse", VERSE).when(F.col("kind") == "line", LINE).otherwise(NONE)
    ordered = lambda kinds, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("line", c)))), lambda x: x[c])
    made = rows.groupBy("path", "_of").agg(
        F.max("header").alias("header"),
        F.max(strength).alias("brk"),
        F.max(F.when(F.col("kind") == "verse", F.regexp_extract("said", rf"^({LABEL})", 1))).alias("label"),
        F.array_join(ordered(("verse", "line", "on", "bare"), "_text"), " ").alias("text"),
        F.transform(ordered(("section",), "said"), lambda s: F.trim(F.substring(s, 3, 1_000_000))).alias("sections"),
    )
    made = made.where("_of > 0 AND text <> ''")
    line = Window.partitionBy("path").orderBy("_of")
    verse = F.last("label", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(line) == 1
    return made.select(
        "path",
        F.regexp_extract("header", r"^#\s*(.+?)\s+(\d+)\s*$", 1).alias("book"),
        F.try_to_number(F.regexp_extract("header", r"^#\s*(.+?)\s+(\d+)\s*$", 2), F.lit("999999")).cast("int").alias("chapter"),
        (F.row_number().over(line) - 1).alias("unit"),
        verse.alias("verse"),
        "text",
        F.when(first, SECTION).otherwise(F.col("brk")).alias("brk"),
        F.col("label").isNotNull().alias("starts"),
        "sections",
    )


def faults(lines: DataFrame) -> DataFrame:
    """(path, line, fault) of what can't be read: no header or several, text before a verse, a label without text, nothing at all."""
    rows = lines.withColumn("said", F.trim("value")).where(~F.col("said").startswith("%"))
    line = Window.partitionBy("path").orderBy("line")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("said").rlike("^#(?!#)")
    text = (F.col("said") != "") & ~F.col("said").startswith("#")
    verse = F.col("said").rlike(rf"^{LABEL}(\s|$)")
    rows = rows.withColumns({"_h": F.sum(header.cast("int")).over(upto), "_v": F.sum(verse.cast("int")).over(upto), "_hd": header, "_t": text})
    fault = (
        F.when(F.col("_hd") & (F.col("_h") > 1), "a second header")
        .when(F.col("_hd") & ~F.col("said").rlike(r"^#\s*.+\s+\d+$"), "a header without book and number")
        .when(F.col("_t") & (F.col("_h") == 0), "text before the header")
        .when(F.col("_t") & (F.col("_v") == 0), "text before a verse")
        .when(F.col("said").rlike(rf"^{LABEL}$"), "a label without text")
    )
    whole = rows.groupBy("path").agg(F.max("_h").alias("h"), F.max("_v").alias("v"))
    none = whole.where("h = 0 OR v = 0").select("path", F.lit(0).alias("line"), F.when(F.col("h") == 0, "no header").otherwise("no text").alias("fault"))
    return rows.select("path", "line", fault.alias("fault")).where("fault IS NOT NULL").unionByName(none)
