"""Rules on documents and chapters before anything is read aloud: what is looked at, refused, warned of or noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The longest first verse that is an acclamation, and how many verses 1 make a chapter several.
ACCLAMATION, SEVERAL = 25, 3


def wanted(docs: DataFrame, path: str, allowed: list[str] | None = None, ignore: str = "") -> DataFrame:
    """Documents whose path is among those allowed, if any are named, and doesn't match the pattern of those to ignore."""
    out = docs.where(F.col(path).isin(allowed)) if allowed else docs
    return out.where(~F.coalesce(F.col(path).rlike(ignore), F.lit(False))) if ignore else out


def ignored_title(title: Column, patterns: list[str]) -> Column:
    """Whether a title matches one of the patterns and so closes its book."""
    return F.coalesce(title.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def of_book(chapters: DataFrame, discarded: DataFrame, book: str) -> tuple[DataFrame, DataFrame]:
    """The chapters of one book, and of what was discarded that which names the book first."""
    return chapters.where(F.col("book") == book), discarded.where(F.col("reference").startswith(f"{book} "))


def one_document(docs: DataFrame, index: str, path: str, wanted_: str) -> DataFrame:
    """The document with this number, or the only one whose path has this text; otherwise an error with how many there are."""
    fits = F.col(index) == int(wanted_) if wanted_.isdigit() else F.contains(F.col(path), F.lit(wanted_))
    found = docs.where(fits)
    n = found.count()
    if n != 1:
        raise ValueError(f"{wanted_!r} is {n} documents")
    return found


def short_first(units: DataFrame, keys: list[str], order: list[str], verse: str = "verse", text: str = "text", starts: str = "starts") -> DataFrame:
    """(keys, acclamation, ones): whether a chapter begins with a short line numbered 1 and then verse 1, and how many verses are numbered 1."""
    line = Window.partitionBy(*keys).orderBy(*order)
    rows = units.withColumn("_verse", F.sum(F.col(starts).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.max(F.when((F.col("_verse") == 1) & F.col(starts), F.col(verse))) == "1"
    second = F.max(F.when((F.col("_verse") == 2) & F.col(starts), F.col(verse))) == "1"
    short = F.sum(F.when(F.col("_verse") == 1, F.length(text))) <= ACCLAMATION
    ones = F.count_if(F.col(starts) & (F.col(verse) == "1"))
    return rows.groupBy(*keys).agg(F.coalesce(first & second & short, F.lit(False)).alias("acclamation"), ones.alias("ones"))


def edition_notes(units: DataFrame, keys: list[str], order: list[str], **columns) -> DataFrame:
    """(keys, note): acclamations numbered apart, and verses in brackets without text (units has omitted, an array)."""
    own = short_first(units, keys, order, **columns).where("acclamation AND ones = 2").select(*keys, F.lit("begins with a short line numbered 1").alias("note"))
    absent = units.select(*keys, *order, F.explode("omitted").alias("_o")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_o"))), lambda x: x["_o"]).alias("_all"))
    return own.unionByName(absent.select(*keys, F.concat(F.lit("absent: "), F.array_join("_all", ", ")).alias("note")))


def several_chapters(units: DataFrame, keys: list[str], verse: str = "verse", starts: str = "starts") -> DataFrame:
    """(keys, ones) of chapters with so many verses 1 that they hold several; these are refused."""
    return units.groupBy(*keys).agg(F.count_if(F.col(starts) & (F.col(verse) == "1")).alias("ones")).where(F.col("ones") >= SEVERAL)


def refused(units: DataFrame, keys: list[str], **columns) -> DataFrame:
    """units, with an error as soon as a row of a chapter that holds several is read."""
    bad = several_chapters(units, keys, **columns)
    said = F.concat(F.lit("several chapters in one: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))
    return units.join(bad, keys, "left").where(F.when(F.col("ones").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).select(*units.columns)


def header_faults(files: DataFrame) -> DataFrame:
    """Files (path, book, chapter of the header) whose header isn't that of their place .../book/chapter.txt."""
    place = lambda i: F.regexp_extract("path", r"([^/]+)/(\d+)\.txt$", i)
    return files.where((place(1) != F.col("book")) | (place(2) != F.col("chapter").cast("string")))


def available(paths: DataFrame) -> DataFrame:
    """(book, chapter) of extracted chapter files by their paths; names that are no numbers don't count."""
    place = lambda i: F.regexp_extract("path", r"([^/]+)/(\d+)\.txt$", i)
    return paths.where(place(2) != "").select(place(1).alias("book"), place(2).cast("int").alias("chapter")).distinct()


def outside(chapters: DataFrame, expected: DataFrame, most: int = 10) -> DataFrame:
    """(book, expected, beyond): chapter numbers greater than the book has, the first ones."""
    found = chapters.select("book", "chapter").distinct().join(expected, "book").where(F.col("chapter") > F.col("expected"))
    return found.groupBy("book", "expected").agg(F.slice(F.array_sort(F.collect_set("chapter")), 1, most).alias("beyond"))


def assumed_first(chapters: DataFrame, expected: DataFrame) -> DataFrame:
    """(book): chapter 1 has no mark of its own though the book has more than one."""
    return chapters.where("chapter = 1 AND NOT marked").join(expected.where("expected > 1"), "book").select("book").distinct()


def book_totals(units: DataFrame, books: DataFrame) -> DataFrame:
    """(ord, book, found, expected, verses, characters) of units (book, chapter, verse, text) by the dimension of books (ord, id, chapters).

    found are the chapters from 1 on that have text, verses the distinct labels in all chapters. A book that the dimension
    doesn't have has no ord, and stands last, and expects no chapters.
    """
    totals = units.groupBy("book").agg(
        F.count_distinct(F.when(F.col("chapter") >= 1, F.col("chapter"))).alias("found"),
        F.count_distinct("chapter", "verse").alias("verses"),
        F.sum(F.length("text").cast("long")).alias("characters"),
    )
    known = books.select("ord", F.col("id").alias("book"), F.col("chapters").alias("expected"))
    return totals.join(known, "book", "left").select("ord", "book", "found", F.coalesce("expected", F.lit(0)).alias("expected"), "verses", "characters").orderBy(F.col("ord").asc_nulls_last(), "book")


def has_prologue(chapters: DataFrame) -> DataFrame:
    """(book, prologue, chapters): whether there is a chapter 0, and how many others."""
    return chapters.groupBy("book").agg(F.bool_or(F.col("chapter") == 0).alias("prologue"), F.countDistinct(F.when(F.col("chapter") > 0, F.col("chapter"))).alias("chapters"))


def concentrated(marks: DataFrame, keys: list[str], doc: str, percent: int = 20) -> DataFrame:
    """(keys, doc, n): documents that hold at least so many percent of the most marks in one document."""
    counts = marks.groupBy(*keys, doc).agg(F.count("*").alias("n"))
    most = counts.groupBy(*keys).agg(F.max("n").alias("_most"))
    return counts.join(most, keys).where(100 * F.col("n") >= percent * F.col("_most")).select(*keys, doc, "n")


def examples(rows: DataFrame, keys: list[str], order: list[str], value: str, most: int = 6) -> DataFrame:
    """(keys, n, examples): the first few values of each group in order, however many it has."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("_n", place).where(F.col("_n") <= most)
    listed = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias("examples"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(listed, keys)


def run_totals(chapters: DataFrame) -> DataFrame:
    """One row: chapters, chunks flagged, seconds and cost of a run."""
    return chapters.agg(F.count("*").alias("chapters"), F.sum("flagged").alias("flagged"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.sum("usd"), 6).alias("usd"))
