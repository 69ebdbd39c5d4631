"""Events to chapters: the state machine of an assembler as windows over ordered events.

Its state at an event is what came before in the same book: running counts give the book, the chapter mark and the
text run that an event belongs to, and the last values before give the open verse. A book title resets everything, so
that books are independent groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean

NONE, LINE, VERSE, PARAGRAPH, SECTION = range(5)


def with_content(events: DataFrame, doc: list[str]) -> DataFrame:
    """Documents without a book, chapter or verse event go."""
    marks = F.max(F.col("kind").isin("book", "chapter", "verse").cast("int")).over(Window.partitionBy(*doc))
    return events.withColumn("_m", marks).where("_m = 1").drop("_m")


def ignored_characters(events: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, characters) of documents that with_content() leaves out."""
    has = F.max(F.col("kind").isin("book", "chapter", "verse").cast("int"))
    return events.groupBy(*doc).agg(has.alias("_m"), F.sum(F.when(F.col("kind") == "text", F.length("value")).otherwise(0)).alias("characters")).where("_m = 0").drop("_m")


def placed(events: DataFrame, work: list[str], order: list[str]) -> DataFrame:
    """Adds book_no, book, chapter_no and chapter to each event: the title and the mark that it stands under."""
    line = Window.partitionBy(*work).orderBy(*order)
    rows = events.withColumn("book_no", F.sum((F.col("kind") == "book").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy(*work, "book_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(
        {
            "book": F.first(F.when(F.col("kind") == "book", F.col("value")), ignorenulls=True).over(line),
            "chapter_no": F.sum((F.col("kind") == "chapter").cast("int")).over(line),
            "chapter": F.last(F.when(F.col("kind") == "chapter", F.col("value").cast("int")), ignorenulls=True).over(line),
        }
    )


def orphan_marks(rows: DataFrame, work: list[str]) -> DataFrame:
    """(work, marks): chapter marks before any book title."""
    return rows.where((F.col("kind") == "chapter") & (F.col("book_no") == 0)).groupBy(*work).agg(F.count("*").alias("marks"))


def _strength(kind: Column) -> Column:
    return F.when(kind == "section", SECTION).when(kind == "paragraph", PARAGRAPH).when(kind == "verse", VERSE).when(kind == "line", LINE).otherwise(NONE)


def _parts(rows: DataFrame, work: list[str], order: list[str], doc: list[str]) -> DataFrame:
    """(work, book_no, chapter_no, _part, real, book, chapter, origin, strength, label, text, section, absent): what stands between two breaks; real if it has text."""
    group = [*work, "book_no", "chapter_no"]
    line = Window.partitionBy(*group).orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    # Before any mark of a chapter a verse 1 opens the first; what stands before that belongs to none, but for its headings.
    opens = F.max(F.when((F.col("kind") == "verse") & (F.col("value") == "1"), 1)).over(upto).isNotNull()
    rows = rows.where("book_no > 0 AND kind <> 'book'").withColumn("_open", (F.col("chapter_no") > 0) | opens | (F.col("kind") == "section")).where("_open").drop("_open")
    text = F.col("kind").isin("text", "space")
    breaks = F.col("kind").isin("chapter", "verse", "line", "paragraph", "section", "omitted")
    new_doc = F.coalesce(F.struct(*doc) != F.lag(F.struct(*doc)).over(line), F.lit(False))
    # Breaks without text between them count once: a run of text begins with the first text after a break.
    rows = rows.withColumns({"_text": text, "_break": breaks | new_doc})
    rows = rows.withColumn("_part", F.sum(F.col("_break").cast("int")).over(upto))
    return rows.groupBy(*group, "_part").agg(
        F.max((F.col("kind") == "text").cast("int")).alias("real"),
        F.first("book").alias("book"),
        F.first("chapter").alias("chapter"),
        F.min(F.struct(*doc)).alias("origin"),
        F.max(_strength(F.col("kind"))).alias("strength"),
        F.max(F.when(F.col("kind") == "verse", F.col("value"))).alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_text"), F.struct(*order, "value")))), lambda x: x["value"]), "").alias("text"),
        F.max(F.when(F.col("kind") == "section", F.col("value"))).alias("section"),
        F.max(F.when(F.col("kind") == "omitted", F.col("value"))).alias("absent"),
    )


def empty_verses(rows: DataFrame, work: list[str], order: list[str], doc: list[str]) -> DataFrame:
    """(work, book, chapter, verse) of verse numbers without text before the next number or the end of the chapter."""
    group = [*work, "book_no", "chapter_no"]
    line = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    own = _parts(rows, work, order, doc).withColumn("_verse", F.count("label").over(line)).where("_verse > 0")
    verses = own.groupBy(*group, "_verse").agg(F.first("book").alias("book"), F.coalesce(F.first("chapter"), F.lit(1)).alias("chapter"), F.max("label").alias("verse"), F.max("real").alias("_real"))
    return verses.where("_real = 0").select(*work, "book", "chapter", "verse")


def units(rows: DataFrame, work: list[str], order: list[str], doc: list[str]) -> DataFrame:
    """(work, book_no, book, chapter_no, chapter, unit, verse, text, brk, starts, implicit, sections, omitted, marked, origin)

    A unit is the text between two events that break it: a verse, a line, a paragraph, a heading, or the end of a
    document. Its break is the strongest of the events before it; the first of a chapter has the break of a heading.
    Text before any verse number is verse 1, or 0 where the chapter has a verse 1 of its own; then it is implicit.
    Headings and absent verses before a unit are listed with it; headings after the last text of a chapter go to the next
    one of the book that has text. origin is the document that the chapter begins in.
    """
    group = [*work, "book_no", "chapter_no"]
    parts = _parts(rows, work, order, doc)
    line = Window.partitionBy(*group).orderBy("_part")
    in_book = Window.partitionBy(*work, "book_no").orderBy("chapter_no", "_part")
    before = lambda over: F.coalesce(F.sum("real").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The number of parts with text so far: events of a part without any belong to the next one that has.
    parts = parts.withColumns({"unit": before(line), "_turn": before(in_book)})
    open_verse = F.last("label", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("open", open_verse)
    ordered = lambda c, *by: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*by, c)))), lambda x: x[c])
    heads = parts.groupBy(*work, "book_no", "_turn").agg(ordered("section", "chapter_no", "_part").alias("sections"))
    made = parts.groupBy(*group, "unit").agg(
        F.max("real").alias("real"),
        F.max("_turn").alias("_turn"),
        F.first("book").alias("book"),
        F.first("chapter").alias("chapter"),
        F.min("origin").alias("origin"),
        F.max("strength").alias("strength"),
        F.max_by("open", "_part").alias("verse"),
        F.max(F.col("label").isNotNull().cast("int")).alias("starts"),
        F.max(F.when(F.col("real") == 1, F.col("text"))).alias("text"),
        ordered("absent", "_part").alias("omitted"),
    )
    made = made.where("real = 1").join(heads, [*work, "book_no", "_turn"], "left").withColumn("text", clean(F.col("text")))
    whole = Window.partitionBy(*group)
    has_one = F.max((F.col("verse") == "1").cast("int")).over(whole)
    first = F.row_number().over(whole.orderBy("unit")) == 1
    implicit = F.col("verse").isNull()
    label = F.when(~implicit, F.col("verse")).when(F.coalesce(has_one, F.lit(0)) == 1, "0").otherwise("1")
    return made.select(
        *group,
        "book",
        F.coalesce("chapter", F.lit(1)).alias("chapter"),
        "unit",
        label.alias("verse"),
        "text",
        F.when(first, SECTION).otherwise(F.col("strength")).alias("brk"),
        ((F.col("starts") == 1) | (implicit & first)).alias("starts"),
        implicit.alias("implicit"),
        F.coalesce("sections", F.array().cast("array<string>")).alias("sections"),
        "omitted",
        (F.col("chapter_no") > 0).alias("marked"),
        F.to_json(F.min("origin").over(whole)).alias("origin"),
    )


def valid_pieces(made: DataFrame, work: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pieces with at least one verse number of their own, and the others with the reason why they go."""
    group = [*work, "book_no", "chapter_no"]
    numbered = F.sum((F.col("starts") & ~F.col("implicit")).cast("int")).over(Window.partitionBy(*group))
    rows = made.withColumn("numbered", numbered)
    gone = rows.where("numbered = 0").groupBy(*group, "book", "chapter").agg(F.sum(F.length("text")).alias("characters")).withColumn("reason", F.lit("no numbered verse"))
    return rows.where("numbered > 0"), gone


# What titles a prologue, and how many verses of how many characters it has.
PROLOGUE = "(?i)pr[óo]logo|prefacio|proemio"
PROLOGUE_VERSES, PROLOGUE_CHARS = 10, 300


def resolved(pieces: DataFrame, work: list[str]) -> tuple[DataFrame, DataFrame]:
    """Several pieces of one chapter: those that belong together, and a report of the others.

    (units with piece order, report of (work, book, chapter, chapter_no, fate, labels)). Fates: merged; prologue (a piece
    titled so, without a mark, with a numbering of its own before a marked chapter 1 that begins with verse 1: it becomes
    chapter 0); noise (without a mark, few numbered verses, where a marked piece is there), repeated (no new label), lost
    (its labels overlap too much, or a single verse from another document). The most solid piece is the nucleus; the
    others are taken in reading order. Only labels go to the grouped function, and a group is one chapter.
    """
    import pandas as pd

    key = [*work, "book", "chapter"]
    numbered = F.col("starts") & ~F.col("implicit")
    meta = pieces.groupBy(*key, "book_no", "chapter_no", "marked").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(numbered, F.struct("unit", "verse")))), lambda x: x["verse"])).alias("labels"),
        F.count_if(numbered).alias("numbered"),
        F.sum(F.length("text")).alias("characters"),
        F.min("origin").alias("origin"),
        F.max(F.exists("sections", lambda t: t.rlike(PROLOGUE))).alias("titled"),
    )

    def fates(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["book_no", "chapter_no"], kind="stable").reset_index(drop=True)
        labels, fate = [set(x) for x in own["labels"]], ["" for _ in range(len(own))]
        mark = own["marked"].to_numpy().argmax() if own["marked"].any() else 0
        if own["chapter"].iloc[0] == 1 and mark and "1" in labels[mark]:
            for i in range(mark):
                solid = len(labels[i]) >= PROLOGUE_VERSES and "1" in labels[i] and own["characters"][i] <= PROLOGUE_CHARS * max(1, own["numbered"][i])
                fate[i] = "prologue" if solid and own["titled"][i] else ""
        for i in range(len(own)):
            if not fate[i] and own["marked"].any() and not own["marked"][i] and own["numbered"][i] < 3:
                fate[i] = "noise"
        left = [i for i in range(len(own)) if not fate[i]]
        nucleus = max(left, key=lambda i: (own["marked"][i], len(labels[i]), -own["characters"][i] / max(1, len(labels[i]))))
        seen, origins = set(labels[nucleus]), {own["origin"][nucleus]}
        fate[nucleus] = "merged"
        for i in left:
            if i == nucleus:
                continue
            new, common = labels[i] - seen, labels[i] & seen
            near = own["origin"][i] in origins or own["numbered"][i] >= 2
            if not new:
                fate[i] = "repeated"
            elif near and (not common or (len(common) <= max(1, len(labels[i]) // 10) and len(new) > len(common))):
                fate[i] = "merged"
                seen |= labels[i]
                origins.add(own["origin"][i])
            else:
                fate[i] = "lost"
        return own.assign(fate=fate)[[*key, "book_no", "chapter_no", "fate", "labels"]]

    kinds = ", ".join(f"`{k}` {meta.schema[k].dataType.simpleString()}" for k in [*key, "book_no", "chapter_no"])
    decided = meta.groupBy(*key).applyInPandas(fates, f"{kinds}, fate string, labels array<string>")
    report = decided.where("fate NOT IN ('merged', 'prologue')").drop("book_no")
    kept = pieces.join(decided.where("fate IN ('merged', 'prologue')").select(*key, "book_no", "chapter_no", "fate"), [*key, "book_no", "chapter_no"])
    kept = kept.withColumn("chapter", F.when(F.col("fate") == "prologue", 0).otherwise(F.col("chapter")))
    place = Window.partitionBy(*key).orderBy("book_no", "chapter_no", "unit")
    first_of_piece = F.row_number().over(Window.partitionBy(*key, "book_no", "chapter_no").orderBy("unit")) == 1
    later = F.row_number().over(place) > 1
    carried = F.last(F.when(~F.col("implicit"), F.col("verse")), ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))
    # A later piece begins a paragraph; its text without a number goes on with the verse before.
    rows = kept.withColumns({"_first": first_of_piece, "_later": later, "_carried": carried, "place": F.row_number().over(place) - 1})
    on = F.col("implicit") & F.col("_later") & F.col("_carried").isNotNull()
    return rows.select(
        *key,
        F.col("place").alias("unit"),
        F.when(on, F.col("_carried")).otherwise(F.col("verse")).alias("verse"),
        "text",
        F.when(F.col("_first") & F.col("_later"), PARAGRAPH).otherwise(F.col("brk")).alias("brk"),
        (F.col("starts") & ~on).alias("starts"),
        "implicit",
        "sections",
        "omitted",
    ), report


def chapter_text(chapter_units: DataFrame, key: list[str], book: str = "book", chapter: str = "chapter") -> DataFrame:
    """(key, text): each chapter in the canonical text form: # header, ## headings, % notes, numbered verses, / lines, + continuations."""
    blank = F.when((F.col("unit") > 0) & (F.col("brk") >= PARAGRAPH) & (F.size("sections") == 0), "\n").otherwise("")
    heads = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("\n## "), s, F.lit("\n"))), "")
    notes = F.array_join(F.transform("omitted", lambda o: F.concat(F.lit("% omitted "), o, F.lit("\n"))), "")
    mark = F.when(F.col("starts"), F.concat("verse", F.lit(" "))).when(F.col("brk") == LINE, "/ ").otherwise("+ ")
    said = F.concat(heads, notes, blank, mark, "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", said.alias("said")))), lambda x: x["said"]), "\n")
    return chapter_units.groupBy(*key).agg(F.concat(F.lit("# "), F.first(book), F.lit(" "), F.first(chapter).cast("string"), F.lit("\n"), body, F.lit("\n")).alias("text"))
