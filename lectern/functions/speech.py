"""Column functions around what is read aloud: announcements, ranges, previews, clocks, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spanish import cardinal

def number_word(n: Column) -> Column:
    """A number from 0 to 999,999 in words; greater and negative ones in digits."""
    listed = lambda numbers: F.array(*[F.lit(cardinal(i)) for i in numbers])
    small, hundreds = listed(range(100)), F.array(F.lit(""), F.lit("ciento"), *[F.lit(cardinal(100 * i)) for i in range(2, 10)])
    n = n.cast("long")

    def to_999(x: Column) -> Column:
        rest = (x % 100).cast("int")
        over = F.concat_ws(" ", F.get(hundreds, F.floor(x / 100).cast("int")), F.when(rest > 0, F.get(small, rest)))
        return F.when(x < 100, F.get(small, x.cast("int"))).when(x == 100, F.lit(cardinal(100))).otherwise(over)

    thousands, rest = F.floor(n / 1000), n % 1000
    # Before thousands the last one is short.
    short = F.regexp_replace(F.regexp_replace(to_999(thousands), "veintiuno$", "veintiún"), r"\buno$", "un")
    over = F.concat_ws(" ", F.when(thousands == 1, F.lit("mil")).otherwise(F.concat(short, F.lit(" mil"))), F.when(rest > 0, to_999(rest)))
    return F.when((n < 0) | (n >= 1_000_000), n.cast("string")).when(n < 1000, to_999(n)).otherwise(over)


def announcement(book: Column, spoken: Column, chapters: Column, chapter: Column) -> Column:
    """What is read before a chapter: the book and the chapter; psalms by number, no number in a book of one chapter, chapter 0 is the prologue."""
    n = number_word(chapter)
    return (
        F.when(chapter == 0, F.concat(spoken, F.lit(". Prólogo.")))
        .when(book == "sal", F.concat(F.lit("Salmo "), n, F.lit(".")))
        .when(chapters == 1, F.concat(spoken, F.lit(".")))
        .otherwise(F.concat(spoken, F.lit(". Capítulo "), n, F.lit(".")))
    )


def range_numbers(said: Column) -> Column:
    """1,4,7-8 as the sorted distinct numbers; null for what is no range, or none at all."""
    parts = F.filter(F.split(F.replace(said, F.lit(" "), F.lit("")), ","), lambda p: p != "")
    end = lambda p, i: F.element_at(F.split(p, "-"), i).try_cast("int")
    good = lambda p: p.rlike(r"^\d+(-\d+)?$") & (end(p, 1) <= end(p, -1))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(end(p, 1), end(p, -1))))))
    return F.when(F.forall(parts, good) & (F.size(parts) > 0), numbers)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, most: int) -> Column:
    """The text on one line, at most so many characters, with an ellipsis where it goes on."""
    line = one_line(text)
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)


def minutes(seconds: Column) -> Column:
    """mm:ss."""
    n = F.rint(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(n / 60), n % 60)


def verse_range(verses: Column) -> Column:
    """The first and last of the verse labels; the announcement has none."""
    ends = F.concat_ws("–", F.element_at(verses, 1), F.element_at(verses, -1))
    return F.when(F.size(verses) == 0, "announcement").when(F.size(verses) == 1, F.element_at(verses, 1)).otherwise(ends)


def name_hints(text: Column, most: int = 40) -> Column:
    """The distinct words with an initial capital and two small letters more at least, in order, at most so many."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-ZÁÉÍÓÚÑ][a-záéíóúñü]{2,}\b"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)
