"""Column functions for text: cleaning, units, tokens, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that take no room.
INVISIBLE = "­​‌‍⁠﻿"
# Where a sentence ends, with the closing marks that may follow.
SENTENCE_END = r"[.!?…][\"'»”’)\]]*$"
WEAK_END = r"[;:][\"'»”’)\]]*$"
LABEL = r"\d{1,3}[a-z]{0,2}(?:[-–]\d{1,3}[a-z]{0,2})?"
ACCENTED, PLAIN = "áéíóúüñàèìòùâêîôûäëïöçãõ", "aeiouunaeiouaeiouaeiocao"


def without_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


# Marks that stand close to the word before them, and to the word after them.
AFTER_WORD, BEFORE_WORD = ",.;:!?…»”’)]", "«“‘([¿¡"


def _any_of(marks: str) -> str:
    return "[" + "".join(f"\\x{{{ord(m):x}}}" for m in marks) + "]"


def clean(text: Column, remove: str = "") -> Column:
    """Single spaces, none between a mark and the word that it stands close to."""
    kept = F.translate(text, remove, "") if remove else text
    line = F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))
    # After single spaces one look on each side of a space is enough.
    loose = f"\\s(?={_any_of(AFTER_WORD)})|(?<={_any_of(BEFORE_WORD)})\\s"
    return F.regexp_replace(line, loose, "")


def sentences(text: Column) -> Column:
    """The parts between sentence ends and the white space after them."""
    return F.filter(F.split(text, r"(?<=[.!?…»”])\s+"), lambda u: u != "")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and marks, without accents of the Latin alphabets in ACCENTED."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"(?U)[\w&&[^_]]+"), F.lit(0))


def label(text: Column) -> Column:
    """A verse label without spaces and with a plain hyphen, or null."""
    bare = F.translate(F.regexp_replace(text, r"(?U)\s+", ""), "–", "-")
    return F.when(bare.rlike(f"^{LABEL}$"), bare)


def covered(of_label: Column, span: int = 10) -> Column:
    """The numbers that a label stands for: 24-25 for both, the first alone where the span is too wide."""
    first = F.try_to_number(F.regexp_extract(of_label, r"^(\d{1,3})", 1), F.lit("999")).cast("int")
    last = F.when(of_label.rlike(r"-\d"), F.try_to_number(F.regexp_extract(of_label, r"-(\d{1,3})", 1), F.lit("999")).cast("int"))
    wide = last.isNotNull() & (last > first) & (last - first <= span)
    return F.when(first.isNotNull(), F.when(wide, F.sequence(first, last)).otherwise(F.array(first)))
