"""Spanish words to sounds (IPA), marks for words in r, and their undoing. Regular expressions on columns alone, but for the cut of requests."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouáéíóúü"
# Sounds of letters and pairs of letters, from the first rule on. Capitals stand for sounds until the end.
LETTERS = [
    ("x", "K"), ("ch", "C"), ("ll", "L"), ("rr", "R"), ("qu(?=[eiéí])", "k"), ("gu(?=[eiéí])", "G"),
    ("c(?=[eiéí])", "Z"), ("c", "k"), ("z", "Z"), ("g(?=[eiéí])", "x"), ("g", "G"), ("j", "x"), ("q", "k"),
    ("v", "b"), ("ñ", "ɲ"), (f"y(?=[{VOWELS}])", "L"), ("y", "i"), ("(?:^|(?<=[nlsL]))r", "R"),
]
# Modes for a final r.
MODES = [("", "as it is"), ("suave", "single r in IPA [ɾ]"), ("fuerte", "multiple r in IPA [r]"), ("rr", "written rr")]
# The form of a mark, and of a word that ends in r.
MARK = r"\\\{.*?\\\}"
WORD_IN_R = r"(?<![\w\\])[^\W\d_]*[aeiouáéíóúAEIOUÁÉÍÓÚ][rR](?!\w)"
# Where a request may be cut, the best first.
CUTS = [re.compile(p) for p in (r"[.!?…»”]\s+", r"[;:]\s+", r",\s+", r"\s+")]


def sounds(word: Column, seseo: bool = True, final: str = "suave") -> Column:
    """The sounds of a word with the stress right before its vowel; a word of one syllable has none. Null for what isn't letters alone, or has no vowel.

    Of neighbouring vowels the strong ones (a, e, o) and í, ú each make a syllable; the others are glides j, w, except the last
    where there is no strong one. Without an accent words in a vowel, n or s are stressed on the last but one.
    """
    lower = F.lower(word)
    s = lower
    for pattern, sound in LETTERS:
        s = F.regexp_replace(s, pattern, sound)
    if final == "fuerte":
        s = F.regexp_replace(s, "r$", "R")
    s = F.regexp_replace(s, "h", "")
    s = F.regexp_replace(F.regexp_replace(s, f"i(?=[{VOWELS}])", "J"), f"[uü](?=[{VOWELS}JW])", "W")
    s = F.regexp_replace(F.regexp_replace(s, "([aeoáéóíú][JW]*)i", "$1J"), "([aeoáéóíú][JW]*)[uü]", "$1W")

    def said(s: Column) -> Column:
        syllables = F.length(F.regexp_replace(s, f"[^{VOWELS}]", ""))
        stressed = (
            F.when(syllables < 2, s)
            .when(s.rlike("[áéíóú]"), F.regexp_replace(s, "^([^áéíóú]*)", "$1ˈ"))
            .when(lower.rlike("[aeiouns]$"), F.regexp_replace(s, f"([{VOWELS}][^{VOWELS}]*[{VOWELS}][^{VOWELS}]*)$", "ˈ$1"))
            .otherwise(F.regexp_replace(s, f"([{VOWELS}][^{VOWELS}]*)$", "ˈ$1"))
        )
        out = F.translate(stressed, "áéíóúürRJWGZL", "aeiouuɾrjwɡ" + ("s" if seseo else "θ") + "ʝ")
        out = F.regexp_replace(F.regexp_replace(out, "C", "tʃ"), "K", "ks")
        return F.when(word.rlike(r"^\p{L}+$") & (syllables > 0), out)

    # The steps so far are made once, whatever branch is taken: a variable of a function over an array of one.
    return F.get(F.transform(F.array(s), said), 0)


def with_final_r(text: Column, mode: str, seseo: bool = True, exclude: tuple[str, ...] = ()) -> Column:
    """Words that end in r marked with their sounds (suave, fuerte), written with rr, or left; never within a mark or of those excluded."""
    if not mode:
        return text
    pattern = f"(?U)(?:{MARK}|{WORD_IN_R})"
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def put(w: Column) -> Column:
        if mode == "rr":
            new = F.concat(w, F.right(w, F.lit(1)))
        else:
            said = sounds(w, seseo, mode)
            new = F.coalesce(F.concat(F.lit('\\{"word": "'), w, F.lit('", "pronounce": "'), said, F.lit('"\\}')), w)
        stays = w.startswith("\\{")
        return F.when(stays | w.isin(*exclude) if exclude else stays, w).otherwise(new)

    # One more stretch between than found: the last has nothing after it.
    return F.array_join(F.zip_with(between, F.transform(found, put), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def without_marks(text: Column) -> Column:
    """The text as it is billed: each mark is its word."""
    return F.regexp_replace(text, r'\\\{"word": "([^"]*)".*?\\\}', "$1")


def variants(phrases: DataFrame, text: str = "text", seseo: bool = True) -> DataFrame:
    """phrases with mode, description and said, a row for each mode."""
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(d).alias("description"), with_final_r(F.col(text), m, seseo).alias("said")) for m, d in MODES])
    return phrases.select("*", F.inline(modes))


def cut_places(text: str) -> list[np.ndarray]:
    """For each kind of cut, the best first, the places after it, in order and none within a mark."""
    marks = np.array([m.span() for m in re.finditer(MARK, text)], np.int64).reshape(-1, 2)
    out = []
    for pattern in CUTS:
        at = np.array([m.end() for m in pattern.finditer(text)], np.int64)
        before = np.searchsorted(marks[:, 0], at) - 1  # the mark that begins last before it
        inside = (before >= 0) & (at < marks[np.maximum(before, 0), 1]) if len(marks) else np.zeros(len(at), bool)
        out.append(at[~inside])
    return out


def request_parts(text: str, limit: int) -> list[str] | None:
    """The text in parts of at most limit characters, halved at the best kind of cut there is in a part, nearest its middle; never within a mark.

    White space at cuts goes. None where a part has no place to be cut. The places are found once; each round halves all
    parts that are still too long.
    """
    kinds, parts, done = cut_places(text), [(0, len(text))], []
    # Where the text goes on after white space, and where what stands before it ends.
    bare = np.flatnonzero(~np.fromiter(map(str.isspace, text), bool, len(text)))
    while parts:
        halved = []
        for begin, end in parts:
            if end - begin <= limit:
                done.append((begin, end))
                continue
            own = bare[np.searchsorted(bare, begin) : np.searchsorted(bare, end)]
            # A cut has something on both sides.
            low, high = (own[0] + 1, own[-1] + 1) if len(own) else (end, begin)
            inside = [k[np.searchsorted(k, low) : np.searchsorted(k, high)] for k in kinds]
            best = next((k for k in inside if len(k)), None)
            if best is None:
                return None
            at = int(best[np.argmin(np.abs(best - begin - (end - begin) // 2))])
            left, right = own[own < at], own[own >= at]
            halved += [(begin, int(left[-1]) + 1), (int(right[0]), end)]
        parts = halved
    return [text[a:b] for a, b in sorted(done)]


REQUESTS = T.StructType([T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("fault", T.StringType())])


def requests(limit: int):
    """A pandas function: (parts, fault) of each text; a text that has a part without a place to cut has no parts but a fault. A null text has neither."""

    @F.pandas_udf(REQUESTS)
    def cut(texts: pd.Series) -> pd.DataFrame:
        parts = [None if t is None else request_parts(t, limit) for t in texts]
        fault = ["there is no place to cut the text outside of marks" if t is not None and p is None else None for t, p in zip(texts, parts)]
        return pd.DataFrame({"parts": pd.Series(parts, dtype=object), "fault": pd.Series(fault, dtype=object)})

    return cut
