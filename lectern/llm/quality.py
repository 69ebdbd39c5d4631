"""Quality rules: tokeniser fertility against bands for each language or script, after a few base counts.

Every word of a text is encoded by a public vocabulary, as the word is at the start of a line. Three measures of the
text follow: code points of words for each token, the share of byte-fallback tokens, and the entropy of its tokens,
held against what clean text of as many tokens has. Text in a language that the vocabulary covers lies in a narrow band of
each; text in capitals, symbol noise, wrong encodings and lists of repeated words do not. A text out of one of its bands is rejected.

Words are encoded once in each task and looked up thereafter; the table of known words is bounded. All counting is in
arrays over slices of several documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, text_slices

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
KNOWN_WORDS = 400_000
SLICE_CHARS = 2_000_000

# Bands. Fixed values, set once on the labelled documents of a small sample; they don't follow the corpus that is filtered.
# typical: characters per token of clean text; below typical - CHARS_SLACK - CHARS_SPREAD / sqrt(tokens), or above most, goes.
# bytes: the most byte-fallback tokens as a share of all.
# curve: entropy of n tokens of clean text in bits, c0 + c1 log2 n + c2 log2 n squared; below it by more than
# ENTROPY_SLACK + ENTROPY_SPREAD / sqrt(n) goes. Scripts have no curve but a least entropy as a share of log2 n.
LANGUAGES = {
    "en": {"typical": 2.217, "most": 6.5, "bytes": 0.02, "curve": (0.863, 1.0116, -0.0422)},
    "de": {"typical": 2.240, "most": 6.5, "bytes": 0.02, "curve": (1.416, 0.8921, -0.0375)},
    "fr": {"typical": 1.978, "most": 6.5, "bytes": 0.02, "curve": (1.983, 0.7735, -0.0320)},
    "es": {"typical": 1.940, "most": 6.5, "bytes": 0.02, "curve": (1.337, 0.9072, -0.0378)},
}
SCRIPTS = {
    "latin": {"least": 1.4, "most": 7.0, "bytes": 0.10, "share": 0.40},
    "cyrillic": {"least": 1.2, "most": 6.0, "bytes": 0.10, "share": 0.40},
    "greek": {"least": 0.8, "most": 5.0, "bytes": 0.30, "share": 0.35},
    "cjk": {"least": 0.3, "most": 3.0, "bytes": 0.70, "share": 0.35},
    "other": {"least": 0.2, "most": 6.0, "bytes": 0.98, "share": 0.25},
}
CHARS_SLACK, CHARS_SPREAD = 0.10, 3.5
ENTROPY_SLACK, ENTROPY_SPREAD = 0.24, 1.0
MOST_LOG = 16.0  # curves are level beyond 2 ** 16 tokens
FEW_TOKENS = 40  # entropy says little below

MEASURES = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("entropy", pa.float64()), ("script", pa.string())])


class Words(dict):
    """Word to number; new words are noted for encoding. With the number of tokens, of byte tokens, and the tokens of each."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.new = SentencePieceProcessor(model_file=model), []
        n = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.flat, self.start, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n_byte = np.zeros(0, np.int64)

    def __missing__(self, word):
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.new:
            coded = self.model.encode([w.decode() for w in self.new], num_threads=1)
            n = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((t for c in coded for t in c), np.int32, n.sum())
            start = np.cumsum(n) - n
            byte = np.r_[0, np.cumsum(self.is_byte[flat])]
            self.start, self.n = np.r_[self.start, start + len(self.flat)], np.r_[self.n, n]
            self.n_byte = np.r_[self.n_byte, byte[start + n] - byte[start]]
            self.flat, self.new = np.r_[self.flat, flat], []
        return got

    def trimmed(self) -> None:
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.flat, self.start, self.n, self.n_byte = self.flat[:0], self.start[:0], self.n[:0], self.n_byte[:0]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - first, n)


def totals(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over stretches that end at ends."""
    upto = np.r_[0, np.cumsum(values)]
    return upto[ends] - upto[np.r_[0, ends[:-1]]] if len(ends) else upto[:0]


def repeated(ids: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text the number of words that lie in a window of words found twice or more in it."""
    n = np.diff(np.r_[0, ends])
    doc = np.repeat(np.arange(len(ends)), n)
    last = ends[doc] - window
    start = np.flatnonzero(np.arange(len(ids)) <= last)
    if not len(start):
        return np.zeros(len(ends), np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    key = doc[start].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    for j in range(window):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + mixed[start + j]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(ends), np.int64)
    at = np.searchsorted(twice, key)
    start = start[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == key)]
    # The words themselves decide.
    rows = np.c_[doc[start], ids[start[:, None] + np.arange(window)]]
    order = np.lexsort(rows.T[::-1])
    same = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    real = np.zeros(len(start), bool)
    real[order[1:][same]] = real[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, start[real], 1)
    np.add.at(step, start[real] + window, -1)
    return totals(np.cumsum(step)[:-1] > 0, ends)


def entropies(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Entropy of the tokens of each text in bits."""
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = np.sort(doc << np.uint64(32) | tokens.astype(np.uint64))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    of = (key[new] >> np.uint64(32)).astype(np.int64)
    plogp = np.bincount(of, count * np.log2(np.maximum(count, 1)), len(n))
    some = np.maximum(n, 1)
    return np.where(n > 0, np.log2(some) - plogp / some, 0.0)


def script(text: str) -> str:
    """The script of most letters."""
    coded = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    high = coded[coded >= 0x80]
    latin = np.isin(coded, LATIN).sum() + ((high >= 0xC0) & (high < 0x250)).sum()
    found = {"latin": latin, "greek": ((high >= 0x370) & (high < 0x400)).sum(), "cyrillic": ((high >= 0x400) & (high < 0x530)).sum(), "cjk": ((high >= 0x3040) & (high < 0xA000)).sum() + ((high >= 0xAC00) & (high < 0xD7B0)).sum()}
    found["other"] = max(0, (high >= 0x250).sum() - found["greek"] - found["cyrillic"] - found["cjk"])
    best = max(found, key=found.get)
    return best if found[best] else "other"


LATIN = np.array([*range(65, 91), *range(97, 123)], np.uint32)


def measured(texts: list[str], words: Words) -> list[np.ndarray | list]:
    split = [t.encode().split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(texts))
    ends = np.cumsum(n_words)
    ids = words.numbers([w for own in split for w in own])
    chars = np.array([len(t) - sum(t.count(c) for c in SPACES) for t in texts], np.int64)
    symbols = np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64)
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        dup.append(len(lines) - len(set(lines)))
    n = words.n[ids]
    n_tokens = totals(n, ends)
    tokens = words.flat[spread(words.start[ids], n)]
    return [n_words, chars, symbols, np.array(dup, np.int64), repeated(ids, ends), n_tokens, totals(words.n_byte[ids], ends), entropies(tokens, n_tokens), [script(t) for t in texts]]


def measures(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with the counts and measures of each whole text in place of the text; columns of the same names go."""
    keep = [c for c in docs.columns if c != text and c.lower() not in MEASURES.names]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))

    def run(batches):
        words = in_worker(("quality", model), lambda: Words(model), large=True)
        for batch in batches:
            for at, end, texts in text_slices(batch.column(len(keep)), SLICE_CHARS):
                made = measured(texts, words)
                words.trimmed()
                arrays = [batch.column(i).slice(at, end - at) for i in range(len(keep))] + [pa.array(m, f.type) for m, f in zip(made, MEASURES)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *MEASURES.names])

    kinds = {"int64": "bigint", "double": "double", "string": "string"}
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{f.name} {kinds[str(f.type)]}" for f in MEASURES]])
    return slim.mapInArrow(run, schema)


def verdict(found: DataFrame, lang: str | None = "lang", languages: dict = LANGUAGES, scripts: dict = SCRIPTS) -> DataFrame:
    """Adds chars_per_token, byte_share, entropy_least, base_failed, kept.

    A null or unknown language takes the band of the script of most letters. A text without words has failed.
    """
    n = F.greatest("n_tokens", F.lit(1)).cast("double")
    found = found.withColumns({"chars_per_token": F.col("word_chars") / n, "byte_share": F.col("n_bytes") / n})
    name = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")) if lang else F.lit("")
    log = F.least(F.log2(n), F.lit(MOST_LOG))

    def banded(of_language, of_script):
        out = F.lit(None).cast("double")
        for k, v in reversed(scripts.items()):
            out = F.when(F.col("script") == k, of_script(v)).otherwise(out)
        for k, v in reversed(languages.items()):
            out = F.when(name == k, of_language(v)).otherwise(out)
        return out

    least = banded(lambda v: v["typical"] - CHARS_SLACK - CHARS_SPREAD / F.sqrt(n), lambda v: F.lit(v["least"]))
    most = banded(lambda v: F.lit(v["most"]), lambda v: F.lit(v["most"]))
    byte_most = banded(lambda v: F.lit(v["bytes"]), lambda v: F.lit(v["bytes"]))
    entropy_least = banded(lambda v: v["curve"][0] + v["curve"][1] * log + v["curve"][2] * log * log - ENTROPY_SLACK - ENTROPY_SPREAD / F.sqrt(n), lambda v: v["share"] * log)
    found = found.withColumn("entropy_least", F.when(F.col("n_tokens") >= FEW_TOKENS, entropy_least).otherwise(0.0))
    inside = (F.col("chars_per_token") >= least) & (F.col("chars_per_token") <= most) & (F.col("byte_share") <= byte_most) & (F.col("entropy") >= F.col("entropy_least"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(True)))


def op2_quality(docs: DataFrame, model: str) -> DataFrame:
    found = verdict(measures(docs.select("doc_id", "lang", "text"), model))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "entropy_least")


def filtered(docs: DataFrame, model: str) -> DataFrame:
    """The rows of docs that are kept, with their columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    return verdict(measures(rows, model, "_text"), "_lang").where("kept").select("row.*")
