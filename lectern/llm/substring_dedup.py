"""Substring dedup by sliding sentence spans: passages that occurred before are removed, sentence by sentence.

A text is cut into sentences: at line breaks and after closing punctuation. In one of over LONG words the words
themselves add cuts, by their hash, so that a passage has the same cuts in any surroundings and even a text without
punctuation has sentences; LONG is such that of any 50 repeated words a run of WORDS lies between cuts of their own. Runs of
at least `sentences` sentences and `words` words are spans: from each sentence on the shortest, and up to each
sentence the shortest, so that a repeated stretch is covered to both of its ends. In scripts without spaces two
characters count as a word. The hash of a span (96 bits) is that of its words, ASCII letters lower-cased. Spans of equal hash are
joined over all documents, and sentences that any occurrence but the first covers go.

Spans meet their like in one shuffle by hash, in which each later occurrence finds the first one beside it. A hash with a
great share of all spans isn't gathered: such are found on a sample of rows (HEAVY), which bounds their number and decides only
the way, not the result; their first occurrences come from a partial aggregation and go to all tasks, which tell their
own later ones. Within a document later occurrences are known without any join. Spans are made anew in each pass and
never written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLDED, MULTIPLY, SPACE, byte_slices, in_worker, mixed, powers, span_hashes, utf8_of, written

SENTENCES, WORDS, LONG, CUT = 3, 20, 12, 6
# Spans with HEAVY occurrences or more in a sample of about SAMPLE go to all tasks: SAMPLE / HEAVY of them at most.
SAMPLE, HEAVY, CHARS_PER_SPAN = 2_000_000, 20, 20
SLICE_BYTES = 3_000_000
SPAN = "array<struct<start:int,end:int>>"
# Closing punctuation: of ASCII, and of three bytes (…, 。, ！, ？), the last three of which end a word as well.
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
WIDE_STOPS = {(0xE2, 0x80, 0xA6): False, (0xE3, 0x80, 0x82): True, (0xEF, 0xBC, 0x81): True, (0xEF, 0xBC, 0x9F): True}
# What may follow a stop before the space: quotes and brackets, the last two of them of more bytes (» and ” ’).
CLOSING = np.zeros(256, bool)
CLOSING[list(b"\"')]")] = True


class Sentences:
    """The words and sentences of several texts, laid side by side in arrays.

    word: hashes; first, last: the bytes of each word. begin: the first word of each sentence, with the number of words
    at the end; weight: words so far up to each of those. own: the first sentence of each text, with their number at the end.
    """

    def __init__(self, texts):
        data, at = utf8_of(texts)
        self.data, self.at = data, at
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        after = np.zeros(n + 1, bool)  # a stop ends before this byte
        after[1:][STOPS[data]] = True
        broken = np.zeros(n + 1, bool)  # a word ends before this byte, though no space follows
        lead = np.flatnonzero((data[: n - 2] == 0xE2) | (data[: n - 2] == 0xE3) | (data[: n - 2] == 0xEF)) if n > 2 else np.zeros(0, np.int64)
        for (a, b, c), breaks in WIDE_STOPS.items():
            own = lead[(data[lead] == a) & (data[lead + 1] == b) & (data[lead + 2] == c)] + 3
            after[own] = True
            if breaks:
                broken[own] = True
        word = ~SPACE[data]
        start = word & (np.r_[True, ~word[:-1]] | edge[:-1] | broken[:-1]) if n else np.zeros(0, bool)
        end = word & (np.r_[~word[1:], True] | edge[1:] | broken[1:]) if n else np.zeros(0, bool)
        self.first, self.last = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.word = span_hashes(data, self.first, self.last, FOLDED)
        words = len(self.first)
        # Whether a word closes a sentence: by a stop at its end, before quotes and brackets, or by a line break after it.
        to, closes = self.last.copy(), np.zeros(words, bool)
        for _ in range(4):
            closes |= after[to]
            back = to - 1
            two = (back >= 1) & (data[np.maximum(back - 1, 0)] == 0xC2) & (data[np.maximum(back, 0)] == 0xBB) if n else closes
            three = (back >= 2) & (data[np.maximum(back - 2, 0)] == 0xE2) & (data[np.maximum(back - 1, 0)] == 0x80) & np.isin(data[np.maximum(back, 0)], (0x9D, 0x99)) if n else closes
            more = (CLOSING[data[np.maximum(back, 0)]] if n else closes) | two | three
            if not more.any():
                break
            to = np.where(more & (to > self.first + 1), to - np.where(two, 2, np.where(three, 3, 1)), to)
            to = np.maximum(to, self.first)
        lines = np.r_[0, np.cumsum((data == 10) | (data == 13))]
        follow = np.r_[self.first[1:], n] if words else self.first
        text = np.searchsorted(at, self.first, side="right") - 1
        # The last of texts that begin at the same byte is the one with words.
        ends_text = np.r_[text[1:] != text[:-1], True] if words else closes
        closes |= (lines[follow] > lines[self.last]) | ends_text
        begin = np.r_[0, np.flatnonzero(closes) + 1] if words else np.zeros(1, np.int64)
        # Long sentences are cut by the hashes of their words as well.
        long = np.repeat(np.diff(begin) > LONG, np.diff(begin))
        cuts = closes | (long & (mixed(self.word) % np.uint64(CUT) == 0))
        self.begin = np.r_[0, np.flatnonzero(cuts) + 1] if words else begin
        # Two characters of scripts without spaces count as a word.
        wide = np.r_[0, np.cumsum((data >= 0xE3) & (data <= 0xED))]
        weight = np.maximum(1, (wide[self.last] - wide[self.first] + 1) // 2)
        self.weight = np.r_[0, np.cumsum(weight)][self.begin]
        self.text = text[self.begin[:-1]] if words else text
        self.own = np.searchsorted(self.text, np.arange(len(at)))

    def spans(self, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, sentence after the last, key) of the shortest runs from each sentence on and up to each, those that are both once.

        The key has the number of the run's first sentence in its text, or with a last bit of one that after its last.
        """
        n = len(self.text)
        i = np.arange(n)
        low, high = self.own[self.text], self.own[self.text + 1]
        to = np.maximum(i + sentences, np.searchsorted(self.weight, self.weight[:-1] + words, side="left"))
        frm = np.minimum(i + 1 - sentences, np.searchsorted(self.weight, self.weight[1:] - words, side="right") - 1)
        on, upto = to <= high, frm >= low
        upto[upto] = to[frm[upto]] != i[upto] + 1
        a, b = np.r_[i[on], frm[upto]], np.r_[to[on], i[upto] + 1]
        key = np.r_[(i - low)[on] << 1, ((i + 1 - low)[upto] << 1) | 1]
        return a, b, key

    def hashes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hash of the words of each run of sentences."""
        n, out = len(self.word), []
        first, last = self.begin[a], self.begin[b]
        for salt, step in ((1, 0xD1342543DE82EF95), (2, 0xAF251AF3B0F025B5)):
            kept = in_worker(("span-powers", step), dict)
            if len(kept.get("up", ())) < n:
                kept["up"], kept["down"] = powers(step, n + 1), powers(pow(step, -1, 1 << 64), n + 1)
            total = np.r_[np.uint64(0), np.cumsum(mixed(self.word + np.uint64(salt)) * kept["up"][:n], dtype=np.uint64)]
            out.append(mixed((total[last] - total[first]) * kept["down"][first] + (last - first).astype(np.uint64) * MULTIPLY))
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sentences_of(text: str) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, lower-cased words) of each sentence with a word, in code points; the end is where the next one starts."""
    s = Sentences([text])
    n = len(s.text)
    chars = np.r_[0, np.cumsum((s.data & 0xC0) != 0x80)]
    edges = [0, *chars[s.first[s.begin[1:-1]]].tolist(), int(chars[-1])] if n else []
    whole = s.data.tobytes()
    words = [whole[a:b].translate(LOWER) for a, b in zip(s.first.tolist(), s.last.tolist())]
    return [(edges[k], edges[k + 1], words[s.begin[k] : s.begin[k + 1]]) for k in range(n)]


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def spot_of(text: bytes) -> int:
    """The upper half of the spots of a text, as in SQL: shiftleft(crc32(text) - 2^31, 32)."""
    return (zlib.crc32(text) - (1 << 31)) << 32


KINDS = "high bigint, low int, spot bigint"


def _spans(sentences: int, words: int, often=None, only: bool = False, first=None):
    """Rows (doc, text) to a row for each different span of the document: doc, hash, spot; with first, also first_doc and first_spot.

    spot has a crc32 of the text in its upper half, so that different texts of the same doc are told apart, and the key
    of the span in its lower half. often has hashes: only those, or all but those. first has their first occurrences;
    theirs are then in the rows, with a hash by the document instead of the span's, so that they go to no one task.
    """

    def run(batches):
        sorted_often = often.value if often is not None else None
        for batch in batches:
            for at, to in byte_slices(batch.column("text"), SLICE_BYTES):
                s = Sentences(batch.column("text").slice(at, to - at))
                a, b, key = s.spans(sentences, words)
                high, low = s.hashes(a, b)
                text = s.text[a]
                # Of equal spans in one text the leftmost.
                order = np.lexsort((key, a, low, high, text))
                new = np.r_[True, (text[order][1:] != text[order][:-1]) | (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])] if len(order) else np.zeros(0, bool)
                one = order[new]
                high, low, text, key = high[one], low[one], text[one], key[one]
                whole, edges = s.data.tobytes(), s.at.tolist()
                version = np.array([spot_of(whole[edges[i] : edges[i + 1]]) for i in range(to - at)], np.int64)
                spot = version[text] | key
                place = None
                if sorted_often is not None and len(sorted_often):
                    place = np.minimum(np.searchsorted(sorted_often, high), len(sorted_often) - 1)
                    is_often = sorted_often[place] == high
                    if only:
                        high, low, text, spot = (x[is_often] for x in (high, low, text, spot))
                elif only:
                    continue
                made = [batch.column("doc").take(pa.array(text + at, pa.int64())), pa.array(high), pa.array(low), pa.array(spot)]
                names = ["doc", "high", "low", "spot"]
                if first is not None:
                    docs, spots = first.value
                    mine = is_often if place is not None else np.zeros(len(high), bool)
                    row = pa.array(np.where(mine, place if place is not None else 0, 0), pa.int64(), mask=~mine)
                    spread_ = mixed(spot.view(np.uint64)).view(np.int64)
                    made[1] = pa.array(np.where(mine, spread_, high))
                    made += [docs.take(row), pa.array(spots).take(row), pa.array(mine)]
                    names += ["first_doc", "first_spot", "known"]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return run


def later_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, sample: int = SAMPLE, heavy: int = HEAVY) -> DataFrame:
    """(doc, version, places, first_docs) of docs (doc, text): spans that an earlier document has.

    first_docs are the documents with the first occurrence of those spans; version is the crc32 of the text.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc"].dataType.simpleString()
    of = f"doc {kind}, {KINDS}"
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = min(1.0, sample * CHARS_PER_SPAN / max(1, size))
    some = docs.sample(share, seed=7) if share < 1 else docs
    often = some.mapInArrow(_spans(sentences, words), of).groupBy("high").count().where(F.col("count") >= heavy).select("high")
    often = np.sort(np.array([r.high for r in written(often, "sentence-spans-often").toLocalIterator()], np.int64))
    sent = sc.broadcast(often)
    place = lambda d, s: F.struct(F.isnull(d).alias("none"), F.col(d).alias("doc"), F.col(s).alias("spot"))
    rows = docs.mapInArrow(_spans(sentences, words, sent, only=True), of) if len(often) else docs.sparkSession.createDataFrame([], of)
    first = rows.groupBy("high").agg(F.min(place("doc", "spot")).alias("first")).select("high", "first.doc", "first.spot")
    # One row for each of the often ones.
    first = written(first, "sentence-spans-first").orderBy("high").toArrow()
    found = first.column("high").to_numpy()
    known = sc.broadcast(found), sc.broadcast((first.column("doc").combine_chunks(), first.column("spot").to_numpy()))
    rows = docs.mapInArrow(_spans(sentences, words, known[0], first=known[1]), f"{of}, first_doc {kind}, first_spot bigint, known boolean")
    in_order = Window.partitionBy("high", "low").orderBy(F.isnull("doc"), "doc", "spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beside = F.first(place("doc", "spot")).over(in_order)
    rows = rows.select("doc", "spot", "known", place("first_doc", "first_spot").alias("told"), beside.alias("beside"))
    rows = rows.select("doc", "spot", F.when(F.col("known"), F.col("told")).otherwise(F.col("beside")).alias("first"))
    version = lambda spot: F.shiftright(spot, 32)
    later = rows.where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (version(F.col("spot")) == version(F.col("first.spot")))))
    later = later.select("doc", (version(F.col("spot")) + F.lit(1 << 31)).alias("version"), F.col("spot").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"), F.col("first.doc").alias("first"))
    return later.groupBy("doc", "version").agg(F.collect_set("place").alias("places"), F.array_sort(F.collect_set("first")).alias("first_docs"))


def _cuts(sentences: int, words: int):
    """Adds to rows with text and places (later occurrences of spans that began in other documents) what goes and stays."""

    def run(batches):
        for batch in batches:
            keep = [c for c in batch.schema.names if c not in ("text", "places")]
            for at, to in byte_slices(batch.column("text"), SLICE_BYTES):
                s = Sentences(batch.column("text").slice(at, to - at))
                a, b, key = s.spans(sentences, words)
                high, low = s.hashes(a, b)
                text = s.text[a]
                order = np.lexsort((key, a, low, high, text))
                again = np.zeros(len(a), bool)
                if len(order) > 1:
                    again[order[1:]] = (text[order][1:] == text[order][:-1]) & (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
                marked = batch.column("places").slice(at, to - at).combine_chunks() if isinstance(batch.column("places"), pa.ChunkedArray) else batch.column("places").slice(at, to - at)
                size = np.array([len(x) if x is not None else 0 for x in marked.to_pylist()], np.int64)
                told = np.repeat(np.arange(to - at), size) << 32 | marked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                gone = again | np.isin(text << 32 | key, told)
                step = np.zeros(len(s.text) + 1, np.int64)
                np.add.at(step, a[gone], 1)
                np.add.at(step, b[gone], -1)
                cut = np.cumsum(step)[:-1] > 0
                n = np.diff(s.own)
                removed = np.diff(np.r_[0, np.cumsum(cut)][s.own])
                # Sentences go on to where the next one starts; the first begins with its text.
                begins = s.first[s.begin[:-1]] if len(s.text) else s.first
                where, kept, whole = [], [], s.data.tobytes()
                for i in range(to - at):
                    lo, hi = s.at[i], s.at[i + 1]
                    if not removed[i]:
                        where.append([])
                        kept.append(whole[lo:hi].decode())
                        continue
                    own = slice(s.own[i], s.own[i + 1])
                    edge = np.r_[lo, begins[own][1:], hi]
                    flag = np.diff(np.r_[0, cut[own].astype(np.int8), 0])
                    holes = np.stack([edge[np.flatnonzero(flag == 1)], edge[np.flatnonzero(flag == -1)]], axis=1)
                    chars = np.r_[0, np.cumsum((s.data[lo:hi] & 0xC0) != 0x80)]
                    where.append([{"start": int(chars[x - lo]), "end": int(chars[y - lo])} for x, y in holes])
                    edges = [lo, *holes.ravel().tolist(), hi]
                    kept.append(b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2])).decode())
                made = [batch.column(c).slice(at, to - at) for c in keep]
                made += [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(made, names=[*keep, "n_sentences", "n_removed", "removed", "kept_text"])

    return run


def repeated(docs: DataFrame, doc: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """row (struct of the columns), n_sentences, n_removed, removed (spans in code points), first_docs and kept_text of each row.

    The first occurrence of a span is that in the smallest doc, there the leftmost; null docs come last, and texts of
    the same doc are ordered by their crc32. Rows of the same doc and text are one document and get the same result.
    Null and empty texts have no sentences; their kept_text is empty. Texts too short for a span stay whole. An empty
    table gives no rows. Other columns play no part.
    """
    version = F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    slim = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    marks = later_spans(slim, sentences, words).select(F.col("doc").alias("m_doc"), F.col("version").alias("m_version"), "places", "first_docs")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row") if len(docs.columns) > 1 else F.struct(F.lit(None).alias("none")).alias("row"), F.col(f"`{doc}`").alias("doc"), version.alias("version"), F.col(f"`{text}`").alias("text"))
    met = whole.join(marks, F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("version") == F.col("m_version")), "left")
    met = met.select("row", "text", "places", "first_docs")
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    return met.mapInArrow(_cuts(sentences, words), f"row {kinds['row']}, first_docs {kinds['first_docs']}, n_sentences bigint, n_removed bigint, removed {SPAN}, kept_text string")


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """docs with its columns, repeated passages gone from the text. A null text becomes an empty one."""
    found = repeated(docs, doc, text, sentences, words)
    return found.select(*[F.col("kept_text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def op7_repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (start:end, comma-joined), first_docs, kept_chars and kept_crc32 of each document."""
    found = repeated(docs.select("doc_id", "text"))
    where = F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_sentences", "n_removed", where.alias("removed"), F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
        F.length("kept_text").cast("long").alias("kept_chars"), F.crc32(F.col("kept_text").cast("binary")).alias("kept_crc32"),
    )
