"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of each text.

Texts and items are lower-cased (A-Z) and reduced to words with single spaces between and around them. Each window of
consecutive item words is a pattern of the automaton, with its own bounding spaces, so that a match is always of whole
words. Ends of matches are mapped to word numbers, and those to offsets in the text as it was.

The automaton takes memory by the characters of its patterns, about 50 bytes for each. Items go to the executors in parts
of at most max_chars of those; a worker holds the automaton of one part at a time, and a benchmark of several parts is scanned once
for each, its hits brought together by document.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_worker, text_slices, written

WINDOW = 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
MOST_CHARS = 8_000_000
SLICE_CHARS = 4_000_000
SPAN = "struct<item_id:string,start:int,end:int,first:int,last:int>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def patterns(items: list[tuple[str, str | None]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Each pattern with its number of words and the ids of the items that have it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = [w.decode() for w in normal_words(text)]
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            found.setdefault(f" {' '.join(words[i : i + k])} ", (k, set()))[1].add(item)
    return {p: (k, sorted(ids)) for p, (k, ids) in found.items()}


def automaton(found: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, v in found.items():
        a.add_word(p, v)
    a.make_automaton()
    return a


def hits(text: str | None, scan) -> tuple[int, int, list[tuple[int, int, list[str]]]]:
    """Words, hit words, and the matches as (first word, end word, items)."""
    words = normal_words(text)
    if not words or scan is None:
        return len(words), 0, []
    line = f" {b' '.join(words).decode()} "
    ends = list(scan.iter(line))
    if not ends:
        return len(words), 0, []
    out, seen, at = [], 0, 0
    for end, (k, items) in sorted(ends, key=lambda x: x[0]):
        seen += line.count(" ", at, end)  # spaces before the closing one: the words that end there
        at = end
        out.append((seen - k, seen, items))
    covered, n = 0, 0
    for a, b, _ in sorted(out, key=lambda x: x[:2]):
        n += max(0, b - max(a, covered))
        covered = max(covered, b)
    return len(words), n, out


def spans(text: str, found: list[tuple[int, int, list[str]]]) -> list[dict]:
    """Matches of an item that overlap become one span: code points of the text as it was, and its words [first, last)."""
    places = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    by_item: dict[str, list[list[int]]] = defaultdict(list)
    for a, b, items in sorted(found, key=lambda x: x[:2]):
        for item in items:
            own = by_item[item]
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
    made = [{"item_id": i, "start": places[a][0], "end": places[b - 1][1], "first": a, "last": b} for i, own in by_item.items() for a, b in own]
    return sorted(made, key=lambda s: (s["start"], s["end"], s["item_id"]))


def runs_of(text: str, window: int, most: int):
    """(run, characters of its patterns) for runs of words of a text, which have the same windows together and at most so many characters each."""
    words = [w.decode() for w in normal_words(text)]
    k = min(window, len(words))
    size = [0]
    for w in words:
        size.append(size[-1] + len(w) + 1)
    at, total = 0, 0
    for i in range(len(words) - k + 1 if k else 0):
        own = size[i + k] - size[i] + 1
        if total and total + own > most:
            yield " ".join(words[at : i + k - 1]), total
            at, total = i, 0
        total += own
    if total:
        yield " ".join(words[at:]), total


def parts(benchmark: DataFrame, item: str, text: str, max_chars: int, window: int = WINDOW):
    """The items in lists of runs with patterns of max_chars characters at most, one after another."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    part, size = [], 0
    for r in rows.toLocalIterator():
        for run, n in runs_of(r.t, window, max_chars):
            if part and size + n > max_chars:
                yield part
                part, size = [], 0
            part.append((r.i, run))
            size += n
    if part:
        yield part


def _scanner(docs: DataFrame, items: list[tuple[str, str]], window: int):
    """A function for tasks: the automaton of the items, made once in each worker, in place of one made before."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    mark = hashlib.md5(repr((items, window)).encode()).hexdigest()

    def scan():
        held = in_worker("decontamination", dict, large=True)
        if mark not in held:
            held.clear()
            found = patterns(sent.value, window)
            held[mark] = automaton(found) if found else None
        return held[mark]

    return scan


def _scan(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    scanner = _scanner(docs, items, window)
    keep = [c for c in docs.columns if c != "text"]
    kind = pa.list_(pa.struct([("item_id", pa.string()), *[(n, pa.int32()) for n in ("start", "end", "first", "last")]]))

    def run(batches):
        scan = scanner()
        for batch in batches:
            for at, to, texts in text_slices(batch.column("text"), SLICE_CHARS):
                n, hit, found, where = [], [], [], []
                for text in texts:
                    words, k, own = hits(text, scan)
                    n.append(words)
                    hit.append(k)
                    found.append(sorted({i for _, _, items in own for i in items}))
                    where.append(spans(text, own) if own else [])
                made = [batch.column(c).slice(at, to - at) for c in keep] + [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(where, kind)]
                yield pa.RecordBatch.from_arrays(made, names=[*keep, "n_words", "n_hit", "items", "spans"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "n_words bigint, n_hit bigint, items array<string>", f"spans array<{SPAN}>"])
    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_chars: int = MOST_CHARS) -> DataFrame:
    """One row for each row of docs: its key, n_words, n_hit, items (sorted strings), spans (item_id, start, end, first word, word after the last).

    A null or empty text has no words and no hits. Items with a null id or without words have no windows; rows that
    repeat an item_id count as one item. Repeated rows of docs each give a row. A benchmark whose patterns have more than
    max_chars characters is scanned in parts; n_hit is then counted from the union of the spans of all parts.
    """
    slim = docs.select(F.col(f"`{doc}`").alias("key"), F.col(f"`{text}`").alias("text"))
    own = parts(benchmark, item, item_text, max_chars, window)
    first, second = next(own, []), next(own, None)
    found = _scan(slim, first, window)
    if second is not None:
        # Each row gets a number of its own by which its parts meet again; it is written first, so that it stays.
        slim = written(slim.withColumn("row", F.monotonically_increasing_id()), "decontamination")
        found = None
        for part in chain([first, second], own):
            hit = _scan(slim, part, window)
            hit = written(hit if found is None else hit.where("n_hit > 0"), "decontamination-part")
            found = hit if found is None else found.unionByName(hit)
        found = found.groupBy("row").agg(F.first("key").alias("key"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), united(F.flatten(F.collect_list("spans"))).alias("spans"))
        found = found.select("key", "n_words", hit_words("spans").alias("n_hit"), "items", "spans")
    return found.withColumnRenamed("key", doc)


def united(found: Column) -> Column:
    """Spans in order, those of one item that overlap or touch made one."""
    by_item = F.array_sort(F.transform(found, lambda s: F.struct(s["item_id"].alias("item_id"), s["first"].alias("first"), s["last"].alias("last"), s["start"].alias("start"), s["end"].alias("end"))))

    def put(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        more = F.struct(s["item_id"].alias("item_id"), last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joins = (F.size(out) > 0) & (last["item_id"] == s["item_id"]) & (s["first"] <= last["last"])
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(more))).otherwise(F.concat(out, F.array(s)))

    empty = F.array().cast("array<struct<item_id:string,first:int,last:int,start:int,end:int>>")
    in_order = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["item_id"].alias("item_id"), s["first"].alias("first"), s["last"].alias("last"))
    whole = F.array_sort(F.transform(F.aggregate(by_item, empty, put), in_order))
    return F.transform(whole, lambda s: F.struct(s["item_id"].alias("item_id"), s["start"].alias("start"), s["end"].alias("end"), s["first"].alias("first"), s["last"].alias("last")))


def hit_words(found: str) -> Column:
    """The number of words inside any span."""
    cover = F.array_sort(F.transform(found, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    put = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["last"]).alias("upto"))
    return F.aggregate(cover, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), put, lambda a: a["n"].cast("long"))


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs, benchmark)
    ids = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    said = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["item_id"], s["start"].cast("string"), s["end"].cast("string"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), said.alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MOST_CHARS) -> DataFrame:
    """The rows of docs that have no window of the benchmark, with their columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    for number, part in enumerate(parts(benchmark, "item_id", "text", max_chars, window)):
        # One automaton at a time: what a part leaves is written before the next.
        rows = (written(rows, "decontamination-clean") if number else rows).where(_clean(docs, part, window)("text"))
    return rows.select("row.*")


def _clean(docs: DataFrame, items: list[tuple[str, str]], window: int):
    scanner = _scanner(docs, items, window)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        scan = scanner()
        return texts.map(lambda t: hits(t, scan)[1] == 0)

    return clean
