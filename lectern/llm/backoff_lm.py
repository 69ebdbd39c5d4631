"""LM scoring by a weighted backoff automaton, whose size follows the corpus.

Smoothed n-grams become states with arcs and a failure arc. With c the counts of the training texts and M a fixed mass,

    P(w | h) = (c(h w) + M P(w | h')) / (c(h) + M),   h' = h without its first word,

down to single words: c(w) / (N + V + 1) for a known word, (V + 1) / (N + V + 1) for the unknown one, with N training
tokens of V kinds. This is a hierarchical Dirichlet prior; it sums to one at every state. An arc h -> w that was seen
weighs P(w | h); any other word takes the failure arc to h' with the weight M / (c(h) + M) and is looked for there.

The model is never in one place. Documents are packed into parts of bounded size, kept as word numbers with the part's own
vocabulary. Each part sends its own distinct n-grams (hashes of KEY_BITS bits) with its training counts, cut by hash into
ranges; each range is summed over all parts in one task and answered to each part, in the order in which the part sent
them. From the answers a part has the arcs and failure arcs that its own texts can reach, and traverses them from left to
right, all of its texts side by side. Ranges are equal shares of the hashes, so that no frequent word or context makes one
of them larger. Parts and ranges meet in as many rows as their product, so both sizes grow as the root of the corpus: at
10^14 characters a part has 10^8 of them and a range about 10^8 n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, MULTIPLY, byte_slices, mixed, span_hashes, utf8_of, words_of, written

ORDER = 3
MASS = 40.0
FOLD, HELD = 7, 2
PART_CHARS, RANGE_CHARS = 16_000_000, 16_000_000
SLICE_BYTES = 2_000_000
# Of 10^13 kinds of n-grams one in 2,000 would share its hash.
KEY_BITS = 54
START, END = np.uint64(0x1AE16A3B2F9040), np.uint64(0x23A5C85C97CB31)
SHIFT = np.uint64(64 - KEY_BITS)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts with END after each text, and where each text begins."""
    data, at = utf8_of(texts)
    first, last, n = words_of(data, at)
    upto = np.cumsum(n)
    return np.insert(span_hashes(data, first, last, FOLDED) >> SHIFT, upto, END), upto - n + np.arange(len(n))


def grams(tokens: np.ndarray, begins: np.ndarray, order: int):
    """For each length up to order the places where an n-gram of it ends, and its hashes. Before a text stands START."""
    n = len(tokens)
    since = np.arange(n, dtype=np.int32) - np.repeat(begins.astype(np.int32), np.diff(np.r_[begins, n]))  # place in the own text
    key = mixed(tokens + np.uint64(1))
    yield slice(None), key >> SHIFT
    for k in range(2, order + 1):
        # The n-gram of k words: that of k - 1 words, and the word k - 1 places before, or START.
        key *= MULTIPLY
        key[k - 1 :] += tokens[: max(0, n - k + 1)]
        early = np.flatnonzero(since < k - 1)
        key[early] -= np.where(early >= k - 1, tokens[np.maximum(early - k + 1, 0)], np.uint64(0)) - START
        key += np.uint64(k)
        key = mixed(key)
        places = slice(None) if k == 2 else np.flatnonzero(since >= k - 2)
        yield places, key[places] >> SHIFT


# Arrays to bytes


def planes(x: np.ndarray) -> bytes:
    """An array packed byte by byte, so that like bytes stand together."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), asbytes=True)


def from_planes(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def keys_packed(keys: np.ndarray) -> bytes:
    """Keys, sorted but for few places, by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def keys_freed(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8", n), dtype=np.uint64)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where in a sorted array each distinct value begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def cuts_of(keys: np.ndarray, cuts: int) -> np.ndarray:
    """Where sorted keys go from one range to the next."""
    bounds = np.array([i * (1 << KEY_BITS) // cuts for i in range(1, cuts)], np.uint64)
    return np.r_[0, np.searchsorted(keys, bounds), len(keys)]


def rows_of(batch: pa.RecordBatch):
    """The rows one by one: of large values no more than one row's are copied."""
    for i in range(batch.num_rows):
        yield {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}


# Parts

PARTS = pa.schema([("part", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("trained", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("docs", pa.binary())])
PARTS_SQL = "part bigint, n_tokens bigint, n_words bigint, trained bigint, words binary, ids binary, docs binary"


def parts_of(docs: DataFrame, part_chars: int) -> DataFrame:
    """A row for each part: its distinct words by falling frequency (hashes), its tokens as their numbers, its documents."""
    rows = docs.select("doc", "text", "train")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def closed():
            tokens = np.concatenate([t for t, _, _ in held])
            words, ids, seen = np.unique(tokens, return_inverse=True, return_counts=True)
            del tokens
            order = np.argsort(-seen, kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            docs = pa.concat_tables([d for _, _, d in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs)
            row = {"part": part, "n_tokens": len(ids), "n_words": len(words), "trained": sum(n for _, n, _ in held), "words": keys_packed(words[order]), "ids": planes(number[ids]), "docs": sink.getvalue().to_pybytes()}
            return pa.RecordBatch.from_pylist([row], PARTS)

        for batch in batches:
            for at, to in byte_slices(batch.column(1), SLICE_BYTES):
                tokens, begins = token_hashes(batch.column(1).slice(at, to - at))
                n, taught = np.diff(np.r_[begins, len(tokens)]), batch.column(2).slice(at, to - at)
                held.append((tokens, int(n[taught.to_numpy(zero_copy_only=False).astype(bool)].sum()), pa.table({"doc": batch.column(0).slice(at, to - at), "train": taught, "n": pa.array(n, pa.int64())})))
                size += batch.column(1).slice(at, to - at).nbytes
                if size >= part_chars:
                    yield closed()
                    held, size, part = [], 0, part + 1
        if held:
            yield closed()

    return written(rows.mapInArrow(run, PARTS_SQL), "lm-parts")


def opened(r: dict) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The documents of a part, their tokens, and where each begins."""
    docs = pa.ipc.open_stream(r["docs"]).read_all()
    n = docs.column("n").to_numpy()
    return docs, keys_freed(r["words"], r["n_words"])[from_planes(r["ids"], "<u4", r["n_tokens"])], np.cumsum(n) - n


GRAMS = pa.schema([("part", pa.int64()), ("size", pa.int32()), ("cut", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("part", pa.int64()), ("size", pa.int32()), ("cut", pa.int32()), ("n", pa.int64()), ("kinds", pa.int64()), ("counts", pa.binary())])


def asked(parts: DataFrame, order: int, cuts: int) -> DataFrame:
    """Of each part, n-gram length and range the sorted keys and how often each is in the part's training texts."""

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                docs, tokens, begins = opened(r)
                train = np.repeat(docs.column("train").to_numpy().astype(np.uint8), docs.column("n").to_numpy())
                for k, (places, keys) in enumerate(grams(tokens, begins, order)):
                    # The training flag is the last bit of what is sorted.
                    keys <<= np.uint64(1)
                    keys |= train[places]
                    keys.sort()
                    first = starts_of(keys >> np.uint64(1))
                    counts = np.add.reduceat(keys & np.uint64(1), first).astype("<u4") if len(first) else np.zeros(0, "<u4")
                    ordered = keys[first] >> np.uint64(1)
                    del keys, first
                    at = cuts_of(ordered, cuts)
                    yield pa.RecordBatch.from_pylist([{"part": r["part"], "size": k + 1, "cut": int(c), "n": int(at[c + 1] - at[c]), "keys": keys_packed(ordered[at[c] : at[c + 1]]), "counts": planes(counts[at[c] : at[c + 1]])} for c in np.flatnonzero(np.diff(at))], GRAMS)

    return parts.mapInArrow(run, "part bigint, size int, cut int, n bigint, keys binary, counts binary")


def answered(grams_: DataFrame, cuts: int, order: int) -> DataFrame:
    """For each row of asked() the counts in all other parts; kinds is how many of the range's keys were trained, on one row of each range."""
    rows = grams_.repartition(cuts * order, "size", "cut").sortWithinPartitions("size", "cut", "part")

    def run(batches):
        held, of = [], None

        def answers():
            every = np.concatenate([k for _, k, _ in held])
            counts = np.concatenate([c for _, _, c in held])
            place = np.argsort(every)
            first = starts_of(every[place])
            totals = np.add.reduceat(counts[place], first)
            counts[place] = np.repeat(totals, np.diff(np.r_[first, len(every)])) - counts[place]
            at = 0
            for i, (part, keys, _) in enumerate(held):
                own = counts[at : at + len(keys)]
                at += len(keys)
                yield pa.RecordBatch.from_pylist([{"part": part, "size": of[0], "cut": of[1], "n": len(own), "kinds": 0 if i else int((totals > 0).sum()), "counts": planes(own.astype("<u8"))}], ANSWERS)

        for batch in batches:
            for r in rows_of(batch):
                if held and (r["size"], r["cut"]) != of:
                    yield from answers()
                    held = []
                of = (r["size"], r["cut"])
                held.append((r["part"], keys_freed(r["keys"], r["n"]), from_planes(r["counts"], "<u4", r["n"]).astype(np.int64)))
        if held:
            yield from answers()

    return written(rows.mapInArrow(run, "part bigint, size int, cut int, n bigint, kinds bigint, counts binary"), "lm-answers")


# The automaton of a part


class Automaton:
    """Arcs and failure arcs that the texts of a part can reach, laid out by the places of their words.

    counts: of the k-gram that ends at a place, how often it was trained. An arc of weight log10 P leads to each trained
    k-gram from its beginning; the failure arc of a state weighs log10 (M / (c + M)). n_texts counts the state START.
    """

    def __init__(self, counts: list[np.ndarray], begins: np.ndarray, n_texts: int, n_tokens: int, n_kinds: int, mass: float):
        self.counts, self.begins, self.n_texts, self.n_tokens, self.n_kinds, self.mass = counts, begins, n_texts, n_tokens, n_kinds, mass
        self.opens = np.zeros(len(counts[0]), bool)
        self.opens[begins] = True

    def behind(self, k: int) -> np.ndarray:
        """The count of the state of k words one place before each place; before the first word that is START."""
        out = np.empty_like(self.counts[k - 1])
        out[1:] = self.counts[k - 1][:-1]
        out[self.opens] = self.n_texts
        return out

    def scores(self) -> np.ndarray:
        """The log10 probability of each text.

        The beginning of a trained n-gram is trained as well, so that the state behind a place is the longest trained
        n-gram that ends there, of order - 1 words at most. Carried on by one place, it is where the next word is looked
        for: it takes its arc there, or failure arcs until a state has one.
        """
        order, n, all_ = len(self.counts), len(self.opens), self.n_tokens + self.n_kinds + 1
        level = np.zeros(n, np.int8)
        for k in range(1, order + 1):
            level[self.counts[k - 1] > 0] = k
        state = np.zeros(n, np.int8)
        state[1:] = np.minimum(level[:-1], order - 1)
        state[self.opens] = min(1, order - 1)
        p = np.where(level > 0, self.counts[0], self.n_kinds + 1) / all_
        gained = np.where(level <= 1, np.log10(p), 0.0)
        for k in range(2, order + 1):
            behind = self.behind(k - 1)
            p *= self.mass
            p += self.counts[k - 1]
            p /= behind + self.mass
            took = np.flatnonzero(level == k)
            gained[took] += np.log10(p[took])
            failed = np.flatnonzero((state >= k - 1) & (level < k))
            gained[failed] += np.log10(self.mass / (behind[failed] + self.mass))
        return np.add.reduceat(gained, self.begins) if len(self.begins) else gained


SCORES = pa.schema([("doc", pa.string()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scored(parts: DataFrame, answers: DataFrame, order: int, n_texts: int, n_tokens: int, n_kinds: int, mass: float) -> DataFrame:
    rows = parts.unionByName(answers, allowMissingColumns=True)
    # The answers of a part come in order, and then the part.
    rows = rows.repartition("part").sortWithinPartitions("part", F.col("size").asc_nulls_last(), "cut")

    kind = np.int32 if n_tokens < 1 << 31 else np.int64

    def run(batches):
        counts: list[list] = [[] for _ in range(order)]

        def of_part(r):
            docs, tokens, begins = opened(r)
            by_place = []
            train = np.repeat(docs.column("train").to_numpy().astype(np.uint8), docs.column("n").to_numpy())
            for (places, keys), told in zip(grams(tokens, begins, order), counts):
                place = np.argsort(keys)
                first = starts_of(keys[place])
                total = np.concatenate([from_planes(c, "<u8", n).astype(kind) for c, n in told]) if told else np.zeros(0, kind)
                if len(first) != len(total):
                    raise ValueError("the answers aren't those of this part")
                of = place if isinstance(places, slice) else places[place]
                if len(first):
                    total += np.add.reduceat(train[of], first, dtype=kind)
                first = np.diff(np.r_[first, len(keys)])
                del keys, place
                own = np.zeros(len(tokens), kind)
                own[of] = np.repeat(total, first)
                by_place.append(own)
                del of, first, total, own, places
            del tokens, train
            c = by_place[0]
            sums = lambda x: np.add.reduceat(x, begins) if len(begins) else x[:0]
            base_score = sums(np.log10((c + 1.0) / (n_tokens + n_kinds + 1)))
            made = Automaton(by_place, begins, n_texts, n_tokens, n_kinds, mass).scores()
            doc, train, n = (docs.column(x).combine_chunks() for x in ("doc", "train", "n"))
            return pa.RecordBatch.from_arrays([doc.cast(pa.string()), train, n, pa.array(sums((c > 0).astype(np.int64))), pa.array(base_score), pa.array(made)], schema=SCORES)

        for batch in batches:
            for r in rows_of(batch):
                if r["docs"] is None:
                    counts[r["size"] - 1].append((r["counts"], r["n"]))
                else:
                    yield of_part(r)
                    counts = [[] for _ in range(order)]

    return rows.mapInArrow(run, "doc string, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def score(docs: DataFrame, train, doc: str = "doc_id", text: str = "text", order: int = ORDER, mass: float = MASS, part_chars: int | None = None) -> DataFrame:
    """(doc, train, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, learning from the rows where train holds.

    A null or empty text has the end token alone. Repeated rows each count and each give a row, null ids too. A null
    train is false. Without training rows every token is the unknown one, of probability one. No rows give no rows.
    """
    own = docs.select(F.col(f"`{doc}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total, n_texts = own.agg(F.sum(F.octet_length("text").cast("long")), F.count_if("train")).first()
    root = (total or 0) ** 0.5
    cuts = max(1, -(-(total or 0) // int(max(RANGE_CHARS, 40 * root))))
    parts = parts_of(own, part_chars or max(PART_CHARS, int(10 * root)))
    n_tokens = parts.agg(F.sum("trained")).first()[0] or 0
    answers = answered(asked(parts, order, cuts), cuts, order)
    n_kinds = answers.where("size = 1").agg(F.sum("kinds")).first()[0] or 0
    out = scored(parts, answers, order, n_texts, n_tokens, n_kinds, mass)
    kind = docs.schema[doc].dataType
    return out.select(F.col("doc").cast(kind).alias(doc), "train", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_scores(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLD == HELD
    return score(docs, ~held).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
