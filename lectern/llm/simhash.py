"""SimHash near-duplicates: exact links within a Hamming distance by a Gray-order hierarchical index.

Fingerprints within max_bits of each other agree on at least spare of max_bits + spare blocks of bits, whichever bits
differ. The upper nodes of the index are these masked patterns: a fingerprint stands below one node for each choice of
spare blocks, and two that are to link meet below one of them at least. Nodes are dealt out over the tasks.

Below such a node the fingerprints are sorted by their Gray rank, which brings alike patterns together, and runs of them
become nodes, runs of nodes higher nodes. A node keeps the bits on which all below it agree. A search goes down from the
top: at each node only the bits that it has and its parent has not are compared, the differences are added to those
collected so far, and past max_bits the whole group below goes. Groups that are already in the searcher's own component
go as well, so that dense groups of near copies take little more time than others.

Each node sends on only what joins its components (fewer links than fingerprints), never pairs. The components of all
links are found by alternating stars, with each round in the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLDED, MULTIPLY, byte_slices, mixed, span_hashes, utf8_of, words_of, written

BITS = 64
FAN = 8
SLICE, PAIRS = 1_000_000, 300_000
# With checked links: the least Jaccard similarity, as a fraction.
SIMILAR = (4, 5)
# Shingles that make one in COMMON of all of a table's stand last; that decides only how many candidates there are. First all are counted in so many BUCKETS.
COMMON, BUCKETS = 100_000, 1 << 18
HELD = 2_000_000
PARITIES = 8
SURE, UNSURE = 5.0, 6.5
APART, FEW, SEEN = 45, 32, 1_000_000
#: Rare shingles of which similar sets share so many; sets of one shingle, or of several together, that are compared in one task.
RARE_MORE, HOT = 5, 20_000
SLICE_BYTES = 2_000_000
# As many blocks are spare as make a node of the index hold about NODE fingerprints on average.
NODE = 4096
ODD = [f"q{k}" for k in range(PARITIES)]


# Fingerprints


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of the XXH64 (seed 42) of all word shingles, as a signed 64-bit integer; zero without words."""
    return prints_of(text, shingle, 1)[0]


def prints_of(text: str | None, shingle: int, n: int) -> list[int]:
    """n fingerprints: of the hashes, of the hashes mixed once, and so on."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return [0] * n
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()] if len(words) > shingle else [0]
    ends = ends[shingle - 1 :].tolist() if len(words) > shingle else [len(line)]
    return prints_of_hashes((np.array([h(line[a:b], 42) for a, b in zip(starts[i : i + 65_536], ends[i : i + 65_536])], dtype="<u8") for i in range(0, len(starts), 65_536)), len(starts), n)


def prints_of_hashes(parts, count: int, n: int) -> list[int]:
    """n fingerprints of count hashes, which come in parts."""
    total = np.zeros((n, BITS), dtype=np.int64)
    for part in parts:
        for i in range(0, len(part), 65_536):
            hashes = part[i : i + 65_536]
            for k in range(n):
                total[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                if k + 1 < n:
                    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    hashes ^= hashes >> np.uint64(32)
    bits = (2 * total > count).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("bigint")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.int64))

    return make(text)


def shingle_hashes(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of texts, and how many each text has. Fewer words than a shingle are one; none have none."""
    data, at = utf8_of(texts)
    first, last, n = words_of(data, at)
    words = span_hashes(data, first, last, FOLDED)
    place, end = np.arange(len(words)), np.repeat(np.cumsum(n), n)
    key = words.copy()
    for j in range(1, shingle):
        more = np.flatnonzero(place + j < end)
        key[more] = mixed(key[more] * MULTIPLY + words[more + j])
    whole = (place + shingle <= end) | (place == end - np.repeat(n, n))
    return key[whole], np.where(n, np.maximum(1, n - shingle + 1), 0)


def shingle_sets_of(texts, shingle: int):
    """(id, sorted distinct hashes) of each text. The id is a hash of the set, zero for none."""
    from xxhash import xxh64_intdigest as h

    hashes, n = shingle_hashes(texts, shingle)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        own = np.unique(hashes[a:b])
        yield h(own.tobytes(), 42) if len(own) else 0, own


SKETCH = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("rare", pa.list_(pa.int64())), *[(q, pa.int64()) for q in ODD]])


def sketches(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """doc and key (a hash of the text) of docs, with a sketch of the set of shingles of each whole text.

    id is a hash of the set; fp and other are two fingerprints, n its size. rare are its rare shingles: the first when
    common ones stand last, RARE_MORE more than two similar sets can have outside of what they share. Parities say whether an
    odd number of the hashes have a certain remainder; sets differ in as many shingles as parities at least.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, shingle))
    slim = docs.select("doc", F.xxhash64(f"`{text}`").alias("key"), F.col(f"`{text}`").alias("text"))
    up, down = SIMILAR

    def run(batches):
        keys, counts = common.value
        for batch in batches:
            for at, to in byte_slices(batch.column(2), SLICE_BYTES):
                ids, prints, sizes, rares, odds = [], [], [], [], []
                for own, hashes in shingle_sets_of(batch.column(2).slice(at, to - at), shingle):
                    n = len(hashes)
                    seen = np.zeros(n, np.int64)
                    if len(keys) and n:
                        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                        seen = np.where(keys[place] == hashes, counts[place], 0)
                    ids.append(own)
                    prints.append(prints_of_hashes([hashes], n, 2) if n else [0, 0])
                    sizes.append(n)
                    rares.append(hashes[np.lexsort((hashes, seen))][: n - -(-up * n // down) + RARE_MORE].view(np.int64) if n else [])
                    odds.append(np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1)
                odd = np.packbits(np.array(odds, np.uint8), axis=1, bitorder="little").view("<i8")
                fp = np.array(prints, np.int64)
                made = [np.array(ids, np.uint64).view(np.int64), fp[:, 0], fp[:, 1], np.array(sizes, np.int32), pa.array(rares, pa.list_(pa.int64())), *[odd[:, k] for k in range(PARITIES)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), *map(pa.array, made)], names=["doc", "key", *SKETCH.names])

    kind = slim.schema["doc"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc {kind}, key bigint, id bigint, fp bigint, other bigint, n int, rare array<bigint>, " + ", ".join(f"{q} bigint" for q in ODD))


def set_id(text: Column, shingle: int) -> Column:
    """The id of the set of shingles of a text; see sketches."""

    @F.pandas_udf("bigint")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([i for i, _ in shingle_sets_of(pa.array(texts, pa.string(), from_pandas=True), shingle)], np.uint64).view(np.int64))

    return make(text)


# The index below one upper node, for many upper nodes at once


def differing(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of first[1], and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - first, n)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each component, when the links a-b are added to the components in label."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


class Level:
    """Nodes of one height: the rows [start, end) below each, the bits they agree on, and the children's numbers."""

    def __init__(self, start, end, agreed, pattern, child, children):
        self.start, self.end, self.agreed, self.pattern, self.child, self.children = start, end, agreed, pattern, child, children


def levels(fp: np.ndarray, group_start: np.ndarray, group_n: np.ndarray) -> list[Level]:
    """From the rows, each a node of its own, to one node for each group."""
    rows = np.arange(len(fp))
    out = [Level(rows, rows + 1, np.full(len(fp), ~np.uint64(0)), fp, rows, np.zeros(len(fp), np.int64))]
    first, n = group_start, group_n
    while True:
        below = out[-1]
        number = -(-n // FAN)
        place = spread(np.zeros(len(n), np.int64), number)
        child = np.repeat(first, number) + place * FAN
        last = np.minimum(child + FAN, np.repeat(first + n, number))
        all_, any_ = np.bitwise_and.reduceat(below.pattern & below.agreed, child), np.bitwise_or.reduceat(below.pattern | ~below.agreed, child)
        agreed = ~(all_ ^ any_)
        out.append(Level(below.start[child], below.end[last - 1], agreed, all_ & agreed, child, last - child))
        if (number == 1).all():
            return out
        first, n = np.cumsum(number) - number, number


def components(fp: np.ndarray, group: np.ndarray, max_bits: int, other: np.ndarray | None = None, max_both: int = 2 * BITS) -> np.ndarray:
    """For rows sorted by group and Gray rank: the least row of the component of each within its group.

    With a second fingerprint in other, links also need at most max_both differing bits in both together.
    """
    n = len(fp)
    label = np.arange(n)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    away = differing(fp[1:] ^ fp[:-1])
    near = (group[1:] == group[:-1]) & (away <= max_bits)
    if other is not None:
        near &= away + differing(other[1:] ^ other[:-1]) <= max_both
    near = np.flatnonzero(near)
    label = joined(label, near, near + 1)
    tree = levels(fp, start, size)
    top = np.repeat(np.arange(len(start)), size)
    done, step = 0, 4096
    while done < n:
        # As many searchers at once as their groups leave room for.
        row = np.arange(done, min(n, done + step))
        least = [np.minimum.reduceat(label, lv.start) for lv in tree]
        most = [np.maximum.reduceat(label, lv.start) for lv in tree]
        node, depth = top[row], len(tree) - 1
        lv = tree[depth]
        gone = differing((fp[row] ^ lv.pattern[node]) & lv.agreed[node])
        while True:
            lv = tree[depth]
            stay = (gone <= max_bits) & (lv.end[node] > row) & ~((least[depth][node] == label[row]) & (most[depth][node] == label[row]))
            row, node, gone = row[stay], node[stay], gone[stay]
            if depth == 0 or not len(row):
                break
            if len(row) * FAN > SLICE and step > 1:
                break
            depth -= 1
            parent, n_children = node, lv.children[node]
            node = spread(lv.child[parent], n_children)
            row, gone, parent = np.repeat(row, n_children), np.repeat(gone, n_children), np.repeat(parent, n_children)
            low = tree[depth]
            gone = gone + differing((fp[row] ^ low.pattern[node]) & low.agreed[node] & ~lv.agreed[parent])
        if depth and len(row):
            # Too many ways at once: fewer searchers, whose links then spare the others theirs.
            step = max(1, step // 8)
            continue
        if other is not None and depth == 0:
            both = gone + differing(other[row] ^ other[node]) <= max_both
            row, node = row[both], node[both]
        label = joined(label, row, node)
        done += step
        step = min(step * 2, 65_536)
    return label


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each pattern in the Gray code."""
    rank = fp.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


def masks(max_bits: int, spare: int) -> list[int]:
    """Signed 64-bit masks: each choice of spare of max_bits + spare blocks."""
    blocks = max_bits + spare
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(own, spare)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in whole]


def spare_for(n: int, max_bits: int) -> int:
    """How many blocks to leave out of max_bits + spare, so that nodes don't grow with the number n of fingerprints: their masks get longer."""
    spare = 1
    while spare < max_bits and n >> round(BITS * spare / (max_bits + spare)) > NODE:
        spare += 1
    return spare


def _links(max_bits: int, table: list[int], max_both: int | None):
    """Rows (node, fp) or (node, fp, other, id), all of a node together, to links (a, b) that join the components below each node."""

    def solve(node: np.ndarray, fp: np.ndarray, other: np.ndarray | None = None, ids: np.ndarray | None = None):
        ids = fp if ids is None else ids
        fp = fp.view(np.uint64)
        mask = np.array(table, np.int64).view(np.uint64)[node]
        upper = fp & mask
        order = np.lexsort((gray_rank(fp), upper, node))
        node, upper, fp = node[order], upper[order], fp[order]
        new = np.r_[True, (node[1:] != node[:-1]) | (upper[1:] != upper[:-1])]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        order, fp, group = order[several], fp[several], group[several]
        if not len(fp):
            return None
        label = components(fp, group, max_bits) if other is None else components(fp, group, max_bits, other.view(np.uint64)[order], max_both)
        linked = np.flatnonzero(label != np.arange(len(label)))
        a, b = ids[order[label[linked]]], ids[order[linked]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        kept = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if kept is not None:
                columns = [np.r_[k, c] for k, c in zip(kept, columns)]
            node, fp = columns[:2]
            if not len(node):
                continue
            # The last node may go on in the next batch.
            mask = np.array(table, np.int64)[node]
            last = (node == node[-1]) & ((fp & mask) == (fp[-1] & mask[-1]))
            cut = len(node) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut >= 50_000:
                made = solve(*[c[:cut] for c in columns])
                if made is not None:
                    yield made
                columns = [c[cut:] for c in columns]
            kept = columns
        if kept is not None:
            made = solve(*kept)
            if made is not None:
                yield made

    return run


def links(distinct: DataFrame, max_bits: int = 4, spare: int = 2, max_both: int | None = None) -> DataFrame:
    """Links (a, b), a < b, between ids of distinct prints that make the same components as all pairs that link.

    distinct has fp, which is the id; with max_both it has fp, other and id.
    """
    table = masks(max_bits, spare)
    own = ["fp"] if max_both is None else ["fp", "other", "id"]
    nodes = F.explode(F.array(*[F.struct(F.lit(i).alias("node"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(table)]))
    rows = distinct.select(*own, nodes.alias("n")).select(F.col("n.node").alias("node"), *own, F.col("fp").bitwiseAND(F.col("n.mask")).alias("upper"))
    rows = rows.repartition("node", "upper").sortWithinPartitions("node", "upper").select("node", *own)
    return rows.mapInArrow(_links(max_bits, table, max_both), "a bigint, b bigint").distinct()


# Candidates by rare shingles


def _counted(docs: DataFrame, text: str, shingle: int, key) -> DataFrame:
    """(k, n): how many shingles of the sets of all texts have each key. key takes an array of hashes to the keys of those that count."""

    def counts(parts):
        k, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at, to in byte_slices(batch.column(0), SLICE_BYTES):
                for _, own in shingle_sets_of(batch.column(0).slice(at, to - at), shingle):
                    held.append(key(own))
                    size += len(held[-1])
                if size > HELD:
                    yield counts(held)
                    held, size = [], 0
        if held:
            yield counts(held)

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def common_shingles(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of shingles that make at least one in COMMON of the shingles of all sets, at most COMMON of them, and in how many texts each is.

    All texts are read, copies as often as they come, and the counts are exact: a bucket of shingles has at least as many as each of
    them, so that only those of buckets with enough are counted one by one.
    """
    mask = np.uint64(BUCKETS - 1)
    buckets = written(_counted(docs, text, shingle, lambda own: own & mask), "simhash-buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // COMMON))
    full = np.zeros(BUCKETS, bool)
    full[[r[0] for r in buckets.where(F.col("n") >= least).select("k").collect()]] = True
    may = docs.sparkSession.sparkContext.broadcast(full)
    rows = _counted(docs, text, shingle, lambda own: own[may.value[own & mask]]).where(F.col("n") >= least).collect()
    keys, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def shared(prints: DataFrame) -> DataFrame:
    """(h, id, n, pos): the rare shingles that several sets of prints have. Of equal sets each task sends one on."""

    def exploded(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = []
            for row, i in enumerate(ids.tolist()):
                if i not in seen:
                    seen.add(i)
                    new.append(row)
            if len(seen) > SEEN:
                seen.clear()
            rare = batch.column(2).take(pa.array(new, pa.int64()))
            size = np.diff(rare.offsets.to_numpy())
            ends = np.cumsum(size)
            pos = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
            yield pa.RecordBatch.from_arrays([rare.flatten(), pa.array(np.repeat(ids[new], size)), pa.array(np.repeat(n[new], size)), pa.array(pos.astype(np.int32))], names=["h", "id", "n", "pos"])

    kinds = "h bigint, id bigint, n int, pos int"
    rows = prints.select("id", "n", "rare").mapInArrow(exploded, kinds)
    return rows.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_several, kinds)


def _several(batches):
    """Of rows sorted by (h, id) those whose h has several ids, each once."""
    kept, with_before = None, False  # the last row, and whether the one before it has its h
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
        h, ids = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]
        rows, h = rows.filter(pa.array(new)), h[new]
        same = h[1:] == h[:-1]
        good = np.r_[with_before, same[:-1]] | same if len(h) > 1 else same
        yield rows.slice(0, len(h) - 1).filter(pa.array(good))
        kept, with_before = rows.slice(len(h) - 1), bool(same[-1]) if len(h) > 1 else with_before
    if kept is not None and with_before:
        yield kept


def may_be_similar(one: list, other: list) -> np.ndarray:
    """Whether sets can be similar, given (n, pos, fp, other, parities) of both: if they share those shingles at pos among the rare ones and none before.

    Fingerprints of similar sets differ in 15 of 100 bits on average, so that those of FEW shingles and more that differ
    in over APART of 128 bits are not of similar ones (one in 10^9 would be). Parities, if given, rule out what differs in
    more of them than in shingles it may, or than UNSURE standard deviations above what the most such shingles give.
    """
    up, down = SIMILAR
    (m, at, x, x2, *odd), (n, pos, y, y2, *even) = one, other
    apart = differing((x ^ y).view(np.uint64)) + differing((x2 ^ y2).view(np.uint64))
    good = ((up + down) * np.minimum(m - at, n - pos) >= up * (m + n)) & ((apart <= APART) | (np.minimum(m, n) < FEW))
    if odd:
        some = np.flatnonzero(good)
        z = sum(differing((a[some] ^ b[some]).view(np.uint64)) for a, b in zip(odd, even))
        s, k = (m + n)[some], 64 * PARITIES
        most = s * (down - up) // (down + up)
        one_, two = (1 - 2 / k) ** most, (1 - 4 / k) ** most
        spread_ = np.sqrt(np.maximum(0.0, k + k * (k - 1) * two - k * k * one_ * one_)) / 2
        good[some] = (z <= most) & (z <= k * (1 - one_) / 2 + UNSURE * spread_ + 1)
    return good


PAIR = "h", "label", "id", "n", "pos", "fp", "other"
BEFORE = [f"before{k}" for k in range(4)]


def earlier(rows: DataFrame) -> DataFrame:
    """Rows (h, id, pos) of shared(), with the least of the hashes of the set's shingles before each, by several hash functions.

    Where two sets have the same least, they share a shingle before this one: it isn't the first that they share. Without
    any before it the id stands there, which no other set has.
    """
    first = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({b: F.coalesce(F.min(F.xxhash64("h", F.lit(k))).over(first), F.col("id")) for k, b in enumerate(BEFORE)})


def stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different labels: of each shingle the set that comes first by a hash with each other one."""

    def run(batches):
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, *values = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[: len(PAIR)])
            first = np.maximum.accumulate(np.where(np.r_[own is None or own[0] != h[0], h[1:] != h[:-1]], np.arange(len(h)), -1))
            # The row that comes first with the same h may be one of the batch before.
            star = [np.where(first < 0, own[k + 1] if own else 0, x[np.maximum(first, 0)]) for k, x in enumerate(values)]
            good = (star[0] != values[0]) & may_be_similar(star[2:], values[2:])
            a, b = star[1][good], values[1][good]
            if first[-1] >= 0:
                own = (h[-1], *(x[first[-1]] for x in values))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    turn = F.xxhash64("h", "id").alias("turn")
    return rows.select(*PAIR, turn).repartition("h").sortWithinPartitions("h", "turn").mapInArrow(run, "a bigint, b bigint").distinct()


def leading(k: int = 1):
    """Whether a shingle is among the first of a set of which similar sets share k."""
    up, down = SIMILAR
    return F.col("pos") < F.col("n") - F.ceil(F.col("n") * up / down) + k


def candidates(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of ids of different labels, among them all whose sets of shingles are similar by SIMILAR.

    rows are those of shared() with labels, fingerprints and parities. Two similar sets have at least SIMILAR of the greater in
    common, so that the first of what they share, in any order that is the same for all, is among the leading of both; and
    behind it enough must follow in both. Of one more rare shingle for each further step they share the second, the third and so on.

    A pair is looked at by the first shingle that it shares. At later ones it is left out where a shared one before is seen by
    the columns of earlier(), which are added if rows have none, so that long sets don't come once for each of hundreds.

    Sets of a shingle that more than `hot` sets lead with are looked at by that shingle and the next that they share, and of those that are
    still as many by one more, up to RARE_MORE; what remains is cut to blocks of which any two meet in a task of their own.
    """
    rows = rows if BEFORE[0] in rows.columns else earlier(rows)
    own = rows.select(*PAIR, *ODD, *BEFORE)
    at = own.where(leading()).withColumn("key", F.col("h"))
    found = []
    for step in range(1, RARE_MORE + 1):
        many = written(at.groupBy("key").agg(F.count("*").alias("_many")).where(F.col("_many") > hot), "simhash-hot")
        if many.isEmpty():
            break
        # Few keys go to the many rows of each by salts.
        salted = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        at = written(at.withColumn("_salt", F.pmod("id", F.lit(64)).cast("int")).join(salted, ["key", "_salt"], "left").drop("_salt"), "simhash-at")
        found.append(at.where("_many IS NULL").drop("_many"))
        at = at.where("_many IS NOT NULL")
        if step < RARE_MORE:
            # The next shared shingle: one less before it that they don't share.
            more = own.where(leading(step + 1)).select("id", F.col("h").alias("_h"), F.col("pos").alias("_pos"))
            at = at.drop("_many").join(more, "id").where(F.col("_pos") > F.col("pos") + (step - 1))
            at = at.withColumns({"key": F.xxhash64("key", "_h"), "pos": F.col("_pos") - step}).drop("_h", "_pos")
        else:
            blocks = F.ceil(F.col("_many") / hot).cast("int")
            mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
            each = at.withColumns({"_mine": mine, "_with": F.explode(F.sequence(F.lit(0), blocks - 1))})
            at = each.withColumn("key", F.xxhash64("key", F.least("_mine", "_with"), F.greatest("_mine", "_with"))).drop("_many", "_mine", "_with")
    found.append(at)
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every.select("key", *PAIR[1:], *ODD, *BEFORE).repartition("key").sortWithinPartitions("key").mapInArrow(_sharing, "a bigint, b bigint").distinct()


def _sharing(batches):
    def solve(h, label, *values):
        order = np.lexsort((label, h))
        h, label, ids, *values = (x[order] for x in (h, label, *values))
        values, before = values[: -len(BEFORE)], values[-len(BEFORE) :]
        new = np.r_[True, h[1:] != h[:-1]]
        turn = np.flatnonzero(new | np.r_[True, label[1:] != label[:-1]])
        starts, every = np.flatnonzero(new), np.r_[turn, len(h)]
        end = np.r_[starts[1:], len(h)][np.cumsum(new) - 1]
        after = np.repeat(every[1:], np.diff(every))
        row = np.flatnonzero(end > after)
        upto = np.cumsum(end[row] - after[row])
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            own = row[at:to]
            j = spread(after[own], end[own] - after[own])
            i = np.repeat(own, end[own] - after[own])
            for x in before:
                new = x[i] != x[j]
                i, j = i[new], j[new]
            good = may_be_similar([x[i] for x in values], [x[j] for x in values])
            a, b = ids[i[good]], ids[j[good]]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            if both.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            at = to

    kept = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if kept is not None:
            columns = [np.r_[k, c] for k, c in zip(kept, columns)]
        if not len(columns[0]):
            continue
        # The last shingle may go on in the next batch.
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield from solve(*[c[:cut] for c in columns])
        kept = [c[cut:] for c in columns]
    if kept is not None:
        yield from solve(*kept)


# The similarity of candidates


def shingle_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(id, shingles) of rows: the id of the sketch and the upper 32 bits of the hashes of the set. Of equal sets each task makes one."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at, to in byte_slices(batch.column(0), SLICE_BYTES):
                ids, sets = [], []
                for i, own in shingle_sets_of(batch.column(0).slice(at, to - at), shingle):
                    if i not in seen:
                        seen.add(i)
                        ids.append(i)
                        sets.append(np.unique(own >> np.uint64(32)).astype(np.uint32).view(np.int32))
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int32()))], names=["id", "shingles"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "id bigint, shingles array<int>")


def similar(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, text: str, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of at least SIMILAR. docs has doc; distinct has id, n, parities, and key and least, the
    hash of one of its texts and the least doc.

    Sets of s shingles together are similar if they differ in s (down - up) / (down + up) at most. Parities that differ in
    more rule a pair out. With D differing shingles, m parities of them differ in m (1 - (1 - 2/m)^D) / 2 on average, with
    a variance known as exactly; if a pair's differ in SURE standard deviations less than that for the least D that is
    too much, it is similar (a dissimilar pair would have so few once in 3 million). Only the pairs between the two have
    their sets compared.
    """
    up, down = SIMILAR
    m = 64 * PARITIES
    s = F.col("m") + F.col("n")
    differ = sum((F.bit_count(F.col(f"a{q}").bitwiseXOR(F.col(q))) for q in ODD[1:]), F.bit_count(F.col(f"a{ODD[0]}").bitwiseXOR(F.col(ODD[0]))))
    light = distinct.select("id", "n", *ODD)
    pairs = pairs.join(light.toDF("a", "m", *[f"a{q}" for q in ODD]), "a").join(light.withColumnRenamed("id", "b"), "b")
    too_much = F.floor(s * (down - up) / (down + up)) + 1
    one, two = F.pow(F.lit(1 - 2 / m), too_much), F.pow(F.lit(1 - 4 / m), too_much)
    spread_ = F.sqrt(F.greatest(F.lit(0.0), m + m * (m - 1) * two - m * m * one * one)) / 2
    pairs = pairs.select("a", "b", differ.alias("differ"), s.alias("s"), (m * (1 - one) / 2 - SURE * spread_ - 1).alias("few"))
    pairs = pairs.where((up + down) * F.col("differ") <= (down - up) * F.col("s")).select("a", "b", (F.col("differ") <= F.col("few")).alias("sure"))
    pairs = written(pairs, "simhash-pairs")
    unsure = pairs.where("NOT sure").select("a", "b")
    named = unsure.select(F.col("a").alias("id")).union(unsure.select("b")).distinct()
    keys = written(distinct.join(named, "id", "left_semi").select("key", "least"), "simhash-keys")
    one = docs.withColumn("k", F.xxhash64(f"`{text}`")).join(keys, (F.col("k") == F.col("key")) & F.col("doc").eqNullSafe(F.col("least")), "left_semi")
    sets = written(shingle_sets(one, text, shingle).dropDuplicates(["id"]), "simhash-sets")
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    size = F.size("x") + F.size("y")
    # |x and y| / |x or y| >= SIMILAR, in whole numbers.
    compared = unsure.join(left, "a").join(right, "b").where((up + down) * F.size(F.array_intersect("x", "y")) >= up * size).select("a", "b")
    return pairs.where("sure").select("a", "b").unionByName(compared)


# Components of all links


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for each id in the links (a, b): root is the least id reachable. Alternating large and small stars."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: what is above a node goes below the least of its neighbours.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: a node and what is below it go below the least of those.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b")).distinct()
        edges = written(small, "links")
        # Done when every node has one link down, and no node has one down and one up.
        n, below = edges.agg(F.count("*"), F.count_distinct("b")).first()
        if n == below and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4, spare: int | None = None, max_both: int | None = None) -> DataFrame:
    """(doc, fp, print, root, component_id) for each row: its fingerprint and print id, the least print id and the smallest doc reachable.

    Links are between fingerprints of at most max_bits differing bits; the print id is the fingerprint. With max_both
    links are between texts whose sets of shingles are similar by SIMILAR, and the print id is that of the set. Those are
    first looked for where max_bits and max_both allow, then between one set of each rare shingle and the others, which
    joins dense groups by few links, and then among all pairs of what is not joined yet that share a rare shingle, which
    leaves no similar pair out. Every link is checked.

    Null and empty texts have the fingerprint zero and link like others. A null id is never smallest; a component of
    null ids alone has a null component_id. Repeated rows stay. Texts of any length are taken whole; with fewer words
    than a shingle the whole sequence is the shingle. An empty table gives no rows. Other columns play no part.
    """
    if max_both is None:
        made = docs.select(F.col(f"`{doc}`").alias("doc"), fingerprints(F.col(f"`{text}`"), shingle).alias("fp"))
        prints = written(made.withColumn("id", F.col("fp")), "simhash")
        least = written(prints.groupBy("id").agg(F.min("doc").alias("least")), "simhash-distinct")
        roots = connected(links(least.select(F.col("id").alias("fp")), max_bits, spare or spare_for(least.count(), max_bits)))
    else:
        slim = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
        prints = written(sketches(slim, "text", shingle), "simhash")
        least = prints.groupBy("id", "fp", "other", "n", *ODD).agg(F.min(F.struct(F.isnull("doc").alias("none"), "doc", "key")).alias("of"))
        least = written(least.select("id", "fp", "other", "n", *ODD, F.col("of.doc").alias("least"), F.col("of.key").alias("key")), "simhash-distinct")
        index = links(least.select("fp", "other", "id"), max_bits, spare or spare_for(least.count(), max_bits), max_both)
        index = written(index, "simhash-index")
        rows = written(shared(prints), "simhash-shared")
        marks = least.select("id", "fp", "other")
        # What the index links needs no second look between its own; that is only a hint, as its links aren't checked yet.
        hint = index.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
        own = rows.where(leading()).join(marks.join(hint, "id", "left").withColumn("label", F.coalesce("label", "id")), "id")
        sure = written(similar(index.unionByName(stars(own)).distinct(), slim, least, "text", shingle), "simhash-similar")
        roots = connected(sure)
        marks = least.select("id", "fp", "other", *ODD)
        own = earlier(rows).join(marks.join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root"), "id")
        more = written(similar(candidates(own), slim, least, "text", shingle), "simhash-more")
        if not more.isEmpty():
            roots = connected(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(more))
    members = least.select("id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = members.join(smallest, "root").select("id", "root", "component_id")
    return prints.join(of_print, "id").select(F.col("doc").alias(doc), "fp", F.col("id").alias("print"), "root", "component_id")


def op1_near_duplicates(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# For shingles of five words, where links are looked for first; see groups.
NEAR_BITS, NEAR_BOTH = 6, 14


def one_of_each(docs: DataFrame, shingle: int = 5, max_bits: int = NEAR_BITS, max_both: int = NEAR_BOTH) -> DataFrame:
    """The rows of docs, without all but one of each group of near copies: that with the smallest doc_id stays.

    Where several rows have that doc_id, or all ids of a group are null, the one with the least hash of its text stays.
    """
    found = written(groups(docs, shingle=shingle, max_bits=max_bits, max_both=max_both), "simhash-groups")
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    once = own.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    kept = docs.join(once.where("count = 1").select("doc_id"), "doc_id", "left_semi")
    several = written(once.where("count > 1").select("doc_id"), "simhash-repeated")
    if not several.isEmpty() or not own.where("doc_id IS NULL").isEmpty():
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("tie"), set_id(F.col("text"), shingle).alias("print"))
        rows = rows.where("doc_id IS NULL").unionByName(rows.join(several, "doc_id", "left_semi"))
        rows = rows.join(found.select("print", "root", "component_id").distinct(), "print").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        first = F.row_number().over(Window.partitionBy("root").orderBy("tie", "print"))
        kept = kept.select(*docs.columns).unionByName(rows.withColumn("first", first).where("first = 1").select("row.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
