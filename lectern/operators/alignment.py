"""Verification: what was to be said against what was heard, by blocks of equal words.

The longest stretch of words that both have is a block, the first of equals in what was said, then in what was heard;
what stands before and after it on both sides is aligned in the same way. All word lists of an Arrow batch are aligned at once, in arrays: equal
words in a row on both sides are found by one sort, and each round cuts them to the open stretches and takes the longest
of each. Words so frequent that their pairs would not fit are matched by a suffix automaton instead, in memory by length.

A long pair of lists is first cut at words that each side has once, where it stands, and becomes stretches that different
tasks align. Stretches are sent as numbers of words, packed, never as words that nobody asks for. Counts, runs, rates, flags
and times are column expressions over the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# When a chunk is flagged.
OMISSION_RUN, INSERTION_RUN, MOST_WER = 3, 4, 0.25

#: Pairs of equal words in memory at once.
PAIRS = 1 << 21
#: Words of both sides in memory at once, or those of one row.
WORDS = 1 << 18
#: Words of a stretch, about, and anchors in a row that a cut needs around it.
STRETCH, ANCHORS = 2000, 3

BLOCKS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2")]]))
OPS = np.array(["equal", "replace", "delete", "insert"])
#: Where a stretch begins and ends on both sides, and the numbers of its words, packed.
PIECES = T.ArrayType(T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("i0", "i1", "j0", "j1")], *[T.StructField(c, T.BinaryType()) for c in ("a", "b")]]))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def equal_runs(a: np.ndarray, b: np.ndarray, row_a: np.ndarray, row_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, i, j, length) of each longest stretch of equal words in a row, for words as numbers in rows one after the other."""
    kinds = int(max(a.max(initial=0), b.max(initial=0))) + 1
    key_a, key_b = row_a * kinds + a, row_b * kinds + b
    order = np.argsort(key_b, kind="stable")
    first, last = np.searchsorted(key_b[order], key_a), np.searchsorted(key_b[order], key_a, side="right")
    count = last - first
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.repeat(first - _starts(count), count) + np.arange(count.sum())]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i - j) != 0) | (np.diff(i) != 1) | (row_a[i[1:]] != row_a[i[:-1]])
    at = np.flatnonzero(new)
    return row_a[i[at]], i[at], j[at], np.diff(np.r_[at, len(i)])


def longest_first(runs: tuple[np.ndarray, ...], upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, j, length) of the blocks of all rows, from their runs. upto: where rows begin, with the end of the last."""
    of, i, j, n = runs
    low_a, high_a, low_b, high_b = upto_a[:-1], upto_a[1:], upto_b[:-1], upto_b[1:]
    blocks = [np.zeros((3, 0), np.int64)]
    while len(of):
        # What of each run lies in its stretch, which it was dealt to.
        slant = i - j
        start = np.maximum(np.maximum(i, low_a[of]), low_b[of] + slant)
        long = np.minimum(np.minimum(i + n, high_a[of]), high_b[of] + slant) - start
        kept = long > 0
        of, i, j, n = of[kept], start[kept], start[kept] - slant[kept], long[kept]
        if not len(of):
            break
        by = np.lexsort((j, i, -n, of))
        best = by[np.r_[True, np.diff(of[by]) != 0]]
        blocks.append(np.stack([i[best], j[best], n[best]]))
        # Each stretch becomes two: 2k and 2k + 1 of the k-th that had a block.
        own, (bi, bj, bn) = of[best], blocks[-1]
        place = np.zeros(len(low_a), np.int64)
        place[own] = np.arange(len(own))
        low_a, high_a, low_b, high_b = [np.stack(x, axis=1).ravel() for x in ((low_a[own], bi + bn), (bi, high_a[own]), (low_b[own], bj + bn), (bj, high_b[own]))]
        k = place[of]
        left, right = (i < bi[k]) & (j < bj[k]), (i + n > (bi + bn)[k]) & (j + n > (bj + bn)[k])
        of, i, j, n = np.r_[2 * k[left], 2 * k[right] + 1], np.r_[i[left], i[right]], np.r_[j[left], j[right]], np.r_[n[left], n[right]]
    i, j, n = np.concatenate(blocks, axis=1)
    by = np.argsort(i, kind="stable")
    return i[by], j[by], n[by]


class Automaton:
    """The suffix automaton of a list of numbers: states with their longest length, link, arcs and first end."""

    def __init__(self, words: list[int]):
        self.arcs, self.link, self.long, self.end = [{}], [-1], [0], [-1]
        last = 0
        for at, w in enumerate(words):
            new = self._state({}, 0, self.long[last] + 1, at)
            p = last
            while p >= 0 and w not in self.arcs[p]:
                self.arcs[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.arcs[p][w]
                if self.long[p] + 1 != self.long[q]:
                    copy = self._state(dict(self.arcs[q]), self.link[q], self.long[p] + 1, self.end[q])
                    while p >= 0 and self.arcs[p].get(w) == q:
                        self.arcs[p][w] = copy
                        p = self.link[p]
                    self.link[q] = q = copy
                self.link[new] = q
            last = new

    def _state(self, arcs: dict, link: int, long: int, end: int) -> int:
        for of, value in zip((self.arcs, self.link, self.long, self.end), (arcs, link, long, end)):
            of.append(value)
        return len(self.arcs) - 1

    def longest(self, words: list[int]) -> tuple[int, int, int]:
        """(i, j, length) of the longest stretch that words and the automaton's own have; the first of equals."""
        best, state, long = (0, 0, 0), 0, 0
        for at, w in enumerate(words):
            while state and w not in self.arcs[state]:
                state = self.link[state]
                long = self.long[state]
            if w in self.arcs[state]:
                state, long = self.arcs[state][w], long + 1
            if long > best[2]:
                best = at - long + 1, self.end[state] - long + 1, long
        return best


def by_automata(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, length) of the blocks of one pair of lists, in memory by their length whatever is repeated."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        low_a, high_a, low_b, high_b = todo.pop()
        i, j, n = Automaton(b[low_b:high_b]).longest(a[low_a:high_a])
        if n:
            i, j = i + low_a, j + low_b
            out.append((i, j, n))
            todo += [x for x in ((low_a, i, low_b, j), (i + n, high_a, j + n, high_b)) if x[0] < x[1] and x[2] < x[3]]
    return sorted(out)


def _numbers(said: pa.Array, heard: pa.Array) -> tuple[np.ndarray, ...]:
    """Words of both sides as numbers, and where rows begin, with the end of the last. Null lists are empty."""
    both = pa.chunked_array([said.flatten(), heard.flatten()]).combine_chunks()
    words = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    length = lambda x: np.r_[0, np.cumsum(np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))]
    upto_a, upto_b = length(said), length(heard)
    return words[: upto_a[-1]], words[upto_a[-1] :], upto_a, upto_b


def _blocks(a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, j, length) of the blocks of all rows, by slices of rows with PAIRS pairs of equal words at most."""
    n = len(upto_a) - 1
    row_a, row_b = np.repeat(np.arange(n), np.diff(upto_a)), np.repeat(np.arange(n), np.diff(upto_b))
    kinds = int(max(a.max(initial=0), b.max(initial=0))) + 1
    key, times = np.unique(row_b * kinds + b, return_counts=True)
    mine = row_a * kinds + a
    at = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
    pairs = np.bincount(row_a, weights=np.where(key[at] == mine, times[at], 0) if len(key) else np.zeros(len(a)), minlength=n)
    upto, out, row = np.r_[0, np.cumsum(pairs)], [np.zeros((3, 0), np.int64)], 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(upto, upto[row] + PAIRS, side="right")) - 1)
        in_a, in_b = slice(upto_a[row], upto_a[to]), slice(upto_b[row], upto_b[to])
        if pairs[row] > PAIRS:
            found = np.array(by_automata(a[in_a].tolist(), b[in_b].tolist()), np.int64).reshape(-1, 3).T
        else:
            runs = equal_runs(a[in_a], b[in_b], row_a[in_a] - row, row_b[in_b] - row)
            found = np.stack(longest_first(runs, upto_a[row : to + 1] - upto_a[row], upto_b[row : to + 1] - upto_b[row]))
        out.append(found + np.array([[upto_a[row]], [upto_b[row]], [0]]))
        row = to
    return tuple(np.concatenate(out, axis=1))


def _opcodes(a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, op, i1, i2, j1, j2) in order: equal blocks, and between them what is replaced, deleted or inserted."""
    i, j, n = _blocks(a, b, upto_a, upto_b)
    rows = len(upto_a) - 1
    of = np.searchsorted(upto_a, i, side="right") - 1
    # An empty block ends each row.
    of, i, j, n = [np.r_[x, y] for x, y in ((of, np.arange(rows)), (i, upto_a[1:]), (j, upto_b[1:]), (n, np.zeros(rows, np.int64)))]
    by = np.lexsort((j + n, i + n, of))
    of, i, j, n = of[by], i[by], j[by], n[by]
    new = np.r_[True, np.diff(of) != 0][: len(of)]
    from_a, from_b = np.where(new, upto_a[of], np.r_[0, (i + n)[:-1]]), np.where(new, upto_b[of], np.r_[0, (j + n)[:-1]])
    # Before each block what differs, then the block.
    op = np.stack([np.where(from_a < i, np.where(from_b < j, 1, 2), 3), np.zeros(len(of), np.int64)], axis=1).ravel()
    i1, i2, j1, j2 = [np.stack(x, axis=1).ravel() for x in ((from_a, i), (i, i + n), (from_b, j), (j, j + n))]
    of = np.repeat(of, 2)
    kept = (i1 < i2) | (j1 < j2)
    of, op, i1, i2, j1, j2 = [x[kept] for x in (of, op, i1, i2, j1, j2)]
    return of, op, i1 - upto_a[of], i2 - upto_a[of], j1 - upto_b[of], j2 - upto_b[of]


def _listed(a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> pa.Array:
    """The blocks of all rows as lists."""
    of, op, *places = _opcodes(a, b, upto_a, upto_b)
    offsets = np.searchsorted(of, np.arange(len(upto_a))).astype(np.int32)
    fields = [pa.array(OPS[op], pa.string()), *[pa.array(x.astype(np.int32)) for x in places]]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["op", "i1", "i2", "j1", "j2"]))


@F.arrow_udf(BLOCKS)
def blocks(said: pa.Array, heard: pa.Array) -> pa.Array:
    return _listed(*_numbers(said, heard))


def _slices(n_words: np.ndarray):
    """Slices of rows with WORDS words at most, or of one row; an empty one if there are no rows."""
    upto, row = np.r_[0, np.cumsum(n_words)], 0
    while True:
        to = min(len(n_words), max(row + 1, int(np.searchsorted(upto, upto[row] + WORDS, side="right")) - 1))
        yield slice(row, to)
        row = to
        if row >= len(n_words):
            return


def cut_places(a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, most: int, anchors: int) -> tuple[np.ndarray, ...]:
    """(row, i, j) of the cuts of all rows, in order (see stretches). Null words are 0."""
    n_a, n_b = np.diff(upto_a), np.diff(upto_b)
    long, kinds = np.maximum(n_a, n_b) > most, int(max(a.max(initial=0), b.max(initial=0))) + 1

    def once(words, row):
        at = np.flatnonzero(long[row] & (words > 0))
        key, first, times = np.unique(row[at] * kinds + words[at], return_index=True, return_counts=True)
        return key[times == 1], at[first[times == 1]]

    (key_a, at_a), (key_b, at_b) = once(a, np.repeat(np.arange(len(n_a)), n_a)), once(b, np.repeat(np.arange(len(n_b)), n_b))
    key, in_a, in_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    by = np.argsort(at_a[in_a])
    row, i, j = (key // kinds)[by], at_a[in_a][by], at_b[in_b][by]
    back = anchors - 1
    kept = np.ones(len(row), bool)
    kept[:back] = False
    kept[back:] &= (row[back:] == row[: len(row) - back]) & (i[back:] - i[: len(i) - back] == back) & (j[back:] - j[: len(j) - back] == back)
    row, i, j = row[kept], i[kept], j[kept]
    # Rows follow each other on both sides, so that places in the batch tell of anchors that change sides in the same row alone.
    before, after = np.r_[-1, np.maximum.accumulate(j)[:-1]][: len(j)], np.r_[np.minimum.accumulate(j[::-1])[::-1][1:], len(b)][: len(j)]
    kept = (before < j) & (j < after)
    row, i, j = row[kept], (i - upto_a[row])[kept], (j - upto_b[row])[kept]
    row, i, j = row[i >= most], i[i >= most], j[i >= most]
    first = np.r_[True, (np.diff(row) != 0) | (np.diff(i // most) != 0)][: len(row)]
    return row[first], i[first], j[first]


def packed(words: np.ndarray, codec: pa.Codec) -> bytes:
    """Numbers by their differences, compressed: those of words first seen rise by one."""
    return codec.compress(np.diff(words, prepend=0).astype("<i4").tobytes(), asbytes=True) if len(words) else b""


def unpacked(data: bytes, n: int, codec: pa.Codec) -> np.ndarray:
    return np.cumsum(np.frombuffer(codec.decompress(data, 4 * n, asbytes=True), "<i4"), dtype=np.int64) if n else np.zeros(0, np.int64)


def cut_lists(said: pa.Array, heard: pa.Array, most: int, anchors: int) -> pa.Array:
    """The stretches of each pair of lists, as PIECES has them."""
    codec, out = pa.Codec("zstd"), []
    lengths = lambda x: np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    for rows in _slices(lengths(said) + lengths(heard)):
        a, b, upto_a, upto_b = _numbers(said[rows], heard[rows])
        row, i, j = cut_places(a, b, upto_a, upto_b, most, anchors)
        whole = np.arange(len(upto_a) - 1)
        of, i0, j0 = np.r_[whole, row], np.r_[0 * whole, i], np.r_[0 * whole, j]
        by = np.lexsort((i0, of))
        of, i0, j0 = of[by], i0[by], j0[by]
        last = np.r_[np.diff(of) != 0, True][: len(of)]
        i1, j1 = [np.where(last, np.diff(upto)[of], np.r_[k0[1:], 0][: len(of)]) for upto, k0 in ((upto_a, i0), (upto_b, j0))]
        sides = [pa.array([packed(words[x:y], codec) for x, y in zip((upto[of] + k0).tolist(), (upto[of] + k1).tolist())], pa.binary()) for words, upto, k0, k1 in ((a, upto_a, i0, i1), (b, upto_b, j0, j1))]
        fields = [*[pa.array(x.astype(np.int32)) for x in (i0, i1, j0, j1)], *sides]
        offsets = np.searchsorted(of, np.arange(len(upto_a))).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["i0", "i1", "j0", "j1", "a", "b"])))
    return pa.concat_arrays(out)


def pieces(said: Column, heard: Column, most: int, anchors: int) -> Column:
    @F.arrow_udf(PIECES)
    def cut(said: pa.Array, heard: pa.Array) -> pa.Array:
        return cut_lists(said, heard, most, anchors)

    return cut(said, heard)


@F.arrow_udf(BLOCKS)
def blocks_of_packed(n_a: pa.Array, a: pa.Array, n_b: pa.Array, b: pa.Array) -> pa.Array:
    """The blocks of stretches that are sent packed."""
    codec, n_a, n_b, out = pa.Codec("zstd"), n_a.to_numpy(zero_copy_only=False).astype(np.int64), n_b.to_numpy(zero_copy_only=False).astype(np.int64), []
    for rows in _slices(n_a + n_b):
        side = lambda data, n: np.concatenate([np.zeros(0, np.int64), *[unpacked(x.as_buffer(), k, codec) for x, k in zip(data[rows], n[rows].tolist())]])
        out.append(_listed(side(a, n_a), side(b, n_b), np.r_[0, np.cumsum(n_a[rows])], np.r_[0, np.cumsum(n_b[rows])]))
    return pa.concat_arrays(out)


def _sum(of: Column, value) -> Column:
    return F.aggregate(of, F.lit(0), lambda a, x: a + value(x))


def _most(of: Column, value) -> Column:
    return F.aggregate(of, F.lit(0), lambda a, x: F.greatest(a, value(x)))


def _lost(x: Column) -> Column:
    return F.when(x["op"] != "equal", F.greatest((x["i2"] - x["i1"]) - (x["j2"] - x["j1"]), F.lit(0))).otherwise(0)


def _more(x: Column) -> Column:
    return F.when(x["op"] != "equal", F.greatest((x["j2"] - x["j1"]) - (x["i2"] - x["i1"]), F.lit(0))).otherwise(0)


def counted(df: DataFrame, said: str = "said", heard: str = "heard", omission_run: int = OMISSION_RUN, insertion_run: int = INSERTION_RUN, found: Column | None = None) -> DataFrame:
    """Adds blocks, substitutions, omissions, insertions, omission_run, insertion_run, missing, extra (see verified). found: the blocks, if not those of said and heard."""
    df = df.withColumn("blocks", blocks(said, heard) if found is None else found)
    b = F.col("blocks")
    words = lambda c, a, z: F.array_join(F.slice(c, a + 1, z - a), " ")
    gone = F.filter(b, lambda x: (x["op"] == "delete") | ((x["op"] == "replace") & (_lost(x) >= omission_run)))
    extra = F.filter(b, lambda x: (x["op"] == "insert") | ((x["op"] == "replace") & (_more(x) >= insertion_run)))
    changed = lambda x: F.when(x["op"] != "equal", F.least(x["i2"] - x["i1"], x["j2"] - x["j1"])).otherwise(0)
    return df.withColumns(
        {
            "substitutions": _sum(b, changed),
            "omissions": _sum(b, _lost),
            "insertions": _sum(b, _more),
            "omission_run": _most(b, _lost),
            "insertion_run": _most(b, _more),
            "missing": F.slice(F.transform(gone, lambda x: words(F.col(said), x["i1"], x["i2"])), 1, 5),
            "extra": F.slice(F.transform(extra, lambda x: words(F.col(heard), x["j1"], x["j2"])), 1, 5),
        }
    )


def judged(df: DataFrame, n_said: Column, n_heard: Column, omission_run: int = OMISSION_RUN, insertion_run: int = INSERTION_RUN, most_wer: float = MOST_WER) -> DataFrame:
    """Adds wer, flagged and reason to counted rows."""
    rate = (F.col("substitutions") + F.col("omissions") + F.col("insertions")) / F.greatest(n_said, F.lit(1))
    reasons = F.array_compact(
        F.array(
            F.when((n_heard == 0) & (n_said > 0), "nothing was heard"),
            F.when(F.col("omission_run") >= omission_run, F.format_string("%d words in a row are missing", "omission_run")),
            F.when(F.col("insertion_run") >= insertion_run, F.format_string("%d words in a row are extra", "insertion_run")),
            F.when(rate > most_wer, F.concat(F.lit("WER "), F.format_string("%.0f%%", rate * 100), F.lit(f" > {most_wer:.0%}"))),
        )
    )
    return df.withColumns({"wer": F.bround(rate, 4), "flagged": F.size(reasons) > 0, "reason": F.array_join(reasons, "; ")})


def verified(df: DataFrame, said: str = "said", heard: str = "heard", omission_run: int = OMISSION_RUN, insertion_run: int = INSERTION_RUN, most_wer: float = MOST_WER) -> DataFrame:
    """Adds blocks, substitutions, omissions, insertions, omission_run, insertion_run, missing, extra, wer, flagged, reason.

    Of a replaced stretch as many words as the shorter side count as substituted, the rest as omitted or inserted; its
    words are listed only if that rest is as long as a run that flags. missing and extra have five stretches at most.
    Null lists are empty.
    """
    df = counted(df, said, heard, omission_run, insertion_run)
    return judged(df, F.coalesce(F.size(said), F.lit(0)), F.coalesce(F.size(heard), F.lit(0)), omission_run, insertion_run, most_wer)


def _stretches(df: DataFrame, keys: list[str], said: str, heard: str, most: int, anchors: int) -> DataFrame:
    """(keys, stretch, _x, said, heard), _x as PIECES has it."""
    rows = df.select(*keys, F.coalesce(said, F.array().cast("array<string>")).alias("said"), F.coalesce(heard, F.array().cast("array<string>")).alias("heard"))
    # Outer, though each pair has a stretch: for the other Spark adds a filter, and cuts all pairs twice.
    parts = rows.withColumn("_all", pieces(F.col("said"), F.col("heard"), most, anchors)).select(*keys, "said", "heard", F.posexplode_outer("_all").alias("stretch", "_x"))
    cut_of = lambda c, k: F.slice(c, F.col(f"_x.{k}0") + 1, F.col(f"_x.{k}1") - F.col(f"_x.{k}0")).alias(c)
    return parts.select(*keys, "stretch", "_x", cut_of("said", "i"), cut_of("heard", "j"))


def stretches(df: DataFrame, keys: list[str], said: str = "said", heard: str = "heard", most: int = STRETCH, anchors: int = ANCHORS) -> DataFrame:
    """(keys, stretch, i0, j0, said, heard): pairs of lists of more than `most` words cut to stretches of about so many.

    An anchor ends so many words in a row that each side has once; a cut goes before its last word, if no other anchor
    changes sides with it, at the first in each `most` words of what was said. So a cut lies inside equal words,
    and no run of faults crosses it. A pair without anchors stays whole. keys tell the rows apart.
    """
    return _stretches(df, keys, said, heard, most, anchors).select(*keys, "stretch", F.col("_x.i0").alias("i0"), F.col("_x.j0").alias("j0"), "said", "heard")


def verified_whole(df: DataFrame, keys: list[str], said: str = "said", heard: str = "heard", most: int = STRETCH, omission_run: int = OMISSION_RUN, insertion_run: int = INSERTION_RUN, most_wer: float = MOST_WER) -> DataFrame:
    """(keys, n_said, n_heard and what verified() adds but the blocks) for pairs of any length, whose stretches are dealt over tasks.

    Words are dealt with them only where missing or extra is read.
    """
    size = lambda k: F.col(f"_x.{k}1") - F.col(f"_x.{k}0")
    parts = _stretches(df, keys, said, heard, most, ANCHORS).select(*keys, "stretch", size("i").alias("n_said"), size("j").alias("n_heard"), F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b"), "said", "heard")
    # By number: packed stretches are so small that few tasks would be left of partitions joined by their bytes.
    parts = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "stretch")
    rows = counted(parts, "said", "heard", omission_run, insertion_run, found=blocks_of_packed("n_said", "_a", "n_heard", "_b"))
    first = lambda c: F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("stretch", c)))), lambda x: x[c])), 1, 5)
    whole = rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_said", "n_heard", "substitutions", "omissions", "insertions")],
        *[F.max(c).alias(c) for c in ("omission_run", "insertion_run")],
        *[first(c).alias(c) for c in ("missing", "extra")],
    )
    return judged(whole, F.col("n_said"), F.col("n_heard"), omission_run, insertion_run, most_wer)


def verse_times(df: DataFrame, keys: list[str], verses: str = "verses", heard_starts: str = "heard_starts", seconds: str = "seconds", said: str = "said") -> DataFrame:
    """(keys, place, verse, time): the start of the first heard word aligned at or after each verse's first word, else its share.

    verses is an array of structs (verse, token); heard_starts has the start of each heard word. A verse that comes
    again is marked #2, #3 and so on.
    """
    equal = F.filter("blocks", lambda x: x["op"] == "equal")
    rows = df.select(*keys, equal.alias("_equal"), heard_starts, seconds, F.size(said).alias("_n"), F.posexplode(verses).alias("place", "_v"))
    ahead = F.filter("_equal", lambda x: x["i2"] > F.col("_v.token"))
    first = F.try_element_at(ahead, F.lit(1))
    at = first["j1"] + F.greatest(F.col("_v.token") - first["i1"], F.lit(0))
    time = F.coalesce(F.try_element_at(F.col(heard_starts), at + 1), F.col(seconds) * F.col("_v.token") / F.greatest("_n", F.lit(1)))
    again = F.row_number().over(Window.partitionBy(*keys, "_v.verse").orderBy("place"))
    verse = F.when(again > 1, F.concat("_v.verse", F.lit("#"), again.cast("string"))).otherwise(F.col("_v.verse"))
    return rows.select(*keys, "place", verse.alias("verse"), F.round(time, 3).alias("time"))
