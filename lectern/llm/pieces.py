"""SentencePiece encoding and decoding: the N best segmentations by a Viterbi pass and a backward A* search.

The lattice of a text has its characters as nodes and each piece of the vocabulary that matches between two nodes as an
edge; a character that no piece has is an edge of its byte pieces. Forward Viterbi scores give the best way from the
beginning to each node. They are exact heuristics for a search that goes backward from the end: the best complete way
through a partial one is known when it is put on the agenda, so that complete segmentations leave it in order of their
scores.

No piece has a space mark after another character or a line break, so every segmentation of a text is one of each of its
chunks: space marks and what follows, or line breaks. Each distinct chunk is a lattice of its own; the lattices of many
chunks are laid side by side in arrays for the Viterbi passes. A forward and a backward pass give the best
segmentation of each and the loss of the second best: the least loss of a way over an edge that the best doesn't use.
The lattice of a text has the chunks' segmentations as edges, and its Viterbi scores are sums of best scores. Its N best
differ from the best only in the N - 1 chunks of least losses, so that these alone are searched, each by A* over its
pieces, and then by A* over their alternatives.

A model of the BPE kind ranks its pieces but has no probabilities. A piece of rank r has here the score of the
Zipf-Mandelbrot law, -ln(r + 2.7) less a constant, so that the sum over a segmentation is a log probability. A model of
the unigram kind keeps its own scores. Of equal scores
the one with the longer last pieces is the best.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, text_slices

SPACE = "▁"
N_BEST = 4
#: Distinct chunks that a worker knows; of more it keeps five in eight.
KNOWN = 400_000
AT_ONCE = 200_000
SLICE_CHARS = 2_000_000
UNKNOWN_LOSS = 10.0
# Longer chunks are searched one by one.
LONG = 4096

Way = tuple[float, tuple[int, ...]]


class Lattice:
    """The vocabulary as a lattice over any text."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, zipf: bool = True):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path) if path else SentencePieceProcessor(model_proto=proto)
        ids = range(m.vocab_size())
        plain = [i for i in ids if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        if zipf:
            order = sorted(plain, key=lambda i: (-m.get_score(i), i))
            whole = math.log(sum(1 / (r + 2.7) for r in range(len(order))))
            score = {i: -math.log(r + 2.7) - whole for r, i in enumerate(order)}
        else:
            score = {i: m.get_score(i) for i in plain}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        self.unknown = min(score.values()) - UNKNOWN_LOSS
        self.unk_id = m.unk_id()
        self.piece = {m.id_to_piece(i): (i, score[i]) for i in plain}
        self.longest = max(map(len, self.piece))
        if any(p.lstrip(SPACE).find(SPACE) > 0 or "\n" in p for p in self.piece):
            raise ValueError("pieces of this vocabulary go over spaces or line breaks")
        # Beginnings of pieces end the search for longer ones.
        self.begins = {p[:k] for p in self.piece for k in range(1, len(p) + 1)}
        self.text = {i: m.id_to_piece(i).replace(SPACE, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte.items()}

    def edges(self, chunk: str) -> tuple[array, array, array, array]:
        """The edges by the node where they end: upto (of node k: edges upto[k] to upto[k + 1]), where each begins, score, piece or -1."""
        # Beginnings of pieces, from each node on; an edge is known where it begins and wanted where it ends.
        n, ends = len(chunk), [[] for _ in range(min(self.longest, len(chunk)) + 1)]
        upto, begin, weight, piece = array("q", [0, 0]), array("q"), array("d"), array("q")
        for a in range(n):
            own, alone = ends, False
            for b in range(a + 1, min(n, a + self.longest) + 1):
                part = chunk[a:b]
                if part not in self.begins:
                    break
                if part in self.piece:
                    i, s = self.piece[part]
                    own[b % len(own)].append((a, s, i))
                    alone |= b == a + 1
            if not alone:
                own[(a + 1) % len(own)].append((a, self.unknown, -1))
            for x, s, i in own[(a + 1) % len(own)]:
                begin.append(x)
                weight.append(s)
                piece.append(i)
            own[(a + 1) % len(own)] = []
            upto.append(len(begin))
        return upto, begin, weight, piece

    def spelled_unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte[x] for x in char.encode()) if self.byte else (self.unk_id,)

    def best(self, chunk: str, n: int) -> list[Way]:
        """The n best segmentations of a chunk as (score, ids), best first."""
        upto, begin, weight, piece = self.edges(chunk)
        # Forward Viterbi: the best score from the beginning to each node.
        forward = array("d", [0.0]) + array("d", bytes(8 * len(chunk)))
        for at in range(1, len(chunk) + 1):
            forward[at] = max(forward[begin[e]] + weight[e] for e in range(upto[at], upto[at + 1]))
        # Backward A*. The loss of a partial way is what its best completion scores less than the best way: a sum over its
        # edges, each exactly nothing where Viterbi's best goes. Of equal losses that nearest to the beginning is first,
        # so that a best way is gone straight through. The n best go over no node more than n times.
        agenda, back, edge = [(0.0, len(chunk), 0)], array("q", [-1]), array("q", [-1])
        left = array("q", [n]) * (len(chunk) + 1)
        out: list[Way] = []
        while agenda and len(out) < n:
            lost, at, way = heapq.heappop(agenda)
            if not left[at]:
                continue
            left[at] -= 1
            if at == 0:
                ids: list[int] = []
                while way > 0:
                    e = edge[way]
                    ids += (piece[e],) if piece[e] >= 0 else self.spelled_unknown(chunk[begin[e]])
                    way = back[way]
                out.append((forward[-1] - lost, tuple(ids)))
                continue
            for e in range(upto[at], upto[at + 1]):
                a = begin[e]
                if left[a]:
                    heapq.heappush(agenda, (lost + (forward[at] - (forward[a] + weight[e])), a, len(back)))
                    back.append(way)
                    edge.append(e)
        return out

    def _trie(self) -> None:
        """The vocabulary as arrays: sorted keys node << 21 | character, the node each leads to, and the piece that ends there."""
        node, keys, leads = {"": 0}, [], []
        for begin in sorted(self.begins, key=len):
            node[begin] = len(node)
            keys.append(node[begin[:-1]] << 21 | ord(begin[-1]))
            leads.append(node[begin])
        order = np.argsort(keys)
        self.keys, self.leads = np.array(keys, np.int64)[order], np.array(leads, np.int64)[order]
        self.ends = np.full(len(node), -1, np.int64)
        self.weight = np.zeros(len(node))
        for p, (i, s) in self.piece.items():
            self.ends[node[p]], self.weight[node[p]] = i, s

    def viterbi(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk the best score, the loss of the second best segmentation, the number of ids of the best; and all those ids."""
        if not hasattr(self, "keys"):
            self._trie()
        n = np.array([len(c) for c in chunks], np.int64)
        text = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(n)
        left = np.repeat(ends, n) - np.arange(len(text))  # characters from here to the end of the chunk
        # All edges: walk down the trie from every character at once.
        begin, node, found = np.arange(len(text)), np.zeros(len(text), np.int64), []
        for length in range(1, self.longest + 1):
            key = node << 21 | text[begin + length - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            begin, node = begin[there], self.leads[at[there]]
            real = self.ends[node] >= 0
            found.append((begin[real], np.full(int(real.sum()), length), self.ends[node[real]], self.weight[node[real]]))
            on = left[begin] > length
            begin, node = begin[on], node[on]
            if not len(begin):
                break
        alone = np.ones(len(text), bool)
        alone[found[0][0]] = False
        odd = np.flatnonzero(alone)
        found.append((odd, np.ones(len(odd), np.int64), np.full(len(odd), -1), np.full(len(odd), self.unknown)))
        begin, length, piece, weight = (np.concatenate(x) for x in zip(*found))
        # Node numbers: a chunk of n characters has n + 1.
        own = np.repeat(np.arange(len(n)), n)
        start = np.r_[0, ends[:-1]] + np.arange(len(n)) if len(n) else ends
        a = begin + own[begin]
        b = a + length
        depth = b - start[own[begin]]
        total = int(len(text) + len(n))
        order = np.lexsort((a, b, depth))
        a, b, piece, weight, length, begin, depth = (x[order] for x in (a, b, piece, weight, length, begin, depth))
        forward, taken = np.full(total, -np.inf), np.full(total, -1, np.int64)
        forward[start] = 0.0
        steps = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(depth) else np.zeros(1, np.int64)
        for i, j in zip(steps, steps[1:]):
            through = forward[a[i:j]] + weight[i:j]
            first = np.flatnonzero(np.r_[True, b[i + 1 : j] != b[i : j - 1]])
            best = np.maximum.reduceat(through, first)
            forward[b[i:j][first]] = best
            # The first, and so the longest, of equals.
            hit = np.flatnonzero(through == np.repeat(best, np.diff(np.r_[first, j - i])))
            taken[b[i:j][hit[::-1]]] = i + hit[::-1]
        back = np.full(total, -np.inf)
        back[start + n] = 0.0
        up = np.lexsort((a, -(a - start[own[begin]])))
        rise = (a - start[own[begin]])[up]
        steps = np.flatnonzero(np.r_[True, rise[1:] != rise[:-1], True]) if len(rise) else np.zeros(1, np.int64)
        for i, j in zip(steps, steps[1:]):
            e = up[i:j]
            through = back[b[e]] + weight[e]
            first = np.flatnonzero(np.r_[True, a[e][1:] != a[e][:-1]])
            back[a[e][first]] = np.maximum.reduceat(through, first)
        # The best ways, from the ends backward, all chunks side by side.
        used = np.zeros(len(a), bool)
        chunk, at, picked = np.arange(len(n)), start + n, []
        while len(chunk):
            open_ = at > start[chunk]
            chunk, at = chunk[open_], at[open_]
            e = taken[at]
            used[e] = True
            picked.append(e)
            at = a[e]
        e = np.flatnonzero(used)
        e = e[np.argsort(a[e])]
        # The ids of an unknown character are those of its bytes.
        several = [(int(piece[x]),) if piece[x] >= 0 else self.spelled_unknown(chr(text[begin[x]])) for x in e] if (piece[e] < 0).any() else None
        if several is None:
            flat, of = piece[e].astype(np.int32), own[begin[e]]
        else:
            flat, of = np.array([i for x in several for i in x], np.int32), np.repeat(own[begin[e]], [len(x) for x in several])
        score = forward[start + n]
        loss = np.full(len(n), np.inf)
        other = ~used
        np.minimum.at(loss, own[begin[other]], score[own[begin[other]]] - (forward[a] + weight + back[b])[other])
        return score, np.maximum(loss, 0.0), np.bincount(of, minlength=len(n)), flat

    def chunks(self, text: str) -> list[str]:
        """The text with space marks, cut before marks that follow other characters, and around line breaks."""
        if not text:
            return []
        out = []
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append("\n")
            marked = (SPACE if number == 0 else "") + line.replace(" ", SPACE)
            own = marked.split(SPACE)
            if own[0]:
                out.append(own[0])
            marks = 0
            for word in own[1:]:
                marks += 1
                if word:
                    out.append(SPACE * marks + word)
                    marks = 0
            if marks:
                out.append(SPACE * marks)
        return out

    def decode(self, ids) -> str:
        """The text of ids, without the space mark that encoding puts before it. A text's own U+2581 comes back as a space: pieces don't tell them apart."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Chunks(dict):
    """Chunk to number, with the score and the ids of its best segmentation and the loss of the second best, in arrays."""

    def __init__(self, lattice: Lattice, n: int, most: int = KNOWN):
        self.most = most
        self.lattice, self.n, self.new, self.chunk, self.several = lattice, n, [], [], {}
        self.score, self.loss, self.flat = np.zeros(0), np.zeros(0), np.zeros(0, np.int32)
        self.size, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, chunk):
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at

    def numbers(self, chunks: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        at = 0
        while at < len(self.new):
            if len(self.new[at]) > LONG:
                # Beside others a long chunk would only add steps of its own.
                found = self.lattice.best(self.new[at], max(2, self.n))
                self.several[len(self.chunk) + at] = found[: self.n]
                lost = found[0][0] - found[1][0] if len(found) > 1 else np.inf
                self._add(np.array([found[0][0]]), np.array([lost]), np.array([len(found[0][1])]), np.array(found[0][1], np.int32))
                at += 1
                continue
            chars, to = 0, at
            while to < len(self.new) and (to == at or chars < AT_ONCE) and len(self.new[to]) <= LONG:
                chars += len(self.new[to])
                to += 1
            self._add(*self.lattice.viterbi(self.new[at:to]))
            at = to
        self.chunk += self.new
        self.new = []
        return got

    def _add(self, score: np.ndarray, loss: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.first = np.r_[self.first, np.cumsum(size) - size + len(self.flat)]
        self.score, self.loss, self.size, self.flat = np.r_[self.score, score], np.r_[self.loss, loss], np.r_[self.size, size], np.r_[self.flat, flat]

    def best_ids(self, number: int) -> tuple[int, ...]:
        return tuple(self.flat[self.first[number] : self.first[number] + self.size[number]].tolist())

    def ways(self, number: int) -> list[Way]:
        """The n best of a chunk; of equals that of the Viterbi pass comes first."""
        if number not in self.several:
            found, first = self.lattice.best(self.chunk[number], self.n), self.best_ids(number)
            rest = [w for w in found if w[1] != first]
            self.several[number] = [(float(self.score[number]), first), *rest[: self.n - 1]]
        return self.several[number]

    def trimmed(self):
        if len(self) > self.most:
            kept = self.most * 5 // 8
            # Frequent chunks were met first.
            for chunk in self.chunk[kept:]:
                del self[chunk]
            self.chunk = self.chunk[:kept]
            self.several = {k: w for k, w in self.several.items() if k < kept}
            self.score, self.loss, self.size, self.first = (x[:kept].copy() for x in (self.score, self.loss, self.size, self.first))
            self.flat = self.flat[: self.first[-1] + self.size[-1]].copy()


def n_best(numbers: np.ndarray, known: Chunks) -> list[tuple[float, dict[int, int]]]:
    """The n best segmentations of a text of these chunks, as scores and the chunks that don't take their best: place to rank."""
    n = known.n
    best = float(known.score[numbers].sum())
    # Of all chunks, the n - 1 with the least first loss; an n best way differs from the best in no other.
    loss = known.loss[numbers] if n > 1 else np.zeros(0)
    take = min(n - 1, len(loss))
    if take and len(loss) > take:
        edge = np.partition(loss, take - 1)[take - 1]
        under = np.flatnonzero(loss < edge)
        some = np.sort(np.r_[under, np.flatnonzero(loss == edge)[: take - len(under)]])
    else:
        some = np.arange(take)
    some = [i for i in some.tolist() if loss[i] < np.inf]
    gaps = [[max(0.0, ways[0][0] - s) for s, _ in ways] for ways in (known.ways(int(numbers[i])) for i in some)]
    # Backward A* over the chunks that may differ: whatever is still ahead takes its best, so that its loss is nothing.
    agenda: list = [(0.0, len(gaps), ())]
    out = []
    while agenda and len(out) < n:
        lost, at, ranks = heapq.heappop(agenda)
        if at == 0:
            out.append((best - lost, {some[i]: r for i, r in enumerate(reversed(ranks)) if r}))
            continue
        for rank, gap in enumerate(gaps[at - 1]):
            heapq.heappush(agenda, (lost + gap, at - 1, (*ranks, rank)))
    return out


def ids_of(numbers: np.ndarray, known: Chunks, differing: dict[int, int] | None = None) -> np.ndarray:
    """The ids of a segmentation."""
    if not differing:
        size = known.size[numbers]
        ends = np.cumsum(size)
        return known.flat[np.arange(ends[-1] if len(size) else 0) - np.repeat(ends - size - known.first[numbers], size)]
    # The best one's ids with those of few chunks replaced.
    best, upto = ids_of(numbers, known), np.r_[0, np.cumsum(known.size[numbers])]
    out, at = [], 0
    for i in sorted(differing):
        out += [best[at : upto[i]], np.array(known.ways(int(numbers[i]))[differing[i]][1], np.int32)]
        at = upto[i + 1]
    return np.concatenate([*out, best[at:]])


ENCODED = "n_pieces bigint, score double, best_scores array<double>, ids array<int>, alternatives array<array<int>>, round_trip boolean, ids_crc32 bigint, best_crc32 array<bigint>"


def encoded(docs: DataFrame, path: str, n: int = N_BEST, doc: str = "doc_id", text: str = "text", with_ids: bool = True, with_alternatives: bool = False, known_chunks: int = KNOWN) -> DataFrame:
    """(doc, n_pieces, score, best_scores, ids, alternatives, round_trip, ids_crc32) for each row of docs.

    ids is the best segmentation, best_scores has the scores of the n best (fewer where there are fewer), alternatives
    the ids of all of them if with_alternatives. round_trip says whether the ids of each, decoded, are the text. Null and
    empty texts have no pieces and score 0. Texts of any length are taken whole. Repeated rows each give a row, null
    ids too; no rows give no rows. ids_crc32 is of the ids as little-endian 32-bit
    integers, best_crc32 of those of each of the n best. known_chunks bounds the memory of a worker, not the result.
    """
    slim = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        known = in_worker(("pieces", path, n, known_chunks), lambda: Chunks(Lattice(path), n, known_chunks), large=True)
        lattice = known.lattice
        for batch in batches:
            for at, to, texts in text_slices(batch.column(1), SLICE_CHARS):
                several = [lattice.chunks(t) for t in texts]
                numbers = known.numbers([c for own in several for c in own])
                cuts = np.cumsum([0, *map(len, several)])
                pieces, scores, bests, ids, others, trips, crcs, sums = [], [], [], [], [], [], [], []
                for i, t in enumerate(texts):
                    own = numbers[cuts[i] : cuts[i + 1]]
                    ways = n_best(own, known)
                    first = ids_of(own, known)
                    good = not t or lattice.decode(first.tolist()) == t
                    # The others differ from the best in few chunks, and those are all that has to be decoded again.
                    for _, other in ways[1:]:
                        good = good and all(_spelled(lattice, known.ways(int(own[p]))[r][1]) == _spelled(lattice, known.best_ids(int(own[p]))) for p, r in other.items())
                    pieces.append(len(first))
                    scores.append(ways[0][0])
                    bests.append([s for s, _ in ways])
                    ids.append(first if with_ids else None)
                    trips.append(good)
                    several_ids = [first, *(ids_of(own, known, d) for _, d in ways[1:])]
                    sums.append([zlib.crc32(x.astype("<u4").tobytes()) for x in several_ids])
                    crcs.append(sums[-1][0])
                    others.append([x.tolist() for x in several_ids] if with_alternatives else None)
                known.trimmed()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(pieces, pa.int64()), pa.array(scores, pa.float64()), pa.array(bests, pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.list_(pa.int32()))), pa.array(trips, pa.bool_()), pa.array(crcs, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
                    names=["doc", "n_pieces", "score", "best_scores", "ids", "alternatives", "round_trip", "ids_crc32", "best_crc32"],
                )

    kind = slim.schema["doc"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc {kind}, {ENCODED}").withColumnRenamed("doc", doc)


def _spelled(lattice: Lattice, ids) -> bytes:
    return b"".join(map(lattice.text.__getitem__, ids))


def op10_pieces(docs: DataFrame, path: str) -> DataFrame:
    """Per document the pieces and scores of its N best segmentations, a checksum of the ids of each, and whether all decode to the text."""
    return encoded(docs, path, with_ids=False).select("doc_id", "n_pieces", "score", "best_scores", "ids_crc32", "best_crc32", "round_trip")
