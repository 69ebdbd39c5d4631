"""Approximate nearest neighbours by cosine: a forest of random-projection trees searched through one priority queue.

A tree rotates the unit vectors at random and splits them by one direction a level, each node at the median of its part
of a bounded sample. How far a query is on the wrong side of the splits above a node, squared and summed, bounds its
squared distance to all vectors there from below, as the directions of a tree are orthonormal. A query pops the nodes of
all trees from one queue, least bound first; leaves come out in that order.

The first leaves of one tree, their vectors scored exactly, give the distance of a query's k-th nearest so far. The queue of all
trees then goes on until the least bound in it is over that squared distance times `reach`, a share fitted on the sample: such that
the wanted part of the true neighbours within it lie in leaves, of one tree at least, with bounds below it. In data with
groups few leaves remain; vectors spread evenly in many dimensions have neighbours almost as far as all others, so that
about half of the leaves remain for any index of this kind. Each leaf visited is scored whole.

All rows are indexed. Leaves and the queries that visit them meet in blocks of at most ROWS vectors and about QUERIES
queries, so that a leaf with a third of all vectors, or one that all queries visit, is many tasks' work.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

TREES, LEAF, FIRST = 3, 512, 4
#: Rows and bytes of the sample at most; sampled rows for each leaf at least, which bounds the number of leaves.
SAMPLE, SAMPLE_BYTES, LEAST = 1 << 15, 32 << 20, 32
ROWS, QUERIES, PAIRS = 4096, 2048, 1 << 16
RECALL = 0.97


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


#: Length and number type of packed vectors, '<f4' or '<f8'.
Shape = tuple[int, str]


def matrix(column: pa.Array, shape: Shape) -> np.ndarray:
    """Packed vectors as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), shape[1]).reshape(len(column), shape[0]).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, made so that neither very large nor very small components are lost."""
    most = np.abs(x).max(axis=1, keepdims=True)
    y = x / most
    return y / np.sqrt((y**2).sum(axis=1, keepdims=True))


class Forest:
    """Rotations and medians, a few megabytes at most, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, k: int, recall: float, seed: int = 12):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.depth = min(depth, dim)
        self.turned = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : self.depth] for _ in range(trees)]
        self.medians: list[list[np.ndarray]] = []
        for turn in self.turned:
            at, node, levels = sample @ turn, np.zeros(len(sample), np.int64), []
            for level in range(self.depth):
                order = np.lexsort((at[:, level], node))
                count = np.bincount(node, minlength=1 << level)
                start = np.cumsum(count) - count
                levels.append(np.where(count > 0, at[order[np.minimum(start + count // 2, max(len(sample) - 1, 0))], level], 0.0))
                node = 2 * node + (at[:, level] >= levels[-1][node])
            self.medians.append(levels)
        self.reach = self.fitted(sample, k, recall)

    def fitted(self, sample: np.ndarray, k: int, recall: float, queries: int = 512) -> float:
        """The share of the squared distance of the k-th neighbour that bounds must be searched to, from neighbours within the sample."""
        if not self.depth or len(sample) <= k + 1:
            return 1.0
        asked = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, k, axis=1)[:, :k]
        far = 2 - 2 * np.take_along_axis(near, best, axis=1).min(axis=1)
        bounds = np.full(best.shape, np.inf)
        for tree in range(len(self.turned)):
            at, leaf = sample[asked] @ self.turned[tree], self.leaves(sample, tree)[best]
            bound = np.zeros(best.shape)
            for level in range(self.depth):
                node, right = leaf >> (self.depth - level), (leaf >> (self.depth - level - 1)) & 1
                gap = at[:, level : level + 1] - self.medians[tree][level][node]
                bound += np.where((gap >= 0) != (right == 1), gap**2, 0.0)
            bounds = np.minimum(bounds, bound)
        share = bounds / np.maximum(far, 1e-12)[:, None]
        return float(min(np.quantile(share, recall), 1.0))

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        at, node = x @ self.turned[tree], np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + (at[:, level] >= self.medians[tree][level][node])
        return node

    def search(self, places: list[list[float]], limit: float, most: int | None):
        """(tree, leaf) from one queue of the trees of places, least bound first: `most` at most, to the limit.

        places: where the query is on the directions of each tree.
        """
        heap = [(0.0, tree, 0, 0) for tree in range(len(places))]
        popped, out = 0, []
        while heap and (most is None or popped < most):
            bound, tree, level, node = heapq.heappop(heap)
            if bound > limit:
                break
            at, medians = places[tree], self.medians[tree]
            while level < self.depth:
                gap = at[level] - medians[level][node]
                right = gap >= 0
                other = bound + gap * gap
                if other <= limit:
                    heapq.heappush(heap, (other, tree, level + 1, 2 * node + (not right)))
                node, level = 2 * node + right, level + 1
            popped += 1
            out.append((tree, int(node)))
        return out


def as_binary(df: DataFrame, shape: Shape) -> DataFrame:
    """(vec_id, v): vectors packed to bytes."""
    def pack(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in flat.reshape(-1, shape[0])], pa.binary())], names=["vec_id", "v"])

    return df.mapInArrow(pack, "vec_id bigint, v binary")


def in_leaves(vectors: DataFrame, forest: Forest, shape: Shape) -> DataFrame:
    """(tree, leaf, spread, vec_id, v): each vector once in each tree; spread counts the rows of a task."""
    def place(batches):
        done = 0
        for batch in batches:
            if not len(batch):
                continue
            x = units(matrix(batch.column("v"), shape))
            spread = pa.array(np.arange(done, done + len(x)))
            done += len(x)
            for tree in range(len(forest.turned)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(forest.leaves(x, tree)), spread, batch.column("vec_id"), batch.column("v")], names=["tree", "leaf", "spread", "vec_id", "v"])

    return vectors.mapInArrow(place, "tree int, leaf bigint, spread bigint, vec_id bigint, v binary")


def visits(queries: DataFrame, forest: Forest, shape: Shape, first: int | None) -> DataFrame:
    """(query_id, q, least, tree, leaf): the first leaves of each query in the first tree, or all those in all trees that its k-th score leaves.

    least is the score a vector must have to matter; null where fewer than k are found, so that all leaves are visited.
    """
    def walk(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = units(matrix(batch.column("q"), shape))
            places = [(x @ turn).tolist() for turn in forest.turned]
            ids, q, least = batch.column("query_id").to_pylist(), batch.column("q").to_pylist(), batch.column("least").to_pylist()
            out = {c: [] for c in ("query_id", "q", "least", "tree", "leaf")}
            for i, (one, vector, score) in enumerate(zip(ids, q, least)):
                limit = forest.reach * (2 - 2 * score) if score is not None else np.inf
                for tree, leaf in forest.search([p[i] for p in places][: 1 if first else None], limit, first):
                    for c, value in zip(out, (one, vector, score, tree, leaf)):
                        out[c].append(value)
                if len(out["q"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(out, ARROW_VISITS)
                    out = {c: [] for c in out}
            yield pa.RecordBatch.from_pydict(out, ARROW_VISITS)

    return queries.mapInArrow(walk, VISITS)


VISITS = "query_id bigint, q binary, least double, tree int, leaf bigint"
ARROW_VISITS = pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("least", pa.float64()), ("tree", pa.int32()), ("leaf", pa.int64())])
FOUND = "query_id bigint, q binary, vec_id bigint, score double"
ARROW_FOUND = pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())])


def scored(queries: np.ndarray, own: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(place of the query, place of the vector, score): the k nearest vectors of each query, ties to smaller ids, its own left out.

    Products of matrices find who may be among them; their scores are then made in one order of sums, so that equal
    vectors have equal scores in whatever block.
    """
    a, b = units(queries), units(vectors)
    for at in range(0, len(a), 256):
        near = a[at : at + 256] @ b.T
        near[own[at : at + 256, None] == ids[None, :]] = -np.inf
        kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        floor = np.maximum(np.where(np.isfinite(kth), kth, -2.0), least[at : at + 256]) - 1e-9
        i, j = np.nonzero(near >= floor[:, None])
        score = np.concatenate([np.zeros(0), *[(a[at + i[s : s + PAIRS]] * b[j[s : s + PAIRS]]).sum(axis=1) for s in range(0, len(i), PAIRS)]])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield at + i[kept], j[kept], score[kept]


def searched(visited: DataFrame, placed: DataFrame, sizes: DataFrame, shape: Shape, k: int) -> DataFrame:
    """FOUND: for each query the k nearest of each block of vectors that it visits, once each."""
    asked = visited.groupBy("tree", "leaf").agg(F.count("*").alias("asked"))
    # A row for each leaf: TREES * SAMPLE / LEAST at most.
    cut = sizes.join(asked, ["tree", "leaf"]).select("tree", "leaf", F.ceil(F.col("n") / ROWS).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("crowds"))
    cut = F.broadcast(written(cut, "leaves"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = placed.join(cut, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "spread"), "blocks").cast("int")).withColumn("crowd", every("crowds"))
    queries = visited.join(cut, ["tree", "leaf"]).withColumn("crowd", F.pmod(F.xxhash64("query_id"), "crowds").cast("int")).withColumn("block", every("blocks"))
    keys = ["tree", "leaf", "block", "crowd"]

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return ARROW_FOUND.empty_table()
        asked, vectors = matrix(q.column("q").combine_chunks(), shape), matrix(x.column("v").combine_chunks(), shape)
        own, ids = q.column("query_id").to_numpy(), x.column("vec_id").to_numpy()
        least = np.nan_to_num(q.column("least").to_numpy(zero_copy_only=False).astype(np.float64), nan=-2.0)
        parts = [pa.table([pa.array(own[i]), q.column("q").take(pa.array(i)), pa.array(ids[j]), pa.array(s)], schema=ARROW_FOUND) for i, j, s in scored(asked, own, least, vectors, ids, k)]
        return pa.concat_tables(parts)

    met = queries.select(*keys, "query_id", "q", "least").groupBy(*keys).cogroup(vectors.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(meet, FOUND)
    # A vector comes from each tree where its leaf is visited.
    return best(met.dropDuplicates(["query_id", "vec_id", "score"]), k)


def best(found: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds, among all with another id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those without an id or of another length than
    most (of equally frequent lengths, the smaller). Scores are cosines in double precision; ties go to smaller ids. Of rows with the
    same id and vector one counts; where a query's id has several vectors, the least of them by its bytes asks. No rows
    give no rows. Other columns are left out.
    """
    kind = vectors.schema[embedding].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(f"`{embedding}`").cast("array<float>" if narrow else "array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = lengths
    shape = (dim, "<f4" if narrow else "<f8")
    rows = rows.where(F.size("v") == dim)
    # A sample of rows by their own hash, about so many.
    wanted = max(2, min(sample, SAMPLE_BYTES // (8 * dim)))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)) < wanted) if n > wanted else rows
    table = as_binary(picked.select("vec_id", "v"), shape).select("v").limit(2 * wanted).toArrow().column("v").combine_chunks()
    taken = units(matrix(table, shape)) if len(table) else np.zeros((0, dim))
    depth = max(0, min(int(np.ceil(np.log2(max(n / leaf, 1)))), int(np.log2(max(len(taken) / LEAST, 1)))))
    forest = Forest(taken, depth, trees if depth else 1, k, recall)

    placed = in_leaves(as_binary(rows.select("vec_id", "v"), shape), forest, shape)
    sizes = written(placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")), "sizes")
    asking = as_binary(rows.where("asks").select("vec_id", "v"), shape).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id")
    asking = written(asking.withColumn("least", F.lit(None).cast("double")), "queries")
    first = written(visits(asking, forest, shape, FIRST), "visits")
    near = written(searched(first, placed.where("tree = 0"), sizes, shape, k), "near")
    least = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = written(visits(asking.drop("least").join(least, "query_id", "left").select("query_id", "q", "least"), forest, shape, None), "visits")
    both = near.unionByName(searched(rest, placed, sizes, shape, k)).dropDuplicates(["query_id", "vec_id", "score"])
    return best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_nearest(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of the contract: queries are the rows whose vec_id is divisible by 50."""
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
