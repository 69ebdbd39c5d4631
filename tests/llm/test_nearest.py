import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import nearest

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, k=5, every=50):
    """For each query its k nearest by cosine, ties to smaller ids."""
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)})
    unit = {(i, v): np.array(v) / np.linalg.norm(v) for i, v in fine}
    out = {}
    for q, v in fine:
        if q % every == 0:
            score = sorted((-round(float(unit[q, v] @ unit[i, w]), 12), i) for i, w in fine if i != q)
            out[q] = [i for _, i in score[:k]]
    return out


def found(df, **more):
    out = {}
    for r in sorted(nearest.nearest(df, F.col("vec_id") % 50 == 0, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("of", ["spread", "groups"])
def test_recall_and_scores_against_brute_force(spark, of):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24))
    if of == "groups":
        x = rng.normal(size=(60, 24))[rng.integers(0, 60, 4000)] + 0.1 * x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = found(df, leaf=64)
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, leaf=64).collect():
        a, b = x[r["query_id"]], x[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_groups_leave_most_leaves_unvisited(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(64, 16))[rng.integers(0, 64, 8192)] + 0.02 * rng.normal(size=(8192, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = nearest.Forest(x, 7, 3, 5, nearest.RECALL)
    near = np.sort(x[:50] @ x.T, axis=1)[:, -6]
    seen = [len(forest.search([(x[q] @ t).tolist() for t in forest.turned], forest.reach * (2 - 2 * near[q]), None)) for q in range(50)]
    assert np.mean(seen) < 0.2 * 3 * 128


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {}
    for r in nearest.op12_nearest(df).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert recall(got, want) >= 0.9


def test_copies_in_many_blocks_tie_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 16)
    monkeypatch.setattr(nearest, "QUERIES", 2)
    rng = np.random.default_rng(5)
    v = rng.normal(size=7).tolist()
    rows = [(i, v) for i in range(400)] + [(400 + i, rng.normal(size=7).tolist()) for i in range(300)]
    got = found(spark.createDataFrame(rows, SCHEMA), leaf=64)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[350] == [0, 1, 2, 3, 4]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (50, [0.0, 0.0]), (100, None), (150, [-1e300, 1e300]), (9, [1e-300, 1e-300]), (1, [2.0, 0.1])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == {0: [1, 9, 150], 150: [9, 1, 0]}
    clash = df.withColumns({c: F.lit(1) for c in ("query_id", "score", "rank", "v", "q", "leaf", "tree", "asks", "n", "dim")})
    assert found(clash) == found(df)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == {} and found(spark.createDataFrame([(1, None)], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0])], SCHEMA)) == {}
