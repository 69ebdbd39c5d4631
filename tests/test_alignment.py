import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from lectern.operators import alignment

SCHEMA = "k int, said array<string>, heard array<string>"


def brute(said, heard):
    return [tuple(x) for x in SequenceMatcher(None, said or [], heard or [], autojunk=False).get_opcodes()]


def found(rows):
    side = lambda n: pa.array([r[n] for r in rows], pa.list_(pa.string()))
    return [[tuple(x.values()) for x in r] for r in alignment.blocks.func(side(0), side(1)).to_pylist()]


def edited(r, words, kinds):
    out = []
    for w in words:
        if r.random() > 0.12:
            out.append(w if r.random() > 0.08 else str(r.randrange(kinds)))
        if r.random() < 0.06:
            out += [str(r.randrange(kinds)) for _ in range(r.randrange(4))]
    return out


def some_rows():
    r = random.Random(7)
    rows = [(None, ["a"]), (["a"], None), ([], []), (None, None), (["a"] * 30, ["a"] * 17), (["a", "b"] * 9, ["b", "a"] * 12)]
    for _ in range(400):
        kinds = r.choice([1, 2, 3, 6, 40, 300])
        said = [str(r.randrange(kinds)) for _ in range(r.randrange(60))]
        rows.append((said, edited(r, said, kinds) if r.random() > 0.2 else [str(r.randrange(kinds)) for _ in range(r.randrange(60))]))
    return rows


@pytest.mark.parametrize("pairs", [1 << 21, 5])
def test_blocks_of_texts_with_repeated_words(monkeypatch, pairs):
    """5 pairs at once: most rows go by suffix automata, the others a few at a time."""
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    rows = some_rows()
    assert found(rows) == [brute(*r) for r in rows]


def test_automaton_finds_the_first_of_the_longest():
    assert alignment.Automaton(list("xabyab")).longest(list("zabab")) == (1, 1, 2)
    assert alignment.by_automata([1, 2, 3], [3, 1, 2]) == [(0, 1, 2)]
    assert alignment.by_automata([], [1]) == []


def long_pair(seed, n, kinds):
    """Half of the words from a few kinds, the others nearly all different."""
    r = random.Random(seed)
    said = [str(r.randrange(kinds if r.random() < 0.5 else 100 * n)) for _ in range(n)]
    return said, edited(r, said, kinds)


def test_stretches_of_long_pairs_have_the_faults_of_the_whole(spark):
    rows = [(1, *long_pair(1, 3000, 400)), (2, *long_pair(2, 900, 500)), (3, ["a"] * 700, ["a"] * 650), (4, [], []), (5, None, ["x"]), (6, ["a", "b"], ["a", "b"])]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = alignment.stretches(df, ["k"], most=200).collect()
    count = {k: sum(p.k == k for p in parts) for k in range(1, 7)}
    assert count[1] > 8 and count[3] == count[4] == count[5] == count[6] == 1
    for k, said, heard in rows:
        own = sorted((p for p in parts if p.k == k), key=lambda p: p.stretch)
        assert sum([p.said for p in own], []) == (said or []) and sum([p.heard for p in own], []) == (heard or [])
        assert [p.i0 for p in own] == [sum(len(q.said) for q in own[:i]) for i in range(len(own))]
    whole = {r.k: r for r in alignment.verified(df).collect()}
    for r in alignment.verified_whole(df, ["k"], most=200).collect():
        w = whole[r.k]
        for c in ("substitutions", "omissions", "insertions", "omission_run", "insertion_run", "missing", "extra", "wer", "flagged", "reason"):
            assert r[c] == w[c], (r.k, c)


def test_cuts_lie_inside_equal_words(spark):
    said, heard = long_pair(3, 2000, 900)
    parts = sorted(alignment.stretches(spark.createDataFrame([(1, said, heard)], SCHEMA), ["k"], most=100).collect(), key=lambda p: p.stretch)
    assert len(parts) > 5
    for p in parts[1:]:
        assert said[p.i0 - 2 : p.i0 + 1] == heard[p.j0 - 2 : p.j0 + 1]
