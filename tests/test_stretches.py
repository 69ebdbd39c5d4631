import random

import duckdb
import pyarrow as pa
import pytest

from lectern.operators import alignment
from lectern.plans import catalogue

from test_alignment import SCHEMA, brute, edited


def rows_of(seed):
    r = random.Random(seed)
    rows = [(None, ["a"] * 9), (["a"] * 9, None), ([], []), ([None] * 40, [None] * 35)]
    for _ in range(150):
        n = r.randrange(120)
        said = [str(r.randrange(r.choice([5, 40, 3 * n + 1]))) if r.random() > 0.02 else None for _ in range(n)]
        heard = edited(r, said, 60)
        at = r.randrange(n + 1)
        rows.append((said, heard[at:] + heard[:at] if r.random() < 0.5 else heard))  # half of them with anchors that change sides
    return rows


def cuts(said, heard, most, anchors):
    """By the definition: the places of cuts of a pair."""
    said, heard = said or [], heard or []
    if max(len(said), len(heard)) <= most:
        return []
    once = lambda words: {w for w in words if w is not None and words.count(w) == 1}
    both = [(said.index(w), heard.index(w)) for w in once(said) & once(heard)]
    both.sort()
    back = anchors - 1
    found = [x for n, x in enumerate(both) if n >= back and both[n - back] == (x[0] - back, x[1] - back)]
    found = [x for x in found if all((x[0] < y[0]) == (x[1] < y[1]) for y in found if y != x)]
    return [min(x for x in found if x[0] // most == k) for k in sorted({i // most for i, _ in found}) if k]


@pytest.mark.parametrize("anchors", [1, 3])
@pytest.mark.parametrize("words", [1 << 18, 50])
def test_lists_are_cut_as_defined_and_sent_packed(monkeypatch, words, anchors):
    monkeypatch.setattr(alignment, "WORDS", words)
    rows = rows_of(5)
    side = lambda n: pa.array([r[n] for r in rows], pa.list_(pa.string()))
    found = alignment.cut_lists(side(0), side(1), 20, anchors)
    assert sum(len(x) > 1 for x in found) > 20
    for (said, heard), own in zip(rows, found.to_pylist(), strict=True):
        at = [(0, 0), *cuts(said, heard, 20, anchors), (len(said or []), len(heard or []))]
        assert [((x["i0"], x["j0"]), (x["i1"], x["j1"])) for x in own] == list(zip(at, at[1:]))
    flat = found.flatten()
    n = lambda k: pa.array([x[f"{k}1"] - x[f"{k}0"] for x in flat.to_pylist()], pa.int32())
    blocks = alignment.blocks_of_packed.func(n("i"), flat.field("a"), n("j"), flat.field("b")).to_pylist()
    parts = [((said or [])[x["i0"] : x["i1"]], (heard or [])[x["j0"] : x["j1"]]) for (said, heard), own in zip(rows, found.to_pylist()) for x in own]
    assert [[tuple(x.values()) for x in b] for b in blocks] == [brute(*p) for p in parts]


def test_no_rows():
    none = pa.array([], pa.list_(pa.string()))
    assert len(alignment.cut_lists(none, none, 20, 3)) == 0
    assert len(alignment.blocks_of_packed.func(*[pa.array([], t) for t in (pa.int32(), pa.binary(), pa.int32(), pa.binary())])) == 0


def dealt(df):
    """The types of what goes through each exchange of a plan, and how often a Python function is called."""
    todo, out, calls = [df._jdf.queryExecution().executedPlan()], [], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        calls += node.nodeName() == "ArrowEvalPython"
        if node.nodeName() == "Exchange":
            out.append([node.output().apply(i).dataType().simpleString() for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out, calls


def test_words_are_not_dealt_out_unless_they_are_read(spark, sf):
    """Words went through the shuffle three times: one by one, as whole documents and as stretches."""
    exchanges, calls = dealt(catalogue.QUERIES["document_stretches"](spark, sf))
    assert len(exchanges) == 2 and calls == 2
    assert not any(t == "string" or t.startswith("array") for types in exchanges for t in types)
    whole = alignment.verified_whole(spark.createDataFrame([(1, ["a"], ["b"])], SCHEMA), ["k"])
    assert [("array<string>" in types) for types in dealt(whole)[0]].count(True) >= 1


def test_document_stretches_are_their_sql(spark, tmp_path):
    """Rates that end in a 5, of 4,000 and 12,000 words; no text, and no words."""
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in (4000, 12000, 1001, 17, 1)] + [(2, None), (3, ""), (4, "... -- !")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        asked = con.execute(catalogue.ORACLE["document_stretches"]).fetchall()
    assert sorted(tuple(r) for r in catalogue.QUERIES["document_stretches"](spark, str(tmp_path)).collect()) == sorted(asked)
