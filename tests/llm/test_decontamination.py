import hashlib
import random
import re

import pytest

from lectern.llm import decontamination as dc


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    out = []
    for d, t in docs:
        own, hit, found = words_of(t), set(), set()
        for i, text in items:
            w = words_of(text)
            k = min(window, len(w))
            if i is None or not k:
                continue
            runs = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            for j in range(len(own) - k + 1):
                if tuple(own[j : j + k]) in runs:
                    hit |= set(range(j, j + k))
                    found.add(str(i))
        out.append((d, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def data():
    rnd = random.Random(3)
    words = "alpha beta gamma Delta été x1 7 naïve".split()
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25)))) for i in range(15)]
    items += [(100, "short One"), (101, None), (102, "--- !!"), (None, "alpha beta"), (103, "twelve words " * 6), (103, "second row of the same item id has its own ten words"), (11, "É é")]
    docs = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))
        if i % 3 == 0:
            text += "... " + rnd.choice(items)[1].__str__().upper().replace(" ", ", ") + " !"
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "filler " * 30_000 + "short one"), (None, "short-one"), (700, "SHORT\none"), (700, "SHORT\none"), (503, "shortone short ones xshort one")]
    return docs, items


@pytest.mark.parametrize("max_chars", [32_000_000, 300])
def test_matches_brute_force(spark, max_chars):
    docs, items = data()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id bigint, text string, n_words int, row int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.contamination(df, bench, max_chars=max_chars).collect()
    mine = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got]
    assert sorted(mine, key=repr) == plain(docs, items)
    text = dict(docs)
    for r in got:
        for s in r.spans:
            inside = words_of(text[r.doc_id][s.start : s.end])
            own = [words_of(t) for i, t in items if str(i) == s.item_id]
            assert any(inside[: min(10, len(w))] == w[j : j + min(10, len(w))] for w in own for j in range(len(w)))
    if max_chars > 1000:
        found = dc.op3_decontaminate(df, bench)
        assert sorted((tuple(r) for r in found.drop("spans").collect()), key=repr) == plain(docs, items)
        whole = {(r.doc_id, r.spans) for r in found.collect()}
    else:
        # In parts the spans are those of one automaton.
        whole = {(r.doc_id, r.spans) for r in dc.op3_decontaminate(df, bench).collect()}
    assert {(r.doc_id, ",".join(f"{s.item_id}:{s.start}:{s.end}" for s in r.spans)) for r in got} == whole
    clean = dc.without_contaminated(df, bench, max_chars=max_chars)
    assert clean.columns == df.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((p[0] for p in plain(docs, items) if not p[-1]), key=repr)


def test_nothing(spark):
    docs, items = data()
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert dc.op3_decontaminate(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in dc.op3_decontaminate(df, bench.limit(0)).collect())


def test_runs_have_all_windows_and_bounded_patterns():
    text = " ".join(f"w{i}" for i in range(500))
    runs = list(dc.runs_of(text, 10, 400))
    assert len(runs) > 20 and all(n <= 400 for _, n in runs)
    assert set(dc.patterns([("i", text)], 10)) == {p for run, _ in runs for p in dc.patterns([("i", run)], 10)}
    assert sum(len(p) for p in dc.patterns([("i", runs[0][0])], 10)) == runs[0][1]
    assert [r for r, _ in dc.runs_of("just three words", 10, 5)] == ["just three words"] and list(dc.runs_of("--", 10, 5)) == []
