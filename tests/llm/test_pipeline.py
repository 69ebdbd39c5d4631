import random
import re

import corpus_pipeline as cp
from lectern.llm import decontamination, pieces, quality, secret_scan, simhash


def corpus():
    rnd = random.Random(12)
    vocabulary = [a + b for a in "the of an in er re on ti nd ha ou ed".split() for b in "the at ing tion ea st or es sh ble ly".split()]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)) + "."
    docs = [(i, prose(rnd.randrange(150, 400))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(8)]
    edited = docs[9][1].split()
    edited[20] = "changed"
    docs += [(120, " ".join(edited)), (121, docs[10][1] + " token = \"0123456789abcdef0123\" and on"), (122, "word! " * 300), (123, None), (124, ""), (125, "few words")]
    bench = [(1, prose(25)), (2, prose(12))]
    docs += [(130, prose(200) + " " + bench[0][1].upper() + " " + prose(100)), (131, prose(250) + ' password: "correct-horse-battery" ' + prose(60))]
    return [(d, t, "xx", f"s{d % 3}", len(t or "")) for d, t in docs], bench


def test_run_matches_the_stages_one_by_one(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = quality.Words(cp.MODEL)
    rows = {d: t for d, t, *_ in docs}

    def good(t):
        m = dict(zip(quality.MEASURES.names, (x[0] for x in quality.measured([t or ""], words))))
        if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
            return False
        s = quality.SCRIPTS[m["script"]]
        n = max(1, m["n_tokens"])
        import math

        least = s["share"] * min(16.0, math.log2(n)) if n >= quality.FEW_TOKENS else 0.0
        return s["least"] <= m["word_chars"] / n <= s["most"] and m["n_bytes"] / n <= s["bytes"] and m["entropy"] >= least

    rows = {d: t for d, t in rows.items() if good(t)}
    prints = {d: simhash.prints_of(t, 5, 2) for d, t in rows.items()}
    group = {d: d for d in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            x, y = (sum((p & (2**64 - 1) ^ q & (2**64 - 1)).bit_count() for p, q in zip(prints[a][:k], prints[b][:k])) for k in (1, 2))
            if a < b and x <= simhash.NEAR_BITS and y <= simhash.NEAR_BOTH and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    rows = {d: t for d, t in rows.items() if group[d] == d}
    runs = decontamination.patterns([(str(i), t) for i, t in bench], 10)
    rows = {d: t for d, t in rows.items() if not any(p in f" {' '.join(w.decode() for w in decontamination.normal_words(t))} " for p in runs)}
    for d, t in rows.items():
        for a, b in reversed(secret_scan.merged([s for own in secret_scan.find(t) for s in own])):
            rows[d] = rows[d][:a] + "[SECRET]" + rows[d][b:]
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(rows)
    assert not {100, 101, 120, 122, 123, 124, 125, 130} & set(got) and 131 in got
    lattice = pieces.Lattice(cp.MODEL)
    for d, r in got.items():
        assert lattice.decode(r.ids) == rows[d] and r.round_trip and r.n_pieces == len(r.ids)
    assert "[SECRET]" in lattice.decode(got[131].ids) and not re.search("correct-horse", lattice.decode(got[131].ids))


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert len(cp.STAGES) == 5
