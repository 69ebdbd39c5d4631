import random
import zlib

from pyspark.sql import functions as F

from lectern.llm import substring_dedup as sd


def plain(docs, sentences=sd.SENTENCES, words=sd.WORDS):
    """Spans of all documents in one dictionary, by brute force."""
    first, runs = {}, {}
    weight = lambda w: max(1, (sum("\u3000" <= c <= "\ud7ff" for c in w.decode()) + 1) // 2)
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    for i in order:
        own = sd.sentences_of(docs[i][1] or "")
        upto = [0]
        for _, _, w in own:
            upto.append(upto[-1] + sum(map(weight, w)))
        good = lambda a, b: b - a >= sentences and upto[b] - upto[a] >= words
        found = {(a, b) for a in range(len(own)) for b in [next((b for b in range(a + sentences, len(own) + 1) if good(a, b)), 0)] if b}
        found |= {(a, b) for b in range(len(own) + 1) for a in [next((a for a in range(b - sentences, -1, -1) if good(a, b)), -1)] if a >= 0}
        runs[i] = [(a, b, tuple(x for _, _, w in own[a:b] for x in w)) for a, b in sorted(found)]
        for a, b, key in runs[i]:
            first.setdefault(key, (docs[i][:2], a))
    out = []
    for i, (d, t, *_) in enumerate(docs):
        own, gone, origin = sd.sentences_of(t or ""), set(), set()
        for a, b, key in runs[i]:
            if first[key] != ((d, t), a):
                gone |= set(range(a, b))
                if first[key][0] != (d, t):
                    origin.add(first[key][0][0])
        kept, at = "", 0
        for s in sorted(gone):
            kept += (t or "")[at : own[s][0]]
            at = own[s][1]
        kept += (t or "")[at:]
        out.append((d, len(own), len(gone), sorted(origin), len(kept), zlib.crc32(kept.encode())))
    return sorted(out, key=repr)


def prose(rnd, n):
    words = [rnd.choice("alpha beta gamma delta été x1 naïve omega kappa the of and".split()) + str(rnd.randrange(300)) for _ in range(n)]
    return " ".join(w + rnd.choice([".", "?", ",", "\n", "", "", "", "", ""]) for w in words)


def data():
    rnd = random.Random(7)
    passages = [prose(rnd, 60) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [prose(rnd, rnd.randrange(0, 120))]
        if i % 3 == 0:
            parts += [passages[0] if i % 2 else rnd.choice(passages), prose(rnd, 30)]
        docs.append((i, " ".join(parts), "x"))
    copy = docs[20][1]
    docs += [(500, copy, "x"), (501, copy, "y"), (502, None, "x"), (503, "", None), (504, " \n ", "x"), (505, "One. Two. Three.", "x"), (506, "One. Two. Three.", "x")]
    docs += [(507, "OF!! " * 400, "x"), (508, "no stop " * 30_000, "x"), (None, passages[1], "x"), (509, passages[2], "x"), (509, passages[2], "x"), (510, "第一句。 第二句。 " * 30, "x")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, s, 1) for d, t, s in docs], "doc_id bigint, text string, places string, n_removed int")


def test_matches_brute_force(spark):
    docs = data()
    got = sd.op7_repeated_spans(frame(spark, docs).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_sentences, r.n_removed, list(r.first_docs), r.kept_chars, r.kept_crc32) for r in got), key=repr) == plain(docs)
    assert sum(r.n_removed > 0 for r in got) > 40


def test_passages_in_any_surroundings_go_once(spark):
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(55)]
    for stops in (0, 4):
        passage = " ".join(w + "." * bool(stops and i % (55 // stops) == 9) for i, w in enumerate(words))
        docs = [(i, f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}", "x") for i in range(8)] + [(100 + i, prose(rnd, 90), "x") for i in range(30)]
        got = {r.doc_id: r for r in sd.op7_repeated_spans(frame(spark, docs)).collect()}
        assert [d for d, r in sorted(got.items()) if r.n_removed] == list(range(1, 8))
        assert all(0 in got[i].first_docs for i in range(1, 8))


def test_rows_keep_their_columns(spark):
    docs = frame(spark, data())
    out = sd.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    again = sd.op7_repeated_spans(out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert again.agg(F.sum("n_removed")).first()[0] < 60
    assert sd.op7_repeated_spans(docs.limit(0)).collect() == [] and sd.without_repeats(docs.limit(0)).collect() == []


def test_sentences():
    text = 'One two. "Three four!" he said.) Five\nsix… seven  第一句。第二句！ end'
    got = sd.sentences_of(text)
    assert [text[a:b] for a, b, _ in got] == ["One two. ", '"Three four!" ', "he said.) ", "Five\n", "six… ", "seven  第一句。", "第二句！ ", "end"]
    assert [w for _, _, w in got][:2] == [[b"one", b"two."], [b'"three', b'four!"']]
    assert "".join(text[a:b] for a, b, _ in got) == text
    assert sd.sentences_of("") == [] and sd.sentences_of(" \n ") == []


def test_unspaced_passages_and_ends_of_stretches(spark):
    rnd = random.Random(13)
    cjk = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n)) + "。"
    passage = "".join(cjk(9) for _ in range(8))
    say = lambda n, k: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n - 1)) + f" end{k}{rnd.randrange(10**6)}."
    stretch = " ".join(say(n, "t") for n in (11, 3, 3, 3, 3, 3))
    docs = [(i, cjk(12) + passage + cjk(14), "x") for i in range(3)] + [(10 + i, f"{say(9, 'a')} {stretch} {say(8, 'b')} {say(9, 'c')}", "x") for i in range(3)]
    got = {r.doc_id: r for r in sd.op7_repeated_spans(frame(spark, docs)).collect()}
    assert [got[i].n_removed for i in (0, 1, 2)] == [0, 8, 8]
    assert [got[i].n_removed for i in (10, 11, 12)] == [0, 6, 6]
    for i, text, _ in docs[4:]:
        if i >= 11:
            a, b = map(int, got[i].removed.split(":"))
            assert text[a:b].strip() == stretch
