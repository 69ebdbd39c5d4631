import random
from bisect import bisect_left

import pytest

from lectern.operators import inference, markup, sequences


def book(chapters, verse="<sup class='v'>{}</sup>", other=None, chapter="<h2>Cap. {}</h2>", poem=False):
    """Documents of a book: an introduction that names numbers, then chapters of seven verses each, three a document."""
    out = ["<body><h1>Intro</h1><p>See <b>3</b> and <b>9</b> there, and many words that go on and on about it all, for a hundred characters at the least, and more.</p></body>"]
    for at in range(1, chapters + 1, 3):
        doc = ""
        for c in range(at, min(chapters, at + 2) + 1):
            doc += chapter.format(c)
            for v in range(1, 8):
                mark = (other if other and v % 3 == 0 else verse).format(v)
                words = "short line" if poem else "words " * 30
                doc += f"<p class='{'s' if v == 1 else 'n'}'>{mark} {words}.</p>"
        out.append(f"<body>{doc}</body>")
    return out


@pytest.fixture(scope="module")
def found(spark):
    made = {
        "plain": book(12), "two": book(12, other="<a>{}</a>"), "poem": book(9, poem=True), "none": ["<body><p>no numbers at all</p></body>"],
        "bold": book(6, verse="<b>{}</b>", chapter="<p class='t'>{}</p>"),
    }
    docs = spark.createDataFrame([(w, i, html) for w, own in made.items() for i, html in enumerate(own)], "work string, doc int, html string")
    expected = spark.createDataFrame([("plain", 12), ("two", 12), ("poem", 9), ("none", 3), ("bold", 6)], "work string, expected int")
    margins = spark.createDataFrame([("s", 1.0), ("n", 0.5), ("x", 1.0)], "class string, em double")
    profile = markup.profile(docs, ["work", "doc"], "html").cache()
    return profile, {r.work: r for r in inference.suggested(profile, ["work"], "doc", expected, margins).collect()}


def test_profile(found):
    rows = found[0].where("work = 'plain' AND doc = 1")
    count = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert count == {"number": 21, "heading": 3, "block": 21, "size": 1}
    block = rows.where("kind = 'block'").orderBy("pos").first()
    assert (block.signature, block.starts, block.ends, block.classes) == ("p.s", True, True, ["s"])


def test_structure(found):
    got = found[1]
    assert (got["plain"].verses, got["plain"].verse_marks, got["plain"].chapter, got["plain"].chapter_marks) == (["sup.v"], 84, "h2", 12)
    assert got["two"].verses == ["sup.v", "a"] and got["two"].verse_marks == 84
    assert got["bold"].verses == ["b"] and got["bold"].chapter == "p.t"
    assert "none" not in got
    assert (got["plain"].short_line, got["plain"].stanzas) == (None, [])
    assert (got["poem"].short_line, got["poem"].stanzas) == (100, ["s"])
    assert got["poem"].reasons[0].startswith("verses: sup.v, 63 marks") and got["poem"].reasons[-1] == "stanzas: s"


def marked(spark, of):
    rows = [("w", kind, sign, p, v, 10) for kind, signs in of.items() for sign, own in signs.items() for p, v in own]
    return spark.createDataFrame(rows, "work string, kind string, signature string, position int, value int, expected int")


def test_signatures_that_fill_holes(spark):
    heads = {"h2": [(i * 10, i) for i in range(1, 11) if i % 4], "h3": [(40, 4), (80, 8)], "li": [(1000 + i, i) for i in range(1, 11)]}
    verses = {"sup": [(i, i % 12 + 1) for i in range(180) if i % 6 not in (2, 5)], "a": [(i, i % 12 + 1) for i in range(2, 180, 6)], "i": [(i, i % 12 + 1) for i in range(5, 180, 6)], "b": [(5, 77), (6, 3)], "em": [(i, 50) for i in range(3, 180, 30)]}
    main = spark.createDataFrame([("w", "sup")], "work string, signature string")
    got = inference.more_verses(marked(spark, {"number": verses}).drop("kind"), ["work"], main)
    assert [r.signature for r in got.orderBy("round").collect()] == ["sup", "a", "i"]
    places = {"v": [(p + 1, 1) for m in ("h2", "h3") for p, _ in heads[m]]}
    marks, own = marked(spark, {"heading": heads, "number": places}), spark.createDataFrame([("w", "v")], "work string, signature string")
    shares = inference.shares_with_verses(marks, ["work"], own)
    assert {r.signature: r.share for r in shares.where("kind = 'heading'").collect()} == {"h2": 1.0, "h3": 1.0, "li": 0.0}
    best = inference.chapter_signatures(marks, ["work"], own, shares)
    assert [(r.signature, r.n, r.score) for r in best.collect()] == [("h2", 8, 0.8)]
    more = inference.more_chapters(marks.where("kind = 'heading'").drop("kind"), ["work"], best.select("work", "signature"), own, shares)
    assert [r.signature for r in more.orderBy("round").collect()] == ["h2", "h3"]


def longest(values):
    ends = []
    for v in values:
        at = bisect_left(ends, v)
        ends[at : at + 1] = [v]
    return len(ends)


def test_tails_of_parts_are_those_of_the_whole():
    r = random.Random(3)
    for _ in range(60):
        most = r.randrange(1, 12)
        values = [r.randrange(1, most + 1) for _ in range(r.randrange(40))]
        cuts = sorted(r.randrange(len(values) + 1) for _ in range(r.randrange(4)))
        whole = sequences.Tails(most)
        for a, b in zip([0, *cuts], [*cuts, len(values)]):
            part = sequences.Tails(most)
            for v in values[a:b]:
                part.add(v)
            whole = whole.then(part)
        assert whole.longest() == longest(values)


def test_rising_of_long_groups_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sequences, "HELD", 50)
    r = random.Random(5)
    rows = [("long", i, r.randrange(0, 25), 20) for i in range(3000)] + [(f"g{k}", i, r.randrange(1, 9), 7) for k in range(40) for i in range(r.randrange(30))]
    df = spark.createDataFrame(rows, "k string, at int, v int, most int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.k: x.rising for x in sequences.rising_within(df, ["k"], ["at"], "v", "most").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for k, _, v, most in rows:
        if 1 <= v <= most:
            want.setdefault(k, []).append(v)
    assert got == {k: longest(v) for k, v in want.items()}


@pytest.mark.parametrize("values, expected, likeness", [(list(range(1, 11)) * 5, 10, 0.0), ([1], 1, 0.0), (list(range(1, 11)), 10, 1.0), ([1, 2, 99, 3, 4], 4, 1.0), ([], 4, None), ([1, 1, 1, 1, 1, 2], 4, 0.0)])
def test_chapter_likeness(spark, values, expected, likeness):
    df = spark.createDataFrame([("b", i, v, expected) for i, v in enumerate(values)], "k string, at int, v int, n int")
    got = [r.likeness for r in sequences.chapter_likeness(df, ["k"], ["at"], "v", "n").collect()]
    assert got == ([likeness] if likeness is not None else [])


def test_verse_likeness_goes_back_to_one_and_two(spark):
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate([0, 2, 3, 1, 2, 2])], "k string, at int, v int")
    assert sequences.verse_likeness(df, ["k"], ["at"], "v").first().likeness == (0.5 + 1 + 1 + 1 + 1) / 5
