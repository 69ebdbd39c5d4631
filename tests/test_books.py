import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import assembly, markup
from lectern.sources import canonical, epub

BOOK = """<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><body>
<h1>Viajes</h1><a id="x"/><h3>El camino</h3>
<h2 class="capitulo">Capítulo 1</h2>
<p><sup class="v">1</sup>Salió el sol<a href="#n">*</a>. <sup class="v">2</sup>Y an&shy;duvo, dijo.</p>
<p><sup>3</sup>Nueva cosa.<br/>En otra línea</p><p class="poesia">y otra más</p>
<aside>Nota que no se lee.</aside>
<h2 class="capitulo">Capítulo 2</h2><p>Empieza sin número. <sup>2</sup>Sigue <sup>[3]</sup> <sup>4</sup>fin.</p></body></html>"""
MORE = """<html><body><p>Continúa aquí. <sup>5</sup>De nuevo.</p><h1>Segundo</h1><h2>1</h2><p><sup>1</sup>Otro libro.</p></body></html>"""
INTRO = "<html><body><p>Una introducción sin marcas.</p></body></html>"
OPF = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="i" href="intro.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/>
<item id="b" href="c.html" media-type=""/><item id="s" href="s.css" media-type="text/css"/><item id="f" href="f.otf" media-type="font/otf"/></manifest>
<spine><itemref idref="i"/><itemref idref="a"/><itemref idref="none"/><itemref idref="b"/></spine></package>"""
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def book(path, extra=()):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in [("mimetype", "application/epub+zip"), ("META-INF/container.xml", CONTAINER), ("OEBPS/content.opf", OPF), ("OEBPS/intro.xhtml", INTRO), ("OEBPS/A b.xhtml", BOOK), ("OEBPS/c.html", MORE), ("OEBPS/s.css", "p.top { margin-top: 1em } @media x { .in, .b c { padding: 8px 0 } } .low { margin: 0.1em }"), ("OEBPS/f.otf", "font"), *extra]:
            z.writestr(name, text)


def encryption(algorithm, uri):
    return ("META-INF/encryption.xml", f'<encryption xmlns:e="x"><e:EncryptedData><e:EncryptionMethod Algorithm="{algorithm}"/><e:CipherData><e:CipherReference URI="{uri}"/></e:CipherData></e:EncryptedData></encryption>')


@pytest.fixture(scope="module")
def chapters(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    book(at / "one.epub")
    members = epub.read(spark, str(at))
    docs = epub.documents(members)
    events = markup.events(docs, ["epub", "spine"], "content")
    rows = assembly.placed(assembly.with_content(events, ["epub", "spine"]), ["epub"], ["spine", "ev"])
    made = assembly.units(rows, ["epub"], ["spine", "ev"], ["spine"])
    return members, docs, events, made


def test_container(chapters):
    members, docs, events, _ = chapters
    assert [(r.spine, r.href) for r in docs.orderBy("spine").collect()] == [(0, "OEBPS/intro.xhtml"), (1, "OEBPS/a b.xhtml"), (2, "OEBPS/c.html")]
    assert {r.class_name: r.em for r in epub.top_margins(epub.style_sheets(members)).collect()} == {"top": 1.0, "in": 0.5}
    assert [r.characters for r in assembly.ignored_characters(events, ["epub", "spine"]).collect()] == [len("Una introducción sin marcas.")]


@pytest.mark.parametrize("extra, protected, fonts", [([], False, 0), ([("META-INF/rights.xml", "<r/>")], True, 0), ([encryption("http://www.w3.org/2001/04/xmlenc#aes128-cbc", "OEBPS/c.html")], True, 0), ([encryption("http://www.idpf.org/2008/embedding", "OEBPS/f.otf")], False, 1)])
def test_protection(spark, tmp_path, extra, protected, fonts):
    book(tmp_path / "b.epub", extra)
    members = epub.read(spark, str(tmp_path))
    r = epub.diagnosis(members).first()
    assert (r.protected, r.obfuscated_fonts) == (protected, fonts)
    if protected:
        with pytest.raises(Exception, match="b.epub"):
            epub.documents(members).collect()


def test_not_a_container(spark, tmp_path):
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    assert epub.diagnosis(epub.read(spark, str(tmp_path))).first().protected is None


def test_units(chapters):
    made = chapters[-1]
    got = [(r.book, r.chapter, r.verse, r.text, r.brk, r.starts) for r in made.orderBy("book_no", "chapter_no", "unit").collect()]
    assert got == [
        ("Viajes", 1, "1", "Salió el sol.", 4, True),
        ("Viajes", 1, "2", "Y anduvo, dijo.", 2, True),
        ("Viajes", 1, "3", "Nueva cosa.", 3, True),
        ("Viajes", 1, "3", "En otra línea", 1, False),
        ("Viajes", 1, "3", "y otra más", 1, False),
        ("Viajes", 2, "1", "Empieza sin número.", 4, True),
        ("Viajes", 2, "2", "Sigue", 2, True),
        ("Viajes", 2, "4", "fin.", 2, True),
        ("Viajes", 2, "4", "Continúa aquí.", 3, False),
        ("Viajes", 2, "5", "De nuevo.", 2, True),
        ("Segundo", 1, "1", "Otro libro.", 4, True),
    ]
    rows = made.collect()
    assert [r.omitted for r in rows if r.chapter == 2 and r.verse == "4" and r.starts] == [["3"]]
    assert [r.implicit for r in rows if r.text.startswith("Empieza")] == [True]


def test_canonical_round_trip(spark, chapters, tmp_path):
    valid, gone = assembly.valid_pieces(chapters[-1], ["epub"])
    whole, report = assembly.resolved(valid, ["epub"])
    assert gone.count() == 0 and report.count() == 0
    texts = assembly.chapter_text(whole, ["epub", "book", "chapter"])
    for r in texts.collect():
        (tmp_path / f"{r.book}-{r.chapter}.txt").write_text(r.text)
    lines = canonical.read(spark, str(tmp_path))
    assert canonical.faults(lines).count() == 0
    back = canonical.units(lines)
    key = lambda r: (r.book, r.chapter, r.unit, r.verse, r.text, r.brk, r.starts)
    assert sorted(map(key, back.collect())) == sorted(map(key, whole.collect()))
    again = assembly.chapter_text(back.withColumn("omitted", F.array().cast("array<string>")).withColumn("implicit", F.lit(False)), ["path", "book", "chapter"])
    strip = lambda t: "\n".join(x for x in t.split("\n") if not x.startswith("%"))
    assert sorted(r.text for r in again.collect()) == sorted(strip(r.text) for r in texts.collect())


@pytest.mark.parametrize("text, fault", [("", "no header"), ("1 text", "text before the header"), ("# b 1\ntext", "text before a verse"), ("# b 1\n", "no text"), ("# b 1\n1\n", "a label without text"), ("# b 1\n# c 2\n1 x", "a second header"), ("# b\n1 x", "a header without book and number")])
def test_faults(spark, tmp_path, text, fault):
    (tmp_path / "c.txt").write_text(text + "\n")
    assert fault in {r.fault for r in canonical.faults(canonical.read(spark, str(tmp_path))).collect()}


def test_pieces_of_a_chapter(spark):
    def piece(no, labels, marked=True, size=20):
        return [("e", 1, no, "b", 3, i, v, "x" * size, 4 if i == 0 else 2, True, False, [], [], marked, len(labels), "d1") for i, v in enumerate(labels)]

    schema = "epub string, book_no int, chapter_no int, book string, chapter int, unit int, verse string, text string, brk int, starts boolean, implicit boolean, sections array<string>, omitted array<string>, marked boolean, numbered int, origin string"
    rows = piece(1, ["3", "4"]) + piece(2, ["1", "2", "5"]) + piece(3, ["1", "2"]) + piece(4, ["9"], marked=False) + piece(5, ["1", "2", "3", "6"])
    whole, report = assembly.resolved(spark.createDataFrame(rows, schema), ["epub"])
    got = whole.orderBy("unit").collect()
    # The most solid piece has four verses; that of 3 and 4 overlaps it in one.
    fates = {r.chapter_no: r.fate for r in report.collect()}
    assert fates[4] == "noise" and fates[3] == "repeated"
    assert [r.verse for r in got][-4:] == ["1", "2", "3", "6"] and [r.unit for r in got] == list(range(len(got)))


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    events = markup.events(pages, ["page_id"], "html", markup.Selectors(book="title", remove=".ad, nav, footer"))
    kinds = {r.kind for r in events.select("kind").distinct().collect()}
    assert {"text", "paragraph", "line"} <= kinds
    assert events.where("value LIKE '%track(%'").count() == 0


def laid(spark, marks):
    """Units and empty verses of one book from (document, kind, value)."""
    rows = [("e", d, i, k, v) for i, (d, k, v) in enumerate([(1, "book", "b"), *marks])]
    events = spark.createDataFrame(rows, "work string, doc int, ev int, kind string, value string")
    placed = assembly.placed(events, ["work"], ["doc", "ev"])
    made = assembly.units(placed, ["work"], ["doc", "ev"], ["doc"])
    return made, assembly.empty_verses(placed, ["work"], ["doc", "ev"], ["doc"])


def test_headings_go_to_the_next_chapter(spark):
    say = lambda *kinds: [(1, *k.partition(":")[::2]) for k in kinds]
    made, empty = laid(spark, say("section:Before", "chapter:1", "verse:1", "text:one", "verse:2", "section:In", "text:two", "verse:3", "section:End", "section:Last", "chapter:2", "verse:1", "text:x", "verse:2", "line:", "text:y", "section:Lost"))
    got = [(r.chapter, r.verse, r.sections) for r in made.orderBy("chapter_no", "unit").collect()]
    assert got == [(1, "1", ["Before"]), (1, "2", ["In"]), (2, "1", ["End", "Last"]), (2, "2", [])]
    assert [(r.chapter, r.verse) for r in empty.collect()] == [(1, "3")]


def test_prologues_and_pieces_of_other_documents(spark):
    verses = lambda doc, labels, n=20: [e for v in labels for e in ((doc, "verse", str(v)), (doc, "text", "x" * n))]
    titled = [(1, "section", "Prólogo del traductor"), *verses(1, range(1, 12)), (2, "chapter", "1"), *verses(2, range(1, 6))]
    other = [*titled, (3, "chapter", "1"), *verses(3, [9]), (4, "chapter", "1"), *verses(4, [7, 8])]
    made, _ = laid(spark, other)
    whole, report = assembly.resolved(assembly.valid_pieces(made, ["work"])[0], ["work"])
    got = {c: [r.verse for r in whole.where(f"chapter = {c}").orderBy("unit").collect()] for c in (0, 1)}
    assert got == {0: [str(i) for i in range(1, 12)], 1: ["1", "2", "3", "4", "5", "7", "8"]}
    assert [(r.fate, r.labels) for r in report.collect()] == [("lost", ["9"])]
    # Without such a title the piece is one of the chapter's.
    made, _ = laid(spark, titled[1:])
    whole, report = assembly.resolved(assembly.valid_pieces(made, ["work"])[0], ["work"])
    assert whole.where("chapter = 0").count() == 0 and report.count() == 1


def test_only_a_verse_one_opens_a_chapter_without_a_mark(spark):
    def chapters(*events):
        rows = [(1, 0, i, kind, value) for i, (kind, value) in enumerate(events)]
        placed = assembly.placed(spark.createDataFrame(rows, "work int, doc int, ev int, kind string, value string"), ["work"], ["doc", "ev"])
        return [(r.chapter, r.verse, r.text, r.sections) for r in assembly.units(placed, ["work"], ["doc", "ev"], ["doc"]).orderBy("chapter_no", "unit").collect()]

    assert chapters(("book", "b"), ("verse", "7"), ("text", "seven"), ("verse", "8"), ("text", "eight")) == []
    late = (("book", "b"), ("text", "before"), ("section", "head"), ("verse", "7"), ("text", "seven"), ("verse", "1"), ("text", "one"), ("verse", "2"), ("text", "two"))
    assert chapters(*late) == [(1, "1", "one", ["head"]), (1, "2", "two", [])]
    assert chapters(("book", "b"), ("verse", "7"), ("text", "seven"), ("chapter", "3"), ("text", "implicit"), ("verse", "2"), ("text", "two")) == [(3, "1", "implicit", []), (3, "2", "two", [])]
