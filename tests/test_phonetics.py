import pytest
from pyspark.sql import functions as F

from lectern.functions import phonetics, speech

# Words with their sounds where c and z are s, and where they are θ.
WORDS = {
    "mar": ("maɾ", "maɾ"), "por": ("poɾ", "poɾ"), "decir": ("desˈiɾ", "deθˈiɾ"), "oír": ("oˈiɾ", "oˈiɾ"), "mujer": ("muxˈeɾ", "muxˈeɾ"),
    "construir": ("konstɾwˈiɾ", "konstɾwˈiɾ"), "mártir": ("mˈaɾtiɾ", "mˈaɾtiɾ"), "confiar": ("konfjˈaɾ", "konfjˈaɾ"), "honrar": ("onrˈaɾ", "onrˈaɾ"),
    "averiguar": ("abeɾiɡwˈaɾ", "abeɾiɡwˈaɾ"), "llorar": ("ʝoɾˈaɾ", "ʝoɾˈaɾ"), "quitar": ("kitˈaɾ", "kitˈaɾ"), "Baltasar": ("baltasˈaɾ", "baltasˈaɾ"),
    "tierra": ("tjˈera", "tjˈera"), "cielo": ("sjˈelo", "θjˈelo"), "casa": ("kˈasa", "kˈasa"), "queso": ("kˈeso", "kˈeso"), "guitarra": ("ɡitˈara", "ɡitˈara"),
    "llave": ("ʝˈabe", "ʝˈabe"), "niño": ("nˈiɲo", "nˈiɲo"), "reloj": ("relˈox", "relˈox"), "canción": ("kansjˈon", "kanθjˈon"), "muy": ("mwi", "mwi"),
    "rey": ("rej", "rej"), "vergüenza": ("beɾɡwˈensa", "beɾɡwˈenθa"), "taxi": ("tˈaksi", "tˈaksi"), "chico": ("tʃˈiko", "tʃˈiko"), "viuda": ("bjˈuda", "bjˈuda"),
    "y": ("i", "i"), "abc1": (None, None), "3x": (None, None), "brr": (None, None), "": (None, None),
}


def test_sounds(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", phonetics.sounds(F.col("w")).alias("a"), phonetics.sounds(F.col("w"), seseo=False).alias("b"))
    assert {r.w: (r.a, r.b) for r in df.collect()} == WORDS
    strong = spark.createDataFrame([("dormir",), ("mar",)], "w string").select(phonetics.sounds(F.col("w"), final="fuerte").alias("s"))
    assert [r.s for r in strong.collect()] == ["doɾmˈir", "mar"]


def test_marks_and_back(spark):
    text = 'Van al mar, y el mar nunca \\{"word": "ver", "pronounce": "x"\\} ir_a 3r por eso; AMOR'
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    soft, kept, rr = (r for r in [phonetics.with_final_r(F.col("t"), "suave"), phonetics.with_final_r(F.col("t"), "fuerte", exclude=("mar",)), phonetics.with_final_r(F.col("t"), "rr")])
    rows = df.select(soft.alias("a"), kept.alias("b"), rr.alias("c"), phonetics.without_marks(soft).alias("d")).collect()
    a, b, c, d = rows[0]
    assert a.count('\\{"word": "mar", "pronounce": "maɾ"\\}') == 2 and '"pronounce": "poɾ"' in a and '"pronounce": "x"' in a and '"AMOR", "pronounce": "amˈoɾ"' in a
    assert "al mar, y el mar" in b and '"pronounce": "por"' in b
    assert c == 'Van al marr, y el marr nunca \\{"word": "ver", "pronounce": "x"\\} ir_a 3r porr eso; AMORR'
    assert d == "Van al mar, y el mar nunca ver ir_a 3r por eso; AMOR"
    assert tuple(rows[1]) == (None,) * 4 and tuple(rows[2]) == ("",) * 4
    assert [r.said for r in phonetics.variants(spark.createDataFrame([("mar",)], "text string")).collect()] == ["mar", '\\{"word": "mar", "pronounce": "maɾ"\\}', '\\{"word": "mar", "pronounce": "mar"\\}', "marr"]


def test_requests():
    mark = '\\{"word": "a. b", "pronounce": "x"\\}'
    assert phonetics.request_parts("short", 10) == ["short"]
    assert phonetics.request_parts("One two. Three four, five six.", 21) == ["One two.", "Three four, five six."]
    parts = phonetics.request_parts(f"{mark} {mark} {mark}", 60)
    assert parts == [mark] * 3
    assert phonetics.request_parts("x" * 30, 20) is None and phonetics.request_parts(f"{mark} x", 20) is None
    assert phonetics.request_parts("  a b  ", 3) == ["a", "b"] or phonetics.request_parts("  a b  ", 4) == ["  a", "b  "]
    text = " ".join(f"w{i}" for i in range(3000))
    parts = phonetics.request_parts(text, 50)
    assert " ".join(parts) == text and max(map(len, parts)) <= 50


def test_a_text_that_cannot_be_cut_does_not_end_the_query(spark):
    df = spark.createDataFrame([(1, "x" * 30), (2, "one two"), (3, None), (4, "")], "k int, text string")
    got = {r.k: (r.p.parts, r.p.fault is None) if r.p else (None, True) for r in df.select("k", phonetics.requests(20)("text").alias("p")).collect()}
    assert got == {1: (None, False), 2: (["one two"], True), 3: (None, True), 4: ([""], True)}


def test_numbers_of_chapters(spark):
    numbers = [0, 1, 21, 99, 100, 101, 200, 201, 555, 999, 1000, 1001, 2000, 21_001, 100_000, 121_121, 999_999]
    df = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", speech.number_word(F.col("n")).alias("said"))
    from lectern.functions.spanish import cardinal

    assert {r.n: r.said for r in df.collect()} == {n: cardinal(n) for n in numbers}
    assert spark.range(1).select(speech.announcement(F.lit("gn"), F.lit("Génesis"), F.lit(300), F.lit(201)).alias("x")).first().x == "Génesis. Capítulo doscientos uno."


def test_speech_columns(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    say = lambda b, n, c: speech.announcement(F.lit(b), F.lit("Book"), F.lit(n), F.lit(c))
    assert list(row(say("x", 3, 0), say("sal", 150, 21), say("x", 1, 1), say("x", 3, 2))) == ["Book. Prólogo.", "Salmo veintiuno.", "Book.", "Book. Capítulo dos."]
    assert row(speech.range_numbers(F.lit("1, 4,7-8,4")))[0] == [1, 4, 7, 8]
    for bad in ("", "3-1", "a", "1-"):
        assert row(speech.range_numbers(F.lit(bad)))[0] is None
    labels = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert list(row(speech.minutes(F.lit(75.6)), speech.verse_range(labels()), speech.verse_range(labels("3")), speech.verse_range(labels("3", "4", "9")))) == ["01:16", "announcement", "3", "3–9"]
    assert row(speech.name_hints(F.lit("Ana y Luz, ANA de Ávila; Ana")))[0] == ["Ana", "Luz", "Ávila"]
