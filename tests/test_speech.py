import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import spanish
from lectern.operators import alignment, chunking, timing


@pytest.mark.parametrize(
    "n, words",
    [(0, "cero"), (16, "dieciséis"), (21, "veintiuno"), (31, "treinta y uno"), (100, "cien"), (101, "ciento uno"), (555, "quinientos cincuenta y cinco"), (1000, "mil"), (21_001, "veintiún mil uno"), (46_500, "cuarenta y seis mil quinientos"), (1_000_000, "un millón"), (2_000_021, "dos millones veintiuno"), (675_000, "seiscientos setenta y cinco mil")],
)
def test_cardinals(n, words):
    assert spanish.cardinal(n) == words


@pytest.mark.parametrize(
    "text, said",
    [("21 hombres", "veintiún hombres"), ("675.000 ovejas", "seiscientas setenta y cinco mil ovejas"), ("el 3.º día", "el tercer día"), ("la 2.ª vez", "la segunda vez"), ("4b y 3,5", "4b y 3,5"), ("eran 21 en total", "eran veintiuno en total"), ("1.000.000 de años", "un millón de años"), ("21 casas", "veintiuna casas"), ("200 días", "doscientos días"), ("10.2.3.4", "10.2.3.4")],
)
def test_numbers_in_text(text, said):
    assert spanish.spoken(text) == said


def test_equal_when_heard():
    assert spanish.heard_tokens("46.500 hombres") == spanish.heard_tokens("46,500 HOMBRES") == spanish.heard_tokens("cuarenta y seis mil quinientas hombres!")
    assert spanish.heard_tokens("Un niño, una vez") == ["uno", "nino", "uno", "vez"]


@pytest.mark.parametrize("text, soft", [("LA AMADA.", "La Amada."), ("SEÑOR", "Señor"), ("Antíoco IV", "Antíoco IV"), ("la ONU", "la ONU"), ("MIL", "MIL")])
def test_capitals(text, soft):
    assert spanish.softened(text) == soft


def result(spark, said, heard, **more):
    df = spark.createDataFrame([(1, said.split(), heard.split())], "k int, said array<string>, heard array<string>")
    return alignment.verified(df, **more).first()


def test_verification(spark):
    text = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis"
    assert not result(spark, text, text).flagged
    r = result(spark, text, text.replace("cinco seis siete ocho ", ""))
    assert (r.omissions, r.omission_run, r.flagged, r.missing) == (4, 4, True, ["cinco seis siete ocho"])
    assert r.reason.startswith("4 words in a row are missing") and r.wer == 0.25
    r = result(spark, text, text.replace("cinco", "x").replace("diez", "y"))
    assert (r.substitutions, r.omissions, r.insertions, r.flagged) == (2, 0, 0, False)
    r = result(spark, text, text.replace("ocho", "ocho a b c d e"))
    assert (r.insertions, r.insertion_run, r.flagged, r.extra) == (5, 5, True, ["a b c d e"])
    r = result(spark, text, "")
    assert r.reason == "nothing was heard; 16 words in a row are missing; WER 100% > 25%"


def test_verse_times(spark):
    rows = [(1, "a b c d e f".split(), "a b x d e f".split(), [0.1, 0.5, 0.9, 1.3, 1.7, 2.1], 3.0, [("24", 0), ("25", 2), ("24", 3)])]
    df = spark.createDataFrame(rows, "k int, said array<string>, heard array<string>, heard_starts array<double>, seconds double, verses array<struct<verse:string,token:int>>")
    got = alignment.verse_times(alignment.verified(df), ["k"]).orderBy("place").collect()
    assert [(r.verse, r.time) for r in got] == [("24", 0.1), ("25", 1.3), ("24#2", 1.3)]
    silent = df.withColumns({"heard": F.array().cast("array<string>"), "heard_starts": F.array().cast("array<double>")})
    assert [r.time for r in alignment.verse_times(alignment.verified(silent), ["k"]).orderBy("place").collect()] == [0.0, 1.0, 1.5]


def units(spark, rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], "chapter string, unit int, verse string, text string, brk int, starts boolean")


def test_plan(spark):
    plan = chunking.Plan(target=60, most=120)
    long = ", ".join(f"parte {i} de algo" for i in range(40)) + "."
    rows = [("1", "Una frase corta.", 4, True), ("2", "Otra que sigue y no acaba", 2, True), ("2", "en esta línea.", 1, False), ("3", "Párrafo nuevo.", 3, True), ("4", long, 2, True), ("5", None, 2, True), ("6", "Con 21 hombres.", 2, True)]
    df = units(spark, rows)
    chunks = chunking.planned(df, ["chapter"], "unit", plan)
    got = chunks.orderBy("chunk").collect()
    assert all(len(r.text) <= 120 for r in got) and got[-1].pause_ms == 1500
    assert got[0].text == "Una frase corta. Otra que sigue y no acaba,\nen esta línea." and got[0].pause_ms == 650
    assert [(v.verse, v.token) for v in got[0].verses] == [("1", 0), ("2", 3)]
    check = chunking.plan_checks(chunks, df, ["chapter"], 120).first()
    assert check.within and check.all_verses
    assert [v.verse for r in got for v in r.verses] == ["1", "2", "3", "4", "6"]


def test_plan_cuts_back_to_a_sentence(spark):
    rows = [("1", "Primera acaba aquí.", 4, True), ("2", "segunda queda abierta", 2, True), ("3", "tercera no cabe ya en el trozo.", 2, True)]
    got = chunking.planned(units(spark, rows), ["chapter"], "unit", chunking.Plan(target=500, most=60)).orderBy("chunk").collect()
    assert [r.text for r in got] == ["Primera acaba aquí.", "segunda queda abierta tercera no cabe ya en el trozo."]


def test_simulated_voice(spark):
    df = spark.createDataFrame([(1, ["ab", "abc"])], "k int, words array<string>")
    got = timing.word_times(df, ["k"], "words").orderBy("position").collect()
    assert [(r.start, r.end) for r in got] == [(0.2, 0.42), (0.48, 0.75)]
    assert df.select(timing.spoken_seconds(F.col("words")).alias("s")).first().s == pytest.approx(0.2 + 2 * 0.18 + 0.25)
    assert pd.notna(got[0].start)
