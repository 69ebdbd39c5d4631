from lectern.operators import books, titles

# Titles with the book and how it was found.
TITLES = {
    "GÉNESIS": ("gn", "exact"), "Libro del Génesis": ("gn", "exact"), "GÉNESIS 1": ("gn", "name"), "PRIMERA EPÍSTOLA DE SAN JUAN": ("1jn", "exact"), "Evangelio según san Juan": ("jn", "exact"),
    "SAMUEL": ("1s", "first of its series"), "El segundo libro de Samuel": ("2s", "ordinal"), "II Reyes": ("2r", "exact"), "Notas": (None, "unknown"), "  ": (None, "empty"), "Salterio": ("sal", "exact"),
    "La primera a los Corintios": ("1co", "ordinal"), "Cantar de los Cantares, poema": ("ct", "name"), "Tercera carta, san Juan": ("3jn", "ordinal"), "Apéndice": ("ap", "config"), "Historia": (None, "seccion"), "Génesis, Éxodo": ("gn", "name"),
}


def test_titles(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)] + [(99, None)], "k int, title string")
    found = titles.resolved(df, "k", "title", books.table(spark), books.ORDINALS, {"apendice": "ap", "Historia": "seccion"})
    got = {r.k: (r.book, r.mode) for r in found.collect()}
    assert [got[i] for i in range(len(TITLES))] == list(TITLES.values())
    assert got[99] == (None, "unknown")


def test_rows_with_the_same_key_keep_their_own_titles(spark):
    df = spark.createDataFrame([(1, "La primera a los Corintios"), (1, "La segunda a los Corintios"), (1, "La primera a los Corintios"), (2, "La segunda a los Corintios")], "k int, title string")
    found = titles.resolved(df, "k", "title", books.table(spark), books.ORDINALS)
    assert sorted((r.k, r.book) for r in found.collect()) == [(1, "1co"), (1, "1co"), (1, "2co"), (2, "2co")]


def test_long_names(spark):
    names = spark.createDataFrame([(1, "long", None, ["uno dos tres cuatro cinco seis siete"], [])], "ord int, id string, number int, bases array<string>, exact array<string>")
    df = spark.createDataFrame([(1, "El libro de uno dos tres cuatro cinco seis siete, otra vez")], "k int, title string")
    assert titles.resolved(df, "k", "title", names, books.ORDINALS).first().book == "long"


def test_books(spark):
    rows = {r.id: r for r in books.table(spark).collect()}
    assert len(rows) == 73 and sum(r.chapters for r in rows.values() if r.testament == "NT") == 260
    assert (rows["1r"].spoken, rows["2co"].spoken, rows["3jn"].spoken, rows["rm"].spoken) == ("Primer libro de los Reyes", "Segunda carta a los Corintios", "Tercera carta de san Juan", "Carta a los Romanos")
    whole = [k for r in rows.values() for k in r.exact]
    assert len(whole) == len(set(whole))
