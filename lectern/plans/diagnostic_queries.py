"""Queries of diagnostics, sinks, titles, structure and audio over tables that stand for chapters, titles and recordings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import assembly, audio, books, content, diagnostics, inference, markup, sinks, titles
from lectern.operators.lineage import cut

from .catalogue import query, table

# Lines of orders as verses: a book for some parts, a chapter for each supplier's number.
CHAPTERS = "(SELECT 'b' || (l_partkey % 15) AS book, (l_suppkey % 60)::INTEGER AS chapter, l_orderkey % 3 <> 0 AS marked, 20 + l_partkey % 15 * 2 AS expected FROM lineitem)"
VERSES = "(SELECT l_orderkey, l_linenumber::VARCHAR AS verse, repeat('x', l_quantity::INTEGER) AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS place FROM lineitem)"


def chapters(spark, sf_dir):
    book = F.col("l_partkey") % 15
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), book.cast("string")).alias("book"), (F.col("l_suppkey") % 60).cast("int").alias("chapter"), (F.col("l_orderkey") % 3 != 0).alias("marked"), (20 + book * 2).alias("expected"))
    return rows.drop("expected"), rows.select("book", "expected").distinct()


def verses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("verse"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"), F.lit(True).alias("starts"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query("chapters_outside", f"SELECT book, expected, list_sort(list(DISTINCT chapter))[1:10] AS beyond FROM {CHAPTERS} WHERE chapter > expected GROUP BY book, expected")
def chapters_outside(spark, sf_dir):
    return diagnostics.outside(*chapters(spark, sf_dir))


@query("assumed_first_chapters", f"SELECT DISTINCT book FROM {CHAPTERS} WHERE chapter = 1 AND NOT marked AND expected > 1")
def assumed_first_chapters(spark, sf_dir):
    own, expected = chapters(spark, sf_dir)
    return diagnostics.assumed_first(own, expected)


BOOK_ROWS = ", ".join(f"({b[0]}, '{b[1]}', {b[4]})" for b in books.BOOKS)


@query(
    "book_totals",
    f"""WITH b AS (SELECT * FROM (VALUES {BOOK_ROWS}) t(ord, id, chapters)),
    u AS (SELECT coalesce((SELECT id FROM b WHERE ord = l_partkey % 75 + 1), 'x' || l_partkey % 75) AS book, l_suppkey % 60 AS chapter, l_linenumber AS verse, l_quantity::BIGINT AS n FROM lineitem)
    SELECT any_value(ord)::INTEGER AS ord, book, count(DISTINCT chapter) FILTER (WHERE chapter >= 1) AS found, coalesce(any_value(chapters), 0)::INTEGER AS expected, count(DISTINCT (chapter, verse)) AS verses, sum(n)::BIGINT AS characters
    FROM u LEFT JOIN b ON id = book GROUP BY book""",
)
def book_totals(spark, sf_dir):
    """Lines of orders as verses of the 73 books and of two that nobody knows."""
    place, known = (F.col("l_partkey") % 75 + 1).cast("int"), books.table(spark)
    ids = F.array(*[F.lit(b[1]) for b in books.BOOKS])
    book = F.coalesce(F.get(ids, place - 1), F.concat(F.lit("x"), (F.col("l_partkey") % 75).cast("string")))
    units = table(spark, sf_dir, "lineitem").select(book.alias("book"), (F.col("l_suppkey") % 60).alias("chapter"), F.col("l_linenumber").alias("verse"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    return diagnostics.book_totals(units, known)


@query("prologue_flags", f"SELECT book, bool_or(chapter = 0) AS prologue, count(DISTINCT chapter) FILTER (WHERE chapter > 0) AS chapters FROM {CHAPTERS} GROUP BY book")
def prologue_flags(spark, sf_dir):
    return diagnostics.has_prologue(chapters(spark, sf_dir)[0])


@query(
    "first_verse_acclamations",
    f"""SELECT l_orderkey, coalesce(max(verse) FILTER (WHERE place = 1) = '1' AND max(verse) FILTER (WHERE place = 2) = '1' AND max(len(text)) FILTER (WHERE place = 1) <= 25, false) AS acclamation,
    count(*) FILTER (WHERE verse = '1') AS ones FROM {VERSES} GROUP BY l_orderkey""",
)
def first_verse_acclamations(spark, sf_dir):
    return diagnostics.short_first(verses(spark, sf_dir), ["l_orderkey"], ORDER)


@query("chapters_refused", f"SELECT l_orderkey, count(*) AS ones FROM {VERSES} WHERE verse = '1' GROUP BY l_orderkey HAVING count(*) >= 3")
def chapters_refused(spark, sf_dir):
    return diagnostics.several_chapters(verses(spark, sf_dir), ["l_orderkey"])


@query(
    "edition_notes",
    f"""WITH a AS (SELECT l_orderkey, coalesce(max(verse) FILTER (WHERE place = 1) = '1' AND max(verse) FILTER (WHERE place = 2) = '1' AND max(len(text)) FILTER (WHERE place = 1) <= 25, false) AS short, count(*) FILTER (WHERE verse = '1') AS ones FROM {VERSES} GROUP BY l_orderkey)
    SELECT l_orderkey, 'begins with a short line numbered 1' AS note FROM a WHERE short AND ones = 2
    UNION ALL SELECT l_orderkey, 'absent: ' || string_agg(verse || 'b', ', ' ORDER BY place) FROM {VERSES} WHERE len(text) = 50 GROUP BY l_orderkey""",
)
def edition_notes(spark, sf_dir):
    absent = F.when(F.length("text") == 50, F.array(F.concat("verse", F.lit("b")))).otherwise(F.array().cast("array<string>"))
    return diagnostics.edition_notes(verses(spark, sf_dir).withColumn("omitted", absent), ["l_orderkey"], ORDER)


@query(
    "mark_concentration",
    """SELECT user_id % 5 AS book, user_id AS doc, count(*) AS n FROM events e WHERE event_type <> 'view' GROUP BY user_id
       QUALIFY 100 * count(*) >= 20 * max(count(*)) OVER (PARTITION BY user_id % 5)""",
)
def mark_concentration(spark, sf_dir):
    marks = table(spark, sf_dir, "events").where("event_type <> 'view'").select((F.col("user_id") % 5).alias("book"), F.col("user_id").alias("doc"))
    return diagnostics.concentrated(marks, ["book"], "doc")


@query("group_examples", "SELECT event_type, n, list(event_id ORDER BY event_id) AS examples FROM (SELECT event_type, event_id, count(*) OVER w AS n, row_number() OVER (w ORDER BY event_id) AS r FROM events WINDOW w AS (PARTITION BY event_type)) WHERE r <= 6 GROUP BY ALL")
def group_examples(spark, sf_dir):
    return diagnostics.examples(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], "event_id")


@query("run_totals", "SELECT count(*) AS chapters, sum((o_totalprice > 200000)::INT)::BIGINT AS flagged, round(sum(o_orderkey % 1000 / 10), 3) AS seconds, round(sum(o_orderkey % 100 / 100), 6) AS usd FROM orders")
def run_totals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return diagnostics.run_totals(orders.select((F.col("o_totalprice") > 200000).cast("int").alias("flagged"), (F.col("o_orderkey") % 1000 / 10).alias("seconds"), (F.col("o_orderkey") % 100 / 100).alias("usd")))


@query("wanted_documents", "SELECT page_id, regexp_matches(url, '(?:/1)|(?:7$)') AS ignored FROM pages WHERE NOT regexp_matches(url, '[02468]$')")
def wanted_documents(spark, sf_dir):
    pages = diagnostics.wanted(table(spark, sf_dir, "pages"), "url", ignore="[02468]$")
    return pages.select("page_id", diagnostics.ignored_title(F.col("url"), ["/1", "7$"]).alias("ignored"))


@query(
    "chapter_index_json",
    """SELECT conv_id, '{"conv_id":' || conv_id || ',"seconds":' || (count(*) * 2) || '.0,"verses":[' || string_agg('{"name":"' || turn || '","start":' || (turn * 2) || '.0}', ',' ORDER BY turn) || '],"sections":[' ||
       coalesce(string_agg('{"name":"' || role || '","start":' || (turn * 2) || '.0}', ',' ORDER BY turn) FILTER (WHERE turn % 4 = 0), '') || ']}' AS json FROM conversations GROUP BY conv_id""",
)
def chapter_index_json(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("turn").cast("string").alias("verse"), F.col("role").alias("title"), (F.col("turn") * 2).cast("double").alias("start"))
    seconds = turns.groupBy("conv_id").agg((F.count("*") * 2).cast("double").alias("seconds"))
    return sinks.chapter_index(turns, ["conv_id"], turns.where("position % 4 = 0"), seconds)


@query("verification_json", """SELECT conv_id, '[' || string_agg('{"chunk":' || turn || ',"flagged":' || (len(text) > 200) || '}', ',' ORDER BY turn) || ']' AS json FROM conversations GROUP BY conv_id""")
def verification_json(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk"), (F.length("text") > 200).alias("flagged"))
    return sinks.verification_json(rows, ["conv_id"])


@query("content_keys", """SELECT doc_id, left(sha256('{"firma": "x", "texto": ' || CAST(to_json(text) AS VARCHAR) || ', "variante": ' || doc_id % 3 || '}'), 32) AS key FROM documents""")
def content_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content.cache_key(F.lit("x"), F.col("text"), F.col("doc_id") % 3).alias("key"))


# Nations as books: those of uneven regions in series of three, titles made of them by orders.
NAMES = "(SELECT n_nationkey AS k, replace(lower(n_name), '_', ' ') AS base, n_regionkey % 2 = 1 AS series FROM nation)"


@query(
    "titles_resolved",
    f"""WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'PRIMERA a ' WHEN 1 THEN '2 ' WHEN 2 THEN '' WHEN 3 THEN 'III, ' WHEN 4 THEN 'sobre ' ELSE 'Nota ' END || CASE WHEN o_orderkey % 6 = 5 THEN 'x' ELSE n_name END || CASE o_orderkey % 4 WHEN 0 THEN ' 1' ELSE '' END AS title
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT k, trim(regexp_replace(regexp_replace(lower(title), '[^\\pL\\pN\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM t),
    f AS (SELECT p.k, base, series, n.k AS book, string_split(trim(left(t, strpos(' ' || t || ' ', ' ' || base || ' ') - 1)), ' ') AS before, t FROM p, {NAMES} n WHERE strpos(' ' || t || ' ', ' ' || base || ' ') > 0),
    o AS (SELECT *, list_filter([CASE WHEN list_has_any(before, ['1', 'i', 'primer', 'primero', 'primera']) THEN 1 END, CASE WHEN list_has_any(before, ['2', 'ii', 'segundo', 'segunda']) THEN 2 END, CASE WHEN list_has_any(before, ['3', 'iii', 'tercer', 'tercero', 'tercera']) THEN 3 END], lambda x: x IS NOT NULL) AS said FROM f),
    r AS (SELECT k, CASE WHEN NOT series AND t = base THEN base WHEN NOT series AND len(said) = 0 THEN base WHEN series AND len(said) > 0 THEN base || list_min(said) WHEN series AND len(said) = 0 THEN base || '1' END AS book,
          CASE WHEN NOT series AND t = base THEN 'exact' WHEN NOT series AND len(said) = 0 THEN 'name' WHEN series AND len(said) > 0 THEN 'ordinal' WHEN series THEN 'first of its series' END AS mode, row_number() OVER (PARTITION BY k ORDER BY len(base) DESC, base) AS n FROM o),
    b AS (SELECT * FROM r WHERE book IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY n) = 1)
    SELECT k, book, coalesce(mode, 'unknown') AS mode FROM p LEFT JOIN b USING (k)""",
)
def titles_resolved(spark, sf_dir):
    from lectern.operators.books import ORDINALS

    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    before = F.element_at(F.array(*map(F.lit, ["PRIMERA a ", "2 ", "", "III, ", "sobre ", "Nota "])), (o % 6 + 1).cast("int"))
    made = rows.select(o.alias("k"), F.concat(before, F.when(o % 6 == 5, "x").otherwise(F.col("n_name")), F.when(o % 4 == 0, " 1").otherwise("")).alias("title"))
    nation = table(spark, sf_dir, "nation").select(F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")).alias("base"), (F.col("n_regionkey") % 2 == 1).alias("series"))
    number = F.explode(F.when(F.col("series"), F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(None).cast("int"))))
    names = nation.select("base", number.alias("number")).withColumn("id", F.concat("base", F.coalesce(F.col("number").cast("string"), F.lit(""))))
    names = names.select(F.xxhash64("base", "number").alias("ord"), "id", "number", F.array("base").alias("bases"), F.when(F.col("number").isNull(), F.array("base")).otherwise(F.array().cast("array<string>")).alias("exact"))
    return titles.resolved(made, "k", "title", names, ORDINALS)


# The first forty orders of some customers as a book's chapters, their lines as verses.
BOOK = """(SELECT o_custkey % 10 AS book, dense_rank() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS chapter, o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS verse
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def book_pages(spark, sf_dir, said=None):
    """(book, doc, html): a document for each ten chapters; verse numbers in sup or b, chapters in h2 or a class."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("book", F.col("o_custkey") % 10)
    per = rows.groupBy("book", "o_orderkey").agg(F.count("*").alias("n"))
    per = per.withColumn("chapter", F.row_number().over(Window.partitionBy("book").orderBy("o_orderkey"))).where("chapter <= 40")
    even = F.col("book") % 2 == 0
    mark = lambda v: F.when(even, F.concat(F.lit("<sup class='v'>"), v, F.lit("</sup>"))).otherwise(F.concat(F.lit("<b>"), v, F.lit("</b>")))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(F.lit("<p class='n'>"), mark(i.cast("string")), F.lit(" "), F.lit("words of the verse.") if said is None else said, F.lit("</p>"))), "")
    head = F.when(even, F.concat(F.lit("<h2>Cap. "), F.col("chapter").cast("string"), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p class='t'>"), F.col("chapter").cast("string"), F.lit("</p>")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", F.concat(head, body).alias("html")))), lambda x: x["html"]), "")
    return per.groupBy("book", F.floor((F.col("chapter") - 1) / 10).cast("int").alias("doc")).agg(F.concat(F.lit("<body>"), whole, F.lit("</body>")).alias("html"))


@query(
    "structure_suggestion",
    f"""SELECT book, CASE book % 2 WHEN 0 THEN ['sup.v'] ELSE ['b'] END AS verses, count(*)::INTEGER AS verse_marks, CASE book % 2 WHEN 0 THEN 'h2' ELSE 'p.t' END AS chapter, max(chapter)::INTEGER AS chapter_marks, 100 AS short_line
    FROM {BOOK} WHERE chapter <= 40 GROUP BY book""",
)
def structure_suggestion(spark, sf_dir):
    pages = book_pages(spark, sf_dir)
    profile = cut(markup.profile(pages, ["book", "doc"], "html"))
    expected = pages.select("book").distinct().withColumn("expected", F.lit(40))
    margins = spark.createDataFrame([("n", 1.0)], "class string, em double")
    return inference.suggested(profile, ["book"], "doc", expected, margins).select("book", "verses", "verse_marks", "chapter", "chapter_marks", "short_line")


@query(
    "kept_configuration",
    f"""SELECT book, CASE WHEN book % 2 = 1 THEN 'suggested' WHEN book % 5 = 4 THEN 'current' ELSE 'reading' END AS config, max(chapter)::BIGINT AS chapters, count(*)::BIGINT AS verses, (40 - max(chapter))::BIGINT AS warnings
    FROM {BOOK} WHERE chapter <= 40 GROUP BY book""",
)
def kept_configuration(spark, sf_dir):
    """Books whose marks the selectors don't know take the suggestion; of the others those in short lines take its pauses."""
    long = F.when(F.col("book") % 5 == 4, F.repeat(F.lit("words of a long verse, "), 8)).otherwise(F.lit("words of the verse."))
    pages = book_pages(spark, sf_dir, long)
    expected = pages.select("book").distinct().withColumn("expected", F.lit(40))
    return inference.tried(pages, ["book"], "doc", "html", expected, spark.createDataFrame([("n", 1.0)], "class string, em double"))


@query(
    "assembled_chapters",
    """WITH c AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS chapter FROM conversations),
    v AS (SELECT * FROM c WHERE role <> 'user' AND chapter > 0)
    SELECT conv_id, chapter::INTEGER AS chapter, count(*) FILTER (WHERE turn % 5 <> 3) AS units, count(*) FILTER (WHERE turn % 5 = 3) AS empty FROM v GROUP BY conv_id, chapter HAVING count(*) FILTER (WHERE turn % 5 <> 3) > 0""",
)
def assembled_chapters(spark, sf_dir):
    """Conversations as books: what a user says opens a chapter, an answer is a verse, some without text."""
    turns = table(spark, sf_dir, "conversations")
    chapter = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = turns.withColumn("c", chapter).where("c > 0")
    opens = F.array(F.struct(F.lit("chapter").alias("kind"), F.col("c").cast("string").alias("value")))
    verse = F.struct(F.lit("verse").alias("kind"), F.col("turn").cast("string").alias("value"))
    said = F.struct(F.lit("text").alias("kind"), F.concat(F.lit("said "), F.col("turn").cast("string")).alias("value"))
    made = F.when(F.col("role") == "user", opens).when(F.col("turn") % 5 == 3, F.array(verse)).otherwise(F.array(verse, said))
    rows = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.posexplode(made).alias("i", "e")).select("conv_id", "turn", F.col("i").cast("int").alias("i"), "e.*")
    first = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit(0).alias("i"), F.lit("book").alias("kind"), F.lit("b").alias("value"))
    placed = assembly.placed(first.unionByName(rows).withColumn("doc", F.lit(1)), ["conv_id"], ["turn", "i"])
    made = assembly.units(placed, ["conv_id"], ["turn", "i"], ["doc"])
    empty = assembly.empty_verses(placed, ["conv_id"], ["turn", "i"], ["doc"]).groupBy("conv_id", "chapter").agg(F.count("*").alias("empty"))
    return made.groupBy("conv_id", "chapter").agg(F.count("*").alias("units")).join(empty, ["conv_id", "chapter"], "left").select("conv_id", "chapter", "units", F.coalesce("empty", F.lit(0)).alias("empty"))


@query(
    "wav_trimmed",
    """SELECT s_suppkey, 24000 AS rate, round((s_suppkey % 7) * 0.1 + 0.3 + (s_suppkey % 3) * 0.1, 3) AS seconds, round(0.3 + least(0.04, (s_suppkey % 7) * 0.1) + least(0.04, (s_suppkey % 3) * 0.1), 1) AS heard, round(greatest(0, (s_suppkey % 7) * 0.1 - 0.04), 3) AS offset FROM supplier""",
)
def wav_trimmed(spark, sf_dir):
    """A recording for each supplier, silence before and after it, read back and cut."""
    k = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select("s_suppkey", audio.spoken()((k % 7 * 100).cast("int"), F.lit(0.3), (k % 3 * 100).cast("int")).alias("wav"))
    read = made.select("s_suppkey", audio.read_wav("wav").alias("w"))
    cut = read.select("s_suppkey", "w", audio.trim()("w.pcm", "w.rate").alias("t"))
    return cut.select("s_suppkey", F.col("w.rate").alias("rate"), F.round(audio.duration(F.col("w.pcm"), F.col("w.rate")), 3).alias("seconds"), F.round(audio.duration(F.col("t.pcm"), F.col("w.rate")), 1).alias("heard"), F.round("t.offset", 3).alias("offset"))
