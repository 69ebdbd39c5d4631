"""Queries of the operators that need pandas functions: checked by tests and invariants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import spanish
from lectern.functions import text as tx
from lectern.operators import alignment, chunking, inference, markup, sequences, timing

from .catalogue import query, table


def chapter_units(spark, sf_dir):
    """Documents as chapters: each sentence a unit, the first after a line break a paragraph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    rows = docs.select("doc_id", "line", F.posexplode(tx.sentences(F.col("text"))).alias("part", "text"))
    brk = F.when(F.col("part") == 0, chunking.PARAGRAPH).otherwise(chunking.VERSE)
    return rows.select("doc_id", (F.col("line").cast("long") * 100_000 + F.col("part")).alias("unit"), F.concat_ws(".", "line", "part").alias("verse"), tx.clean(F.col("text")).alias("text"), brk.alias("brk"), F.lit(True).alias("starts"))


@query("chunk_plan")
def chunk_plan(spark, sf_dir):
    chunks = chunking.planned(chapter_units(spark, sf_dir), ["doc_id"], "unit")
    return chunks.select("doc_id", "chunk", F.length("text").alias("chars"), "units", F.size("verses").alias("verses"), "pause_ms")


@query(
    "chunk_invariants",
    """SELECT doc_id, true AS within, true AS all_verses, md5(regexp_replace(text, '\\s+', '', 'g')) AS letters FROM documents WHERE regexp_matches(text, '[^ \\t\\n]')""",
)
def chunk_invariants(spark, sf_dir):
    """Whether chunks are short enough and have every verse once, and a digest of all their letters in order."""
    units = chapter_units(spark, sf_dir)
    chunks = chunking.planned(units, ["doc_id"], "unit")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")
    letters = chunks.groupBy("doc_id").agg(F.md5(F.regexp_replace(said, r"\s+", "").cast("binary")).alias("letters"))
    return chunking.plan_checks(chunks, units, ["doc_id"]).join(letters, "doc_id")


# Words of numbers below 1000 in SQL, before a masculine and a feminine noun.
SQL_WORDS = """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 1000)::INTEGER AS n FROM lineitem),
    r AS (SELECT *, n % 100 AS r, list_extract(['cero','uno','dos','tres','cuatro','cinco','seis','siete','ocho','nueve','diez','once','doce','trece','catorce','quince','dieciséis','diecisiete','dieciocho','diecinueve','veinte','veintiuno','veintidós','veintitrés','veinticuatro','veinticinco','veintiséis','veintisiete','veintiocho','veintinueve'], n % 100 + 1) AS low,
      list_extract(['treinta','cuarenta','cincuenta','sesenta','setenta','ochenta','noventa'], n % 100 // 10 - 2) AS ten, list_extract(['uno','dos','tres','cuatro','cinco','seis','siete','ocho','nueve'], n % 10) AS one,
      list_extract(['ciento','doscientos','trescientos','cuatrocientos','quinientos','seiscientos','setecientos','ochocientos','novecientos'], n // 100) AS hundred FROM n),
    w AS (SELECT *, CASE WHEN r < 30 THEN low ELSE ten || CASE WHEN r % 10 > 0 THEN ' y ' || one ELSE '' END END AS rest FROM r),
    c AS (SELECT *, CASE WHEN n = 100 THEN 'cien' WHEN n < 100 THEN rest WHEN r = 0 THEN hundred ELSE hundred || ' ' || rest END AS said FROM w)"""


@query(
    "number_words",
    SQL_WORDS + """ SELECT n, count(*) AS lines, 'eran ' || said || ', ' || regexp_replace(CASE WHEN said LIKE '%veintiuno' THEN left(said, len(said) - 3) || 'ún' WHEN said LIKE '%uno' THEN left(said, len(said) - 1) ELSE said END, '$', ' libros y ') ||
    CASE WHEN said LIKE '%uno' THEN left(replace(said, 'ientos', 'ientas'), len(said) - 1) || 'a' ELSE replace(said, 'ientos', 'ientas') END || ' casas' AS said FROM c GROUP BY n, said""",
)
def number_words(spark, sf_dir):
    n = (F.col("l_partkey") % 1000).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(n.alias("n")).agg(F.count("*").alias("lines"))
    text = F.format_string("eran %d, %d libros y %d casas", "n", "n", "n")
    return rows.select("n", "lines", spanish.spoken_numbers(text).alias("said"))


@query(
    "caps_softening",
    """WITH c AS (SELECT c_custkey, upper(split_part(n_name, '_', 1)) || CASE n_nationkey % 3 WHEN 1 THEN ' PUEBLO' WHEN 2 THEN ' DEL MAR' ELSE '' END AS n, upper(c_mktsegment) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, array_to_string(list_transform(string_split(n, ' '), lambda x: x[1] || lower(x[2:])), ' ') || ', ' || m[1] || lower(m[2:]) || ' IV de ' || left(n, 3) || ' y MI' AS soft FROM c""",
)
def caps_softening(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("n_nationkey") % 3
    name = F.concat(F.upper(F.substring_index("n_name", "_", 1)), F.when(k == 1, " PUEBLO").when(k == 2, " DEL MAR").otherwise(""))
    return rows.select("c_custkey", spanish.soft_capitals(F.concat(name, F.lit(", "), F.upper("c_mktsegment"), F.lit(" IV de "), F.left(name, F.lit(3)), F.lit(" y MI"))).alias("soft"))


def heard_turns(spark, sf_dir):
    """Each turn as it would be heard with every eleventh word left out and every seventeenth changed."""
    said = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    heard = F.transform(F.filter(F.transform("said", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["i"] % 11 != 10), lambda x: F.when(x["i"] % 17 == 16, "changed").otherwise(x["w"]))
    return turns.withColumn("heard", heard)


def placed(said):
    """Each word told apart by its place."""
    return F.transform(said, lambda w, i: F.concat_ws("_", w, i))


def misheard(own):
    """Words without every eleventh, every seventeenth changed."""
    kept = F.filter(F.transform(own, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["i"] % 11 != 10)
    return F.transform(kept, lambda x: F.when(x["i"] % 17 == 16, F.concat(F.lit("changed"), x["w"])).otherwise(x["w"]))


def apart(said, heard="heard"):
    """said with each word told apart by its place, and what is heard of it: every eleventh left out, every seventeenth changed."""
    own = placed(said)
    return own.alias("said"), misheard(own).alias(heard)


# Words of a text in SQL, with what is left out and changed.
SQL_WORDS_OF = "list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')"
SQL_FAULTS = "len(list_filter(range(len(w)), lambda i: i % 11 = 10)) AS o, len(list_filter(range(len(w)), lambda i: i % 17 = 16 AND i % 11 <> 10)) AS c"


@query(
    "benchmark_align",
    f"""SELECT item_id, c::INTEGER AS substitutions, o::INTEGER AS omissions, 0 AS insertions, (o > 0)::INTEGER AS omission_run, 0 AS insertion_run, round((o + c) / greatest(1, n), 4) AS wer, (o + c) / greatest(1, n) > 0.25 AS flagged
    FROM (SELECT item_id, len(w) AS n, {SQL_FAULTS} FROM (SELECT item_id, {SQL_WORDS_OF} AS w FROM benchmark))""",
)
def benchmark_align(spark, sf_dir):
    said = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").select("item_id", said.alias("words")).select("item_id", *apart(F.col("words")))
    return alignment.verified(items).select("item_id", "substitutions", "omissions", "insertions", "omission_run", "insertion_run", "wer", "flagged")


@query(
    "wer_by_doc",
    """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM conversations),
    n AS (SELECT conv_id, turn, len(w) AS n, len(list_filter(range(len(w)), lambda i: i % 11 = 10)) AS o, len(list_filter(range(len(w)), lambda i: i % 17 = 16 AND i % 11 <> 10)) AS c FROM w)
    SELECT conv_id, turn, c::INTEGER AS substitutions, o::INTEGER AS omissions, round((o + c) / greatest(1, n), 4) AS wer, (o + c) / greatest(1, n) > 0.25 AS flagged FROM n""",
)
def wer_by_doc(spark, sf_dir):
    """Turns whose words are told apart by their places, so that what was left out and changed is known."""
    turns = heard_turns(spark, sf_dir).select("conv_id", "turn", *apart(F.col("said")))
    return alignment.verified(turns).select("conv_id", "turn", "substitutions", "omissions", "wer", "flagged")


def reheard(words):
    """What is heard of words: every eleventh not, every seventeenth as the word before it, and two words again after every 23rd."""
    at = lambda i: F.get(words, i)
    one = lambda w, i: F.when(i % 11 == 10, F.array().cast("array<string>")).when(i % 17 == 16, F.array(at(i - 1))).when(i % 23 == 22, F.array(w, at(i - 2), at(i - 1))).otherwise(F.array(w))
    return F.flatten(F.transform(words, one))


@query(
    "document_error_rates",
    f"""WITH RECURSIVE d AS (SELECT doc_id, {SQL_WORDS_OF} AS w FROM documents),
    c AS (SELECT doc_id, k, w[100 * k + 1:100 * k + 100] AS s FROM (SELECT doc_id, w, unnest(range((len(w) + 99) // 100)) AS k FROM d)),
    h AS MATERIALIZED (SELECT *, flatten(list_transform(range(len(s)), lambda i: CASE WHEN i % 11 = 10 THEN [] WHEN i % 17 = 16 THEN [s[i]] WHEN i % 23 = 22 THEN [s[i + 1], s[i - 1], s[i]] ELSE [s[i + 1]] END)) AS h FROM c),
    p AS (SELECT x.doc_id, x.k, i, j FROM (SELECT doc_id, k, unnest(range(len(s))) AS i, unnest(s) AS w FROM h) x JOIN (SELECT doc_id, k, unnest(range(len(h))) AS j, unnest(h) AS w FROM h) y USING (doc_id, k, w)),
    r AS MATERIALIZED (SELECT doc_id, k, min(i) AS i, min(j) AS j, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k, i - j ORDER BY i) AS g FROM p) GROUP BY doc_id, k, i - j, g),
    q AS (
      SELECT doc_id, k, 0::BIGINT AS a, len(s)::BIGINT AS b, 0::BIGINT AS c, len(h)::BIGINT AS e, false AS done FROM h
      UNION ALL
      SELECT doc_id, k, CASE side WHEN 1 THEN t.i + t.n ELSE a END, CASE side WHEN 0 THEN t.i ELSE b END, CASE side WHEN 1 THEN t.j + t.n ELSE c END, CASE side WHEN 0 THEN t.j ELSE e END, side = 2
      FROM (SELECT q.doc_id, q.k, a, b, c, e, min({{'o': -(least(i + n, b, e + i - j) - greatest(i, a, c + i - j)), 'i': greatest(i, a, c + i - j), 'j': greatest(i, a, c + i - j) - i + j, 'n': least(i + n, b, e + i - j) - greatest(i, a, c + i - j)}})
                   FILTER (least(i + n, b, e + i - j) > greatest(i, a, c + i - j)) AS t
            FROM q LEFT JOIN r ON r.doc_id = q.doc_id AND r.k = q.k WHERE NOT done GROUP BY q.doc_id, q.k, a, b, c, e) z, (SELECT unnest([0, 1, 2]) AS side) sides
      WHERE (t IS NOT NULL AND side < 2) OR (t IS NULL AND side = 2))
    SELECT doc_id, count(DISTINCT k)::INTEGER AS chunks, sum(least(b - a, e - c))::BIGINT AS substitutions, sum(greatest(b - a - e + c, 0))::BIGINT AS omissions, sum(greatest(e - c - b + a, 0))::BIGINT AS insertions,
           max(greatest(b - a - e + c, 0))::INTEGER AS omission_run, max(greatest(e - c - b + a, 0))::INTEGER AS insertion_run, any_value(n_words) AS n_words,
           round(sum(greatest(b - a, e - c)) / any_value(n_words), 4) AS wer
    FROM q JOIN (SELECT doc_id, len(w)::BIGINT AS n_words FROM d) USING (doc_id) WHERE done GROUP BY doc_id""",
)
def document_error_rates(spark, sf_dir):
    """Documents aligned with what is heard of them, 100 words at a time, words as often as they come: faults and rates by document."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    chunks = docs.select("doc_id", F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 100).cast("int")), lambda k: F.slice("w", k * 100 + 1, 100)).alias("all"))
    said = chunks.select("doc_id", F.explode("all").alias("said"))
    rows = alignment.counted(said.withColumn("heard", reheard(F.col("said"))))
    rates = rows.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("chunks"), *[F.sum(c).alias(c) for c in ("substitutions", "omissions", "insertions")],
        *[F.max(c).alias(c) for c in ("omission_run", "insertion_run")], F.sum(F.size("said")).alias("n_words"),
    )
    return rates.withColumn("wer", F.round((F.col("substitutions") + F.col("omissions") + F.col("insertions")) / F.col("n_words"), 4))


@query(
    "document_stretches",
    f"""SELECT doc_id, n::BIGINT AS n_said, (n - o)::BIGINT AS n_heard, c::BIGINT AS substitutions, o::BIGINT AS omissions, 0::BIGINT AS insertions, (o > 0)::INTEGER AS omission_run, 0 AS insertion_run, round((o + c) / greatest(1, n), 4) AS wer, (o + c) / greatest(1, n) > 0.25 AS flagged
    FROM (SELECT doc_id, len(w) AS n, {SQL_FAULTS} FROM (SELECT doc_id, {SQL_WORDS_OF} AS w FROM documents))""",
)
def document_stretches(spark, sf_dir):
    """Whole documents of any length against what is heard of them, in stretches of about 1,000 words that different tasks align."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNotNull().alias("known"), words.alias("words"))
    docs = docs.select("doc_id", "known", placed(F.col("words")).alias("said")).withColumn("heard", misheard(F.col("said")))
    found = alignment.verified_whole(docs, ["doc_id", "known"], most=1000)
    # Rounded as in the SQL: halves up, where the operator has the even digit.
    faults = F.col("substitutions") + F.col("omissions") + F.col("insertions")
    found = found.withColumn("wer", F.round(faults / F.greatest("n_said", F.lit(1)) * 10_000) / 10_000)
    # Of a text that isn't known nothing is, but that nothing was inserted.
    found = found.withColumns({c: F.when(F.col("known"), F.col(c)) for c in ("n_said", "n_heard", "substitutions", "omissions", "omission_run", "wer", "flagged")})
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_said", "n_heard", "substitutions", "omissions", "insertions")], "omission_run", "insertion_run", "wer", "flagged")


@query(
    "turn_verse_times",
    f"""WITH w AS (SELECT conv_id, turn, w, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS x FROM (SELECT conv_id, turn, {SQL_WORDS_OF} AS w FROM conversations)),
    h AS (SELECT conv_id, turn, n, i, i % 17 <> 16 AS same, 0.12 + 0.05 * (len(x || '_' || i) + CASE WHEN i % 17 = 16 THEN 7 ELSE 0 END) AS took FROM w WHERE i % 11 <> 10),
    t AS (SELECT *, 0.2 + coalesce(sum(took + 0.06) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h),
    s AS (SELECT conv_id, turn, max(round(start + took, 3)) AS seconds FROM t GROUP BY ALL),
    v AS (SELECT w.conv_id, w.turn, n, i AS token, i // 8 AS place, (i // 8) % 5 AS label FROM w WHERE i % 8 = 0)
    SELECT v.conv_id, v.turn, place::INTEGER AS place, label || CASE WHEN place >= 5 THEN '#' || (place // 5 + 1) ELSE '' END AS verse,
    round(coalesce((SELECT round(arg_min(start, i), 3) FROM t WHERE t.conv_id = v.conv_id AND t.turn = v.turn AND same AND i >= token), seconds * token / n), 3) AS time FROM v JOIN s ON s.conv_id = v.conv_id AND s.turn = v.turn""",
)
def turn_verse_times(spark, sf_dir):
    turns = heard_turns(spark, sf_dir).select("conv_id", "turn", *apart(F.col("said")))
    times = timing.word_times(turns, ["conv_id", "turn"], "heard").groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "start"))), lambda x: x["start"]).alias("heard_starts"), F.max("end").alias("seconds"))
    verses = F.transform(F.sequence(F.lit(0), F.greatest(F.size("said") - 1, F.lit(0)), F.lit(8)), lambda i: F.struct((i / 8 % 5).cast("int").cast("string").alias("verse"), i.cast("int").alias("token")))
    return alignment.verse_times(alignment.verified(turns.join(times, ["conv_id", "turn"])).withColumn("verses", verses), ["conv_id", "turn"])


@query("page_events")
def page_events(spark, sf_dir):
    s = markup.Selectors(book="title", remove=".ad, nav, footer")
    events = markup.events(table(spark, sf_dir, "pages"), ["page_id"], "html", s)
    return events.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("page_clean_text")
def page_clean_text(spark, sf_dir):
    events = markup.events(table(spark, sf_dir, "pages"), ["page_id"], "html", markup.Selectors(book="title", remove=".ad, nav, footer"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("text", "space"), F.struct("ev", "value")))), lambda x: x["value"]), "")
    return events.groupBy("page_id").agg(tx.clean(text).alias("text"))


@query(
    "block_profile",
    """WITH b AS (SELECT source, t FROM (SELECT source, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t <> '')
    SELECT source, 'p' AS signature, count(*) AS n, (sum(len(t)) // count(*))::BIGINT AS mean_length, (count(*) FILTER (WHERE len(t) <= 100) * 100 // count(*))::INTEGER AS short_pct,
    (count(*) FILTER (WHERE regexp_matches(t, '^\\s*[0-9]')) * 100 // count(*))::INTEGER AS number_pct, (count(*) FILTER (WHERE regexp_matches(t, '\\.\\s*$')) * 100 // count(*))::INTEGER AS period_pct FROM b GROUP BY source""",
)
def block_profile(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    return inference.block_profile(blocks.withColumn("signature", F.lit("p")), ["source"])


@query(
    "poetry_detector",
    """SELECT doc_id, count(*) FILTER (WHERE len(t) <= 100) >= 8 AND count(*) FILTER (WHERE len(t) <= 100) * 100 >= 15 * count(*) AS poetic
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t <> '' GROUP BY doc_id""",
)
def poetry_detector(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    return inference.poetic(blocks, ["doc_id"])


@query(
    "first_short_run",
    """WITH b AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    s AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM b WHERE len(t) <= 100),
    r AS (SELECT doc_id, min(p) - 1 AS first FROM s GROUP BY doc_id, g HAVING count(*) >= 3)
    SELECT doc_id, min(first)::INTEGER AS first FROM r GROUP BY doc_id""",
)
def first_short_run(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return inference.first_short_run(blocks, ["doc_id"], "line")


@query(
    "signature_candidates",
    # Chapters rise but for every ninth mark, which is 1: the longest rising run is all others, and the first 1 where the ninth comes first.
    """WITH r AS (SELECT l_suppkey % 20 AS book, CASE WHEN l_linenumber = 1 THEN 'h2' ELSE 'sup' END AS signature, l_linenumber AS v,
      row_number() OVER (PARTITION BY l_suppkey % 20, l_linenumber = 1 ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS p FROM lineitem),
    x AS (SELECT book, signature, p, CASE WHEN signature = 'sup' THEN v WHEN p % 9 = 4 THEN 1 ELSE p END AS x FROM r WHERE signature = 'sup' OR p <= 100),
    s AS (SELECT *, lag(x) OVER (PARTITION BY book, signature ORDER BY p) AS b FROM x)
    SELECT book, signature, count(*) AS n, CASE WHEN count(*) >= 5 THEN avg(CASE WHEN b IS NULL THEN NULL WHEN x - b IN (0, 1) OR (x IN (1, 2) AND b >= x) THEN 1.0 WHEN x - b = 2 THEN 0.5 ELSE 0.0 END) ELSE 0 END AS verse_likeness,
           CASE WHEN signature = 'h2' THEN count(*) FILTER (WHERE p % 9 <> 4) / 100::DOUBLE ELSE 0::DOUBLE END AS chapter_likeness FROM s GROUP BY book, signature""",
)
def signature_candidates(spark, sf_dir):
    """Line numbers of orders as marks of two signatures: verses, and the first hundred chapters of a book with every ninth wrong."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    marks = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("book"), F.when(F.col("l_linenumber") == 1, "h2").otherwise("sup").alias("signature"), order.alias("position"), F.col("l_linenumber").alias("v"))
    heads = marks.where("signature = 'h2'").withColumn("p", F.row_number().over(Window.partitionBy("book").orderBy("position"))).where("p <= 100")
    value = F.when(F.col("p") % 9 == 4, 1).otherwise(F.col("p"))
    rows = heads.select("book", "signature", "position", value.alias("value")).unionByName(marks.where("signature = 'sup'").select("book", "signature", "position", F.col("v").alias("value")))
    return inference.candidates(rows.withColumn("expected", F.lit(100)), ["book"], "expected")


@query(
    "gap_reasons",
    """WITH v AS (SELECT l_orderkey, l_linenumber AS n, sum((l_quantity * 10)::INTEGER) AS len FROM lineitem GROUP BY ALL),
    m AS (SELECT l_orderkey, median(len) AS mid, max(n) AS upto FROM v GROUP BY l_orderkey),
    g AS (SELECT l_orderkey, unnest(range(1, upto + 1)) AS n FROM m EXCEPT SELECT l_orderkey, n FROM v),
    s AS (SELECT l_orderkey, min(n) AS first, max(n) AS last, count(*) AS k FROM (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS r FROM g) GROUP BY l_orderkey, r)
    SELECT s.l_orderkey, first::INTEGER AS first, last::INTEGER AS last, k AS n, CASE WHEN len / greatest(mid, 1) >= k + 1 AND len >= 150 THEN 'number lost' WHEN len / greatest(mid, 1) >= 1 + 0.4 * k THEN 'unclear' ELSE 'not in this edition' END AS reason
    FROM s JOIN m ON m.l_orderkey = s.l_orderkey LEFT JOIN v ON v.l_orderkey = s.l_orderkey AND v.n = s.first - 1""",
)
def gap_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("verse"), F.repeat(F.lit("x"), (F.col("l_quantity") * 10).cast("int")).alias("text"))
    return sequences.gap_reasons(rows, ["l_orderkey"], ["verse"], "verse", "text")
