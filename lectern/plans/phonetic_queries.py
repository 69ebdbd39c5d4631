"""Queries of sounds, announcements, ranges, previews and name hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import phonetics, speech

from .catalogue import query, table

V = "aeiouáéíóúü"
# The letters of SQL's word: expressions without look-around, so that what must follow is captured and put back.
SQL_LETTERS = [
    ("x", "K"), ("ch", "C"), ("ll", "L"), ("rr", "R"), ("qu([eiéí])", r"k\1"), ("gu([eiéí])", r"G\1"), ("c([eiéí])", r"Z\1"), ("c", "k"), ("z", "Z"),
    ("g([eiéí])", r"x\1"), ("g", "G"), ("j", "x"), ("q", "k"), ("v", "b"), ("ñ", "ɲ"), (f"y([{V}])", r"L\1"), ("y", "i"), ("^r", "R"), ("([nlsL])r", r"\1R"), ("h", ""),
    (f"i([{V}])", r"J\1"), (f"i([{V}])", r"J\1"), (f"[uü]([{V}JW])", r"W\1"), (f"[uü]([{V}JW])", r"W\1"), ("([aeoáéóíú][JW]*)i", r"\1J"), ("([aeoáéóíú][JW]*)[uü]", r"\1W"),
]


def sql_sounds(word: str, source: str, keep: str = "") -> str:
    """SQL that gives s, the sounds, for the column word of source; keep is what else to select."""
    s = f"lower({word})"
    for pattern, put in SQL_LETTERS:
        s = f"regexp_replace({s}, '{pattern}', '{put}', 'g')"
    return f"""SELECT {keep}{word}, CASE WHEN regexp_matches({word}, '^\\pL+$') AND n > 0 THEN replace(replace(translate(CASE WHEN n < 2 THEN s
        WHEN regexp_matches(s, '[áéíóú]') THEN regexp_replace(s, '^([^áéíóú]*)', '\\1ˈ')
        WHEN regexp_matches(lower({word}), '[aeiouns]$') THEN regexp_replace(s, '([{V}][^{V}]*[{V}][^{V}]*)$', 'ˈ\\1')
        ELSE regexp_replace(s, '([{V}][^{V}]*)$', 'ˈ\\1') END, 'áéíóúürRJWGZL', 'aeiouuɾrjwɡsʝ'), 'C', 'tʃ'), 'K', 'ks') END AS ipa
    FROM (SELECT *, len(regexp_replace(s, '[^{V}]', '', 'g')) AS n FROM (SELECT *, {s} AS s FROM {source}))"""


@query("ipa_words", sql_sounds("word", "(SELECT DISTINCT unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) AS word FROM documents WHERE lang = 'es')"))
def ipa_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", phonetics.sounds(F.col("word")).alias("ipa"))


IN_R = "(SELECT doc_id, unnest(regexp_extract_all(text, '[\\pL\\pN\\pM_]+')) AS word FROM documents WHERE lang = 'es')"


@query(
    "final_r_marks",
    f"""WITH w AS (SELECT doc_id, word FROM {IN_R} WHERE regexp_matches(word, '^\\pL*[aeiouáéíóúAEIOUÁÉÍÓÚ][rR]$')), k AS (SELECT DISTINCT word FROM w), i AS ({sql_sounds("word", "k")}),
    t AS (SELECT doc_id, count(*) AS marks, sum(len(ipa) + len(word) + 31) AS longer, count(*) AS rs FROM w JOIN i USING (word) GROUP BY doc_id)
    SELECT doc_id, coalesce(marks, 0) AS marks, len(text) - coalesce((SELECT sum(len(word)) FROM w WHERE w.doc_id = d.doc_id), 0)::BIGINT + coalesce(longer, 0)::BIGINT AS marked_chars, len(text) AS billed_chars, len(text) + coalesce(rs, 0) AS rr_chars
    FROM documents d LEFT JOIN t USING (doc_id) WHERE lang = 'es'""",
)
def final_r_marks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'es'").withColumn("said", phonetics.with_final_r(F.col("text"), "suave"))
    return docs.select(
        "doc_id", F.regexp_count("said", F.lit('"pronounce": ')).cast("long").alias("marks"), F.length("said").cast("long").alias("marked_chars"),
        F.length(phonetics.without_marks(F.col("said"))).cast("long").alias("billed_chars"), F.length(phonetics.with_final_r(F.col("text"), "rr")).cast("long").alias("rr_chars"),
    )


@query(
    "final_r_variants",
    """SELECT turn % 7 AS kind, mode, count(*) AS n, sum(CASE mode WHEN '' THEN len(text) WHEN 'rr' THEN len(text) + len(list_filter(regexp_extract_all(text, '[\\pL\\pN\\pM_]+'), lambda w: regexp_matches(w, '^\\pL*[aeiouáéíóúAEIOUÁÉÍÓÚ][rR]$'))) ELSE len(text) END)::BIGINT AS chars
       FROM conversations, (VALUES (''), ('suave'), ('fuerte'), ('rr')) m(mode) GROUP BY ALL""",
)
def final_r_variants(spark, sf_dir):
    own = phonetics.variants(table(spark, sf_dir, "conversations").select((F.col("turn") % 7).alias("kind"), "text"))
    return own.groupBy("kind", "mode").agg(F.count("*").alias("n"), F.sum(F.length(phonetics.without_marks(F.col("said"))).cast("long")).alias("chars"))


@query(
    "request_parts",
    """SELECT doc_id, regexp_matches(text, '[^\\s]{401}') AS uncut, NOT regexp_matches(text, '[^\\s]{401}') AS within, CASE WHEN NOT regexp_matches(text, '[^\\s]{401}') THEN md5(regexp_replace(text, '\\s+', '', 'g')) END AS letters FROM documents""",
)
def request_parts(spark, sf_dir):
    """All documents cut to requests; one with more than 400 characters without white space can't be and says so."""
    docs = table(spark, sf_dir, "documents").select("doc_id", phonetics.requests(400)("text").alias("r"))
    within = F.coalesce(F.forall("r.parts", lambda p: F.length(p) <= 400), F.lit(False))
    return docs.select("doc_id", F.col("r.fault").isNotNull().alias("uncut"), within.alias("within"), F.md5(F.regexp_replace(F.array_join("r.parts", ""), r"\s+", "").cast("binary")).alias("letters"))


# Chapters by order of a customer: the number of an order among those of its customer is a chapter's.
@query(
    "announcements",
    """WITH c AS (SELECT n_name AS spoken, n_nationkey, o_orderkey, (o_orderkey % 32)::INTEGER AS chapter, CASE n_nationkey % 5 WHEN 0 THEN 1 ELSE 40 END AS chapters
                  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    w AS (SELECT *, list_extract(['cero','uno','dos','tres','cuatro','cinco','seis','siete','ocho','nueve','diez','once','doce','trece','catorce','quince','dieciséis','diecisiete','dieciocho','diecinueve','veinte','veintiuno','veintidós','veintitrés','veinticuatro','veinticinco','veintiséis','veintisiete','veintiocho','veintinueve','treinta','treinta y uno'], chapter + 1) AS n FROM c)
    SELECT o_orderkey, CASE WHEN chapter = 0 THEN spoken || '. Prólogo.' WHEN n_nationkey = 7 THEN 'Salmo ' || n || '.' WHEN chapters = 1 THEN spoken || '.' ELSE spoken || '. Capítulo ' || n || '.' END AS said FROM w""",
)
def announcements(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    chapters = F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(40)
    book = F.when(F.col("n_nationkey") == 7, "sal").otherwise("")
    return rows.select("o_orderkey", speech.announcement(book, F.col("n_name"), chapters, (F.col("o_orderkey") % 32).cast("int")).alias("said"))


@query(
    "range_numbers",
    """WITH p AS (SELECT user_id, unnest([event_id % 9 + 1, event_id % 5 + 2]) AS a, unnest([event_id % 9 + 4, event_id % 5 + 2]) AS b FROM events)
       SELECT user_id, list_sort(list_distinct(flatten(list(range(a, b + 1)))))::INTEGER[] AS numbers FROM p GROUP BY user_id""",
)
def range_numbers(spark, sf_dir):
    """Ranges such as '3-6,4' of all events of a user, as one text and back to numbers."""
    e = F.col("event_id")
    part = F.concat_ws(",", F.concat_ws("-", e % 9 + 1, e % 9 + 4), (e % 5 + 2).cast("string"))
    said = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(part), ", ").alias("said"))
    return said.select("user_id", speech.range_numbers(F.col("said")).alias("numbers"))


@query(
    "previews",
    """SELECT doc_id, CASE WHEN len(one) > 24 THEN left(one, 23) || '…' ELSE one END AS preview, lpad((n // 60)::VARCHAR, greatest(2, len((n // 60)::VARCHAR))::INTEGER, '0') || ':' || lpad((n % 60)::VARCHAR, 2, '0') AS clock
       FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one, (len(text) // 14)::BIGINT AS n FROM documents)""",
)
def previews(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", speech.preview(F.col("text"), 24).alias("preview"), speech.minutes(F.floor(F.length("text") / 14)).alias("clock"))


@query(
    "name_hints",
    """SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\\pL\\pN\\pM_]+'), lambda w: regexp_matches(w, '^[A-ZÁÉÍÓÚÑ][a-záéíóúñü]{2,}$'))))[1:40] AS names FROM documents""",
)
def name_hints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", speech.name_hints(F.col("text")).alias("names"))
