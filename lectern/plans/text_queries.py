"""Queries on text: units, warnings, notes, lexicon, titles, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import content, lexicon

from .catalogue import query, table

UNITS = """SELECT doc_id, lang, u, generate_subscripts(u, 1) AS i, unnest(u) AS t FROM (SELECT doc_id, lang,
    list_filter(string_split(regexp_replace(text, '([.!?…»”])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS u FROM documents)"""


def units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(tx.sentences(F.col("text"))).alias("unit", "text"))


@query("doc_units_explode", f"SELECT doc_id, (i - 1)::INTEGER AS unit, len(t)::INTEGER AS n_chars FROM ({UNITS})")
def doc_units_explode(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "unit", F.length("text").alias("n_chars"))


@query("unit_token_counts", f"SELECT doc_id, count(*) AS n_units, sum(len(regexp_extract_all(lower(t), '[\\pL\\pN\\pM]+')))::BIGINT AS n_tokens FROM ({UNITS}) GROUP BY doc_id")
def unit_token_counts(spark, sf_dir):
    return units(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.size(tx.tokens(F.col("text")))).alias("n_tokens"))


@query("long_unit_warnings", f"SELECT doc_id, (i - 1)::INTEGER AS unit, len(t)::INTEGER AS n_chars FROM ({UNITS}) WHERE len(t) > 300")
def long_unit_warnings(spark, sf_dir):
    return units(spark, sf_dir).where(F.length("text") > 300).select("doc_id", "unit", F.length("text").alias("n_chars"))


LOOSE = "(^|[.!?] )[0-9]{1,3} [A-ZÁÉÍÓÚÑ]|^[0-9]+$"


@query(
    "loose_number_warnings",
    f"""SELECT doc_id, (i - 1)::INTEGER AS unit FROM (SELECT doc_id, i, CASE i % 9 WHEN 2 THEN i::VARCHAR || ' ' || t WHEN 3 THEN 'x' || i::VARCHAR || ' ' || t WHEN 4 THEN i::VARCHAR ELSE t END AS t FROM ({UNITS}))
    WHERE regexp_matches(t, '{LOOSE}')""",
)
def loose_number_warnings(spark, sf_dir):
    """Units some of which have a number before them, as a verse number that wasn't recognised."""
    i = F.col("unit") + 1
    marked = F.when(i % 9 == 2, F.concat(i.cast("string"), F.lit(" "), "text")).when(i % 9 == 3, F.concat(F.lit("x"), i.cast("string"), F.lit(" "), "text")).when(i % 9 == 4, i.cast("string")).otherwise(F.col("text"))
    return units(spark, sf_dir).where(marked.rlike(LOOSE)).select("doc_id", "unit")


@query("non_latin_warnings", "SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '[Ͱ-Ͽἀ-῿֐-׿]')) AS warned, count(*) AS n FROM documents GROUP BY lang")
def non_latin_warnings(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("text").rlike("[Ͱ-Ͽἀ-῿֐-׿]")).alias("warned"), F.count("*").alias("n"))


@query(
    "digits_note_refs",
    """SELECT source, count(*) AS n, array_to_string(list(doc_id::VARCHAR ORDER BY doc_id)[1:3], ', ') AS refs FROM documents WHERE regexp_matches(text, '[0-9]') GROUP BY source""",
)
def digits_note_refs(spark, sf_dir):
    from lectern.operators.notes import grouped_refs

    return grouped_refs(table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")), ["source"], "doc_id", 3)


@query(
    "median_outlier_lengths",
    "SELECT lang, doc_id, n_chars / m AS ratio FROM (SELECT lang, doc_id, n_chars, median(n_chars) OVER (PARTITION BY lang) AS m FROM documents) WHERE n_chars >= 3 * m",
)
def median_outlier_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    middle = docs.groupBy("lang").agg(F.median("n_chars").alias("m"))
    return docs.join(F.broadcast(middle), "lang").where(F.col("n_chars") >= 3 * F.col("m")).select("lang", "doc_id", (F.col("n_chars") / F.col("m")).alias("ratio"))


@query(
    "lexicon_rewrite",
    """SELECT doc_id, md5(text) AS digest, n FROM (SELECT doc_id, len(regexp_extract_all(text, '\\b(?:the|and|of)\\b'))::INTEGER AS n,
       regexp_replace(regexp_replace(regexp_replace(text, '\\bthe\\b', 'THE', 'g'), '\\band\\b', '&', 'g'), '\\bof\\b', 'OF', 'g') AS text FROM documents WHERE lang = 'en')""",
)
def lexicon_rewrite(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    words = {"the": "THE", "and": "&", "of": "OF"}
    return docs.select("doc_id", F.md5(lexicon.rewritten(F.col("text"), words).cast("binary")).alias("digest"), lexicon.occurrences(F.col("text"), words).alias("n"))


@query(
    "page_tag_profile",
    """SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""",
)
def page_tag_profile(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(
    "page_topk_signatures",
    """SELECT lang, tag, n FROM (SELECT lang, tag, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, s, tag) AS r FROM (
       SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, tag, count(*) AS n, min(page_id) AS s
       FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL)) WHERE r <= 5""",
)
def page_topk_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return content.top(rows, ["lang"], "tag", 5, "page_id")
