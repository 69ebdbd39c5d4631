"""The queries of the numbered operators over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import sql
from .backoff_lm import op8_scores
from .common import table
from .conversation_trie import op11_trie
from .decontamination import op3_decontaminate
from .merkle import op13_merkle
from .nearest import op12_nearest
from .pieces import op10_pieces
from .quality import op2_quality
from .secret_scan import op6_secret_scan
from .sharding import op5_shards
from .simhash import op1_near_duplicates
from .substring_dedup import op7_repeated_spans
from .token_files import op4_token_files
from .warc import op9_archives


def op1_simhash_near_dedup(spark, sf_dir):
    return op1_near_duplicates(table(spark, sf_dir, "documents"))


def op2_tokeniser_fertility(spark, sf_dir):
    return op2_quality(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_benchmark_decontamination(spark, sf_dir):
    return op3_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_huffman_token_files(spark, sf_dir):
    return op4_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_stratified_shards(spark, sf_dir):
    return op5_shards(table(spark, sf_dir, "documents"))


def op6_multipart_secrets(spark, sf_dir):
    return op6_secret_scan(table(spark, sf_dir, "documents"))


def op7_sentence_spans(spark, sf_dir):
    return op7_repeated_spans(table(spark, sf_dir, "documents"))


def op8_backoff_scores(spark, sf_dir):
    return op8_scores(table(spark, sf_dir, "documents"))


def op9_warc_archives(spark, sf_dir):
    return op9_archives(table(spark, sf_dir, "pages"))


def op10_sentencepiece_nbest(spark, sf_dir):
    return op10_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_conversation_trie(spark, sf_dir):
    return op11_trie(table(spark, sf_dir, "conversations"))


def op12_projection_forest(spark, sf_dir):
    return op12_nearest(table(spark, sf_dir, "embeddings"))


def op13_merkle_proofs(spark, sf_dir):
    return op13_merkle(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_tokeniser_fertility, op3_benchmark_decontamination, op4_huffman_token_files, op5_stratified_shards, op6_multipart_secrets, op7_sentence_spans, op8_backoff_scores, op9_warc_archives, op10_sentencepiece_nbest, op11_conversation_trie, op12_projection_forest, op13_merkle_proofs)}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op11_conversation_trie": sql.TRIE,
    "op13_merkle_proofs": sql.MERKLE,
    "op9_warc_archives": """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, strlen(coalesce(html, '')) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again
      FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))""",
    "op3_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, item_id, dw.i, dw.k FROM dw JOIN bw ON dw.p = bw.p AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id),
r AS (SELECT DISTINCT doc_id, item_id, i, i + k AS e FROM m),
g AS (SELECT *, coalesce(i > max(e) OVER (PARTITION BY doc_id, item_id ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM r),
j AS (SELECT doc_id, item_id, min(i) AS a, max(e) AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, item_id ORDER BY i, e) AS n FROM g) GROUP BY doc_id, item_id, n),
p AS (SELECT doc_id, i, length(x) AS n, sum(length(s) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e
      FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x, unnest(s[1:len(w)]) AS s
            FROM (SELECT doc_id, w, string_split_regex({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS s FROM d JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM m)))),
z AS (SELECT j.doc_id, string_agg(item_id || ':' || (f.e - f.n)::BIGINT || ':' || l.e::BIGINT, ',' ORDER BY f.e - f.n, l.e, item_id::VARCHAR) AS spans
      FROM j JOIN p f ON f.doc_id = j.doc_id AND f.i = j.a JOIN p l ON l.doc_id = j.doc_id AND l.i = j.b - 1 GROUP BY j.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id""",
}
