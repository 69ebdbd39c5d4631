"""DuckDB SQL of the conversation trie and the Merkle manifest."""

from __future__ import annotations

# CRC-32 of a text of ASCII digits, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1), lambda i: [-1 - ascii(({0})[i]), 1, 1, 1, 1, 1, 1, 1, 1]))),
       lambda c, x: CASE WHEN x < 0 THEN xor(c, -1 - x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


def field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


LEAF = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH RECURSIVE a AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS tree, source, {LEAF('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {CRC32.format('doc_id::VARCHAR')} % 5 = 0 THEN {LEAF(LOWER)} ELSE {LEAF('text')} END AS used
  FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY encode(tree), doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM a),
t AS (
  SELECT tree, 0 AS level, place::BIGINT AS place, n::BIGINT AS n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY tree, level, place // 16),
s AS MATERIALIZED (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, place::BIGINT AS place, n::BIGINT AS n, subroot AS digest FROM s
  UNION ALL
  SELECT level + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY level, place // 16),
v AS MATERIALIZED (SELECT tree, level, place, n, digest FROM t UNION ALL SELECT NULL, level, place, n, digest FROM u),
k AS MATERIALIZED (
  SELECT x.tree, x.level, x.place, x.n, coalesce(string_agg(y.digest, '' ORDER BY y.place) FILTER (y.place < x.place), '') AS lefts,
         coalesce(string_agg(y.digest, '' ORDER BY y.place) FILTER (y.place > x.place), '') AS rights
  FROM v x JOIN v y ON x.tree IS NOT DISTINCT FROM y.tree AND x.level = y.level AND x.place // 16 = y.place // 16 WHERE x.n > 1 GROUP BY ALL),
f AS (
  SELECT l.tree, l.place AS row_place, 0 AS level, l.tree AS at_tree, l.place::BIGINT AS place, l.n::BIGINT AS n, used AS folded, '' AS proof FROM l
  UNION ALL
  SELECT f.tree, row_place, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n > 1 THEN f.at_tree END,
         CASE WHEN f.n = 1 THEN s.place ELSE f.place // 16 END, CASE WHEN f.n = 1 THEN s.n ELSE (f.n + 15) // 16 END,
         CASE WHEN f.n = 1 THEN folded ELSE sha256(lefts || folded || rights) END, CASE WHEN f.n = 1 THEN proof ELSE proof || lefts || rights END
  FROM f LEFT JOIN k ON k.tree IS NOT DISTINCT FROM f.at_tree AND k.level = f.level AND k.place = f.place AND f.n > 1
  LEFT JOIN s ON s.tree = f.tree AND f.n = 1
  WHERE f.n > 1 OR f.at_tree IS NOT NULL)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.digest AS verified, l.source, l.place::BIGINT AS place, l.n::BIGINT AS n
FROM l JOIN s ON s.tree = l.tree JOIN f ON f.tree = l.tree AND f.row_place = l.place AND f.at_tree IS NULL AND f.n = 1, (SELECT digest FROM u WHERE n = 1) r"""

TRIE = f"""
WITH o AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, {CRC32.format('conv_id::VARCHAR')} % 4 AS h FROM o),
c AS (SELECT h.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1:h.h] END, h.own[h.h + 1:]) AS path FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path FROM c),
n AS MATERIALIZED (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM p GROUP BY ALL),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS MATERIALIZED (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.node[depth].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
  FROM n LEFT JOIN k ON k.node = n.node),
s AS (
  SELECT above, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node[1:unnest(range(0, depth + 1))] AS above, n_children, saved FROM a) GROUP BY above)
SELECT a.conv_id, a.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN s ON s.above = a.node LEFT JOIN n q ON a.depth > 0 AND q.node = a.node[1:a.depth - 1]"""
