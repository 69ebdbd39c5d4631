import hashlib
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from lectern.llm import conversation_trie, sql

SCHEMA = "conv_id bigint, turn int, role string, text string"


def brute(rows):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            own.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"] or 0), (r["role"] or "", r["text"] or "")))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    members, ends, children = {}, {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], set()).add(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], digest(p)) for p, m in members.items())


def found(df):
    return Counter(tuple(r) for r in conversation_trie.op11_trie(df).collect())


def held(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute([r.asDict() for r in df.collect()])
    return df


def test_equals_brute_force_and_sql_over_a_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = found(df)
    assert got == brute([r.asDict() for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert Counter(map(tuple, con.execute(sql.TRIE).fetchall())) == got


def test_copies_prefixes_and_openings_across_families(spark, many_ranges):
    said = [("user", f"word {i} and more") for i in range(9)]
    rows = []
    for conv in range(130):
        kind = conv % 5
        turns = said[:3] if kind == 0 else said if kind == 1 else said[: conv % 9] if kind == 2 else [*said[:2], ("assistant", f"own {conv}")] if kind == 3 else [("user", f"alone {conv}")]
        rows += [(conv, t, r, x) for t, (r, x) in enumerate(turns)]
    held(spark, rows)


def test_nulls_empty_and_turnless(spark):
    rows = [(20, None, "user", "null first"), (20, 0, None, None), (20, 1, "", ""), (21, 0, "user", None), (3, 5, "a", "bc"), (43, 5, "ab", "c"), (None, 0, "user", "left out"), (1000, 0, "u", "no base before it")]
    df = held(spark, rows)
    assert 0 < sum(n for r, n in found(df).items() if r[1] == 0) == 1


def test_no_family_base_leaves_own_turns_alone(spark):
    got = found(spark.createDataFrame([(25, 0, "u", "one")], SCHEMA))
    assert got == brute([{"conv_id": 25, "turn": 0, "role": "u", "text": "one"}])


def test_repeated_rows_are_turns_of_their_own_and_other_columns_dont_matter(spark):
    df = held(spark, [(40, 0, "u", "x"), (40, 0, "u", "x"), (41, 0, "u", "x"), (41, 1, "u", "x")])
    clash = df.withColumns({c: F.lit(1) for c in ("key", "depth", "parent", "n_convs", "path", "base", "rank", "digest", "words", "first")})
    assert found(clash) == found(df)


def test_long_conversations_and_long_texts(spark):
    rows = [(c, t, "u", f"turn {t % 50}") for c in (0, 1, 60) for t in range(700)] + [(61, 0, "u", "long " * 100_000)]
    held(spark, rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()
