import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle, sql

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def folds(level, fan):
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def path(levels, i, fan):
    out = []
    for level in levels[:-1]:
        first = i // fan * fan
        run = level[first : first + fan]
        out.append((run[: i - first], run[i - first + 1 :]))
        i //= fan
    return out


def brute(rows, fan=16):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of the contract, one row after the other."""
    by = {}
    for r in rows:
        leaf = H(*[field(r[c]) for c in merkle.FIELDS])
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: folds([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fan) for s in names}
    top = folds([trees[s][-1][0] for s in names], fan)
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            ways, text = path(trees[s], i, fan) + path(top, k, fan), r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            at = H(*[field(text if c == "text" else r[c]) for c in merkle.FIELDS])
            for left, right in ways:
                at = H(*left, at, *right)
            root = top[-1][0]
            out.append((r["doc_id"], leaf, trees[s][-1][0], root, H(*[x for a, b in ways for x in a + b]), at, at == root))
    return out


def found(df, fan=16):
    return [tuple(r)[:7] for r in merkle.op13_merkle(df, fan).collect()]


def test_equals_brute_force_over_a_table(spark, many_ranges, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = found(docs)
    assert Counter(got) == Counter(brute([r.asDict() for r in docs.collect()]))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("fan", [2, 3])
def test_deep_trees_and_many_sources(spark, fan):
    rows = [(i, f"Text {i}", "en", f"s{i % 7}" if i % 3 else "hot", i) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(found(docs, fan)) == Counter(brute([r.asDict() for r in docs.collect()], fan))


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (5, "É Ü ẞ", None, "", 3), (5, "É Ü ẞ", None, "", 3), (5, "other", "de", "", None), (7, "", "en", "é", 0), (8, None, "en", "z", 1), (9, "A" * 200_000, "en", "z", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter(brute([r.asDict() for r in docs.collect()]))
    assert Counter(found(docs)) == want
    clash = docs.withColumns({c: F.lit("x") for c in ("leaf", "root", "tree", "place", "n", "digest", "path", "level", "rank", "_x_row")})
    assert Counter(found(clash)) == want


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([(1, "Abc", "en", "s", 3)], SCHEMA)
    (row,) = found(one)
    assert row[1] == row[2] == row[3] and row[4] == H()
    assert found(one.limit(0)) == []


def test_proof_of_a_few_leaves_looks_up_their_runs(spark):
    leaves = spark.createDataFrame([("t", i, H(str(i))) for i in range(40)], "tree string, name int, digest string")
    levels_of, at, trees = merkle.manifest(leaves, ["name"], 4)
    asked = merkle.proofs(levels_of, at.where("name in (3, 37)"), trees, 4)
    rows = asked.select("name", merkle.folded(F.col("digest"), F.col("path")).alias("to"), "root").collect()
    assert len(rows) == 2 and all(r["to"] == r["root"] for r in rows)


def test_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = merkle.op13_merkle(spark.read.parquet(f"{sf}/documents.parquet"))
    assert Counter(map(tuple, con.execute(sql.MERKLE).fetchall())) == Counter(map(tuple, got.collect()))
