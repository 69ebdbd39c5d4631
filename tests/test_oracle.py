"""Every registered query outside llm against its DuckDB SQL over a whole scale factor, by values."""

import math
import os
from collections import Counter

import duckdb
import pytest

import lectern.plans  # noqa: F401
from lectern.plans import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.9g}")
    return str(v)


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_runs_and_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if name not in catalogue.ORACLE:
        return
    own = counted(df.columns, [[r[c] for c in df.columns] for r in rows])
    asked = duck.execute(catalogue.ORACLE[name])
    assert own == counted([c[0] for c in asked.description], asked.fetchall())
