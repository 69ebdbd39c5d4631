from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.llm.ordered import ranked


def test_ranks_over_many_ranges(spark, many_ranges):
    df = written(spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("g")), "test")
    rows = sorted((r.v, r.g) for r in df.collect())
    assert sorted((r.v, r["rank"]) for r in ranked(df, ["v"]).collect()) == [(v, i) for i, (v, _) in enumerate(rows)]
    want = []
    for g in {g for _, g in rows}:
        want += [(g, v, i) for i, v in enumerate(v for v, h in rows if h == g)]
    assert sorted((r.g, r.v, r["rank"]) for r in ranked(df, ["g", "v"], ["g"]).collect()) == sorted(want)


def test_nulls_first_and_no_rows(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert {(r.v, r["rank"]) for r in ranked(df, ["v"]).collect()} == {(None, 0), (1, 1), (2, 2)}
    assert ranked(df.limit(0), ["v"]).collect() == []
