import hashlib
import zlib
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from lectern.llm.sharding import interleave, op5_shards


def plain(rows, shards=16, seed="lectern-5"):
    """The method as loops over lists: (doc_id, source) to shard and slot."""
    by = {}
    for d, s in rows:
        by.setdefault("" if s is None else f"={s}", []).append((hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest(), d))
    line = []
    for s, own in by.items():
        own.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
        line += [(Fraction(2 * r + 1, 2 * len(own)), s, r, d) for r, (_, d) in enumerate(own)]
    line.sort(key=lambda x: x[:3])
    out, slots = [], Counter()
    for p, (_, s, _, d) in enumerate(line):
        shard = p * shards // len(line)
        out.append((d, shard, slots[shard]))
        slots[shard] += 1
    return out


def rows():
    out = [(i, f"text {i}", f"s{i % 7 if i % 3 else 0}", 1) for i in range(3000)]
    return [*out, (5000, None, None, 2), (5001, "", "s1", 2), (None, "no id", "s2", 2), (5002, "same", "", 2), (5003, "long " * 50_000, "s3", 2)]


def test_matches_plain_ranking(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, shard int")
    got = op5_shards(df).collect()
    assert sorted(((r.doc_id, r.shard, r.slot) for r in got), key=repr) == sorted(plain([(d, s) for d, _, s, _ in data]), key=repr)
    text = {d: (t or "").encode() for d, t, _, _ in data}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
    again = {r.doc_id: (r.shard, r.slot) for r in op5_shards(df.repartition(7)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_counts_slots_and_mixture(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, source string, x int").union(spark.createDataFrame(rows()[:50], "doc_id bigint, text string, source string, x int"))
    got = interleave(df.select("doc_id", "source"), shards=16)
    by_shard = {r.shard: r for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots")).collect()}
    n = [r.n for r in by_shard.values()]
    assert len(n) == 16 and max(n) - min(n) <= 1 and all(r.low == 0 and r.high == r.n - 1 and r.slots == r.n for r in by_shard.values())
    for s in ("s0", "s1", "s5"):
        own = Counter(r.shard for r in got.where(F.col("source") == s).collect())
        assert max(own.values()) - min(own.values()) <= 2


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id bigint, text string, source string")
    assert sorted((r.shard, r.slot) for r in op5_shards(df).collect()) == [(0, 0), (8, 0)]
    assert op5_shards(df.limit(0)).collect() == []


def test_columns_of_any_name(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    clash = docs.withColumns({c: F.lit(7) for c in ("_x_s", "_x_o", "_x_n", "_x_b", "_x_r", "_x_f", "_x_p", "_c0", "shard", "slot", "fraction", "Slot.x")})
    key = lambda df: sorted((r.doc_id, r["shard"], r["slot"]) for r in df.collect())
    got = interleave(clash, shards=4, rows_per_bucket=5)
    assert key(got) == key(interleave(docs, shards=4, rows_per_bucket=5)) and {r["_x_s"] for r in got.collect()} == {7}
