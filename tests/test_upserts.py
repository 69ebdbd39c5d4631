import hashlib
import json

import pytest

from lectern.operators import content
from lectern.streaming.upserts import Taken, Texts

SCHEMA = "id int, text string"


def made(spark, tmp_path, **more):
    return Texts(spark, str(tmp_path / "table"), {"id": "int"}, **more)


def there(table):
    return {r.id: r.text for r in table.rows().collect()}


def put(table, spark, rows, query, number, **more):
    return table.upsert(spark.createDataFrame(rows, SCHEMA), query, number, **more)


def test_no_row_is_lost_or_frozen(spark, tmp_path):
    t = made(spark, tmp_path)
    assert put(t, spark, [(1, "a"), (9, "k")], "q", 0) == {"write": 2}
    assert put(t, spark, [(2, "b")], "q", 1) == {"write": 1}
    # A row that the batch between didn't name is still that written last, and can be overwritten.
    assert put(t, spark, [(1, "z"), (9, "k")], "q", 2) == {"overwrite": 1, "same": 1}
    assert there(t) == {1: "z", 2: "b", 9: "k"}


def test_repeats_gaps_and_new_checkpoints(spark, tmp_path):
    t = made(spark, tmp_path)
    put(t, spark, [(1, "a")], "q", 0)
    assert put(t, spark, [(1, "other")], "q", 0) == {} and there(t) == {1: "a"}
    # A gap in the numbers: all that was there stays.
    put(t, spark, [(2, "b")], "q", 7)
    assert put(t, spark, [(3, "c")], "q", 5) == {} and there(t) == {1: "a", 2: "b"}
    # A query with another checkpoint begins with batch 0, and isn't the one that ran.
    assert put(t, spark, [(3, "c")], "another", 0) == {"write": 1}
    assert there(made(spark, tmp_path)) == {1: "a", 2: "b", 3: "c"}


def test_edited_texts_are_kept_until_forced(spark, tmp_path):
    t = made(spark, tmp_path)
    put(t, spark, [(1, "a"), (2, "b")], "q", 0)
    t.edit(spark.createDataFrame([(1, "by hand"), (5, "new by hand")], SCHEMA))
    assert put(t, spark, [(1, "c"), (2, "d"), (5, "e")], "q", 1) == {"keep": 2, "overwrite": 1}
    # What is edited back to what was written can be overwritten again.
    t.edit(spark.createDataFrame([(1, "a")], SCHEMA))
    assert put(t, spark, [(1, "c"), (5, "e")], "q", 2) == {"keep": 1, "overwrite": 1}
    assert put(t, spark, [(5, "e")], "q", 3, force=True) == {"overwrite": 1}
    assert there(t) == {1: "c", 2: "d", 5: "e"}


def test_last_of_several_and_nulls(spark, tmp_path):
    t = made(spark, tmp_path)
    df = spark.createDataFrame([(1, "early", 1), (1, "late", 2), (1, "also late", 2), (2, None, 1), (None, "x", 1)], "id int, text string, at int")
    assert t.upsert(df, "q", 0, ["at"]) == {"write": 1} and there(t) == {1: "late"}
    assert t.upsert(df.limit(0), "q", 1) == {} and there(t) == {1: "late"}


def test_a_batch_costs_what_it_changes(spark, tmp_path):
    t = made(spark, tmp_path)
    put(t, spark, [(i, str(i)) for i in range(2000)], "q", 0)
    put(t, spark, [(7, "new"), (8, "8")], "q", 1)
    folder = t.state().deltas[-1][1]
    assert spark.read.schema(t.schema).parquet(f"{t.path}/{folder}").count() == 1
    bucket = spark.createDataFrame([(7,)], "id int").select(t.bucket()).first()[0]
    plan = t.rows(buckets=[bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"bucket" in plan and t.rows(buckets=[bucket]).count() < 100


def test_compaction_loses_nothing(spark, tmp_path):
    t = made(spark, tmp_path, compact_after=3)
    for n in range(8):
        put(t, spark, [(n, f"first {n}"), (0, f"zero {n}")], "q", n)
    state = t.state()
    assert state.base and len(state.deltas) < 3 and state.done == {"q": 7}
    assert there(t) == {0: "zero 7"} | {n: f"first {n}" for n in range(1, 8)}
    assert put(t, spark, [(3, "again")], "q", 7) == {} and put(t, spark, [(3, "again")], "q", 8) == {"overwrite": 1}


def test_two_writers_take_different_entries(spark, tmp_path):
    t, other = made(spark, tmp_path), made(spark, tmp_path)
    put(t, spark, [(1, "a")], "q", 0)
    with pytest.raises(Taken):
        t._commit(0, {"kind": "none"})
    commit, seen = t._commit, []

    def beaten(version, entry):
        if not seen:
            seen.append(version)
            put(other, spark, [(2, "other")], "r", 0)
        return commit(version, entry)

    t._commit = beaten
    assert put(t, spark, [(1, "b")], "q", 1) == {"overwrite": 1}
    assert seen == [1] and there(t) == {1: "b", 2: "other"} and t.state().version == 2


def test_as_a_stream_over_restarts(spark, tmp_path):
    t = made(spark, tmp_path)

    def run(rows, checkpoint):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(t.sink()).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run([(1, "a")], "c1")
    run([(2, "b")], "c1")
    run([(1, "z")], "c1")
    assert there(t) == {1: "z", 2: "b"} and len(t.state().done) == 1
    # Another checkpoint reads all files again: nothing of it is dropped.
    run([(3, "c")], "c2")
    assert set(there(t)) == {1, 2, 3} and len(t.state().done) == 2


def test_cache_key_is_that_of_the_json(spark):
    texts = ["plain", 'a "quote" and \\ slash', "tab\tline\nreturn\r", "\x00\x1f\x0b\x7f é日", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", content.cache_key(df.text, df.text, df.text.isNotNull().cast("int")).alias("key")).collect():
        said = json.dumps({"firma": r.text, "texto": r.text, "variante": 1}, sort_keys=True, ensure_ascii=False)
        assert r.key == hashlib.sha256(said.encode()).hexdigest()[:32]
