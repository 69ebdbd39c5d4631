import datetime as dt

from pyspark.sql import functions as F

from lectern.streaming import ledger


def rows(spark, days, usd=1.0):
    t = dt.datetime(2024, 1, 30, 12)
    data = [(t + dt.timedelta(days=d), "p", "tts", 10.0, usd, f"r{d}") for d in days]
    return spark.createDataFrame(data, "ts timestamp, provider string, kind string, units double, usd double, ref string")


def run(stream, tmp_path, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_ledger_is_read_and_summed(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(rows(spark, [0, 0, 3, 40], 1.23456789), path)
    (tmp_path / "ledger" / "bad.json").write_text('{"ts": broken\n\n')
    assert ledger.read_batch(spark, path).count() == 4 and ledger.read_batch(spark, path).first().usd == 1.234568
    run(ledger.monthly(ledger.read(spark, path)), tmp_path, "months", "complete")
    got = {r.month.month: (r.units, round(r.usd, 6)) for r in spark.table("months").collect()}
    assert got == {1: (20.0, 2.469136), 2: (10.0, 1.234568), 3: (10.0, 1.234568)}
    run(ledger.hourly_windows(ledger.read(spark, path)), tmp_path, "hours", "complete")
    assert sorted(r.calls for r in spark.table("hours").collect()) == [1, 1, 2]
    # A later run takes only what is new.
    ledger.append(rows(spark, [41]), path)
    assert ledger.read_batch(spark, path).agg(F.count("*")).first()[0] == 5


def test_work_is_done_once(spark, tmp_path):
    path = str(tmp_path / "work")
    ledger.append(rows(spark, [0, 0, 0, 1]), path)
    run(ledger.once(ledger.read(spark, path), "ref", "ts", "3 days"), tmp_path, "once", "append")
    assert sorted(r.ref for r in spark.table("once").collect()) == ["r0", "r1"]
