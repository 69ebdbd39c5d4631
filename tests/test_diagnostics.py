import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import audio, diagnostics, sinks


def test_documents(spark):
    docs = spark.createDataFrame([(1, "text/a1.xhtml"), (2, "text/a2.xhtml"), (3, "notes/a1.xhtml"), (4, None)], "i int, path string")
    assert [r.i for r in diagnostics.wanted(docs, "path", ignore="^notes").collect()] == [1, 2, 4]
    assert [r.i for r in diagnostics.wanted(docs, "path", ["text/a2.xhtml"]).collect()] == [2]
    assert diagnostics.one_document(docs, "i", "path", "3").first().i == 3 and diagnostics.one_document(docs, "i", "path", "a2").first().i == 2
    with pytest.raises(ValueError, match="2 documents"):
        diagnostics.one_document(docs, "i", "path", "a1")
    with pytest.raises(ValueError, match="0 documents"):
        diagnostics.one_document(docs, "i", "path", "zz")


def test_refusal_and_headers(spark):
    units = spark.createDataFrame([("a", 1, v, True) for v in "12121"] + [("b", 1, v, True) for v in "123"], "book string, chapter int, verse string, starts boolean")
    assert [tuple(r) for r in diagnostics.several_chapters(units, ["book", "chapter"]).collect()] == [("a", 1, 3)]
    assert diagnostics.refused(units.where("book = 'b'"), ["book", "chapter"]).count() == 3
    with pytest.raises(Exception, match="several chapters in one: a 1"):
        diagnostics.refused(units, ["book", "chapter"]).collect()
    files = spark.createDataFrame([("x/gn/1.txt", "gn", 1), ("x/gn/2.txt", "gn", 3), ("x/ex/1.txt", "gn", 1)], "path string, book string, chapter int")
    assert sorted(r.path for r in diagnostics.header_faults(files).collect()) == ["x/ex/1.txt", "x/gn/2.txt"]
    more = files.select("path").union(spark.createDataFrame([("x/gn/notes.txt",)], "path string"))
    assert sorted((r.book, r.chapter) for r in diagnostics.available(more).collect()) == [("ex", 1), ("gn", 1), ("gn", 2)]
    of, gone = diagnostics.of_book(units, spark.createDataFrame([("a 3 no verse",), ("ab 1",)], "reference string"), "a")
    assert (of.count(), gone.count()) == (5, 1)


def test_work_is_kept_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("ab1", 1), ("ab1", 1), ("cd2", 2)], "key string, v int")
    assert sinks.cached(rows, path).count() == 2
    assert sorted(r.key for r in sinks.cached(rows.union(spark.createDataFrame([("ef3", 3)], "key string, v int")), path).collect()) == ["ef3"]
    assert spark.read.parquet(path).count() == 3 and (tmp_path / "cache" / "shard=ab").exists()


def test_reports(spark, tmp_path):
    times = spark.createDataFrame([("b", 1, 0, "1", 0.12345), ("b", 1, 1, "2", 2.0)], "book string, chapter int, position int, verse string, start double")
    seconds = spark.createDataFrame([("b", 1, 9.87654), ("b", 2, 1.0)], "book string, chapter int, seconds double")
    index = sinks.chapter_index(times, ["book", "chapter"], times.withColumn("title", F.lit("T")).where("position = 1"), seconds)
    sinks.write_json(index, str(tmp_path / "index"), ["book", "chapter"])
    got = {r.chapter: json.loads(r.value) for r in spark.read.text(str(tmp_path / "index")).collect()}
    assert got[1] == {"book": "b", "chapter": 1, "seconds": 9.877, "verses": [{"name": "1", "start": 0.123}, {"name": "2", "start": 2.0}], "sections": [{"name": "T", "start": 2.0}]}
    assert got[2]["verses"] == []
    sinks.write_json(index.limit(0), str(tmp_path / "none"), ["book"])
    assert not (tmp_path / "none").exists()
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(100)], "place int, line string")
    assert {r.part: r["count"] for r in sinks.report(*[lines] * 5).groupBy("part").count().collect()} == {"totals": 100, "titles": 60, "discarded": 40, "warnings": 100, "notes": 100}


def test_recordings(spark):
    rate = 24_000
    pcm = audio.silence(500, rate) + audio.tone(240, 0.5, rate) + audio.silence(250, rate)
    whole = audio.wrapped(pcm, rate)
    unknown = whole[:40] + b"\xff\xff\xff\xff" + whole[44:]
    odd = whole[:12] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + whole[12:]
    rows = [whole, whole[:40] + bytes(4) + whole[44:], unknown, odd, whole[:36], b"OggS" + bytes(20), None, whole[:12] + whole[36:]]
    got = spark.createDataFrame([(i, bytearray(w) if w else None) for i, w in enumerate(rows)], "i int, wav binary").select("i", audio.read_wav("wav").alias("w")).orderBy("i").collect()
    assert all((r.w.rate, r.w.channels, r.w.width, r.w.format, bytes(r.w.pcm)) == (rate, 1, 2, 1, pcm) for r in got[:4])
    assert [r.w.fault for r in got[4:]] == ["no data", "no RIFF/WAVE header", "no RIFF/WAVE header", "data before the format"]
    cut, offset = audio.trimmed(pcm, rate, -45, 40)
    assert offset == pytest.approx(0.46) and len(cut) / 2 / rate == pytest.approx(0.58, abs=0.011)
    assert np.frombuffer(cut, "<i2")[int(0.045 * rate) :].any()
    assert audio.trimmed(audio.silence(300, rate), rate, -45, 40) == (b"", 0.0) and audio.trimmed(b"", rate, -45, 40) == (b"", 0.0)
