import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import assembly
from lectern.streaming import assembler

SCHEMA = "work string, doc int, ev int, kind string, value string"
SHOWN = ["work", "book_no", "book", "chapter", "unit", "verse", "text", "brk", "starts", "implicit", "sections", "omitted", "marked", "origin"]


def works(seed):
    r = random.Random(seed)
    out = []
    for w in range(3):
        doc, ev, rows = 0, 0, []

        def add(kind, value=""):
            nonlocal ev
            rows.append((f"w{w}", doc, ev, kind, value))
            ev += 1

        add("text", "before any title")
        for b in range(2):
            add("book", f"book {b}")
            if r.random() < 0.5:
                add("text", "lost"), add("section", "early head")
                add("verse", "1"), add("text", "first of an unmarked chapter")
            for c in range(1, r.randrange(2, 6)):
                if r.random() < 0.4:
                    add("section", f"head before {c}")
                add("chapter", str(c))
                for v in range(1, r.randrange(1, 6)):
                    if r.random() < 0.3:
                        add(r.choice(["line", "paragraph"]))
                    if r.random() < 0.2:
                        add("section", f"head {c} {v}")
                    add("verse", str(v))
                    if r.random() < 0.9:
                        add("text", f"words {b} {c} {v} ")
                    if r.random() < 0.2:
                        add("omitted", f"{v}a")
                    if r.random() < 0.2:
                        doc, ev = doc + 1, 0
        add("end")
        out.append(rows)
    return out


def shown(df):
    return sorted(map(repr, df.select(*SHOWN).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_units_of_a_batch(spark, tmp_path, seed):
    made = works(seed)
    every = [row for rows in made for row in rows]
    df = spark.createDataFrame([x for x in every if x[3] != "end"], SCHEMA)
    want = shown(assembly.units(assembly.placed(df, ["work"], ["doc", "ev"]), ["work"], ["doc", "ev"], ["doc"]))
    # Files in the order of reading, with pieces of all works, cut anywhere; rows of a file in any order.
    r = random.Random(seed)
    cuts = [sorted(r.randrange(len(rows) + 1) for _ in range(3)) for rows in made]
    for n in range(4):
        piece = [x for rows, c in zip(made, cuts) for x in rows[([0, *c])[n] : ([*c, len(rows)])[n]]]
        r.shuffle(piece)
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if n % 2:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
            assembler.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) > 20


def test_a_quiet_chapter_closes(spark, tmp_path):
    rows = [("w", 0, 0, "book", "b"), ("w", 0, 1, "chapter", "2"), ("w", 0, 2, "verse", "1"), ("w", 0, 3, "text", "one")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = assembler.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), idle_ms=1, processingTime="1 second")
    try:
        import time

        got = []
        for _ in range(90):
            time.sleep(1)
            try:
                got = spark.read.parquet(str(tmp_path / "out")).collect()
            except Exception:  # noqa: BLE001, S112
                continue
            if got:
                break
        assert [(r.chapter, r.verse, r.text) for r in got] == [(2, "1", "one")]
    finally:
        query.stop()
