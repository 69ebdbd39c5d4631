import random

from pyspark.sql import functions as F

from lectern.operators import inference, retries

SCHEMA = "k int, p string, cost long, flagged boolean, omission_run int, insertion_run int, omissions int, insertions int, wer double"


def outcome(k, attempt):
    run = random.Random(f"{k}-{attempt}").randrange(4)
    return (run > 1, run, 0, run, 0, run / 10)


def again(rows, attempt):
    spark = rows.sparkSession
    keys = [r.k for r in rows.select("k").collect()]
    return spark.createDataFrame([(k, *outcome(k, attempt)) for k in keys], "k int, " + SCHEMA.split(", ", 3)[3])


def brute(rows, left, most, cached):
    """Rounds one piece after the other."""
    best, attempt = {r[0]: r[3:] for r in rows}, {r[0]: 0 for r in rows}
    pending, left, spent = [r for r in rows if r[3]], dict(left), []
    for n in range(1, most + 1):
        before, tried, of = {}, [], {}
        for k, p, cost, *_ in sorted(pending):
            due = 0 if cached(k, n) else cost
            fits = cached(k, n) or before.get(p, 0) + due <= left.get(p, 0)
            before[p] = before.get(p, 0) + due
            t = of.setdefault(p, [0, 0, 0])
            t[0 if fits else 1] += 1
            t[2] += due * fits
            tried += [(k, p, cost)] * fits
        if not of:
            break
        spent += [(p, n, *t) for p, t in of.items()]
        for p, t in of.items():
            if p in left:
                left[p] -= t[2]
        for k, _, _ in tried:
            new = outcome(k, n)
            if (max(new[1], new[2]), new[3] + new[4], new[5]) < (max(best[k][1], best[k][2]), best[k][3] + best[k][4], best[k][5]):
                best[k], attempt[k] = new, n
        pending = [r for r in tried if best[r[0]][0]]
    return best, attempt, sorted(spent)


def test_rounds_within_budgets(spark):
    rows = [(k, "abc"[k % 3], 10 + k % 7, *outcome(k, 0)) for k in range(60)]
    left = [("a", 90), ("b", 10_000)]  # c has nothing
    cached = lambda k, n: k % 11 == n
    best, spent = retries.rounds(
        spark.createDataFrame(rows, SCHEMA), again, ["k"], "p", ["k"], "cost", spark.createDataFrame(left, "p string, left long"), 3,
        cached=lambda df, n: df.withColumn("cached", F.col("k") % 11 == n), bucket=F.floor(F.col("k") / 10),
    )
    want, attempt, sums = brute(rows, left, 3, cached)
    assert sorted((r.p, r["round"], r.tried, r.refused, r.cost) for r in spent.collect()) == sums
    assert {r.k: (r.attempt, r.flagged, r.omission_run) for r in best.collect()} == {k: (attempt[k], v[0], v[1]) for k, v in want.items()}
    assert any(s[3] for s in sums) and max(attempt.values()) > 1


def test_nothing_to_try(spark):
    df = spark.createDataFrame([(1, "a", 5, *outcome(1, 0))], SCHEMA).withColumn("flagged", F.lit(False))
    left = spark.createDataFrame([("a", 9)], "p string, left long")
    for rows in (df, df.limit(0)):
        best, spent = retries.rounds(rows, again, ["k"], "p", ["k"], "cost", left, 2)
        assert best.count() == rows.count() and spent.count() == 0


def test_which_configuration_is_kept(spark):
    scores = {
        "more": [("current", 3, 30, 0), ("suggested", 4, 20, 9), ("reading", 3, 30, 0)], "verses": [("current", 3, 30, 0), ("suggested", 3, 31, 9)],
        "fewer warnings": [("current", 3, 30, 2), ("suggested", 3, 30, 1)], "same": [("current", 3, 30, 2), ("suggested", 3, 30, 2)],
        "reads": [("current", 3, 30, 2), ("suggested", 3, 30, 2), ("reading", 3, 30, 2)], "worse": [("current", 3, 30, 2), ("suggested", 2, 99, 0), ("reading", 3, 30, 2)],
    }
    df = spark.createDataFrame([(b, *s) for b, own in scores.items() for s in own], "b string, config string, chapters long, verses long, warnings long")
    got = {r.b: r.config for r in inference.kept_configuration(df, ["b"]).collect()}
    assert got == {"more": "suggested", "verses": "suggested", "fewer warnings": "suggested", "same": "current", "reads": "reading", "worse": "current"}
