import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import backoff_lm as lm


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split() + ["</s>"]


def plain(rows, train, order, mass):
    """Probabilities by recursion over dictionaries."""
    counts, contexts, texts = Counter(), Counter(), 0
    for (_, t), teach in zip(rows, train):
        if teach:
            texts += 1
            own = ["<s>", *tokens(t)]
            for i in range(1, len(own)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        counts[tuple(own[i - k + 1 : i + 1])] += 1
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(1 for g in counts if len(g) == 1)
    contexts = Counter({g: c for g, c in counts.items()})
    contexts["<s>",] = texts

    def p(w, h):
        if not h:
            return counts[w,] / (n + v + 1) if counts[w,] else (v + 1) / (n + v + 1)
        return (counts[(*h, w)] + mass * p(w, h[1:])) / (contexts[h] + mass)

    out = []
    for d, t in rows:
        own = ["<s>", *tokens(t)]
        score = sum(math.log10(p(own[i], tuple(own[max(0, i - order + 1) : i]))) for i in range(1, len(own)))
        base = sum(math.log10((counts[w,] + 1) / (n + v + 1)) for w in own[1:])
        out.append((d, len(own) - 1, sum(counts[w,] > 0 for w in own[1:]), n, base, score))
    # The distribution at any state sums to one.
    for h in [(), ("<s>",), ("the",), ("unseen",)][: 1 if order == 1 else 4]:
        assert sum(p(w, h) for (w,) in [g for g in counts if len(g) == 1]) + p("never seen", h) == pytest.approx(1) or not n
    return out


def rows():
    rnd = random.Random(8)
    words = "the The of AND and was it ünïcode É".split() + [f"w{i}" for i in range(60)]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(80)]
    return [*out, (200, None), (201, ""), (202, "the of " * 4000), (None, "no id the of"), (5, "repeated the"), (5, "repeated the")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_recursion(spark, order):
    data = rows()
    df = spark.createDataFrame([(d, t, 0.0, "x") for d, t in data], "doc_id bigint, text string, score double, train string").repartition(3)
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in data]
    want = plain(data, [not h for h in held], order, 40.0)
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = lm.score(df, train, order=order, mass=40.0, part_chars=3000).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:])
    if order == 2:
        op = lm.op8_scores(df).collect()
        assert len(op) == len(data) and sum(r.held_out for r in op) == sum(held)


def test_none_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert lm.op8_scores(df.limit(0)).collect() == []
    r = lm.score(df, F.lit(None).cast("boolean")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_better_than_single_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = lm.op8_scores(df).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert r.score > r.base


def test_registered_order_sees_longer_contexts(spark):
    # After "a b" comes c and after "x b" comes d: single words before can't tell.
    data = [(i, "a b c " * 30 + "x b d " * 30) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.op8_scores(df).collect()}
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in data]
    want = {r[0]: r[5] for r in plain(data, [not h for h in held], 3, lm.MASS)}
    two = {r[0]: r[5] for r in plain(data, [not h for h in held], 2, lm.MASS)}
    assert any(held)
    for d, r in got.items():
        assert r.score == pytest.approx(want[d]) and r.score > two[d] + 10
