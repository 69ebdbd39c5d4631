import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lectern.llm import quality as q

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(text, model):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    tokens = [t for w in words for t in model.encode(w)]
    n = len(tokens)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n, sum(model.is_byte(t) for t in tokens), entropy


def rows():
    rnd = random.Random(5)
    words = "the of and house été Straße naïve 日本語 ☃ #tag a|b <x>".split()
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60))).replace(" of ", "\n" if i % 3 else " "), ["en", "fr", None, "xx"][i % 4]) for i in range(60)]
    block = " ".join(f"w{i}" for i in range(20))
    out += [(100, f"{block} x {block} y", "en"), (101, "same line here\n" * 9, "en"), (102, None, "en"), (103, "", None), (104, " \t\n\x0b\x0c\r", "de"), (105, "\x1c\x1f\x85\xa0", "en"), (106, f"{block}\n" * 3000, "en"), (None, "no id " * 30, "en")]
    return [*out, (7, "repeated row", "en"), (7, "repeated row", "en")]


def test_measures_match_brute_force(spark):
    model = SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows()], "doc_id bigint, text string, lang string, n_words int, script string")
    got = q.measures(df.select("doc_id", "lang", "text", "n_words"), PATH).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_bytes", "entropy"]
    key = lambda r: tuple(x if x is not None else -1 for x in r)
    mine = sorted(((r.doc_id, *[r[n] for n in names]) for r in got), key=key)
    want = sorted(((d, *plain(t, model)) for d, t, _ in rows()), key=key)
    for a, b in zip(mine, want):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1])


def test_verdict(spark):
    got = {r.doc_id: r for r in q.op2_quality(spark.createDataFrame(rows(), "doc_id bigint, text string, lang string"), PATH).collect()}
    assert got[106].base_failed and not got[106].kept and got[102].base_failed and got[102].n_words == 0
    assert all(not r.kept for r in got.values() if r.base_failed)
    assert got[100].n_repeat_words == 40 and got[101].n_dup_lines == 8
    assert q.op2_quality(spark.createDataFrame([], "doc_id bigint, text string, lang string"), PATH).collect() == []


def test_labels_of_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = q.op2_quality(docs, PATH).join(labels, "doc_id").where("NOT base_failed")
    good = found.where("quality = 1").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    bad = found.where("quality = 0").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert good > 0.97 and (bad is None or bad < 0.2)


def test_filtered_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit(False)).withColumn("n_words", F.lit("x"))
    out = q.filtered(docs, PATH)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


@pytest.mark.parametrize("text, script", [("abc é", "latin"), ("привет a", "cyrillic"), ("日本語 a", "cjk"), ("", "other"), ("123", "other"), ("ελλ", "greek"), ("ไทยไทย", "other")])
def test_script(text, script):
    assert q.script(text) == script
