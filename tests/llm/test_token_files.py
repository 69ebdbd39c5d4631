import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_encode_as_whole_texts():
    rnd = random.Random(4)
    parts = ["word", " ", "  ", "\n", "\t", "été", "don't", "'s", "12", "$%", " ", "　", "日本", "\x1c", "x" * 50, ",", ".", "_", "a,", "é.", "\u0301", "\u0085", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["", " ", "  ", "a  ", "a \n ", " a"]
    known, whole = tf.Pieces(PATH), Tokenizer.from_file(PATH)
    ids, n = known.encode(texts)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n, limit", [(1, 18), (2, 18), (3, 2), (300, 9), (5000, 13), (60, 6)])
def test_codes(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(2 * n + 5, np.int64)
    counts[rng.choice(len(counts), n, replace=False)] = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
    lengths = tf.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all() and used.max() <= limit
    if n > 1:
        assert (2.0**-used).sum() == 1
    codes = tf.canonical(lengths)
    written = sorted(f"{codes[i]:0{lengths[i]}b}" for i in np.flatnonzero(lengths))
    assert not any(b.startswith(a) for a, b in zip(written, written[1:]))
    ids = rng.choice(np.flatnonzero(counts), 5000)
    bits, marks, size = tf.packed(ids, codes, lengths)
    assert "".join(f"{codes[i]:0{lengths[i]}b}" for i in ids) == "".join(f"{b:08b}" for b in bits)[:size]
    n_of = np.full(len(marks), tf.STRIDE)
    n_of[-1] = len(ids) - tf.STRIDE * (len(marks) - 1)
    got = tf.unpacked(np.frombuffer(bits, np.uint8), marks, n_of, tf.table(lengths, limit), limit)
    assert (got == ids).all()
    # A stretch alone decodes without those before it.
    assert (tf.unpacked(np.frombuffer(bits, np.uint8), marks[3:4], n_of[3:4], tf.table(lengths, limit), limit) == ids[3 * tf.STRIDE : 4 * tf.STRIDE]).all()


def test_lengths_are_as_short_as_huffman():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2, 0])
    heap, cost = [c for c in counts.tolist() if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((tf.code_lengths(counts) * counts).sum()) == cost


def test_files(spark):
    rnd = random.Random(6)
    words = [w + s for w in "the of and Überraschung naïve été word".split() for s in ("", ",", ".", "\n")]
    rows = [(i * 3 % 997, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(600)]
    rows += [(2000, None), (2001, ""), (2002, "long text " * 40_000), (None, "null id"), (5, "repeated"), (5, "repeated"), (-3, "first")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, start int, part string")
    got = sorted((tuple(r) for r in tf.op4_token_files(df, PATH).collect()), key=lambda r: r[1])
    whole = Tokenizer.from_file(PATH)
    want, at = [], 0
    by = {}
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        by.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for d in sorted(by, key=lambda d: (d is not None, d or 0)):
        assert sorted(r[2:] for r in got if r[0] == d) == sorted(by[d])
        want += [d] * len(by[d])
    assert [r[0] for r in got] == want
    for r in got:
        assert r[1] == at
        at += r[2]
    assert tf.op4_token_files(df.limit(0), PATH).collect() == []


def test_forgotten_pieces_are_encoded_anew(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN", 50)
    monkeypatch.setattr(tf, "KEPT", 20)
    known, whole = tf.Pieces(PATH), Tokenizer.from_file(PATH)
    for i in range(20):
        text = " ".join(f"word{j}" for j in range(i, i + 30))
        ids, _ = known.encode([text])
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and len(known) <= 80
