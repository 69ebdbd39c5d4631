import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lectern.llm import pieces as ps

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return ps.Lattice(PATH)


def every_way(lattice, marked):
    """All segmentations of a short text by recursion, best first."""
    if not marked:
        return [(0.0, ())]
    out = []
    for k in range(1, min(len(marked), lattice.longest) + 1):
        if marked[:k] in lattice.piece:
            i, s = lattice.piece[marked[:k]]
            out += [(s + t, (i, *rest)) for t, rest in every_way(lattice, marked[k:])]
    if marked[0] not in lattice.piece:
        own = tuple(lattice.byte[b] for b in marked[0].encode())
        out += [(lattice.unknown + t, (*own, *rest)) for t, rest in every_way(lattice, marked[1:])]
    return sorted(out, key=lambda w: -w[0])


@pytest.mark.parametrize("text", ["a", "the", "hello w", "  in  ", "x\ny", "\n", " ", "añ日\u0001", "of the in", "␣é"])
def test_n_best_are_the_best_of_all(lattice, text):
    known = ps.Chunks(lattice, 6)
    numbers = known.numbers(lattice.chunks(text))
    ways = ps.n_best(numbers, known)
    want = every_way(lattice, ("▁" + text).replace(" ", "▁"))
    assert [s for s, _ in ways] == pytest.approx([s for s, _ in want[:6]])
    got = [tuple(ps.ids_of(numbers, known, d).tolist()) for _, d in ways]
    assert len(set(got)) == len(got)
    by = dict((ids, s) for s, ids in want)
    for (s, _), ids in zip(ways, got):
        assert by[ids] == pytest.approx(s) and lattice.decode(ids) == text


def test_two_levels_are_one_search(lattice):
    rnd = random.Random(1)
    for _ in range(30):
        text = " ".join(rnd.choice("the of naïve xyzzy einer é 12 (a) running".split()) for _ in range(rnd.randrange(1, 8)))
        known = ps.Chunks(lattice, 5)
        ways = ps.n_best(known.numbers(lattice.chunks(text)), known)
        whole = lattice.best(("▁" + text).replace(" ", "▁"), 5)
        assert [s for s, _ in ways] == pytest.approx([s for s, _ in whole])


def test_chunks_are_the_text(lattice):
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choice(" ab\n\t é") for _ in range(rnd.randrange(12)))
        assert "".join(lattice.chunks(text)) == (("▁" + text).replace(" ", "▁") if text else "")


def as_unigram(proto):
    """The model's bytes with the kind unigram and the scores used here; fields by their public numbers."""

    def varint(b, i):
        x = s = 0
        while True:
            x |= (b[i] & 127) << s
            s += 7
            i += 1
            if b[i - 1] < 128:
                return x, i

    def number(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    def fields(b):
        i = 0
        while i < len(b):
            tag, i = varint(b, i)
            if tag & 7 == 2:
                n, j = varint(b, i)
                yield tag, b[j : j + n]
                i = j + n
            elif tag & 7 == 0:
                v, i = varint(b, i)
                yield tag, v
            else:
                n = {5: 4, 1: 8}[tag & 7]
                yield tag, b[i : i + n]
                i += n

    def written(items):
        return b"".join(number(t) + (number(len(v)) + v if t & 7 == 2 else number(v) if t & 7 == 0 else v) for t, v in items)

    lattice = ps.Lattice(PATH)
    out = []
    for tag, value in fields(proto):
        if tag >> 3 == 1:
            own = dict(fields(value))
            piece = own[10].decode()
            if piece in lattice.piece:
                own[21] = np.float32(lattice.piece[piece][1]).tobytes()
            value = written(own.items())
        elif tag >> 3 == 2:
            value = written([(t, 1 if t == 24 else v) for t, v in fields(value)])
        out.append((tag, value))
    return written(out)


def test_agrees_with_the_library_on_a_unigram_model(lattice):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=as_unigram(open(PATH, "rb").read()))
    for text in ["the running of einer", "naïve words", "over lattice pieces", "(12) a"]:
        known = ps.Chunks(lattice, 4)
        numbers = known.numbers(lattice.chunks(text))
        got = {tuple(ps.ids_of(numbers, known, d).tolist()) for _, d in ps.n_best(numbers, known)}
        assert tuple(ps.ids_of(numbers, known).tolist()) == tuple(model.encode(text))
        assert got == set(map(tuple, model.nbest_encode_as_ids(text, 4)))


def test_rows(spark, lattice):
    rows = [(1, "The naïve the\n\nof"), (2, None), (3, ""), (4, "long text é " * 20_000), (None, "no id"), (5, "same"), (5, "same"), (6, "\x00퟿▁")]
    df = spark.createDataFrame([(d, t, 1, 2.0) for d, t in rows], "doc_id bigint, text string, ids int, score double")
    got = sorted(ps.encoded(df, PATH, with_alternatives=True).collect(), key=repr)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        assert len(r.ids) == r.n_pieces and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.best_scores == sorted(r.best_scores, reverse=True) and r.alternatives[0] == r.ids
        assert r.score == pytest.approx(sum(w[0][0] for w in (lattice.best(c, 1) for c in lattice.chunks(text))))
        if "▁" not in text:
            assert r.round_trip and all(lattice.decode(a) == text for a in r.alternatives)
    assert [r.round_trip for r in got if r.doc_id == 6] == [False]
    assert ps.op10_pieces(df.limit(0), PATH).collect() == []


def test_every_short_word(lattice):
    for a, b in itertools.product("ab é", repeat=2):
        best = lattice.best("▁" + (a + b).replace(" ", "▁"), 3)
        assert best and not any(math.isinf(s) for s, _ in best)


def test_side_by_side_is_one_by_one(lattice):
    rnd = random.Random(3)
    words = ["▁" * rnd.randrange(3) + "".join(rnd.choice("abcdefghiotn éß日,.\u0001") for _ in range(rnd.randrange(1, 14))) for _ in range(800)] + ["▁", "\n", "▁" + "x" * 500, "▁" * 40]
    words = [w.replace(" ", "") or "▁" for w in words]
    score, loss, size, flat = lattice.viterbi(words)
    at = 0
    for w, s, lost, n in zip(words, score, loss, size):
        ways = lattice.best(w, 2)
        assert s == pytest.approx(ways[0][0])
        assert lost == pytest.approx(ways[0][0] - ways[1][0]) if len(ways) > 1 else lost == math.inf
        own = flat[at : at + n].tolist()
        at += n
        if lost > 1e-9:
            assert tuple(own) == ways[0][1]
        assert b"".join(lattice.text[i] for i in own) == w.replace("▁", " ").encode()
    assert at == len(flat)


def test_unspaced_texts_take_memory_by_their_length(lattice):
    import tracemalloc

    rnd = random.Random(4)
    text = "".join(rnd.choice("thequickbrownfoxinganderst日本語") for _ in range(6000))
    tracemalloc.start()
    ways = lattice.best(text, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert len(ways) == len({w for _, w in ways}) == 4 and [s for s, _ in ways] == sorted((s for s, _ in ways), reverse=True)
    for text in (text * 17, "ab" * 50_000):
        known = ps.Chunks(lattice, 4)
        ways = ps.n_best(known.numbers(lattice.chunks(text)), known)
        assert len(ways) == 4 and all(a[0] >= b[0] for a, b in zip(ways, ways[1:]))


def test_a_million_characters_without_spaces(lattice):
    import time

    rnd = random.Random(5)
    phrase = "".join(rnd.choice("日本語の文章therunningofing") for _ in range(35))
    began = time.process_time()
    spent = []
    for n in (100_000, 1_000_000):
        text = (phrase * (n // 35 + 1))[:n]
        known = ps.Chunks(lattice, 4)
        numbers = known.numbers(lattice.chunks(text))
        ways = ps.n_best(numbers, known)
        assert len(ways) == 4 and all(a[0] >= b[0] for a, b in zip(ways, ways[1:]))
        assert all(lattice.decode(ps.ids_of(numbers, known, d).tolist()) == text for _, d in ways)
        spent.append(time.process_time() - began - sum(spent))
    assert spent[1] < 25 * spent[0]


def test_checksums_are_those_of_the_alternatives(spark):
    df = spark.createDataFrame([(1, "the running of a lattice"), (2, None), (3, "a")], "doc_id bigint, text string")
    for r in ps.encoded(df, PATH, with_alternatives=True).collect():
        assert r.best_crc32 == [zlib.crc32(np.array(a, "<u4").tobytes()) for a in r.alternatives]
        assert len(r.best_crc32) == len(r.best_scores)


@pytest.mark.parametrize("n", [300, 1000])
def test_as_many_ways_as_asked_for(lattice, n):
    want = every_way(lattice, "▁internationally")
    ways = lattice.best("▁internationally", n)
    assert len(want) > n and len(ways) == n and len({ids for _, ids in ways}) == n
    assert [s for s, _ in ways] == pytest.approx([s for s, _ in want[:n]])
