import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash


def plain_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=4):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(zip([r[0] for r in rows], prints))]


def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(40)) for _ in range(rnd.randrange(1, 200))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:15]:
        for _ in range(6):
            words = t.split()
            words[rnd.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, base[0]), (7, base[7]), (7, base[7]), (903, "ÄÖ Ünïcode x\x1fy"), (None, "lonely " * 3), (904, "w " * 30_000)]
    return rows


def test_components_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit(1), "root": F.lit("x"), "component_id": F.lit(0)})
    got = sorted((tuple(r) for r in simhash.op1_near_duplicates(df).collect()), key=repr)
    assert got == sorted(plain_components(rows), key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.op1_near_duplicates(df).collect() == []
    assert simhash.one_of_each(df).collect() == []


def test_index_in_dense_and_sparse_groups():
    rnd = np.random.default_rng(5)
    for n, centres, flips in ((300, 3, 3), (2000, 1, 2), (1500, 400, 4), (500, 500, 0)):
        centre = rnd.integers(0, 2**63, centres, dtype=np.uint64)[rnd.integers(0, centres, n)]
        for _ in range(flips):
            centre = centre ^ (np.uint64(1) << rnd.integers(0, 64, n, dtype=np.uint64))
        fp = np.unique(centre)
        group = (fp & np.uint64(1)).astype(np.int64)
        order = np.lexsort((simhash.gray_rank(fp), group))
        fp, group = fp[order], group[order]
        got = simhash.components(fp, group, 4)
        other = fp ^ (rnd.integers(0, 2**63, len(fp), dtype=np.uint64) & rnd.integers(0, 2**63, len(fp), dtype=np.uint64) & np.uint64(0xFF))
        both = np.argwhere((np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (np.bitwise_count(fp[:, None] ^ fp[None, :]) + np.bitwise_count(other[:, None] ^ other[None, :]) <= 7) & (group[:, None] == group[None, :]))
        assert (simhash.components(fp, group, 4, other, 7) == simhash.joined(np.arange(len(fp)), both[:, 0], both[:, 1])).all()
        want = np.arange(len(fp))
        near = np.argwhere((np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (group[:, None] == group[None, :]))
        want = simhash.joined(want, near[:, 0], near[:, 1])
        assert (got == want).all()


def test_gray_rank_orders_the_gray_code():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], dtype=np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(1000)).all()


def test_masks_leave_no_pair_out():
    rnd = random.Random(1)
    table = simhash.masks(4, 2)
    assert len(table) == 15
    for _ in range(2000):
        diff = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & diff == 0 for m in table)


def test_one_of_each(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id bigint, text string, fp string")
    found = simhash.groups(df, shingle=5, max_bits=simhash.NEAR_BITS, max_both=simhash.NEAR_BOTH)
    kept = simhash.one_of_each(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert kept.count() == found.select("root").distinct().count()
    assert not {r.doc_id for r in kept.collect()} - {r.component_id for r in found.collect()}


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(9)
    vocabulary = [f"word{i}" for i in range(5000)]
    rows, group = [], []
    for g in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(150, 400))]
        for _ in range(3):
            words = list(base)
            for _ in range(max(1, len(words) // 120)):
                words[rnd.randrange(len(words))] = "edited"
            rows.append((len(rows), " ".join(words)))
            group.append(g)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {group[d] for d in kept} == set(range(40)) and len(kept) <= 44


def test_links_are_those_of_brute_force_jaccard(spark):
    rnd = random.Random(21)
    vocabulary = [f"word{i}" for i in range(5000)]
    docs = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(100, 300))]
        docs.append(base)
        for share in (0.016, 0.021, 0.026, 0.04):
            words = list(base)
            for at in rnd.sample(range(len(words)), round(len(words) * share)):
                words[at] = rnd.choice(vocabulary)
            docs.append(words)
    # The same word a thousand times decides every bit, but not the set.
    docs += [["same"] * 1000 + [rnd.choice(vocabulary) for _ in range(40)] for _ in range(4)]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    label, pairs = list(range(len(docs))), 0
    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                label = [min(label[i], label[j]) if x == max(label[i], label[j]) else x for x in label]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    assert pairs > 60 and len(set(label)) > 80
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == set(label)


def sets_with_rare(n_sets, size, shared, rnd):
    """Sets of numbers whose least ones, which lead, are the same in all, with some near copies."""
    sets = {}
    for i in range(n_sets):
        if i % 10 == 9:
            own = sorted(sets[i - 1])
            own[-1 - i % 3] = rnd.randrange(1000, 2**60)
        else:
            own = [*range(1, shared + 1), *(rnd.randrange(1000, 2**60) for _ in range(size - shared))]
        sets[i] = set(own)
    return sets


@pytest.mark.parametrize("shared", [1, 2, 4, 7])
def test_sets_on_hot_shingles_lose_no_similar_pair(spark, shared):
    """Few sets make a shingle hot, so that all steps and blocks are gone through; candidates hold every similar pair."""
    rnd = random.Random(shared)
    sets = sets_with_rare(120, 30, shared, rnd)
    rows = []
    for i, own in sets.items():
        lead = sorted(own)[: 30 - 24 + simhash.RARE_MORE]
        rows += [(h, i, i, 30, pos, 0, 0, *[0] * simhash.PARITIES) for pos, h in enumerate(lead)]
    df = spark.createDataFrame(rows, "h bigint, label bigint, id bigint, n int, pos int, fp bigint, other bigint, " + ", ".join(f"{q} bigint" for q in simhash.ODD))
    similar = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in simhash.candidates(df, hot=5).collect()}
    assert len(similar) >= 12 and similar <= got
    assert similar <= {(r.a, r.b) for r in simhash.candidates(df, hot=10**9).collect()}


def test_a_pair_of_long_sets_is_not_made_by_each_shingle_it_shares(spark):
    import pyarrow as pa

    rnd = random.Random(5)
    sets = {0: set(rnd.sample(range(2**60), 1000))}
    for i in (1, 2):
        sets[i] = set(rnd.sample(sorted(sets[0]), 920)) | set(rnd.sample(range(2**60), 80))
    rows = []
    for i, own in sets.items():
        rows += [(h, i, i, 1000, pos, 0, 0, *[0] * simhash.PARITIES) for pos, h in enumerate(sorted(own)[: 200 + simhash.RARE_MORE])]
    df = spark.createDataFrame(rows, "h bigint, label bigint, id bigint, n int, pos int, fp bigint, other bigint, " + ", ".join(f"{q} bigint" for q in simhash.ODD))
    similar = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    ready = simhash.earlier(df).select(*simhash.PAIR, *simhash.ODD, *simhash.BEFORE).orderBy("h").toPandas()
    made = simhash._sharing(pa.RecordBatch.from_pandas(own, preserve_index=False) for _, own in ready.groupby("h"))
    made = [pair for batch in made for pair in zip(*(c.to_pylist() for c in batch.columns))]
    assert similar and similar <= set(made)
    assert len(made) <= 5 * len(set(made))


def test_common_shingles_are_counted_in_all_texts(spark):
    """Of 3.9 million shingles one is common, in 60 texts; none but it makes one in 100,000."""
    words = "concat_ws(' ', transform(sequence(0, 2999), x -> id * 3000 + x))"
    docs = spark.range(1300).selectExpr(f"{words} || CASE WHEN id % 20 = 0 AND id < 1200 THEN ' The same five Words here' ELSE '' END AS text")
    keys, n = simhash.common_shingles(docs, "text", 5)
    (_, own), = simhash.shingle_sets_of(["the same five words here"], 5)
    assert keys.tolist() == own.tolist() and n.tolist() == [60]
