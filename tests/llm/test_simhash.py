import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from meshwork.llm import golay, simhash


def brute(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    ids = list(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_the_code_is_perfect():
    low, high, error, many, offsets = golay.tables()
    assert sorted(np.bincount(many).nonzero()[0]) == [1, 6] and len({int(e) for e in error}) == 2048
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= 1 << int(b)
        (kx, nx), (ky, ny) = golay.keys(x), golay.keys(y)
        assert all(set(kx[i, : nx[i]]) & set(ky[i, : ny[i]]) for i in range(len(x)))


def test_keys_cover_every_distance_up_to_four():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        # errors fall anywhere, or all into one segment
        span = [range(64), range(23), range(23, 46), range(46, 64)][i % 4]
        for b in rng.choice(list(span), int(rng.integers(0, 5)), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    sets = []
    for v in (x, y):
        own = [set() for _ in v]
        for k, r in zip(*simhash.key_rows(v.view(np.int64)), strict=True):
            own[r].add(int(k))
        sets.append(own)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "a b c", "A B c D", "a b c d", "a\x0bb\x0cc\rd e f", "é É ß", "x " * 40_000, "a b c d e a b c d e"]
    s = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(s).collect()}
    assert out == {i: brute(t) for i, t in enumerate(texts)}
    h = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0] % 2**64
    assert out[6] == h == out[5]


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randint(1, 12)):
            t = base[:]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", None, texts[0], texts[0], "one"]
    return texts


def test_components_against_all_pairs(spark):
    rows = [(i + 10, t) for i, t in enumerate(near_texts(3))]
    out = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes({i: brute(t) for i, t in rows})
    assert {i: r.component_id for i, r in out.items()} == want and len(set(want.values())) < len(rows)
    assert all(r.fingerprint == f"{brute(t):016x}" for (i, t), r in zip(rows, (out[i] for i, _ in rows), strict=True))


def test_one_dense_ball_is_one_component(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63)
    fps = {0: int(base)}
    for i in range(1, 600):
        f = fps[int(rng.integers(0, i))]
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            f ^= 1 << int(b)
        fps[i] = f
    df = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in fps.items()], "doc_id long, fp long")
    assert simhash.components(df).select("comp").distinct().count() == 1


def signed(f):
    return f - 2**64 if f >> 63 else f


def test_an_outlier_in_a_dense_group_costs_a_line_not_a_square(spark):
    """One torn key of n members of one component and one outlier: n pairs at most; components as all pairs give them."""
    rows = lambda n: spark.range(n).selectExpr("1L key", "id * 7919 fp", "0L comp").unionAll(spark.sql("select 1L key, 3L fp, 5L comp"))
    for n in (200, 800):
        assert 0 < simhash.torn_pairs(rows(n)).count() <= 5 * n
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**63))
    for spread in (1, 4, 8):
        fps = {0: base}
        for i in range(1, 400):
            f = base
            for b in rng.choice(64, int(rng.integers(1, spread + 1)), replace=False):
                f ^= 1 << int(b)
            fps[i] = f
        df = spark.createDataFrame([(i, signed(f)) for i, f in fps.items()], "doc_id long, fp long")
        got = {r.fp: r.comp for r in simhash.components(df).collect()}
        want = classes(fps)
        groups = lambda of: {frozenset(i for i in fps if of(i) == c) for c in {of(i) for i in fps}}
        assert groups(lambda i: got[signed(fps[i])]) == groups(want.get)


def test_few_outliers_make_no_rows_by_parts(spark):
    """Up to FEW members outside the main component of a key are compared as they are; with more, only those that share a part."""
    plan = lambda n: (out := simhash.torn_pairs(torn(n)), out._jdf.queryExecution().executedPlan().toString())
    torn = lambda n: spark.range(100).selectExpr("1L key", "id * 7919 fp", "0L comp").unionAll(spark.range(n).selectExpr("1L key", "id * 104729 + 3 fp", "id + 5 comp"))
    for n in (1, simhash.FEW, simhash.FEW + 1, 40):
        pairs, told = plan(n)
        assert ("Generate" in told) == (n > simhash.FEW)
        rows = [tuple(r) for r in torn(n).select("fp", "comp").collect()]
        near = {(x, y) for x, c in rows for y, d in rows if c != d and (x ^ y).bit_count() <= 4}
        got = {tuple(r) for r in pairs.where("bit_count(fp ^ fp2) <= 4").select("fp", "fp2").collect()}
        assert got | {(y, x) for x, y in got} == near and near


def test_a_full_sieve_and_none_give_the_same_components(spark, monkeypatch):
    fps = {i: brute(t) for i, t in enumerate(near_texts(9))}
    df = spark.createDataFrame([(i, signed(f)) for i, f in fps.items()], "doc_id long, fp long")
    want = {tuple(r) for r in simhash.components(df).collect()}
    for bits in (12, 3):  # most places taken; fewer places than hubs: no sieve
        monkeypatch.setattr(simhash, "SIEVE_BITS", bits)
        assert {tuple(r) for r in simhash.components(df).collect()} == want


def test_dedup_loses_no_text(spark):
    """Two unrelated texts under one doc_id both stay; copies without a doc_id are copies; identical rows leave one."""
    d = "doc_id long, text string, tags map<string,string>"
    rows = [(3, "alpha beta gamma delta epsilon", None), (3, "one two three four five six", None), (None, "one two three four five six", None)]
    rows += [(None, "zeta eta theta iota kappa", None), (None, "zeta eta theta iota kappa", {"a": "b"})] + [(9, "lambda mu nu xi omicron pi", None)] * 3
    rows += [(4, "alpha beta gamma delta epsilon", None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, d))
    assert sorted((r.doc_id or -1, r.text[:4]) for r in kept.collect()) == [(-1, "zeta"), (3, "alph"), (3, "one "), (9, "lamb")]
    assert simhash.one_of_each(spark.createDataFrame([], d)).count() == 0


def test_nulls_repeats_empty_and_extra_columns(spark):
    d = "doc_id long, text string, fp string, key int"
    rows = [(None, "q w e r t", "x", 1), (None, "other words are here now", "x", 2), (7, "same text of words", "x", 1), (7, "same text of words", "x", 1), (3, "same text of words", "y", 2)]
    df = spark.createDataFrame(rows, d)
    out = simhash.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 5
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 3]
    assert simhash.near_duplicates(spark.createDataFrame([], d)).count() == 0
