import random
from collections import Counter, defaultdict

import pytest

from meshwork.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def reshared(sizes):
    """Targets by resharing round after round, as the contract says it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, free = float(sum(sizes.values())), list(names)
    while rest > 1e-9 and free:
        share, total, rest = rest, sum(w[s] for s in free), 0.0
        for s in free:
            target[s] += share * w[s] / total
        for s in free:
            if target[s] > 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
        free = [s for s in free if target[s] < 3 * sizes[s]]
    return target


def corpus(seed, n=1200):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "tiny", "empty"]
    rows = []
    for i in range(n):
        s = "a" if rng.random() < 0.4 else rng.choice(names[:5])
        rows.append((i, "w " * min(int(rng.paretovariate(1.1) * 10), 3000), s))
    return [*rows, (n, "only three words", "tiny"), (n + 1, "", "empty"), (n + 2, None, "empty"), (None, "a b", "a"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken, largest = reshared(sizes), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        rate = r.target / r.source_size if r.source_size else 0
        # copies differ from the expected number by less than one, but for those turned over at the root
        assert r["size"] == 0 or int(rate - 1e-9) <= r.copies <= int(rate + 1e-9) + 1
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(mixing.NEAR * want[s], largest[s] / 2) + 1e-6, s


def test_reruns_agree_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame(corpus(3, 600), SCHEMA)
    one, two = (Counter(map(tuple, mixing.mix(x).collect())) for x in (df, df.repartition(7)))
    assert one == two


def test_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = [(i, "w " * (1 + i * 7 % 50), "s" if i % 3 else "t") for i in range(700)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in "st":
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 25.5


def test_expected_copies_are_kept(spark, monkeypatch):
    """Over many seeds a document is taken as often as its probability says: within the standard error, the largest too."""
    rows = [(i, "w " * (400 if i == 0 else 3 + i % 5), "a" if i < 250 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    monkeypatch.setattr(mixing, "BLOCK", 32)
    total, rate, seeds = Counter(), {}, 16
    for seed in range(seeds):
        monkeypatch.setattr(mixing, "SEED", seed)
        out = mixing.mix(df).collect()
        for r in out:
            total[r.doc_id] += r.copies
            rate[r.doc_id] = r.target / r.source_size
        for s in "ab":
            assert abs(sum(r.taken for r in out if r.source == s) / next(r.target for r in out if r.source == s) - 1) <= mixing.NEAR
    error = lambda i: ((rate[i] % 1) * (1 - rate[i] % 1) / seeds) ** 0.5
    off = {i: (total[i] / seeds - rate[i]) / error(i) for i in rate}
    assert abs(off[0]) < 3 and sum(abs(x) > 3 for x in off.values()) <= 4
    for of in (lambda i: 0 < i < 250, lambda i: i >= 250):
        mine = [x for i, x in off.items() if of(i)]
        assert abs(sum(mine) / len(mine)) < 0.3 and 0.7 < sum(x * x for x in mine) / len(mine) < 1.3


def test_hot_document_empty_table_and_extra_columns(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c", "s")] * 500 + [(i, "x y", "t") for i in range(2, 30)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as m", "'c' as copies", "map('a', 1) as extra")
    out = mixing.mix(df)
    assert out.count() == len(rows)
    again = mixing.mixed(df)
    assert again.columns == df.columns and again.count() == sum(r.copies for r in out.collect())
    counts = {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()}
    want = Counter()
    for r in out.collect():
        want[r.doc_id] += r.copies
    assert counts == {k: v for k, v in want.items() if v}


def test_a_small_source_is_paid_back_beside_a_hot_one(spark, monkeypatch):
    """99 documents of 200 words and one of 20,000, beside a source of several blocks."""
    monkeypatch.setattr(mixing, "SEED", 0)
    rows = [(i, "w " * (200 if i else 20_000), "b") for i in range(100)] + [(1000 + i, "w " * 60, "a") for i in range(700)]
    mine = [r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect() if r.source == "b"]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 100 + 1e-6


def test_mixed_repeats_the_rows_that_the_mix_takes(spark):
    """Units of several texts and of identical rows: every text as often as its share of the unit's copies."""
    rows = [(1, "a b c", "s")] * 5 + [(1, "d e f", "s"), (1, "g h i", "s"), (None, "j k", None), (None, "j k", None)] + [(10 + i, "x y z w", "t") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = Counter(r.text for r in mixing.mixed(df).collect())
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[(r.source, r.doc_id)] += r.copies
    assert sum(out[t] for t in ("a b c", "d e f", "g h i")) == taken[("s", 1)] and out["j k"] == taken[(None, None)]
    most, least = divmod(taken[("s", 1)], 7)
    assert 5 * most <= out["a b c"] <= 5 * most + 5 and sorted({out["d e f"], out["g h i"]}) in ([most], [most + 1], [most, most + 1]), least
