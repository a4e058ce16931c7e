"""Matching, independent sets, betweenness, clustering and indexing against small brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import centrality, independent, matching
from meshwork.operators import matrix as M
from meshwork.operators.components import symmetrise


def largest(edges):
    mate = {}

    def grow(c, seen):
        for r in (r for r, k in edges if k == c and r not in seen):
            seen.add(r)
            if r not in mate or grow(mate[r], seen):
                mate[r] = c
                return True
        return False

    return sum(grow(c, set()) for c in sorted({c for _, c in edges}))


@pytest.mark.parametrize("seed", [1, 2])
def test_maximum_matching(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(30)]
    df = spark.createDataFrame(edges, "row long, col long")
    got = matching.maximum_matching(df, "greedy")
    assert got.count() == largest(set(edges))
    assert matching.is_matching(got, df).first().ok and matching.is_maximal_matching(got, df).first().ok


def test_validators_find_faults(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "row long, col long")
    mates = lambda *x: spark.createDataFrame(x, "row long, col long")
    assert not matching.is_matching(mates((0, 1)), df).first().ok
    assert not matching.is_matching(mates((0, 0), (1, 0)), df).first().ok
    assert not matching.is_maximal_matching(mates((0, 0)), df).first().ok


@pytest.mark.parametrize("distance", [1, 2])
def test_independent_sets(spark, distance):
    rng = random.Random(3)
    pairs = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)}
    s = {r.vertex for r in independent.mis(spark.createDataFrame(sorted(pairs), "src long, dst long"), 7, distance=distance).collect()}
    near = {v: {v} for e in pairs for v in e}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    ball = near if distance == 1 else {v: set().union(*(near[w] for w in near[v])) for v in near}
    assert all(not (ball[a] & s - {a}) for a in s) and all(ball[v] & s for v in near)


def test_betweenness(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5)]
    both = symmetrise(spark.createDataFrame(pairs, "src long, dst long"))
    got = {r.vertex: round(r.score, 9) for r in centrality.betweenness(both, both.select(F.col("src").alias("vertex")).distinct()).collect()}
    near = {v: [b if a == v else a for a, b in pairs if v in (a, b)] for v in range(6)}

    def paths(s, t):
        best, todo, found = None, [[s]], []
        while todo and not found:
            todo = [p + [w] for p in todo for w in near[p[-1]] if w not in p]
            found = [p for p in todo if p[-1] == t]
        return found or best or []

    want = dict.fromkeys(range(6), 0.0)
    for s, t in itertools.permutations(range(6), 2):
        all_ = paths(s, t)
        for p in all_:
            for v in p[1:-1]:
                want[v] += 1 / len(all_)
    assert got == {v: round(x, 9) for v, x in want.items()}


def test_clusters(spark):
    pairs = list(itertools.combinations(range(4), 2)) + list(itertools.combinations(range(10, 14), 2)) + [(3, 10)]
    a = M.from_edges(symmetrise(spark.createDataFrame(pairs, "src long, dst long")))
    got = {r.vertex: r.cluster for r in centrality.markov_clustering(a).collect()}
    assert len({got[v] for v in range(4)}) == 1 and len({got[v] for v in range(10, 14)}) == 1 and got[0] != got[13]


def test_prune_assign_and_index(spark):
    a = spark.range(100).select((F.col("id") % 10).alias("row"), F.expr("id div 10").alias("col"), F.col("id").alias("val"))
    at = lambda *x: spark.createDataFrame(list(enumerate(x)), "idx long, val long")
    ri, ci = at(2, 5, 7), at(1, 9)
    hole = M.prune_block(a, ri, ci)
    assert hole.count() == 94 and M.index(hole, ri, ci).count() == 0
    b = M.index(a, ri, ci)
    assert M.equal(M.assign(hole, ri, ci, b), a).first().same
    p = at(3, 1, 0, 2, 4, 9, 8, 7, 6, 5)
    back = spark.createDataFrame([(v, i) for i, v in enumerate((3, 1, 0, 2, 4, 9, 8, 7, 6, 5))], "idx long, val long")
    assert M.equal(M.index(M.index(a, p, p), back, back), a).first().same
