"""Queries read every row of their tables."""

from collections import Counter

import duckdb
import pytest

from meshwork.plans import queries as Q
from meshwork.plans.graphs import EDGES, MATRICES, VECTORS, WHOLE


def test_nothing_is_left_out(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert EDGES["order_part"](spark, sf_dir).count() == n
    for source in (MATRICES["a"], MATRICES["s"], MATRICES["q"], WHOLE["b"]):
        assert source(spark, sf_dir).agg({"val": "sum"}).first()[0] >= n
    assert VECTORS["x"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


@pytest.mark.parametrize("name", ["cc_order_part", "cc_adaptive", "cc_hybrid", "cc_label_doubling"])
def test_a_giant_component_is_met(spark, sf_dir, name):
    edges = duckdb.sql(f"SELECT 2 * l_orderkey, 2 * l_partkey + 1 FROM '{sf_dir}/lineitem.parquet'").fetchall()
    up = {v: v for e in edges for v in e}

    def top(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.vertex: r.component for r in Q.QUERIES[name](spark, sf_dir).collect()}
    assert got == {v: top(v) for v in up}
    assert max(Counter(got.values()).values()) > len(got) / 2


def test_every_query_over_a_part_has_its_whole():
    over = {n for n, sql in Q.ORACLES.items() if MATRICES["b"].sql in sql}
    assert over and not {n for n in over if f"{n}_whole" not in Q.ORACLES}
    assert {n for n, sql in Q.ORACLES.items() if "l_quantity >=" in sql} == over | {"bfs_filtered"}


def test_debruijn_components_over_documents(spark, tmp_path):
    """Brute force over 31-mers, a vertex being the lesser of a k-mer and its reverse complement."""
    texts = ["the quick brown fox jumps over the lazy dog and runs far away", "quick brown fox jumps over the lazy dog and runs", "an unrelated line of text that is long enough for some k-mers", "short"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    to = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    one = lambda k: min(k, k[::-1].translate(str.maketrans("ACGT", "TGCA")))
    near: dict[str, set[str]] = {}
    for t in texts:
        s = "".join(c for c in t.lower() if "a" <= c <= "z").translate(to)
        for i in range(len(s) - 31):
            a, b = one(s[i : i + 31]), one(s[i + 1 : i + 32])
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    sizes, seen = Counter(), set()
    for k in near:
        if k not in seen:
            todo, size = [k], 0
            seen.add(k)
            while todo:
                size += 1
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            sizes[size] += 1
    assert {r.n: r.components for r in Q.QUERIES["cc_debruijn_whole"](spark, str(tmp_path)).collect()} == sizes
