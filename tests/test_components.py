"""The connectivity fixtures: chains, three components, peeling, against union-find."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.operators import bfs, components, edges
from meshwork.operators.components import contract_components, symmetrise
from meshwork.session import Growing, cut, release

THREE = [(2, 11), (2, 3), (2, 4), (3, 4), (5, 6), (5, 8), (6, 10), (6, 8), (50, 51), (51, 52)]
METHODS = [{"method": "contract"}, {"method": "label"}, {"method": "label", "doubling": False}, {"method": "label", "prune_stable": False}, {"method": "hybrid", "bfs_runs": 2}, {"method": "auto"}]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def labels(cc):
    return {r.vertex: r.component for r in cc.collect()}


@pytest.mark.parametrize("kw", METHODS, ids=str)
def test_three_components(spark, kw):
    got = labels(bfs.connected_components(frame(spark, THREE), **kw))
    assert got == union_find(THREE) and set(got.values()) == {2, 5, 50}


@pytest.mark.parametrize("method", ["contract", "label"])
def test_shuffled_chain(spark, method):
    pairs = [(i, i + 1) for i in range(1, 1000)]
    random.Random(1).shuffle(pairs)
    assert labels(bfs.connected_components(frame(spark, pairs), method)) == dict.fromkeys(range(1, 1001), 1)


def test_chain_of_many_rounds(spark):
    """Size estimates end with the lineage, and contraction needs few rounds however long the chain."""
    pairs = spark.range(99_999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    cc = contract_components(pairs, at_hand=0, max_rounds=40)
    assert cc.where("component <> 0").isEmpty() and cc.count() == 100_000
    with pytest.raises(RuntimeError):
        contract_components(pairs, at_hand=0, max_rounds=3)


def test_cut_ends_size_estimates(spark):
    now = spark.range(1000).select(F.col("id").alias("a"))
    sizes = []
    for _ in range(15):
        now = cut(now.join(now.select(F.col("a").alias("b")), F.col("a") == F.col("b")).select("a"))
        sizes.append(int(now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert max(sizes) < 10 * sizes[0]


def test_cut_marks_release_and_growing(spark):
    kept = cut(spark.range(10), n=F.count(F.lit(1)), top=F.max("id"))
    assert kept.marks == {"n": 10, "top": 9} and kept.count() == 10
    release(kept)
    with pytest.raises(Exception, match="(?i)not exist"):
        spark.read.parquet(kept.folder)
    grows = Growing(spark, "id long")
    assert [grows.add(spark.range(k))[1] for k in (3, 0, 4)] == [3, 0, 4]
    assert grows.all().count() == 7 and grows.last(1).count() == 4 and grows.last(2).count() == 4


def test_contraction_to_the_last_edge_and_at_hand_agree(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(-900, 900), rng.randint(-900, 900)) for _ in range(900)]
    for at_hand in (0, 100, 1 << 16):
        assert labels(contract_components(frame(spark, pairs), at_hand)) == union_find(pairs)


def test_levels_beyond_the_most_are_an_error(spark):
    both = symmetrise(frame(spark, [(i, i + 1) for i in range(6)]))
    assert bfs.bfs_tree(both, 0, max_levels=6).count() == 7
    with pytest.raises(RuntimeError):
        bfs.bfs_tree(both, 0, max_levels=5)


def test_medium_three_components(spark):
    pairs = THREE[:8] + [(i, i + 1) for i in range(50, 1000)]
    cc = bfs.connected_components(frame(spark, pairs), "contract")
    assert set(labels(cc).values()) == {2, 5, 50} and edges.component_count(cc).first().n == 3


def test_random_graph_with_loops_repeats_and_nulls(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(-200, 200), rng.randint(-200, 200)) for _ in range(230)]
    pairs += pairs[:20] + [(900, 900)]
    df = frame(spark, [*pairs, (None, 3), (4, None)])
    for method in ("contract", "label"):
        assert labels(bfs.connected_components(df, method)) == union_find(pairs)


def test_empty(spark):
    for kw in METHODS:
        assert bfs.connected_components(frame(spark, []), **kw).count() == 0


def test_hub(spark):
    pairs = [(0, i) for i in range(1, 3000)]
    assert Counter(labels(bfs.connected_components(frame(spark, pairs), "contract")).values()) == {0: 3000}


def chains(p):
    return [(k * 50 + i, k * 50 + i + 1) for k in range(p) for i in range(49)]


def test_peel_one_of_four(spark):
    both = symmetrise(frame(spark, chains(4)))
    sizes, seen = bfs.bfs_peel(both, 1)
    assert sizes == [50] and edges.drop_visited(both, seen).count() == 98 * 3


def test_peel_all_in_one_call_and_one_by_one(spark):
    both = symmetrise(frame(spark, chains(2)))
    sizes, seen = bfs.bfs_peel(both, 5)
    assert sizes == [50, 50] and edges.drop_visited(both, seen).count() == 0
    left, got = both, []
    for _ in range(2):
        sizes, seen = bfs.bfs_peel(left, 1)
        got += sizes
        left = edges.drop_visited(left, seen)
    assert got == [50, 50] and left.count() == 0


def test_tree_and_verifier(spark):
    both = symmetrise(frame(spark, THREE))
    tree = bfs.bfs_tree(both, 2)
    assert {r.vertex: (r.parent, r.level) for r in tree.collect()} == {2: (2, 0), 3: (2, 1), 4: (2, 1), 11: (2, 1)}
    codes = lambda t, root=2: {r.code: r.n for r in bfs.verify_bfs_tree(t, both, root).collect()}
    assert codes(tree) == {0: 8}
    assert -12 in codes(tree.where("vertex <> 4")) and -13 in codes(tree.where("vertex <> 4"))
    assert -999 in codes(tree, 5)
    moved = tree.withColumn("parent", F.when(F.col("vertex") == 11, 3).otherwise(F.col("parent")))
    assert codes(moved) == {-14: 2, -15: 1} or -15 in codes(moved)
    assert -16 in codes(tree.withColumn("parent", F.when(F.col("vertex") == 4, 4).otherwise(F.col("parent"))))
    assert -1 in codes(tree.withColumn("parent", F.when(F.col("vertex") == 4, 11).when(F.col("vertex") == 11, 4).otherwise(F.col("parent"))))


def test_component_measures(spark):
    df = frame(spark, THREE)
    cc = bfs.connected_components(df)
    assert edges.largest_component_edges(cc, symmetrise(df)).first().n == 4
    assert {(r.component, r.n) for r in edges.component_sizes(cc).collect()} == {(2, 4), (5, 4), (50, 3)}


def batches_of(pairs, size):
    for k in range(0, len(pairs), size):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + size, 0]), pa.array(pairs[k : k + size, 1])], ["src", "dst"])


def test_one_task_holds_vertices_not_edges(spark, monkeypatch):
    """Blocks in any order give what all edges at once give; four times the edges over the same vertices take no more memory."""
    rng = np.random.default_rng(3)
    pairs = np.concatenate([rng.integers(-500, 500, (300, 2)), rng.integers(2**61, 2**61 + 900, (400, 2)), [[7, 7], [-9000, -9000]]])
    want = union_find(pairs.tolist())
    for block in (1, 50, 10_000):
        monkeypatch.setattr(components, "_blocks", lambda b, of=components._blocks, block=block: of(b, block))
        got = pa.Table.from_batches(components._finished(batches_of(pairs, 64)))
        assert dict(zip(got["vertex"].to_pylist(), got["root"].to_pylist(), strict=True)) == want
        trees = pa.Table.from_batches(components._forest(batches_of(pairs, 64)))
        assert union_find(zip(trees["src"].to_pylist(), trees["dst"].to_pylist(), strict=True)) == want
        monkeypatch.undo()
    few = rng.integers(0, 1000, (50_000, 2))
    peaks = []
    for n in (40, 160):
        tracemalloc.start()
        list(components._finished(b for _ in range(n) for b in batches_of(few, 10_000)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]


def test_sequential_beyond_its_task_contracts_first(spark):
    pairs = [(random.Random(i).randrange(900), random.Random(-i).randrange(900)) for i in range(1, 700)] + [(5000, 5000)]
    for most in (10, 1 << 20):
        assert labels(components.sequential_components(frame(spark, pairs), most)) == union_find(pairs)
    assert labels(bfs.connected_components(frame(spark, THREE), "sequential")) == union_find(THREE)
