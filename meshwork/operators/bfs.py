"""Breadth-first search: trees, peeling of components, the tree verifier, and the adaptive choice of a method.

A level is one join of the frontier with the edges, one partially aggregated min (the smallest parent wins)
and one anti-join with what was visited; levels are parts of one table in the shared folder, read by one scan however deep the tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.operators.components import contract_components, label_components, sequential_components, symmetrise
from meshwork.operators.edges import degree_ks, drop_visited
from meshwork.session import Growing, cut, cut_counted


def expand_frontier(edges: DataFrame, frontier: DataFrame, pick=F.min) -> DataFrame:
    """(vertex, parent) of all neighbours of frontier (vertex); pick chooses among parents."""
    at = frontier.select(F.col("vertex").alias("f"))
    return edges.join(at, F.col("src") == F.col("f")).groupBy(F.col("dst").alias("vertex")).agg(pick("src").alias("parent"))


def bottom_up_step(edges: DataFrame, frontier: DataFrame, unvisited: DataFrame) -> DataFrame:
    """As expand_frontier, from the side of the vertices not yet visited: less work where few are left."""
    at = frontier.select(F.col("vertex").alias("f"))
    todo = unvisited.select(F.col("vertex").alias("u"))
    return edges.join(todo, F.col("dst") == F.col("u"), "left_semi").join(at, F.col("src") == F.col("f")).groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))


def bfs_tree(edges: DataFrame, root: int, pick=F.min, single_child: bool = False, direction_optimising: bool = False, symmetric: bool = False, max_levels: int = 1_000_000) -> DataFrame:
    """(vertex, parent, level) of what root reaches; the root is its own parent.

    More than max_levels levels are an error, not a part of the tree. pick: which parent wins (F.min; F.max; a seeded hash for random parents). single_child: each parent keeps its
    smallest new child only. direction_optimising: levels whose frontier has over 1/20 of all edges, growing, go bottom-up
    until the frontier is below n^2 / (12 nnz). symmetric: the edges hold both directions, so that a neighbour of a level is
    in it, before it or new, and only the last two levels are compared, not all that was visited.
    """
    spark = edges.sparkSession
    first = spark.range(1).select(F.lit(root).cast("long").alias("vertex"), F.lit(root).cast("long").alias("parent"), F.lit(0).cast("long").alias("level"))
    tree = Growing(spark, "vertex long, parent long, level long")
    frontier, fringe = tree.add(first)
    if direction_optimising:
        vertices, n = cut_counted(edges.select(F.col("dst").alias("vertex")).distinct())
        nnz, bottom, before = edges.count(), False, 0
    for level in range(1, max_levels + 2):
        visited = (tree.last(2) if symmetric and not single_child and not direction_optimising else tree.all()).select("vertex")
        if direction_optimising:
            out = edges.join(frontier.select(F.col("vertex").alias("f")), F.col("src") == F.col("f"), "left_semi").count()
            bottom = out > nnz / 20 and fringe > before if not bottom else fringe >= n * n / (12 * max(nnz, 1))
            before = fringe
        if direction_optimising and bottom:
            found = bottom_up_step(edges, frontier, vertices.join(visited, "vertex", "left_anti"))
        else:
            found = expand_frontier(edges, frontier, pick)
        new = found.join(visited, "vertex", "left_anti")
        if single_child:
            new = new.groupBy("parent").agg(F.min("vertex").alias("vertex")).select("vertex", "parent")
        frontier, fringe = tree.add(new.select("vertex", "parent", F.lit(level).cast("long").alias("level")))
        if not fringe:
            return tree.all()
    raise RuntimeError(f"vertices beyond {max_levels} levels")


def random_parent(seed: int):
    """A pick for bfs_tree: one parent by a seeded hash."""
    return lambda c: F.min_by(F.col(c), F.xxhash64(F.lit(seed), F.col(c)))


def filtered_bfs(edges: DataFrame, keep: Column, root: int) -> DataFrame:
    """BFS over the edges whose attributes pass; the predicate is pushed below the traversal's joins."""
    return bfs_tree(cut(edges.where(keep).select("src", "dst").distinct()), root)


def bfs_peel(edges: DataFrame, n: int) -> tuple[list[int], DataFrame]:
    """Up to n searches over symmetric edges, each from the smallest vertex not visited: (vertices of each run, all visited (vertex))."""
    left = cut(edges.select("src", "dst"))
    sizes: list[int] = []
    done: list[DataFrame] = []
    for _ in range(n):
        root = left.agg(F.min("src")).first()[0]
        if root is None:
            break
        tree = cut(bfs_tree(left, root, symmetric=True).select("vertex"))
        sizes.append(tree.count())
        done.append(tree)
        left = cut(drop_visited(left, tree))
    empty = edges.sparkSession.createDataFrame([], "vertex long")
    return sizes, reduce(DataFrame.unionAll, done, empty)


def connected_components(edges: DataFrame, method: str = "auto", doubling: bool = True, prune_stable: bool = True, bfs_runs: int = 1, symmetric: bool = False) -> DataFrame:
    """(vertex, component): component is its smallest vertex.

    method: 'contract', 'sequential' (union-find in one task, which holds the vertices), 'label', 'hybrid' (bfs_runs searches, then contraction of what is left) or 'auto': one search first where the
    degree distribution follows a power law (Kolmogorov-Smirnov D < 0.05), contraction alone otherwise. Directed edges give
    the weakly connected components.
    """
    if method in ("contract", "sequential"):  # which take an edge either way
        return (contract_components if method == "contract" else sequential_components)(edges.select("src", "dst"))
    both = edges.select("src", "dst") if symmetric else symmetrise(edges)
    if method == "label":
        return label_components(both, doubling, prune_stable)
    if method == "auto":
        both = cut(both)
        method = "hybrid" if degree_ks(both) < 0.05 else "contract"
    if method == "contract":
        return contract_components(both)
    if method != "hybrid":
        raise ValueError(f"no method {method}")
    left, parts = cut(both), []
    for _ in range(bfs_runs):
        root = left.agg(F.min("src")).first()[0]
        if root is None:
            break
        tree = cut(bfs_tree(left, root, symmetric=True).select("vertex"))
        parts.append(tree.select("vertex", F.lit(root).cast("long").alias("component")))
        left = cut(drop_visited(left, tree))
    return reduce(DataFrame.unionAll, [*parts, contract_components(left)])


#: Codes of the verifier.
CODES = {-1: "a vertex has no way up to the root", -10: "an edge leaves the vertex range at src", -11: "an edge leaves the vertex range at dst", -12: "dst of an edge is not in the tree", -13: "src of an edge is not in the tree", -14: "levels of an edge differ by more than one", -15: "a tree edge is no edge", -16: "a second root", -999: "the root is not its own parent"}


def tree_levels(tree: DataFrame, root: int) -> DataFrame:
    """(vertex, parent, level) of tree (vertex, parent): hops up to the root by doubling, null where there is no way.

    Each round a vertex jumps as far again as it has come: log2(depth) rounds. What still moves after log2(vertices)
    rounds runs in a cycle.
    """
    now = cut(tree.select("vertex", "parent", F.when((F.col("vertex") == root) | (F.col("vertex") != F.col("parent")), F.col("parent")).alias("at"), F.when(F.col("vertex") == root, 0).otherwise(1).cast("long").alias("level")))
    for _ in range(now.count().bit_length() + 1):
        up = now.select(F.col("vertex").alias("u"), F.col("at").alias("next"), F.col("level").alias("more"))
        now = cut(now.join(up, F.col("at") == F.col("u"), "left").select("vertex", "parent", F.when(F.col("at") == root, F.col("at")).otherwise(F.col("next")).alias("at"), (F.col("level") + F.when(F.col("at") == root, 0).otherwise(F.col("more"))).alias("level")))
        if now.where(F.col("at") != root).isEmpty():
            break
    return now.select("vertex", "parent", F.when(F.col("at") == root, F.col("level")).alias("level"))


def verify_bfs_tree(tree: DataFrame, edges: DataFrame, root: int, max_vertex: int | None = None) -> DataFrame:
    """(code, n): the violations of each kind in tree (vertex, parent), or one row (0, traversed edges)."""
    tree = cut(tree.select("vertex", "parent"))
    spark = tree.sparkSession
    if tree.where((F.col("vertex") == root) & (F.col("parent") == root)).isEmpty():
        return spark.sql("select cast(-999 as long) code, cast(1 as long) n")
    t = cut(tree_levels(tree, root))
    top = max_vertex if max_vertex is not None else (1 << 63) - 1
    e = edges.where("src >= 0 and dst >= 0").select("src", "dst")
    a = t.select(F.col("vertex").alias("va"), F.col("parent").alias("pa"), F.col("level").alias("la"))
    b = t.select(F.col("vertex").alias("vb"), F.col("parent").alias("pb"), F.col("level").alias("lb"))
    j = e.join(a, F.col("src") == F.col("va"), "left").join(b, F.col("dst") == F.col("vb"), "left")
    code = (
        F.when((F.col("src") > top) & (F.col("dst") <= top), -10).when((F.col("dst") > top) & (F.col("src") <= top), -11)
        .when(F.col("va").isNotNull() & F.col("vb").isNull(), -12).when(F.col("vb").isNotNull() & F.col("va").isNull(), -13)
        .when(F.abs(F.col("la") - F.col("lb")) > 1, -14).when(F.col("va").isNotNull(), 0)
    )
    by_edge = j.select(code.alias("code")).where("code is not null")
    real = symmetrise(e).distinct().select(F.col("src").alias("es"), F.col("dst").alias("ed"))
    unreal = t.where("vertex <> parent").join(real, (F.col("vertex") == F.col("es")) & (F.col("parent") == F.col("ed")), "left_anti").select(F.lit(-15).alias("code"))
    roots = t.where((F.col("vertex") == F.col("parent")) & (F.col("vertex") != root)).select(F.lit(-16).alias("code"))
    lost = t.where("level is null and vertex <> parent").select(F.lit(-1).alias("code"))
    found = by_edge.unionAll(unreal).unionAll(roots).unionAll(lost).groupBy(F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    found = cut(found)
    bad = found.where("code < 0")
    return found.where("code = 0") if bad.isEmpty() else bad


def bfs_statistics(runs: DataFrame) -> DataFrame:
    """Of runs (edges, seconds): quartiles, mean and harmonic mean of millions of edges a second."""
    r = runs.select((F.col("edges") / F.col("seconds") / 1e6).alias("mteps"))
    q = lambda p: F.percentile("mteps", F.lit(p))
    return r.agg(F.min("mteps").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("mteps").alias("most"), F.avg("mteps").alias("mean"), F.stddev("mteps").alias("stddev"), (F.count(F.lit(1)) / F.sum(1 / F.col("mteps"))).alias("harmonic_mean"))
