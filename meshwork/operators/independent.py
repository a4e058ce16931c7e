"""Independent sets by seeded priorities, and the aggregation operator that distance-2 sets give.

Priorities are hashes of (seed, round, vertex): random enough for Luby's argument, the same on every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.operators.components import symmetrise
from meshwork.operators.matrix import spgemm, transpose
from meshwork.operators.relabel import enumerate_sorted
from meshwork.session import cut


def _clean(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symmetric edges without loops, all vertices, those of loops included)."""
    e = cut(symmetrise(edges).distinct())
    return e.where("src <> dst"), cut(e.select(F.col("src").alias("vertex")).distinct())


def _priority(seed: int, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), F.lit(turn), "vertex").alias("h"), F.col("vertex").alias("v"))


def _spread(e: DataFrame, values: DataFrame) -> DataFrame:
    """(vertex, p): the least p of a vertex's neighbours and its own, values being (vertex, p)."""
    heard = e.join(values.select(F.col("vertex").alias("s"), "p"), F.col("src") == F.col("s")).select(F.col("dst").alias("vertex"), "p")
    return heard.unionAll(values.select("vertex", "p")).groupBy("vertex").agg(F.min("p").alias("p"))


def mis(edges: DataFrame, seed: int = 1, keep: Column | None = None, distance: int = 1, max_rounds: int = 1000) -> DataFrame:
    """(vertex): a maximal set of which no two are within distance (1 or 2) of each other, over the edges that keep passes.

    A round takes the candidates of least priority in their neighbourhood and removes what is near them. With a
    filter, vertices that only edges outside it touch are candidates too.
    """
    _, vertices = _clean(edges.select("src", "dst"))
    e, _ = _clean((edges.where(keep) if keep is not None else edges).select("src", "dst"))
    e = cut(e)
    left, members = vertices, []
    for turn in range(max_rounds):
        own = cut(left.select("vertex", _priority(seed, turn).alias("p")))
        best = own
        for _ in range(distance):
            best = _spread(e, best)
        new = cut(own.join(best.select(F.col("vertex").alias("b"), F.col("p").alias("q")), F.col("vertex") == F.col("b")).where("p = q").select("vertex"))
        members.append(new)
        near = new.select("vertex", F.lit(True).alias("p"))
        for _ in range(distance):
            near = _spread(e, near)
        left = cut(left.join(near.select("vertex"), "vertex", "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionAll, members)
    raise RuntimeError(f"vertices undecided after {max_rounds} rounds")


def aggregates(edges: DataFrame, seed: int = 1) -> DataFrame:
    """(vertex, root): each vertex with the distance-2 set's member that it joins.

    Members join themselves; a vertex has one member at most among its neighbours; the others follow one
    neighbour that is next to a member, by a seeded hash.
    """
    e, vertices = _clean(edges)
    e = cut(e)
    roots = cut(mis(edges, seed, distance=2))
    own = roots.select("vertex", F.col("vertex").alias("root"))
    first = e.join(roots.select(F.col("vertex").alias("r")), F.col("src") == F.col("r")).groupBy(F.col("dst").alias("vertex")).agg(F.min("r").alias("root"))
    near = cut(own.unionAll(first))
    rest = vertices.join(near.select("vertex"), "vertex", "left_anti")
    far = e.join(rest.select(F.col("vertex").alias("u")), F.col("dst") == F.col("u")).join(near.select(F.col("vertex").alias("w"), "root"), F.col("src") == F.col("w"))
    far = far.groupBy(F.col("u").alias("vertex")).agg(F.min_by("root", F.struct(F.xxhash64(F.lit(seed), "w"), F.col("w"))).alias("root"))
    return cut(near.unionAll(far))


def restriction(edges: DataFrame, seed: int = 1) -> DataFrame:
    """The restriction matrix: (row = vertex, col = number of its aggregate, val = 1)."""
    of = aggregates(edges, seed)
    number = enumerate_sorted(of.select("root").distinct(), ["root"], "col").select(F.col("root").alias("r"), "col")
    return of.join(number, F.col("root") == F.col("r")).select(F.col("vertex").alias("row"), "col", F.lit(1).cast("long").alias("val"))


def galerkin(a: DataFrame, r: DataFrame, left_first: bool = False) -> DataFrame:
    """The coarse matrix r' a r; either order of products gives the same."""
    rt = transpose(r)
    return spgemm(spgemm(rt, a), r) if left_first else spgemm(rt, spgemm(a, r))
