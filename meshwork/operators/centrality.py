"""Betweenness by batches of sources, and Markov clustering: loops of sparse products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators import matrix as M
from meshwork.operators.components import contract_components
from meshwork.session import cut


def betweenness(edges: DataFrame, sources: DataFrame, batches: int = 1, max_levels: int = 1_000_000) -> DataFrame:
    """(vertex, score): dependency of sources (vertex) on each vertex, over directed edges without repeats.

    The sources of a batch advance together, a row being (vertex, source), which bounds what is held at once; path counts go
    forward level by level, dependencies back along the same edges. Scores of the batches are added up.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    sources = cut(sources.select("vertex"))
    parts = [cut(_batch(e, sources.where(F.pmod(F.xxhash64("vertex"), F.lit(batches)) == k), max_levels)) for k in range(batches)]
    return reduce(DataFrame.unionAll, parts).groupBy("vertex").agg(F.sum("score").alias("score"))


def _batch(e: DataFrame, sources: DataFrame, max_levels: int) -> DataFrame:
    """(vertex, score) of some sources over clean edges."""
    levels = [cut(sources.select("vertex", F.col("vertex").alias("source"), F.lit(1.0).alias("paths"), F.lit(0).alias("level")))]
    seen = levels[0].select("vertex", "source")
    for level in range(1, max_levels):
        at = levels[-1].select(F.col("vertex").alias("f"), "source", "paths")
        new = e.join(at, F.col("src") == F.col("f")).groupBy(F.col("dst").alias("vertex"), "source").agg(F.sum("paths").alias("paths"))
        new = cut(new.join(seen, ["vertex", "source"], "left_anti").select("vertex", "source", "paths", F.lit(level).alias("level")))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionAll(new.select("vertex", "source"))
    else:
        raise RuntimeError(f"vertices beyond {max_levels} levels")
    below, total = None, None
    for level in reversed(levels):
        if below is None:
            now = level.withColumn("dep", F.lit(0.0))
        else:
            w = below.select(F.col("vertex").alias("w"), F.col("source").alias("ws"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
            v = level.select(F.col("vertex").alias("v"), F.col("source").alias("vs"))
            flow = e.join(w, F.col("dst") == F.col("w")).join(v, (F.col("src") == F.col("v")) & (F.col("ws") == F.col("vs"))).groupBy("v", "vs").agg(F.sum("share").alias("share"))
            now = level.join(flow, (F.col("vertex") == F.col("v")) & (F.col("source") == F.col("vs")), "left").select("vertex", "source", "paths", "level", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dep"))
        below = cut(now)
        total = below if total is None else total.unionAll(below)
    return total.groupBy("vertex").agg(F.sum(F.when(F.col("vertex") != F.col("source"), F.col("dep")).otherwise(0.0)).alias("score"))


def _normalise(a: DataFrame) -> DataFrame:
    sums = M.mat_reduce(a, "col", F.sum)
    return M.dim_apply(a, "col", sums, lambda v, s: v / s)


def markov_clustering(a: DataFrame, inflation: float = 2.0, prune_below: float = 1e-5, epsilon: float = 1e-3, self_loops: bool = True, max_rounds: int = 100) -> DataFrame:
    """(vertex, cluster) of a weighted symmetric matrix: square, inflate, prune until chaos is epsilon at most.

    Chaos is the largest, over columns, of maximum less sum of squares. Clusters are the weak components of the limit.
    """
    a = M.convert(a, "double")
    if self_loops:
        loops = a.select(F.explode(F.array("row", "col")).alias("row")).distinct().select("row", F.col("row").alias("col"), F.lit(1.0).alias("val"))
        a = M.remove_loops(a).unionByName(loops)
    a = cut(_normalise(a))
    for _ in range(max_rounds):
        grown = M.apply(M.square(a), lambda v: F.pow(v, F.lit(inflation)))
        a = cut(_normalise(grown))
        per = a.groupBy("col").agg((F.max("val") - F.sum(F.col("val") * F.col("val"))).alias("chaos"))
        chaos = per.agg(F.max("chaos")).first()[0] or 0.0
        a = M.prune(a, lambda v: v < prune_below)
        if chaos <= epsilon:
            break
        a = cut(a)
    else:
        raise RuntimeError(f"chaos above {epsilon} after {max_rounds} rounds")
    cc = contract_components(a.select(F.col("row").alias("src"), F.col("col").alias("dst")))
    return cc.select("vertex", F.col("component").alias("cluster"))
