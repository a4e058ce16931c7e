"""Bipartite matching over (row, col) edges: maximal by rounds of proposals, maximum by augmenting paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.session import cut


def _free(e: DataFrame, mates: DataFrame) -> DataFrame:
    """Edges between vertices that have no mate."""
    r, c = mates.select(F.col("row").alias("mr")), mates.select(F.col("col").alias("mc"))
    return e.join(r, F.col("row") == F.col("mr"), "left_anti").join(c, F.col("col") == F.col("mc"), "left_anti")


def _propose(e: DataFrame) -> DataFrame:
    """Each column asks its smallest row, each row takes the smallest column that asks."""
    asked = e.groupBy("col").agg(F.min("row").alias("row"))
    return asked.groupBy("row").agg(F.min("col").alias("col"))


def _propose_by_degree(e: DataFrame) -> DataFrame:
    """As _propose, to the row of least degree among the rows still free."""
    deg = e.groupBy("row").agg(F.count(F.lit(1)).alias("d")).withColumnRenamed("row", "r")
    asked = e.join(deg, F.col("row") == F.col("r")).groupBy("col").agg(F.min(F.struct("d", "row")).alias("m"), F.count(F.lit(1)).alias("cd"))
    return asked.select("col", "cd", F.col("m.row").alias("row")).groupBy("row").agg(F.min(F.struct("cd", "col")).alias("c")).select("row", "c.col")


def _propose_single(e: DataFrame) -> DataFrame:
    """Columns and rows of degree one first (Karp and Sipser); plain proposals where there are none."""
    lone_col = e.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).where("n = 1").groupBy("row").agg(F.min("col").alias("col"))
    lone_row = e.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("col")).where("n = 1").groupBy("col").agg(F.min("row").alias("row"))
    lone = cut(lone_col.select("row", "col").unionAll(lone_row.select("row", "col")).groupBy("row").agg(F.min("col").alias("col")).groupBy("col").agg(F.min("row").alias("row")).select("row", "col"))
    return lone if not lone.isEmpty() else _propose(e)


METHODS = {"greedy": _propose, "karp_sipser": _propose_single, "min_degree": _propose_by_degree}


def maximal_matching(edges: DataFrame, method: str = "greedy", max_rounds: int = 10_000) -> DataFrame:
    """(row, col): no edge joins two unmatched vertices. Unmatched vertices have no row."""
    e = cut(edges.select("row", "col").distinct())
    mates = cut(e.limit(0))
    for _ in range(max_rounds):
        new = cut(METHODS[method](e).select("row", "col"))
        if new.isEmpty():
            return mates
        mates = cut(mates.unionAll(new))
        e = cut(_free(e, new))
    raise RuntimeError("too many rounds")


def maximum_matching(edges: DataFrame, method: str = "min_degree", max_phases: int = 10_000) -> DataFrame:
    """(row, col) of the largest cardinality.

    A phase grows one tree from every unmatched column, breadth first, a row joining one tree only; a tree that
    reaches a free row stops. Its path is then turned over, all trees at once. No path left: the matching is maximum.
    """
    e = cut(edges.select("row", "col").distinct())
    mates = maximal_matching(e, method)
    columns = cut(e.select("col").distinct())
    for _ in range(max_phases):
        frontier = cut(columns.join(mates.select("col"), "col", "left_anti").select("col", F.col("col").alias("root")))
        tree = cut(e.limit(0).select("row", F.col("col").alias("parent"), F.col("col").alias("root")))
        ends = cut(tree.select("row", "root"))
        while not frontier.isEmpty():
            f = frontier.select(F.col("col").alias("c"), "root")
            found = e.join(f, F.col("col") == F.col("c")).join(tree.select(F.col("row").alias("seen")), F.col("row") == F.col("seen"), "left_anti")
            found = cut(found.groupBy("row").agg(F.min(F.struct("root", "col")).alias("m")).select("row", F.col("m.col").alias("parent"), F.col("m.root").alias("root")))
            if found.isEmpty():
                break
            tree = cut(tree.unionAll(found))
            at = found.join(mates.select(F.col("row").alias("r"), F.col("col").alias("mate")), F.col("row") == F.col("r"), "left")
            stop = cut(at.where("mate is null").groupBy("root").agg(F.min("row").alias("row")).select("row", "root"))
            ends = cut(ends.unionAll(stop))
            frontier = cut(at.where("mate is not null").select(F.col("mate").alias("col"), "root").join(ends.select("root"), "root", "left_anti").select("col", "root"))
        if ends.isEmpty():
            return mates
        # walk each path back to its root: row, its tree parent, the parent's old mate, ...
        at, new = ends.select("row"), None
        while True:
            pairs = cut(at.join(tree, "row").select("row", F.col("parent").alias("col")))
            new = pairs if new is None else cut(new.unionAll(pairs))
            at = cut(pairs.join(mates.select(F.col("row").alias("old"), F.col("col").alias("oc")), F.col("col") == F.col("oc")).select(F.col("old").alias("row")))
            if at.isEmpty():
                break
        kept = mates.join(new.select(F.col("row").alias("nr")), F.col("row") == F.col("nr"), "left_anti").join(new.select(F.col("col").alias("nc")), F.col("col") == F.col("nc"), "left_anti")
        mates = cut(kept.select("row", "col").unionAll(new))
    raise RuntimeError("too many phases")


def is_matching(mates: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ok: no vertex twice, and every pair is an edge."""
    twice = mates.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n").unionAll(mates.groupBy("col").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n"))
    strange = mates.join(edges.select("row", "col").distinct(), ["row", "col"], "left_anti").select(F.lit(1).cast("long").alias("n"))
    return twice.unionAll(strange).agg((F.count(F.lit(1)) == 0).alias("ok"))


def is_maximal_matching(mates: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ok: no edge joins two unmatched vertices."""
    return _free(edges.select("row", "col"), mates).agg((F.count(F.lit(1)) == 0).alias("ok"))
