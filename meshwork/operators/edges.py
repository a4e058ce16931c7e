"""Edge lists (src, dst): filters, checks, degrees and their distribution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.components import symmetrise

__all__ = ["canonical", "component_count", "component_sizes", "degree_distribution", "degree_ks", "degrees", "drop_visited", "edge_count", "edge_distribution", "is_symmetric", "ks_statistic", "largest_component_edges", "symmetrise"]


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once: src < dst."""
    return edges.where("src < dst").select("src", "dst")


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("n"))


def is_symmetric(edges: DataFrame) -> DataFrame:
    """One row symmetric: whether each edge is there as often as its reverse; one aggregate, no join."""
    up = F.when(F.col("src") < F.col("dst"), 1).otherwise(-1)
    per = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(up).alias("n"))
    return per.where("n <> 0").agg((F.count(F.lit(1)) == 0).alias("symmetric"))


def drop_visited(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Edges whose src is not in visited (vertex)."""
    return edges.join(visited.select(F.col("vertex").alias("v")), F.col("src") == F.col("v"), "left_anti").select("src", "dst")


def degrees(edges: DataFrame, distinct: bool = True, loops: bool = False) -> DataFrame:
    """(vertex, degree) over src of a symmetric list: distinct neighbours, or edges with their multiplicity."""
    rows = edges if loops else edges.where("src <> dst")
    rows = rows.select("src", "dst").distinct() if distinct else rows
    return rows.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))


def directed_degrees(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree, degree), every edge counted, self-loops on both sides."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    rows = edges.select(ends.alias("e")).select("e.*").groupBy("vertex").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return rows.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """(degree, n): vertices by number of distinct neighbours; degrees without vertices have no row."""
    return degrees(edges, loops=True).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def component_count(cc: DataFrame) -> DataFrame:
    return cc.agg(F.count_distinct("component").alias("n"))


def component_sizes(cc: DataFrame) -> DataFrame:
    """(component, n): vertices of each."""
    return cc.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def largest_component_edges(cc: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges of the component that has most: half its directed rows of a symmetric list."""
    per = edges.join(cc, F.col("src") == F.col("vertex")).groupBy("component").agg(F.expr("count(1) div 2").alias("n"))
    return per.agg(F.max("n").alias("n"))


def edge_distribution(edges: DataFrame) -> DataFrame:
    """Least, mean and most rows of a partition."""
    per = edges.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def _zeta(s: float, q: np.ndarray) -> np.ndarray:
    """Hurwitz zeta, s > 1, by ten terms and Euler-Maclaurin."""
    head = sum((q + k) ** -s for k in range(10))
    a = q + 10
    tail = a ** (1 - s) / (s - 1) + a**-s / 2
    # Bernoulli numbers 1/6, -1/30, 1/42 over (2j)!
    term = s * a ** (-s - 1)
    for b, c in ((1 / 12, 0), (-1 / 720, 1), (1 / 30240, 2)):
        tail = tail + b * term
        term = term * (s + 2 * c + 1) * (s + 2 * c + 2) / a**2
    return head + tail


def ks_statistic(values: np.ndarray, counts: np.ndarray) -> tuple[float, float, float]:
    """(D, alpha, xmin) of the discrete power law that fits the values (with multiplicities) best from xmin on.

    For each xmin of the distinct values but the last alpha maximises the likelihood, by golden section; the fit of least Kolmogorov-Smirnov distance D counts.
    """
    order = np.argsort(values)
    x, c = values[order].astype(float), counts[order].astype(float)
    best = (1.0, float("nan"), float("nan"))
    for i in range(max(len(x) - 1, 1)):
        y, w = x[i:], c[i:]
        n, logs = w.sum(), float(w @ np.log(y))
        cost = lambda a: a * logs + n * np.log(_zeta(a, y[:1])[0])  # noqa: B023, E731
        lo, hi = 1.001, 12.0
        g = (5**0.5 - 1) / 2
        p, q = hi - g * (hi - lo), lo + g * (hi - lo)
        fp, fq = cost(p), cost(q)
        for _ in range(60):
            if fp < fq:
                hi, q, fq = q, p, fp
                p = hi - g * (hi - lo)
                fp = cost(p)
            else:
                lo, p, fp = p, q, fq
                q = lo + g * (hi - lo)
                fq = cost(q)
        alpha = (lo + hi) / 2
        fitted = 1 - _zeta(alpha, y + 1) / _zeta(alpha, y[:1])
        d = float(np.abs(np.cumsum(w) / n - fitted).max())
        if d < best[0]:
            best = (d, alpha, float(y[0]))
    return best


def degree_ks(edges: DataFrame) -> float:
    """D for the degree histogram, one added to each frequency of 1..largest degree.

    What comes to the driver is one row per distinct frequency: at most about sqrt(2 V).
    """
    hist = degree_distribution(edges)
    per = hist.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.max("degree").alias("most")).collect()
    if not per:
        return 1.0
    empty = max(r.most for r in per) - sum(r.m for r in per)
    values = np.array([r.n + 1 for r in per] + [1] * (empty > 0))
    counts = np.array([r.m for r in per] + [empty] * (empty > 0))
    return ks_statistic(values, counts)[0]
