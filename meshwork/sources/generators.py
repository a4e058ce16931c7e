"""Graph generators: every edge is a function of its number and the seed, so that partitions need nothing from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.components import symmetrise


def chain(spark: SparkSession, n: int) -> DataFrame:
    """Vertices 0..n-1 in a line, each edge both ways."""
    return symmetrise(spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def _scramble(v: Column, scale: int, seed: int) -> Column:
    """A bijection of 0..2^scale-1: Feistel rounds over the two halves of the bits, keyed by the seed.

    With an odd number of bits the halves differ by one bit and swap widths each round; four rounds bring them back.
    """
    low, high = scale // 2, scale - scale // 2
    left, right, wl, wr = F.shiftrightunsigned(v, low), v.bitwiseAND(F.lit((1 << low) - 1)), high, low
    for turn in range(4):
        mixed = left.bitwiseXOR(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), right), F.lit(1 << wl)))
        left, right, wl, wr = right, mixed, wr, wl
    return F.shiftleft(left, wr).bitwiseOR(right)


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, initiator: tuple[float, float, float, float] = (0.57, 0.19, 0.19, 0.05), seed: int = 1, permute: bool = True, both: bool = True) -> DataFrame:
    """R-MAT: edge_factor * 2^scale edges over 2^scale vertices, a quadrant per level by a hash; loops and repeats stay.

    initiator (.25, .25, .25, .25) gives uniform edges. permute renames vertices by a seeded bijection; both emits
    each edge in both directions.
    """
    if abs(sum(initiator) - 1) > 1e-9 or scale < 1:
        raise ValueError("the initiator's four shares sum to 1, and scale is positive")
    a, b, c, _ = initiator
    levels = F.sequence(F.lit(0), F.lit(scale - 1))
    rows = spark.range(edge_factor << scale)

    def descend(acc: Column, level: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), "id", level), F.lit(1 << 40)) / F.lit(float(1 << 40))
        bit_src, bit_dst = F.when(u >= a + b, 1).otherwise(0), F.when((u >= a) & (u < a + b) | (u >= a + b + c), 1).otherwise(0)
        return F.struct((acc["s"] * 2 + bit_src).alias("s"), (acc["d"] * 2 + bit_dst).alias("d"))

    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("d"))
    rows = rows.select(F.aggregate(levels, zero, descend).alias("e")).select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"))
    if permute:
        rows = rows.select(_scramble(F.col("src"), scale, seed).alias("src"), _scramble(F.col("dst"), scale, seed).alias("dst"))
    return symmetrise(rows) if both else rows
