"""Dense ids and ranks without a sort in one task: a range-partitioned sort, counts by partition, offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.session import cut


def with_offsets(df: DataFrame, keys: list[str], total: Column, name: str, local: Callable) -> DataFrame:
    """df plus name = local(window of the partition) + what all earlier partitions total.

    The range-partitioned rows are kept before partitions are numbered, so that both passes see the same ones;
    the offsets are one row per partition.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = cut(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    sums = rows.groupBy("__part").agg(total.alias("__total"))
    before = F.coalesce(F.sum("__total").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("__part").alias("__p"), before.alias("__before"))
    inner = rows.withColumn("__local", local(W.partitionBy("__part").orderBy(*keys)))
    return inner.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, F.col("__local") + F.col("__before")).drop("__part", "__p", "__local", "__before")


def enumerate_sorted(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """df plus its rank from 0 in the order of keys, which are unique."""
    return with_offsets(df, keys, F.count(F.lit(1)), name, lambda w: F.row_number().over(w) - F.lit(1)).withColumn(name, F.col(name).cast("long"))


def compact_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges over 0..V-1, mapping (vertex, id), V): an id is its vertex's rank among all."""
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    mapping = cut(enumerate_sorted(vertices, ["vertex"], "id").select("vertex", "id"))
    a = mapping.select(F.col("vertex").alias("va"), F.col("id").alias("ia"))
    b = mapping.select(F.col("vertex").alias("vb"), F.col("id").alias("ib"))
    out = edges.join(a, F.col("src") == F.col("va")).join(b, F.col("dst") == F.col("vb")).select(F.col("ia").alias("src"), F.col("ib").alias("dst"))
    return out, mapping, mapping.count()


def rename_vertices(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(edges under a random permutation of 0..V-1, mapping (vertex, id)): ids follow a seeded hash."""
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    mapping = cut(enumerate_sorted(vertices.withColumn("h", F.xxhash64(F.lit(seed), "vertex")), ["h", "vertex"], "id").select("vertex", "id"))
    a = mapping.select(F.col("vertex").alias("va"), F.col("id").alias("ia"))
    b = mapping.select(F.col("vertex").alias("vb"), F.col("id").alias("ib"))
    return edges.join(a, F.col("src") == F.col("va")).join(b, F.col("dst") == F.col("vb")).select(F.col("ia").alias("src"), F.col("ib").alias("dst")), mapping


def permute_edges(edges: DataFrame, seed: int) -> DataFrame:
    """The edges in the order of a seeded hash, with their place."""
    return enumerate_sorted(edges.withColumn("h", F.xxhash64(F.lit(seed), "src", "dst")).withColumn("nth", F.monotonically_increasing_id()), ["h", "src", "dst", "nth"], "place").select("place", "src", "dst")
