"""What the physical plans must show: filters and columns reach the scan, no Python and no broadcast of unbounded sides."""

import contextlib
import io

from pyspark.sql import functions as F

from meshwork.functions.hashing import mix64
from meshwork.operators import bfs, edges
from meshwork.operators import matrix as M
from meshwork.plans.graphs import EDGES, FILTERED, MATRICES, VECTORS


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan(EDGES["order_part"](spark, sf_dir))
    text = plan(FILTERED["large_deliveries"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_quantity,40.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text


def test_products_combine_on_the_map_side(spark, sf_dir):
    text = plan(M.spmv(MATRICES["a"](spark, sf_dir), VECTORS["x"](spark, sf_dir)))
    assert "partial_sum" in text and "Python" not in text and "CartesianProduct" not in text


def test_a_traversal_filter_is_pushed(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity")
    text = plan(bfs.expand_frontier(li.where("l_quantity >= 49"), spark.range(3).withColumnRenamed("id", "vertex")))
    assert "GreaterThanOrEqual(l_quantity,49.0)" in text and "partial_min" in text


def test_degrees_and_mixing_need_no_python(spark, sf_dir):
    e = EDGES["part_supplier"](spark, sf_dir)
    for df in (edges.degrees(e), e.select(mix64(F.col("src")).alias("h")), edges.is_symmetric(e)):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)
