"""Graphs, matrices and vectors derived from the star-schema tables, each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Source:
    """A table's rows as Spark reads them and as DuckDB does."""

    def __init__(self, sql: str):
        self.sql = sql

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = f"{self.sql} "
        for t in TABLES:
            sql = sql.replace(f" {t} ", f" parquet.`{sf_dir}/{t}.parquet` ")
        return spark.sql(sql)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Edge lists (src, dst), one row per undirected edge as the tables have it.
EDGES = {
    "event_chain": Source("SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events ) q WHERE dst IS NOT NULL"),
    "order_part": Source("SELECT 2 * l_orderkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem"),
    "part_supplier": Source("SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem WHERE l_partkey IS NOT NULL"),
    "customer_order": Source("SELECT 2 * o_custkey AS src, 2 * o_orderkey + 1 AS dst FROM orders WHERE o_custkey IS NOT NULL"),
    "conversation": Source("SELECT conv_id * 100000 + turn AS src, conv_id * 100000 + lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations "),
    "duplicate_documents": Source("SELECT min(doc_id) OVER (PARTITION BY md5(text)) AS src, doc_id AS dst FROM documents "),
}
EDGES["conversation"] = Source(f"SELECT src, dst FROM ({EDGES['conversation'].sql}) q WHERE dst IS NOT NULL")
EDGES["duplicate_documents"] = Source(f"SELECT src, dst FROM ({EDGES['duplicate_documents'].sql}) q WHERE src <> dst")
#: Matrices (row, col, val): quantity and large deliveries by part and supplier; deliveries by supplier and month, and by
#: the customer's and the supplier's nation.
MATRICES = {
    "a": Source("SELECT l_partkey AS row, l_suppkey AS col, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS val FROM lineitem GROUP BY l_partkey, l_suppkey"),
    "b": Source("SELECT l_partkey AS row, l_suppkey AS col, cast(count(*) AS bigint) AS val FROM lineitem WHERE l_quantity >= 45 GROUP BY l_partkey, l_suppkey"),
    "s": Source("SELECT l_suppkey AS row, cast(month(l_shipdate) AS bigint) AS col, cast(count(*) AS bigint) AS val FROM lineitem GROUP BY l_suppkey, month(l_shipdate)"),
    "q": Source(
        "SELECT cast(c_nationkey AS bigint) AS row, cast(s_nationkey AS bigint) AS col, cast(count(*) AS bigint) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey"
    ),
}
#: Vectors (idx, val): nation number of suppliers; open and finished orders by customer; balance by customer.
VECTORS = {
    "x": Source("SELECT s_suppkey AS idx, cast(s_nationkey AS bigint) + 1 AS val FROM supplier"),
    "orders": Source("SELECT o_custkey AS idx, cast(count(*) AS bigint) AS val FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey"),
    "late": Source("SELECT o_custkey AS idx, cast(count(*) AS bigint) AS val FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    "balance": Source("SELECT c_custkey AS idx, cast(floor(c_acctbal) AS bigint) AS val FROM customer WHERE c_custkey IS NOT NULL"),
}
#: What bfs_filtered finds by its filter, as a graph of its own.
FILTERED = {"large_deliveries": Source("SELECT 2 * l_orderkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem WHERE l_quantity >= 40")}
#: b over every row: what the queries named _whole run over. Beside them stand those over b as it is, a part of a, so that
#: exclusions and differences of the two have something left.
WHOLE = {
    "b": Source("SELECT l_partkey AS row, l_suppkey AS col, cast(count(*) AS bigint) AS val FROM lineitem GROUP BY l_partkey, l_suppkey"),
}
