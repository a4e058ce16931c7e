"""The registered queries of the graph engine and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import hashing, scalars
from meshwork.functions import semiring as S
from meshwork.operators import bfs, centrality, components, edges, independent, kmers, matching, relabel
from meshwork.operators import matrix as M
from meshwork.operators import vector as V
from meshwork.plans.graphs import EDGES, FILTERED, MATRICES, VECTORS, WHOLE, Source
from meshwork.session import cut, work_folder
from meshwork.sources import generators, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, make: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _sql(template: str, whole: bool = False) -> str:
    """Names in braces become subqueries of the derived graphs, matrices and vectors."""
    for group in (WHOLE,) * whole + (EDGES, MATRICES, VECTORS, FILTERED):
        for name, source in group.items():
            template = template.replace("{" + name + "}", f"({source.sql})")
    return template


class Derived:
    """A derived table as a query; whole is the same over every row, itself where it leaves none out."""

    def __init__(self, group: dict[str, Source], name: str):
        self.group, self.name = group, name

    def __call__(self, s: SparkSession, d: str) -> DataFrame:
        return self.group[self.name](s, d)

    @property
    def whole(self) -> Derived:
        return Derived(WHOLE, self.name) if self.name in WHOLE else self


def e(name: str) -> Query:
    return Derived(EDGES, name)


def m(name: str) -> Query:
    return Derived(MATRICES, name)


def v(name: str) -> Query:
    return Derived(VECTORS, name)


def q(name: str, make, *sources: Query, sql: str | None = None) -> None:
    """A query of make(DataFrame, ...) over sources, and name_whole where a source leaves rows out."""
    query(name, lambda s, d: make(*(x(s, d) for x in sources)), _sql(sql) if sql else None)
    whole = [getattr(x, "whole", x) for x in sources]
    if any(x is not y for x, y in zip(sources, whole, strict=True)):
        query(f"{name}_whole", lambda s, d: make(*(x(s, d) for x in whole)), _sql(sql, True) if sql else None)


def _sym(edge: str) -> str:
    return f"(SELECT src, dst FROM {{{edge}}} UNION ALL SELECT dst, src FROM {{{edge}}})"


def _cc(edge: str) -> str:
    """A recursive CTE cc(v, l): the smallest reachable id of each vertex."""
    return f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {{{edge}}} UNION SELECT dst, src FROM {{{edge}}}),
cc(v, l) USING KEY (v) AS (SELECT DISTINCT a, a FROM e UNION
 SELECT x.v, x.l FROM (SELECT e.b v, min(cc.l) l FROM cc JOIN e ON e.a = cc.v GROUP BY 1) x JOIN recurring.cc r ON r.v = x.v WHERE x.l < r.l)
"""


def _levels(edge: str, root: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {{{edge}}} UNION SELECT dst, src FROM {{{edge}}}),
t(v, l) USING KEY (v) AS (SELECT {root} AS v, cast(0 AS bigint) AS l UNION
 SELECT x.v, x.l FROM (SELECT e.b v, min(t.l) + 1 l FROM t JOIN e ON e.a = t.v GROUP BY 1) x LEFT JOIN recurring.t r ON r.v = x.v WHERE r.v IS NULL)
"""


# connected components: GA-1, GA-2, GA-3, GA-4, GA-6, AG-3, AG-4, AG-5
for _name in EDGES:
    q(f"cc_{_name}", lambda g: bfs.connected_components(g, "contract"), e(_name), sql=_cc(_name) + "SELECT v AS vertex, l AS component FROM cc")
_CC = _cc("order_part") + "SELECT v AS vertex, l AS component FROM cc"
for _name, _args in {
    "cc_label_doubling": {"method": "label"},
    "cc_label_plain": {"method": "label", "doubling": False, "prune_stable": False},
    "cc_label_unpruned": {"method": "label", "prune_stable": False},
    "cc_adaptive": {"method": "auto"},
    "cc_hybrid": {"method": "hybrid", "bfs_runs": 2},
    "cc_sequential": {"method": "sequential"},
}.items():
    q(_name, lambda g, a=_args: bfs.connected_components(g, **a), e("order_part"), sql=_CC)
q("cc_hybrid_giant", lambda g: bfs.connected_components(g, "hybrid"), e("part_supplier"), sql=_cc("part_supplier") + "SELECT v AS vertex, l AS component FROM cc")
q("cc_count", lambda g: edges.component_count(components.contract_components(g)), e("order_part"), sql=_cc("order_part") + "SELECT count(DISTINCT l) AS n FROM cc")
q("cc_sizes", lambda g: edges.component_sizes(components.contract_components(g)), e("order_part"), sql=_cc("order_part") + "SELECT l AS component, count(*) AS n FROM cc GROUP BY l")
q("cc_size_histogram", lambda g: edges.component_sizes(components.contract_components(g)).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("n")), e("order_part"), sql=_cc("order_part") + "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM cc GROUP BY l) GROUP BY size")
q("cc_largest_vertices", lambda g: edges.component_sizes(components.contract_components(g)).agg(F.max("n").alias("n")), e("order_part"), sql=_cc("order_part") + "SELECT max(n) AS n FROM (SELECT count(*) AS n FROM cc GROUP BY l)")
q("cc_largest_edges", lambda g: edges.largest_component_edges(components.contract_components(g), components.symmetrise(g)), e("order_part"), sql=_cc("order_part") + f"SELECT max(n) AS n FROM (SELECT count(*) // 2 AS n FROM {_sym('order_part')} s JOIN cc ON s.src = cc.v GROUP BY cc.l)")

# searches: GA-2, GA-7..10, GA-20, JN-1, JN-2, AG-5
_MIN = "(SELECT min(x) FROM (SELECT src AS x FROM {%s} UNION ALL SELECT dst FROM {%s}))"


def _root(g: DataFrame) -> int:
    return g.select(F.least("src", "dst").alias("x")).agg(F.min("x")).first()[0]


def _peel(g: DataFrame, n: int = 1) -> DataFrame:
    sizes, _ = bfs.bfs_peel(components.symmetrise(g), n)
    return g.sparkSession.createDataFrame(list(enumerate(sizes)), "run long, n long")


def _left(g: DataFrame) -> DataFrame:
    both = cut(components.symmetrise(g))
    _, seen = bfs.bfs_peel(both, 1)
    return edges.drop_visited(both, seen)


_FIRST = _cc("order_part") + "SELECT cast(0 AS bigint) AS run, count(*) AS n FROM cc WHERE l = (SELECT min(l) FROM cc)"
q("bfs_peel_first", _peel, e("order_part"), sql=_FIRST)
q("bfs_peel_three", lambda g: _peel(g, 3), e("order_part"), sql=_cc("order_part") + "SELECT row_number() OVER (ORDER BY l) - 1 AS run, n FROM (SELECT l, count(*) AS n FROM cc GROUP BY l ORDER BY l LIMIT 3)")
q("edges_left_after_bfs", _left, e("order_part"), sql=_cc("order_part") + f"SELECT s.src, s.dst FROM {_sym('order_part')} s JOIN cc ON s.src = cc.v WHERE cc.l <> (SELECT min(l) FROM cc)")
_LV = _levels("order_part", _MIN % ("order_part", "order_part"))
for _name, _args in {"bfs_levels": {"symmetric": True}, "bfs_levels_any_edges": {}, "bfs_levels_direction_optimising": {"direction_optimising": True}}.items():
    q(_name, lambda g, a=_args: bfs.bfs_tree(cut(components.symmetrise(g).distinct()), _root(g), **a).select("vertex", "level"), e("order_part"), sql=_LV + "SELECT v AS vertex, l AS level FROM t")
q("bfs_parents", lambda g: bfs.bfs_tree(cut(components.symmetrise(g).distinct()), _root(g), symmetric=True), e("order_part"), sql=_LV + f"SELECT t.v AS vertex, coalesce(min(p.v), t.v) AS parent, t.l AS level FROM t LEFT JOIN {_sym('order_part')} s ON s.dst = t.v LEFT JOIN t p ON p.v = s.src AND p.l = t.l - 1 GROUP BY t.v, t.l")
q("bfs_random_parent_levels", lambda g: bfs.bfs_tree(cut(components.symmetrise(g).distinct()), _root(g), pick=bfs.random_parent(5)).select("vertex", "level"), e("order_part"), sql=_LV + "SELECT v AS vertex, l AS level FROM t")
q("bfs_single_child", lambda g: bfs.bfs_tree(cut(components.symmetrise(g).distinct()), _root(g), single_child=True), e("order_part"))
q("expand_frontier", lambda g, f: bfs.expand_frontier(g, f.select((2 * F.col("idx")).alias("vertex"))), e("order_part"), v("orders"), sql="SELECT g.dst AS vertex, min(g.src) AS parent FROM {order_part} g JOIN {orders} f ON g.src = 2 * f.idx GROUP BY g.dst")


def _verified(g: DataFrame) -> DataFrame:
    both = cut(components.symmetrise(g))
    root = _root(g)
    return bfs.verify_bfs_tree(bfs.bfs_tree(both, root, symmetric=True), both, root)


q("bfs_verified", _verified, e("order_part"), sql=_LV + f"SELECT cast(0 AS bigint) AS code, count(*) AS n FROM {_sym('order_part')} s JOIN t ON s.src = t.v")


def _filtered(s: SparkSession, d: str) -> DataFrame:
    g = s.read.parquet(f"{d}/lineitem.parquet").select((2 * F.col("l_orderkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"), F.col("l_quantity").alias("q"))
    both = g.select("src", "dst", "q").unionAll(g.select("dst", "src", "q"))
    return bfs.filtered_bfs(both, F.col("q") >= 40, _root(FILTERED["large_deliveries"](s, d))).select("vertex", "level")


query("bfs_filtered", _filtered, _sql(_levels("large_deliveries", _MIN % ("large_deliveries", "large_deliveries")) + "SELECT v AS vertex, l AS level FROM t"))
q("visited_edge_removal", lambda g, f: edges.drop_visited(g, f.select((2 * F.col("idx")).alias("vertex"))), e("order_part"), v("orders"), sql="SELECT g.src, g.dst FROM {order_part} g WHERE g.src NOT IN (SELECT 2 * idx FROM {orders})")

# edges: PRJ-1..5, WN-1..4, AG-6, AG-7, AG-16, GA-22
q("symmetrise", components.symmetrise, e("order_part"), sql=f"SELECT src, dst FROM {_sym('order_part')}")
q("canonical_edges", edges.canonical, e("part_supplier"), sql="SELECT src, dst FROM {part_supplier} WHERE src < dst")
q("edge_count", edges.edge_count, e("part_supplier"), sql="SELECT count(*) AS n FROM {part_supplier}")
q("symmetry_check", lambda g: edges.is_symmetric(components.symmetrise(g)), e("order_part"), sql="SELECT true AS symmetric")
q("symmetry_check_directed", edges.is_symmetric, e("order_part"), sql="SELECT count(*) = 0 AS symmetric FROM {order_part} WHERE src <> dst")
q("degree", lambda g: edges.degrees(components.symmetrise(g)), e("part_supplier"), sql=f"SELECT src AS vertex, count(DISTINCT dst) AS degree FROM {_sym('part_supplier')} WHERE src <> dst GROUP BY src")
q("degree_multi", lambda g: edges.degrees(components.symmetrise(g), distinct=False, loops=True), e("part_supplier"), sql=f"SELECT src AS vertex, count(*) AS degree FROM {_sym('part_supplier')} GROUP BY src")
q("degree_directed", edges.directed_degrees, e("event_chain"), sql="SELECT vertex, cast(sum(o) AS bigint) AS out_degree, cast(sum(i) AS bigint) AS in_degree, cast(sum(o + i) AS bigint) AS degree FROM (SELECT src AS vertex, 1 AS o, 0 AS i FROM {event_chain} UNION ALL SELECT dst, 0, 1 FROM {event_chain}) GROUP BY vertex")
q("degree_histogram", lambda g: edges.degree_distribution(components.symmetrise(g)), e("order_part"), sql=f"SELECT degree, count(*) AS n FROM (SELECT count(DISTINCT dst) AS degree FROM {_sym('order_part')} GROUP BY src) GROUP BY degree")
q("degree_power_law", lambda g: g.sparkSession.createDataFrame([(round(edges.degree_ks(components.symmetrise(g)), 6),)], "d double"), e("order_part"))
q("compact_ids", lambda g: relabel.compact_ids(g)[0], e("order_part"), sql="WITH ids AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT src AS x FROM {order_part} UNION SELECT dst FROM {order_part})) SELECT a.i AS src, b.i AS dst FROM {order_part} g JOIN ids a ON g.src = a.x JOIN ids b ON g.dst = b.x")
q("compact_mapping", lambda g: relabel.compact_ids(g)[1], e("order_part"), sql="SELECT x AS vertex, row_number() OVER (ORDER BY x) - 1 AS id FROM (SELECT src AS x FROM {order_part} UNION SELECT dst FROM {order_part})")
q("hash_ids_round_trip", lambda g: g.select(hashing.unmix64(hashing.mix64(F.col("src"))).alias("src"), "dst"), e("order_part"), sql="SELECT src, dst FROM {order_part}")
q("hash_ids", lambda g: hashing.permute_ids(g).agg(F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets")), e("part_supplier"), sql="SELECT count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM {part_supplier}")
q("rename_vertices_degrees", lambda g: edges.degree_distribution(components.symmetrise(relabel.rename_vertices(g, 3)[0])), e("order_part"), sql=f"SELECT degree, count(*) AS n FROM (SELECT count(DISTINCT dst) AS degree FROM {_sym('order_part')} GROUP BY src) GROUP BY degree")
q("permute_edges_count", lambda g: relabel.permute_edges(g, 3).agg(F.count_distinct("place").alias("places"), F.max("place").alias("last")), e("order_part"), sql="SELECT count(*) AS places, count(*) - 1 AS last FROM {order_part}")
q("neighbour_shift", lambda g: V.shifted(V.shifted(g, "src", "dst", "dst", 1, "next_dst"), "src", "dst", "dst", -1, "last_dst").select("src", "next_dst", "last_dst"), e("order_part"), sql="SELECT src, lead(dst) OVER (PARTITION BY src ORDER BY dst) AS next_dst, lag(dst) OVER (PARTITION BY src ORDER BY dst) AS last_dst FROM {order_part}")
q("runs", lambda g: V.runs(g, "src", "dst"), e("order_part"), sql="SELECT src, min(dst) AS first, max(dst) AS last, count(*) AS n FROM {order_part} GROUP BY src")
_SCANNED = "SELECT src, dst, min(w) OVER p AS least, max(w) OVER p AS most, cast(sum(w) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint) AS before FROM (SELECT DISTINCT src, dst, (dst * 7919) % 101 AS w FROM {order_part}) WINDOW p AS (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING)"


def _scanned(g: DataFrame) -> DataFrame:
    w = g.select("src", "dst", ((F.col("dst") * 7919) % 101).alias("w")).distinct()
    w = V.keyed_scan(V.keyed_scan(w, "src", "dst", "w", F.min, name="least"), "src", "dst", "w", F.max, name="most")
    return V.keyed_scan(w, "src", "dst", "w", F.sum, exclusive=True, name="before").drop("w")


q("keyed_scans", _scanned, e("order_part"), sql=_SCANNED)


def _stepped(doubling: bool) -> Callable[[DataFrame], DataFrame]:
    """One step of label propagation from every vertex's own label."""

    def run(g: DataFrame) -> DataFrame:
        both = cut(components.symmetrise(g).distinct())
        step = components.label_step(both, both.select(F.col("src").alias("vertex")).distinct().withColumn("component", F.col("vertex")))
        return components.parent_step(cut(step)) if doubling else step

    return run


_STEP = f"s AS (SELECT src AS vertex, src AS component, least(src, min(dst)) AS next FROM {_sym('order_part')} GROUP BY src)"
q("label_step", _stepped(False), e("order_part"), sql=f"WITH {_STEP} SELECT * FROM s")
q("parent_step", _stepped(True), e("order_part"), sql=f"WITH {_STEP} SELECT s.vertex, s.component, least(s.next, p.next) AS next FROM s JOIN s p ON p.vertex = s.next")
q("edge_distribution", lambda g: edges.edge_distribution(g).select((F.col("most") >= F.col("least")).alias("ok")), e("order_part"), sql="SELECT true AS ok")
q("exclusive_scan", V.exclusive_scan, v("balance"), sql="SELECT idx, cast(coalesce(sum(val) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS val FROM {balance}")


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results of one row each as one row."""
    return a.withColumn("k", F.lit(0)).join(b.withColumn("k", F.lit(0)), "k").drop("k")


# vectors: PRJ-7, 8, 12, 14..17, 19, 20; JN-3..6, 16, 17; AG-10..13; WN-5; ST-6..8; SO-1..5; SRC-12
def _n(s: SparkSession, d: str, table: str = "customer") -> int:
    """Length of a vector over a table's keys, which count from 1."""
    return s.read.parquet(f"{d}/{table}.parquet").count() + 1


_DENSE = "(SELECT r.i AS idx, coalesce(b.val, 0) AS val FROM (SELECT unnest(range((SELECT count(*) + 1 FROM customer))) AS i) r LEFT JOIN {balance} b ON b.idx = r.i)"
dense: Query = lambda s, d: V.densify(VECTORS["balance"](s, d), _n(s, d))
q("densify", lambda x: x, dense, sql=f"SELECT idx, val FROM {_DENSE}")
query("iota", lambda s, d: V.iota(s, 1000, 7), "SELECT i AS idx, i + 7 AS val FROM (SELECT unnest(range(1000)) AS i)")
q("vec_apply", lambda x: V.apply(x, lambda c: c * 2 + 1), v("balance"), sql="SELECT idx, val * 2 + 1 AS val FROM {balance}")
q("vec_apply_masked", lambda x, y: V.apply(x, lambda c: -c, y), v("balance"), v("orders"), sql="SELECT idx, CASE WHEN idx IN (SELECT idx FROM {orders}) THEN -val ELSE val END AS val FROM {balance}")
q("vec_apply_ind", lambda x: V.apply_ind(x, lambda c, i: c + i), v("balance"), sql="SELECT idx, val + idx AS val FROM {balance}")
q("set_num_to_ind", V.set_num_to_ind, v("orders"), sql="SELECT idx, idx AS val FROM {orders}")
q("vec_find", lambda x: V.find(x, lambda c: c > 5000), v("balance"), sql="SELECT idx, val FROM {balance} WHERE val > 5000")
q("vec_find_inds", lambda x: V.find_inds(x, lambda c: c > 5000), v("balance"), sql="SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, idx AS val FROM {balance} WHERE val > 5000")
q("vec_find_vals", lambda x: V.find_vals(x, lambda c: c > 5000), v("balance"), sql="SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, val FROM {balance} WHERE val > 5000")
q("vec_select", lambda x, y: V.select(x, y, lambda c: c > 0), v("orders"), dense, sql="SELECT o.idx, o.val FROM {orders} o JOIN {balance} b USING (idx) WHERE b.val > 0")
q("vec_select_apply", lambda x, y: V.select_apply(x, y, lambda c: c > 0, scalars.plus), v("orders"), dense, sql="SELECT o.idx, o.val + b.val AS val FROM {orders} o JOIN {balance} b USING (idx) WHERE b.val > 0")
q("vec_filter_by_index", lambda x, y: V.filter_by_val(x, y, lambda c: c % 100, True), v("balance"), v("orders"), sql="SELECT idx, val FROM {balance} WHERE val % 100 NOT IN (SELECT idx FROM {orders})")
q("vec_filter_by_value", lambda x, y: V.filter_by_val(x, y, lambda c: c % 100, False), v("balance"), v("orders"), sql="SELECT idx, val FROM {balance} WHERE val % 100 NOT IN (SELECT val FROM {orders})")
query("vec_concatenate", lambda s, d: V.concatenate([(VECTORS["orders"](s, d), _n(s, d)), (VECTORS["late"](s, d), _n(s, d))]), _sql("SELECT idx, val FROM {orders} UNION ALL SELECT idx + (SELECT count(*) + 1 FROM customer), val FROM {late}"))
q("ewise_mult", V.ewise_mult, v("orders"), dense, sql="SELECT o.idx, o.val * b.val AS val FROM {orders} o JOIN {balance} b USING (idx) WHERE b.val <> 0")
q("ewise_exclude", lambda x, y: V.ewise_mult(x, V.apply(y, lambda c: F.when(c > 0, c).otherwise(F.lit(0))), True), v("orders"), dense, sql="SELECT o.idx, o.val FROM {orders} o JOIN {balance} b USING (idx) WHERE b.val <= 0")
q("ewise_inner", lambda x, y: V.ewise_apply(x, y, scalars.minus, lambda a, b: a >= b), v("orders"), v("late"), sql="SELECT idx, o.val - l.val AS val FROM {orders} o JOIN {late} l USING (idx) WHERE o.val >= l.val")
q("ewise_left", lambda x, y: V.ewise_apply(x, y, scalars.minus, w_nulls=True, w_zero=0), v("orders"), v("late"), sql="SELECT o.idx, o.val - coalesce(l.val, 0) AS val FROM {orders} o LEFT JOIN {late} l USING (idx)")
q("ewise_right", lambda x, y: V.ewise_apply(x, y, scalars.maximum, v_nulls=True, v_zero=-1), v("orders"), v("late"), sql="SELECT l.idx, greatest(coalesce(o.val, -1), l.val) AS val FROM {late} l LEFT JOIN {orders} o USING (idx)")
q("ewise_outer", lambda x, y: V.ewise_apply(x, y, scalars.plus, v_nulls=True, w_nulls=True, v_zero=0, w_zero=0), v("orders"), v("late"), sql="SELECT idx, coalesce(o.val, 0) + coalesce(l.val, 0) AS val FROM {orders} o FULL JOIN {late} l USING (idx)")
q("ewise_symmetric_difference", lambda x, y: V.ewise_apply(x, y, scalars.plus, v_nulls=True, w_nulls=True, v_zero=0, w_zero=0, intersect=False), v("orders"), v("late"), sql="SELECT idx, coalesce(o.val, 0) + coalesce(l.val, 0) AS val FROM {orders} o FULL JOIN {late} l USING (idx) WHERE o.val IS NULL OR l.val IS NULL")
q("ewise_difference", lambda x, y: V.ewise_apply(x, y, scalars.plus, w_nulls=True, w_zero=0, intersect=False), v("orders"), v("late"), sql="SELECT idx, val FROM {orders} WHERE idx NOT IN (SELECT idx FROM {late})")
q("ewise_dense_sparse", lambda x, y: V.ewise_apply(x, y, scalars.plus, lambda a, b: b > 0), v("orders"), dense, sql="SELECT o.idx, o.val + b.val AS val FROM {orders} o JOIN {balance} b USING (idx) WHERE b.val > 0")
q("ewise_update", lambda x, y: V.ewise_update(x, y, scalars.plus, lambda a, b: b > 2), dense, v("orders"), sql=f"SELECT b.idx, CASE WHEN o.val > 2 THEN b.val + o.val ELSE b.val END AS val FROM {_DENSE} b LEFT JOIN {{orders}} o USING (idx)")
q("ewise_update_nulls", lambda x, y: V.ewise_update(x, y, scalars.minus, None, True, 5), dense, v("orders"), sql=f"SELECT b.idx, b.val - coalesce(o.val, 5) AS val FROM {_DENSE} b LEFT JOIN {{orders}} o USING (idx)")
q("gather", lambda x, y: V.gather(x, y), v("balance"), v("orders"), sql="SELECT o.idx, coalesce(b.val, 0) AS val FROM {orders} o LEFT JOIN {balance} b ON b.idx = o.val")
q("gget", lambda x, y: V.gget(x, y, lambda c, i: i * 2, -1), v("orders"), v("balance"), sql="SELECT o.idx, coalesce(b.val, -1) AS val FROM {orders} o LEFT JOIN {balance} b ON b.idx = o.idx * 2")
q("vec_reduce", lambda x: V.reduce(x, F.max, 0, F.abs), v("balance"), sql="SELECT coalesce(max(abs(val)), 0) AS val FROM {balance}")
q("vec_count", lambda x: V.count(x, lambda c: c < 0), v("balance"), sql="SELECT count(*) FILTER (val < 0) AS n FROM {balance}")
q("vec_nnz", V.nnz, v("late"), sql="SELECT count(*) AS n FROM {late}")
q("min_element", V.min_element, v("balance"), sql="SELECT idx, val FROM {balance} ORDER BY val, idx LIMIT 1")
q("uniq", V.uniq, v("late"), sql="SELECT min(idx) AS idx, val FROM {late} GROUP BY val")
q("vec_add", V.add, v("orders"), v("late"), sql="SELECT idx, cast(sum(val) AS bigint) AS val FROM (SELECT * FROM {orders} UNION ALL SELECT * FROM {late}) GROUP BY idx")
q("vec_subtract", lambda x, y: V.add(x, y, -1), v("orders"), v("late"), sql="SELECT idx, cast(sum(val) AS bigint) AS val FROM (SELECT * FROM {orders} UNION ALL SELECT idx, -val FROM {late}) GROUP BY idx")
q("setminus", V.setminus, v("orders"), v("late"), sql="SELECT idx, val FROM {orders} WHERE idx NOT IN (SELECT idx FROM {late})")
q("vec_equal", lambda x, y: V.equal(x, y), v("orders"), v("orders"), sql="SELECT true AS same")
q("vec_unequal", lambda x, y: V.equal(x, y), v("orders"), v("late"), sql="SELECT false AS same")
q("invert", lambda x: V.invert(x, 1000), v("late"), sql="SELECT val AS idx, min(idx) AS val FROM {late} WHERE val >= 0 AND val < 1000 GROUP BY val")
q("invert_general", lambda x: V.invert(x, None, lambda c, i: c % 7, lambda c, i: c + i), v("late"), sql="SELECT val % 7 AS idx, min(val + idx) AS val FROM {late} GROUP BY val % 7")
q("vec_assign", V.assign, dense, v("orders"), sql=f"SELECT b.idx, coalesce(o.val, b.val) AS val FROM {_DENSE} b LEFT JOIN {{orders}} o USING (idx)")
q("vec_scatter", lambda x, y: V.scatter(x, y, lambda c, i: c, lambda c, i: i), dense, v("orders"), sql=f"SELECT b.idx, coalesce(o.x, b.val) AS val FROM {_DENSE} b LEFT JOIN (SELECT val AS i, min(idx) AS x FROM {{orders}} GROUP BY val) o ON o.i = b.idx")
q("vec_elements", lambda x: V.del_element(V.set_element(x, 3, 99), 6), v("orders"), sql="SELECT idx, val FROM {orders} WHERE idx NOT IN (3, 6) UNION ALL SELECT 3, 99")
q("vec_get_element", lambda x: V.get_element(x, 9), v("orders"), sql="SELECT idx, val FROM {orders} WHERE idx = 9")
q("sort_values", lambda x: V.sort(x)[0], v("balance"), sql="SELECT row_number() OVER (ORDER BY val, idx) - 1 AS idx, val FROM {balance}")
q("sort_perm", lambda x: V.sort(x)[1], v("balance"), sql="SELECT row_number() OVER (ORDER BY val, idx) - 1 AS idx, idx AS val FROM {balance}")
q("top_k", lambda x: V.top_k(x, 10), v("balance"), sql="SELECT idx, val FROM {balance} ORDER BY val DESC, idx LIMIT 10")
q("random_permutation", lambda x: V.random_permutation(x, 1).agg(F.sum("val").alias("total"), F.max("idx").alias("last")), v("balance"), sql="SELECT cast(sum(val) AS bigint) AS total, count(*) - 1 AS last FROM {balance}")
query("sample_roots", lambda s, d: V.sample_roots(s, 1000, 16).agg(F.count_distinct("val").alias("n")), "SELECT cast(16 AS bigint) AS n")
q("scalar_functions", lambda x: x.select("idx", scalars.safe_inverse(F.col("val")).alias("inverse"), scalars.exponentiate(2)(F.col("val")).alias("power"), scalars.maximum(F.col("val"), F.col("idx")).alias("most"), scalars.minimum(F.col("val"), F.col("idx")).alias("least"), scalars.bit_and(F.col("val"), F.col("idx")).alias("anded"), scalars.bit_or(F.col("val"), F.col("idx")).alias("ored"), scalars.bit_xor(F.col("val"), F.col("idx")).alias("xored"), scalars.set_if_not_equal(0, 1)(F.col("val")).cast("long").alias("cleared"), scalars.logical_xor(F.col("val") > 1, F.col("idx") > 50).alias("either")), v("late"), sql="SELECT idx, 1.0::double / val AS inverse, cast(val AS double) * val AS power, greatest(val, idx) AS most, least(val, idx) AS least, val & idx AS anded, val | idx AS ored, xor(val, idx) AS xored, CASE WHEN val <> 1 THEN 0::bigint ELSE val END AS cleared, (val > 1) <> (idx > 50) AS either FROM {late}")

# matrices: PRJ-6, 9..11, 13, 17, 18; JN-7..15, 18, 19; AG-8, 9, 14, 15; SO-1, 3; SRC-13, 14; GA-13, 16, 21; SR-1..9
q("mat_from_edges", lambda g: M.from_edges(g, True), e("part_supplier"), sql="SELECT src AS row, dst AS col, count(*) AS val FROM {part_supplier} WHERE src >= 0 AND dst >= 0 AND src <> dst GROUP BY src, dst")


def _vectors(a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return M.find_entries(a)


q("mat_find", lambda a: (lambda i, j, x: i.withColumnRenamed("val", "row").join(j.withColumnRenamed("val", "col"), "idx").join(x, "idx"))(*_vectors(a)), m("b"), sql="SELECT row_number() OVER (ORDER BY row, col) - 1 AS idx, row, col, val FROM {b}")
q("mat_find_sparse_round_trip", lambda a: M.equal(a, M.from_vectors(*_vectors(a))), m("b"), sql="SELECT true AS same")
q("mat_from_vectors", lambda a: M.from_vectors(*(V.apply(x, lambda c: c % 10) for x in _vectors(a))), m("b"), sql="SELECT row % 10 AS row, col % 10 AS col, cast(sum(val % 10) AS bigint) AS val FROM {b} GROUP BY 1, 2")
q("mat_apply", lambda a: M.apply(a, lambda x: x * 3), m("a"), sql="SELECT row, col, val * 3 AS val FROM {a}")
q("mat_convert", lambda a: M.convert(a, "boolean"), m("b"), sql="SELECT row, col, val <> 0 AS val FROM {b}")
q("mat_prune", lambda a: M.prune(a, lambda x: x < 50), m("a"), sql="SELECT row, col, val FROM {a} WHERE NOT val < 50")
q("mat_prune_ind", lambda a: M.prune_ind(a, lambda r, c, x: (r + c + x) % 2 == 0), m("a"), sql="SELECT row, col, val FROM {a} WHERE (row + col + val) % 2 <> 0")
q("mat_prune_block", lambda a, x: M.prune_block(a, x.select("idx", (F.col("val") * 3).alias("val")), x), m("a"), v("x"), sql="SELECT row, col, val FROM {a} WHERE NOT (row IN (SELECT val * 3 FROM {x}) AND col IN (SELECT val FROM {x}))")
q("mat_remove_loops", M.remove_loops, m("a"), sql="SELECT row, col, val FROM {a} WHERE row <> col")
q("mat_transpose", M.transpose, m("a"), sql="SELECT col AS row, row AS col, val FROM {a}")
q("mat_add", M.add, m("a"), m("b"), sql="SELECT row, col, cast(sum(val) AS bigint) AS val FROM (SELECT * FROM {a} UNION ALL SELECT * FROM {b}) GROUP BY row, col")
q("mat_subtract", lambda a, b: M.add(a, b, -1), m("a"), m("b"), sql="SELECT row, col, cast(sum(val) AS bigint) AS val FROM (SELECT * FROM {a} UNION ALL SELECT row, col, -val FROM {b}) GROUP BY row, col")
q("mat_symmetric", M.symmetric, m("q"), sql="SELECT row, col, cast(sum(val) AS bigint) AS val FROM (SELECT row, col, val FROM {q} UNION ALL SELECT col, row, val FROM {q}) GROUP BY 1, 2")
q("mat_remove_duplicates", lambda a: M.remove_duplicates(a.select((F.col("row") % 20).alias("row"), (F.col("col") % 20).alias("col"), "val"), F.max), m("a"), sql="SELECT row % 20 AS row, col % 20 AS col, max(val) AS val FROM {a} GROUP BY 1, 2")
q("mat_ewise_mult", M.ewise_mult, m("a"), m("b"), sql="SELECT row, col, a.val * b.val AS val FROM {a} a JOIN {b} b USING (row, col)")
q("mat_ewise_exclude", lambda a, b: M.ewise_mult(a, b, True), m("a"), m("b"), sql="SELECT a.row, a.col, a.val FROM {a} a LEFT JOIN {b} b USING (row, col) WHERE b.val IS NULL")
q("mat_ewise_apply", lambda a, b: M.ewise_apply(a, b, scalars.minus, a_nulls=True, b_nulls=True, a_zero=0, b_zero=7), m("a"), m("q"), sql="SELECT row, col, coalesce(a.val, 0) - coalesce(b.val, 7) AS val FROM {a} a FULL JOIN {q} b USING (row, col)")
q("mat_ewise_apply_not", lambda a, b: M.ewise_apply_not(a, b, scalars.plus, 100), m("a"), m("b"), sql="SELECT a.row, a.col, a.val + 100 AS val FROM {a} a LEFT JOIN {b} b USING (row, col) WHERE b.val IS NULL")
q("mat_ewise_scale", M.ewise_scale, m("b"), m("a"), sql="SELECT row, col, b.val * a.val AS val FROM {b} b JOIN {a} a USING (row, col)")
q("mat_update_dense", lambda a, b: M.update_dense(a, b, scalars.plus), m("a"), m("b"), sql="SELECT a.row, a.col, a.val + coalesce(b.val, 0) AS val FROM {a} a LEFT JOIN {b} b USING (row, col)")
q("dim_apply", lambda a, x: M.dim_apply(a, "col", x, scalars.times), m("a"), v("x"), sql="SELECT a.row, a.col, a.val * x.val AS val FROM {a} a JOIN {x} x ON a.col = x.idx")
q("dim_apply_normalise", lambda a: M.apply(M.dim_apply(a, "col", M.mat_reduce(a, "col", F.sum), lambda x, t: x / t), lambda x: F.round(x, 9)), m("a"), sql="SELECT row, a.col, round(a.val::double / t.val, 9) AS val FROM {a} a JOIN (SELECT col, sum(val)::double AS val FROM {a} GROUP BY col) t ON a.col = t.col")
q("reduce_row", lambda a: M.mat_reduce(a, "row", F.sum), m("a"), sql="SELECT row AS idx, cast(sum(val) AS bigint) AS val FROM {a} GROUP BY row")
q("reduce_col", lambda a: M.mat_reduce(a, "col", F.max, unary=lambda x: -x), m("a"), sql="SELECT col AS idx, max(-val) AS val FROM {a} GROUP BY col")
for _end, _b in {"": m("b"), "_whole": m("b").whole}.items():
    query(f"reduce_dense{_end}", lambda s, d, b=_b: M.mat_reduce(b(s, d), "col", F.sum, zero=0, n=_n(s, d, "supplier")), _sql("SELECT r.i AS idx, coalesce(t.val, 0) AS val FROM (SELECT unnest(range((SELECT count(*) + 1 FROM supplier))) AS i) r LEFT JOIN (SELECT col, cast(sum(val) AS bigint) AS val FROM {b} GROUP BY col) t ON t.col = r.i", bool(_end)))
q("masked_reduce", lambda a, x: M.mat_reduce(a, "col", F.sum, mask=x), m("a"), v("orders"), sql="SELECT col AS idx, cast(sum(val) AS bigint) AS val FROM {a} WHERE row IN (SELECT idx FROM {orders}) GROUP BY col")
q("masked_reduce_exclude", lambda a, x: M.mat_reduce(a, "col", F.sum, mask=x, exclude=True), m("a"), v("orders"), sql="SELECT col AS idx, cast(sum(val) AS bigint) AS val FROM {a} WHERE row NOT IN (SELECT idx FROM {orders}) GROUP BY col")
for _name, _sr, _agg in (
    ("plus_times", S.PLUS_TIMES, "cast(sum(a.val * x.val) AS bigint)"),
    ("min_plus", S.MIN_PLUS, "min(a.val + x.val)"),
    ("max_times", S.MAX_TIMES, "max(a.val * x.val)"),
    ("select_max", S.SELECT_MAX, "max(x.val)"),
    ("select_second", S.SELECT_SECOND, "arg_max(x.val, a.col)"),
    ("copy_first", S.COPY_FIRST, "min(a.val)"),
    ("copy_second", S.COPY_SECOND, "min(x.val)"),
    ("select_min", S.SELECT_MIN, "min(x.val)"),
    ("count", S.COUNT, "count(*)"),
    ("or_and", S.OR_AND, "bool_or(a.val <> 0 AND x.val <> 0)"),
    ("filtered", S.filtered(S.PLUS_TIMES, lambda x: x >= 60), "cast(sum(CASE WHEN a.val >= 60 THEN a.val * x.val END) AS bigint)"),
):
    q(f"spmspv_{_name}", lambda a, x, r=_sr: M.spmv(a, x, r), m("a"), v("x"), sql=f"SELECT a.row AS idx, {_agg} AS val FROM {{a}} a JOIN {{x}} x ON a.col = x.idx GROUP BY a.row")
_TOP = (1 << 63) - 1
q("spmspv_min_plus_saturating", lambda a, x: M.spmv(a, x.select("idx", F.lit(_TOP - 20).alias("val")), S.MIN_PLUS), m("a"), v("x"), sql=f"SELECT a.row AS idx, cast(min(least(a.val::hugeint + {_TOP - 20}, {_TOP})) AS bigint) AS val FROM {{a}} a JOIN {{x}} x ON a.col = x.idx GROUP BY a.row")
q("spmspv_random", lambda a, x: M.spmv(a, x, S.select_random(3)), m("a"), v("x"))
query("spmv_dense", lambda s, d: M.spmv(MATRICES["a"](s, d), V.densify(VECTORS["x"](s, d), _n(s, d, "supplier")), n=_n(s, d, "part")), _sql("SELECT r.i AS idx, coalesce(t.val, 0) AS val FROM (SELECT unnest(range((SELECT count(*) + 1 FROM part))) AS i) r LEFT JOIN (SELECT a.row, cast(sum(a.val * coalesce(x.val, 0)) AS bigint) AS val FROM {a} a LEFT JOIN {x} x ON a.col = x.idx GROUP BY a.row) t ON t.row = r.i", bool(_end)))
_MM = "SELECT a.row, s.col, {agg} AS val FROM {{a}} a JOIN {{s}} s ON a.col = s.row GROUP BY a.row, s.col"
q("spgemm", M.spgemm, m("a"), m("s"), sql=_MM.replace("{agg}", "cast(sum(a.val * s.val) AS bigint)").replace("{{", "{").replace("}}", "}"))
q("spgemm_layers", lambda a, b: M.spgemm(a, b, layers=4), m("a"), m("s"), sql=_MM.replace("{agg}", "cast(sum(a.val * s.val) AS bigint)").replace("{{", "{").replace("}}", "}"))
q("spgemm_min_plus", lambda a, b: M.spgemm(a, b, S.MIN_PLUS), m("a"), m("s"), sql=_MM.replace("{agg}", "min(a.val + s.val)").replace("{{", "{").replace("}}", "}"))
q("spgemm_cosupplier", lambda b: M.spgemm(M.transpose(b), b, S.COUNT), m("b"), sql="SELECT x.col AS row, y.col, count(*) AS val FROM {b} x JOIN {b} y ON x.row = y.row GROUP BY 1, 2")
q("square", M.square, m("q"), sql="SELECT x.row, y.col, cast(sum(x.val * y.val) AS bigint) AS val FROM {q} x JOIN {q} y ON x.col = y.row GROUP BY 1, 2")
q("matrix_powers", lambda a: M.powers(M.convert(M.prune(a, lambda x: x < 8), "boolean"), 2, S.OR_AND), m("q"), sql="WITH p1 AS (SELECT row, col FROM {q} WHERE val >= 8), p2 AS (SELECT DISTINCT x.row, y.col FROM p1 x JOIN p1 y ON x.col = y.row) SELECT DISTINCT x.row, y.col, true AS val FROM p2 x JOIN p2 y ON x.col = y.row")
_RI = lambda x: V.apply(V.set_num_to_ind(x), lambda c: c + 2)
q("mat_index", lambda a, x: M.index(a, x.select("idx", (F.col("val") * 3).alias("val")), x), m("a"), v("x"), sql="SELECT r.idx AS row, c.idx AS col, a.val FROM {a} a JOIN {x} r ON a.row = r.val * 3 JOIN {x} c ON a.col = c.val")
q("mat_assign", lambda a, x, b: M.assign(a, _RI(x), _RI(x), b), m("a"), v("x"), m("q"), sql="SELECT row, col, val FROM {a} WHERE NOT (row IN (SELECT idx + 2 FROM {x}) AND col IN (SELECT idx + 2 FROM {x})) UNION ALL SELECT r.idx + 2, c.idx + 2, b.val FROM {q} b JOIN {x} r ON b.row = r.idx JOIN {x} c ON b.col = c.idx")
q("permutation_matrix", M.permutation_matrix, v("x"), sql="SELECT idx AS row, val AS col, 1::bigint AS val FROM {x}")
q("mat_compact", lambda a: M.compact(M.prune(a, lambda x: x < 120))[0], m("a"), sql="WITH t AS (SELECT * FROM {a} WHERE val >= 120), r AS (SELECT row, row_number() OVER (ORDER BY row) - 1 AS i FROM (SELECT DISTINCT row FROM t)), c AS (SELECT col, row_number() OVER (ORDER BY col) - 1 AS j FROM (SELECT DISTINCT col FROM t)) SELECT r.i AS row, c.j AS col, t.val FROM t JOIN r USING (row) JOIN c USING (col)")
q("mat_equal", lambda a, b: M.equal(M.transpose(M.transpose(a)), b), m("a"), m("a"), sql="SELECT true AS same")
q("load_imbalance", lambda a: M.load_imbalance(a).select("rows", (F.col("imbalance") >= 1).alias("ok")), m("a"), sql="SELECT count(*) AS rows, true AS ok FROM {a}")


# composite algorithms: GA-11..19
def _independence(distance: int) -> Query:
    def run(g: DataFrame) -> DataFrame:
        g = cut(g)
        both = cut(components.symmetrise(g).distinct().where("src <> dst"))
        s = cut(independent.mis(g, 2, distance=distance))
        at = lambda c: s.select(F.col("vertex").alias(c))
        near = both if distance == 1 else both.unionAll(both.join(both.select(F.col("src").alias("m"), F.col("dst").alias("far")), F.col("dst") == F.col("m")).select("src", F.col("far").alias("dst"))).where("src <> dst").distinct()
        clash = near.join(at("a"), F.col("src") == F.col("a")).join(at("b"), F.col("dst") == F.col("b"))
        free = both.select(F.col("src").alias("v")).distinct().join(at("v"), "v", "left_anti").join(near.join(at("a"), F.col("src") == F.col("a")).select(F.col("dst").alias("v")), "v", "left_anti")
        return _beside(clash.agg(F.count(F.lit(1)).alias("clashes")), free.agg(F.count(F.lit(1)).alias("free")))

    return run


for _d in (1, 2):
    q(f"mis_distance_{_d}_check", _independence(_d), e("order_part"), sql="SELECT 0::bigint AS clashes, 0::bigint AS free")
q("mis_filtered", lambda g: independent.mis(g, 4, keep=F.col("src") < F.col("dst")), e("order_part"))
q("amg_aggregates", lambda g: independent.aggregates(g, 1).agg(F.count_distinct("vertex").alias("vertices")), e("order_part"), sql="SELECT count(*) AS vertices FROM (SELECT src FROM {order_part} UNION SELECT dst FROM {order_part})")


def _galerkin(g: DataFrame) -> DataFrame:
    both = cut(components.symmetrise(g))
    a, r = cut(M.from_edges(both)), cut(independent.restriction(g, 1))
    same = M.equal(independent.galerkin(a, r), independent.galerkin(a, r, True))
    return _beside(same, independent.galerkin(a, r).agg(F.sum("val").alias("total")))


q("amg_galerkin", _galerkin, e("order_part"), sql=f"SELECT true AS same, count(*) AS total FROM {_sym('order_part')}")
q("betweenness", lambda g: (lambda b: centrality.betweenness(b, b.select(F.col("src").alias("vertex")).distinct()).select("vertex", F.round("score", 6).alias("score")))(cut(components.symmetrise(g))), e("customer_order"), sql="SELECT v AS vertex, cast(k * (k - 1) AS double) AS score FROM (SELECT src AS v, count(*) AS k FROM {customer_order} GROUP BY src) UNION ALL SELECT dst, 0.0::double FROM {customer_order}")
q("markov_clusters", lambda g: centrality.markov_clustering(M.from_edges(components.symmetrise(g))), e("duplicate_documents"))
q("markov_clusters_cover", lambda g: centrality.markov_clustering(M.from_edges(components.symmetrise(g))).agg(F.count_distinct("vertex").alias("n")), e("duplicate_documents"), sql="SELECT count(*) AS n FROM (SELECT src FROM {duplicate_documents} UNION SELECT dst FROM {duplicate_documents})")


def _bip(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda g: make(g.select(F.col("src").alias("row"), F.col("dst").alias("col")))


def _matched(how: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(b: DataFrame) -> DataFrame:
        b = cut(b)
        mates = cut(how(b))
        return _beside(matching.is_matching(mates, b), matching.is_maximal_matching(mates, b).withColumnRenamed("ok", "maximal"))

    return run


for _how in matching.METHODS:
    q(f"matching_{_how}_check", _bip(_matched(lambda b, h=_how: matching.maximal_matching(b, h))), e("order_part"), sql="SELECT true AS ok, true AS maximal")
q("matching_maximum_check", _bip(_matched(matching.maximum_matching)), e("order_part"), sql="SELECT true AS ok, true AS maximal")
q("matching_maximum_size", _bip(lambda b: matching.maximum_matching(b).agg(F.count(F.lit(1)).alias("n"))), e("order_part"))
query("bfs_statistics", lambda s, d: bfs.bfs_statistics(s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg((F.sum("l_quantity") * 1_000_000).alias("edges"), F.count(F.lit(1)).cast("double").alias("seconds"))).select("least", "q1", "median", "q3", "most", F.round("mean", 6).alias("mean")), "SELECT min(x) AS least, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS most, round(avg(x), 6) AS mean FROM (SELECT sum(l_quantity) / count(*) AS x FROM lineitem GROUP BY l_orderkey)")


# sources and sinks: SRC-1..11, SNK-1..6. What is written goes to the shared folder and is read back.
def _there(s: SparkSession, name: str) -> str:
    return work_folder(s, name)


def _round_trip(write: Callable, read: Callable) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        path = _there(df.sparkSession, "round-trip")
        write(df, path)
        return read(df.sparkSession, path)

    return run


_SIDE = 1 << 40
q("text_edges_round_trip", _round_trip(sinks.write_text, lambda s, p: readers.read_edge_list(s, p, add_reverse=False)), e("order_part"), sql="SELECT src, dst FROM {order_part}")
q("text_edges_reversed", _round_trip(lambda df, p: sinks.write_text(df, p, False), readers.read_edge_list), e("order_part"), sql=f"SELECT src, dst FROM {_sym('order_part')}")
q("text_edges_lenient", _round_trip(lambda df, p: df.select(F.concat(F.lit(" "), "src", F.lit("\t"), "dst", F.lit("  0.5"))).write.text(p), lambda s, p: readers.read_edge_list(s, p, False, False)), e("order_part"), sql="SELECT src, dst FROM {order_part}")
q("binary_edges_round_trip", _round_trip(sinks.write_binary, readers.read_binary_edges), e("part_supplier"), sql="SELECT src, dst FROM {part_supplier} WHERE src < dst")
q("binary_edges_32_round_trip", _round_trip(lambda g, p: sinks.write_binary(g, p, 32), lambda s, p: readers.read_binary_edges(s, p, 32)), e("part_supplier"), sql="SELECT src, dst FROM {part_supplier} WHERE src < dst")
q("dot_lines", _round_trip(sinks.write_dot, lambda s, p: s.read.text(p).select(F.col("value").alias("line"))), e("order_part"), sql="SELECT 'graph G {' AS line UNION ALL SELECT '}' UNION ALL SELECT src || ' -- ' || dst || ';' FROM {order_part} WHERE src < dst")
q("matrix_market_round_trip", _round_trip(lambda a, p: sinks.write_matrix_market(a, p, _SIDE, _SIDE, "integer"), lambda s, p: readers.read_matrix_market(s, p)[0]), m("b"), sql="SELECT row, col, val FROM {b}")
q("triples_transposed", _round_trip(lambda a, p: sinks.write_matrix_market(a, p, _SIDE, _SIDE), lambda s, p: readers.read_triples(s, p, transpose=True)[0]), m("b"), sql="SELECT col AS row, row AS col, val::double AS val FROM {b}")
q("triples_no_values", _round_trip(lambda a, p: sinks.write_matrix_market(a, p, _SIDE, _SIDE, "pattern"), lambda s, p: readers.read_triples(s, p, no_num=True)[0]), m("b"), sql="SELECT row, col, 1.0::double AS val FROM {b}")
q("binary_matrix_round_trip", _round_trip(lambda a, p: sinks.write_binary_matrix(a, p, _SIDE, _SIDE), lambda s, p: readers.read_binary_matrix(s, p)[0]), m("b"), sql="SELECT row, col, val::double AS val FROM {b}")
q("vector_round_trip", _round_trip(sinks.write_vector, readers.read_vector), v("orders"), sql="SELECT idx, val::double AS val FROM {orders}")
q("binary_vector_round_trip", _round_trip(sinks.write_binary_vector, readers.read_binary_vector), v("balance"), sql="SELECT idx, val::double AS val FROM {balance}")
q("hypergraph_lines", _round_trip(lambda a, p: sinks.write_hypergraph(a, p, 10, 10), lambda s, p: s.read.text(p).select(F.col("value").alias("line"))), m("b"), sql="SELECT '0 10 10 ' || count(*) AS line FROM {b} UNION ALL SELECT string_agg(col, ' ' ORDER BY col) FROM {b} GROUP BY row")
q("matrix_description", lambda a: sinks.describe(a.repartition(3, "row")).select("rows", (F.col("most") >= F.col("least")).alias("spread"), (F.col("parts") <= 3).alias("few")), m("b"), sql="SELECT count(*) AS rows, true AS spread, true AS few FROM {b}")


def _attributed(s: SparkSession, d: str) -> DataFrame:
    path = _there(s, "attributed")
    li = s.read.parquet(f"{d}/lineitem.parquet")
    n = (F.col("l_linenumber") - 1).cast("int")
    when = F.when(n > 0, F.concat(F.lit(" "), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))).otherwise(F.lit(""))
    body = li.select(F.concat_ws(" ", F.col("l_orderkey") + 1, F.col("l_partkey") + 1, F.when(F.col("l_returnflag") == "R", 1).otherwise(0), n).alias("a"), when.alias("b"))
    body.select(F.concat("a", "b").alias("value")).write.text(path)
    return readers.read_attributed_edges(s, path).select("src", "dst", "follower", F.col("count").cast("long").alias("count"), F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


def _attributed_binary(s: SparkSession, d: str) -> DataFrame:
    path, n = _there(s, "attributed-binary"), F.col("l_linenumber") - 1
    li = s.read.parquet(f"{d}/lineitem.parquet")
    rows = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("follower"), n.alias("count"), F.when(n > 0, F.col("l_shipdate")).alias("latest"))
    sinks.write_attributed_binary(rows, path)
    return readers.read_attributed_binary(s, path).select("src", "dst", "follower", F.col("count").cast("long").alias("count"), F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


_ATTRIBUTED = "SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag = 'R' AS follower, cast(l_linenumber - 1 AS bigint) AS count, CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS latest FROM lineitem"
query("attributed_edges_binary", _attributed_binary, _ATTRIBUTED)
query("attributed_edges", _attributed, "SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag = 'R' AS follower, cast(l_linenumber - 1 AS bigint) AS count, CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS latest FROM lineitem")


def _reads(s: SparkSession, d: str, table: str = "documents") -> DataFrame:
    """Letters of a table's texts as sequencing reads: every letter becomes one of ACGT."""
    letters = b"abcdefghijklmnopqrstuvwxyz"
    to, others = bytes.maketrans(letters, b"ACGTACGTACGTACGTACGTACGTAC"), bytes(set(range(256)) - set(letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reads = [None if t is None else t.encode().translate(to, others) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(reads, pa.binary()).cast(pa.string())], ["seq"])

    return s.read.parquet(f"{d}/{table}.parquet").select(F.lower("text").alias("text")).mapInArrow(run, "seq string")


def _debruijn(s: SparkSession, d: str) -> DataFrame:
    path = _there(s, "reads")
    record = F.concat(F.lit("@r\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    _reads(s, d).select(record.alias("value")).write.text(path, compression="gzip")
    return kmers.counts(readers.read_fastq(s, path), 31)


_READ = "(SELECT translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM documents)"
query("debruijn_counts", _debruijn, f"WITH k AS (SELECT substr(s, i, 31) AS a, substr(s, i + 1, 31) AS b FROM (SELECT s, unnest(range(1, greatest(length(s) - 30, 1))) AS i FROM {_READ} WHERE length(s) > 31)) SELECT 2 * (SELECT count(*) FROM k) AS n_edges, (SELECT count(*) FROM (SELECT DISTINCT least(x, reverse(translate(x, 'ACGT', 'TGCA'))) FROM (SELECT a AS x FROM k UNION ALL SELECT b FROM k))) AS n_vertices")
_CANON = "least({x}, reverse(translate({x}, 'ACGT', 'TGCA')))"
_KMERS = f"""WITH RECURSIVE k AS (SELECT substr(s, i, 31) AS a, substr(s, i + 1, 31) AS b FROM (SELECT s, unnest(range(1, greatest(length(s) - 30, 1))) AS i FROM {_READ.replace("FROM documents", "FROM benchmark")} WHERE length(s) > 31)),
c AS (SELECT DISTINCT {_CANON.format(x="a")} AS a, {_CANON.format(x="b")} AS b FROM k), e AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
cc(v, l) USING KEY (v) AS (SELECT DISTINCT a, a FROM e UNION
 SELECT x.v, x.l FROM (SELECT e.b v, min(cc.l) l FROM cc JOIN e ON e.a = cc.v GROUP BY 1) x JOIN recurring.cc r ON r.v = x.v WHERE x.l < r.l)
SELECT n, count(*) AS components FROM (SELECT count(*) AS n FROM cc GROUP BY l) GROUP BY n"""
query("cc_debruijn", lambda s, d: edges.component_sizes(components.contract_components(readers.kmer_edges(_reads(s, d, "benchmark"), 31))).groupBy("n").agg(F.count(F.lit(1)).alias("components")), _KMERS)
query("cc_debruijn_whole", lambda s, d: kmers.component_sizes(_reads(s, d), 31).groupBy("n").agg(F.count(F.lit(1)).alias("components")))
query("chain", lambda s, d: generators.chain(s, 1000), "SELECT i AS src, i + 1 AS dst FROM (SELECT unnest(range(999)) AS i) UNION ALL SELECT i + 1, i FROM (SELECT unnest(range(999)) AS i)")
query("cc_chain", lambda s, d: edges.component_sizes(components.contract_components(generators.chain(s, 5000))), "SELECT 0::bigint AS component, 5000::bigint AS n")
query("kronecker_counts", lambda s, d: generators.kronecker(s, 12, 16).agg(F.count(F.lit(1)).alias("n"), (F.max("src") < 4096).alias("in_range")), "SELECT cast(2 * 16 * 4096 AS bigint) AS n, true AS in_range")
query("kronecker", lambda s, d: edges.degree_distribution(generators.kronecker(s, 12, 16)))
query("uniform_random_counts", lambda s, d: generators.kronecker(s, 10, 8, (0.25, 0.25, 0.25, 0.25)).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("src") > 1000).alias("spread")), "SELECT cast(2 * 8 * 1024 AS bigint) AS n, true AS spread")
query("cc_kronecker_adaptive", lambda s, d: edges.component_sizes(bfs.connected_components(generators.kronecker(s, 12, 16), "auto", symmetric=True)).agg(F.max("n").alias("largest")))
