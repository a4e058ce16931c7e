"""Sparse matrices as (row, col, val) rows, 0-based; an entry that is absent is zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.semiring import PLUS_TIMES, Semiring

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


def from_edges(edges: DataFrame, drop_loops: bool = False) -> DataFrame:
    """Multiplicity of each edge; edges with a negative end are empty slots and go."""
    rows = edges.where("src >= 0 and dst >= 0")
    if drop_loops:
        rows = rows.where("src <> dst")
    return rows.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.count(F.lit(1)).alias("val"))


def from_vectors(i: DataFrame, j: DataFrame, v: DataFrame, sum_duplicates: bool = True) -> DataFrame:
    """sparse(i, j, v): the k-th values of three dense vectors are one entry; equal places are summed, or one (the least) stays."""
    rows = i.select("idx", F.col("val").alias("row")).join(j.select("idx", F.col("val").alias("col")), "idx").join(v, "idx")
    return rows.groupBy("row", "col").agg((F.sum if sum_duplicates else F.min)("val").alias("val"))


def find_entries(a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, columns and values as dense vectors in (row, col) order."""
    from meshwork.operators.relabel import enumerate_sorted

    e = enumerate_sorted(a, ["row", "col"])
    return tuple(e.select("idx", F.col(c).alias("val")) for c in ("row", "col", "val"))


def apply(a: DataFrame, f: Unary) -> DataFrame:
    return a.select("row", "col", f(F.col("val")).alias("val"))


def convert(a: DataFrame, kind: str) -> DataFrame:
    """Values cast; to boolean anything but zero is true."""
    return apply(a, lambda v: v != 0 if kind == "boolean" else v.cast(kind))


def prune(a: DataFrame, drop: Unary) -> DataFrame:
    """Without the entries whose value drop holds for."""
    return a.where(~F.coalesce(drop(F.col("val")), F.lit(False)))


def prune_ind(a: DataFrame, drop: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """As prune, drop(row, col, val)."""
    return a.where(~F.coalesce(drop(F.col("row"), F.col("col"), F.col("val")), F.lit(False)))


def prune_block(a: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The sub-block rows x cols (values of two vectors) emptied."""
    r = rows.select(F.col("val").alias("r")).distinct()
    c = cols.select(F.col("val").alias("c")).distinct()
    out = a.join(r, F.col("row") == F.col("r"), "left").join(c, F.col("col") == F.col("c"), "left")
    return out.where("r is null or c is null").select("row", "col", "val")


def remove_loops(a: DataFrame) -> DataFrame:
    return a.where("row <> col")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def remove_duplicates(a: DataFrame, agg: Callable[[Column], Column]) -> DataFrame:
    return a.groupBy("row", "col").agg(agg(F.col("val")).alias("val"))


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + b, or a - b; a + a is allowed."""
    return a.unionByName(apply(b, lambda v: v * sign)).groupBy("row", "col").agg(F.sum("val").alias("val"))


def symmetric(a: DataFrame) -> DataFrame:
    return add(a, transpose(a))


def _pair(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    right = b.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("val").alias("b"), F.lit(True).alias("in_b"))
    left = a.select("row", "col", F.col("val").alias("a"), F.lit(True).alias("in_a"))
    rows = left.join(right, (F.col("row") == F.col("r2")) & (F.col("col") == F.col("c2")), how)
    return rows.select(F.coalesce("row", "r2").alias("row"), F.coalesce("col", "c2").alias("col"), "a", "b", F.col("in_a").isNotNull().alias("has_a"), F.col("in_b").isNotNull().alias("has_b"))


def ewise_mult(a: DataFrame, b: DataFrame, exclude: bool = False) -> DataFrame:
    """a .* b, or the entries of a where b has none."""
    if exclude:
        return a.join(b.select("row", "col"), ["row", "col"], "left_anti").select("row", "col", "val")
    return _pair(a, b, "inner").select("row", "col", (F.col("a") * F.col("b")).alias("val"))


def ewise_apply(a: DataFrame, b: DataFrame, op: Binary, pred: Binary | None = None, a_nulls: bool = False, b_nulls: bool = False, a_zero=None, b_zero=None, intersect: bool = True) -> DataFrame:
    """op on equal places; the flags as for vectors."""
    how = {(False, False): "inner", (False, True): "left", (True, False): "right", (True, True): "full"}[a_nulls, b_nulls]
    rows = _pair(a, b, how)
    if not intersect:
        rows = rows.where(~(F.col("has_a") & F.col("has_b")))
    rows = rows.select("row", "col", F.coalesce("a", F.lit(a_zero)).alias("a"), F.coalesce("b", F.lit(b_zero)).alias("b"))
    if pred is not None:
        rows = rows.where(pred(F.col("a"), F.col("b")))
    return rows.select("row", "col", op(F.col("a"), F.col("b")).alias("val"))


def ewise_apply_not(a: DataFrame, b: DataFrame, op: Binary, default) -> DataFrame:
    """op(a, default) where b has no entry."""
    return ewise_mult(a, b, exclude=True).select("row", "col", op(F.col("val"), F.lit(default)).alias("val"))


def ewise_scale(a: DataFrame, dense: DataFrame) -> DataFrame:
    return _pair(a, dense, "inner").select("row", "col", (F.col("a") * F.col("b")).alias("val"))


def update_dense(dense: DataFrame, a: DataFrame, op: Binary) -> DataFrame:
    """A dense matrix with op(own, entry) where a has an entry."""
    return _pair(dense, a, "left").select("row", "col", F.when(F.col("has_b"), op(F.col("a"), F.col("b"))).otherwise(F.col("a")).alias("val"))


def dim_apply(a: DataFrame, dim: str, v: DataFrame, op: Binary) -> DataFrame:
    """Each entry combined with its row's or column's scalar; dim: 'row' or 'col'."""
    w = v.select(F.col("idx").alias("i"), F.col("val").alias("s"))
    return a.join(w, F.col(dim) == F.col("i")).select("row", "col", op(F.col("val"), F.col("s")).alias("val"))


def mat_reduce(a: DataFrame, dim: str, agg: Callable[[Column], Column], zero=None, unary: Unary | None = None, n: int | None = None, mask: DataFrame | None = None, exclude: bool = False) -> DataFrame:
    """One value per row (dim 'row') or column ('col'); dense over 0..n-1 if n is given.

    mask (columns only): fold the entries whose row is in it, or with exclude those whose row is not.
    """
    if mask is not None:
        if dim != "col":
            raise ValueError("masks go with columns")
        at = mask.select(F.col("idx").alias("m")).distinct()
        a = a.join(at, F.col("row") == F.col("m"), "left_anti" if exclude else "left_semi")
    x = F.col("val") if unary is None else unary(F.col("val"))
    v = a.groupBy(F.col(dim).alias("idx")).agg(agg(x).alias("val"))
    if n is None:
        return v
    from meshwork.operators.vector import densify

    return densify(v, n, zero)


def spmv(a: DataFrame, x: DataFrame, sr: Semiring = PLUS_TIMES, n: int | None = None) -> DataFrame:
    """y = a x: one join on the column, one partially aggregated sum; dense over 0..n-1 if n is given."""
    v = x.select(F.col("idx").alias("i"), F.col("val").alias("x"))
    y = a.join(v, F.col("col") == F.col("i")).groupBy(F.col("row").alias("idx")).agg(sr.total(sr.mul(F.col("val"), F.col("x")), F.col("i")).alias("val"))
    if n is None:
        return y
    from meshwork.operators.vector import densify

    return densify(y, n, sr.zero)


def spgemm(a: DataFrame, b: DataFrame, sr: Semiring = PLUS_TIMES, layers: int = 1) -> DataFrame:
    """c = a b. layers > 1 splits the inner index into layers whose partial products are added last:
    the layer is part of the join key, so that a hub of the inner index meets in several tasks."""
    left = a.select("row", F.col("col").alias("k"), F.col("val").alias("a"))
    right = b.select(F.col("row").alias("k2"), "col", F.col("val").alias("b"))
    if layers > 1:
        left = left.withColumn("layer", F.pmod(F.xxhash64("row"), F.lit(layers)))
        right = right.withColumn("layer2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(layers - 1).cast("long"))))
        on = (F.col("k") == F.col("k2")) & (F.col("layer") == F.col("layer2"))
    else:
        on = F.col("k") == F.col("k2")
    return left.join(right, on).groupBy("row", "col").agg(sr.total(sr.mul(F.col("a"), F.col("b")), F.col("k")).alias("val"))


def square(a: DataFrame, sr: Semiring = PLUS_TIMES) -> DataFrame:
    return spgemm(a, a, sr)


def index(a: DataFrame, ri: DataFrame, ci: DataFrame) -> DataFrame:
    """c[i, j] = a[ri[i], ci[j]]."""
    r = ri.select(F.col("idx").alias("i"), F.col("val").alias("r"))
    c = ci.select(F.col("idx").alias("j"), F.col("val").alias("c"))
    return a.join(r, F.col("row") == F.col("r")).join(c, F.col("col") == F.col("c")).select(F.col("i").alias("row"), F.col("j").alias("col"), "val")


def assign(a: DataFrame, ri: DataFrame, ci: DataFrame, b: DataFrame) -> DataFrame:
    """a with a(ri, ci) = b: the block is emptied first."""
    r = ri.select(F.col("idx").alias("i"), F.col("val").alias("r"))
    c = ci.select(F.col("idx").alias("j"), F.col("val").alias("c"))
    new = b.join(r, F.col("row") == F.col("i")).join(c, F.col("col") == F.col("j")).select(F.col("r").alias("row"), F.col("c").alias("col"), "val")
    return prune_block(a, ri, ci).unionByName(new)


def permutation_matrix(ri: DataFrame) -> DataFrame:
    """m[k, ri[k]] = 1."""
    return ri.select(F.col("idx").alias("row"), F.col("val").alias("col"), F.lit(1).cast("long").alias("val"))


def compact(a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a without empty rows and columns, and the kept rows and columns as dense vectors of old indices."""
    from meshwork.operators.relabel import enumerate_sorted

    r = enumerate_sorted(a.select(F.col("row").alias("val")).distinct(), ["val"])
    c = enumerate_sorted(a.select(F.col("col").alias("val")).distinct(), ["val"])
    return index(a, r, c), r, c


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    from meshwork.operators.vector import equal as same

    return same(a.select("row", "col", "val"), b.select("row", "col", "val"))


def powers(a: DataFrame, k: int, sr: Semiring) -> DataFrame:
    """a^(2^k) by repeated squaring."""
    from meshwork.session import cut

    for _ in range(k):
        a = cut(square(a, sr))
    return a


def load_imbalance(a: DataFrame) -> DataFrame:
    """Partitions, rows, and largest share over the mean one."""
    per = a.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") * F.count(F.lit(1)) / F.sum("n")).alias("imbalance"))
