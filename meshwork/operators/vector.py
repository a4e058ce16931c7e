"""Sparse (idx, val) and dense vectors: a dense one has every idx of 0..n-1. Missing is an absent row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.operators.relabel import enumerate_sorted

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


def _pair(v: DataFrame, w: DataFrame, how: str) -> DataFrame:
    """(idx, a, b) on equal idx; a or b null where a side has none."""
    right = w.select(F.col("idx").alias("idx2"), F.col("val").alias("b"))
    rows = v.select("idx", F.col("val").alias("a")).join(right, F.col("idx") == F.col("idx2"), how)
    return rows.select(F.coalesce("idx", "idx2").alias("idx"), "a", "b", F.col("idx").isNotNull().alias("has_a"), F.col("idx2").isNotNull().alias("has_b"))


def iota(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") + first).alias("val"))


def densify(v: DataFrame, n: int, zero=0) -> DataFrame:
    """Every idx of 0..n-1, with zero where v has none."""
    every = v.sparkSession.range(n).select(F.col("id").alias("i"))
    return every.join(v, F.col("i") == F.col("idx"), "left").select(F.col("i").alias("idx"), F.coalesce("val", F.lit(zero)).alias("val"))


def apply(v: DataFrame, f: Unary, mask: DataFrame | None = None) -> DataFrame:
    """f on values; with a mask only at its indices."""
    if mask is None:
        return v.select("idx", f(F.col("val")).alias("val"))
    at = mask.select(F.col("idx").alias("m")).distinct()
    return v.join(at, F.col("idx") == F.col("m"), "left").select("idx", F.when(F.col("m").isNotNull(), f(F.col("val"))).otherwise(F.col("val")).alias("val"))


def apply_ind(v: DataFrame, f: Binary) -> DataFrame:
    """f(value, index)."""
    return v.select("idx", f(F.col("val"), F.col("idx")).alias("val"))


def set_num_to_ind(v: DataFrame) -> DataFrame:
    return v.select("idx", F.col("idx").alias("val"))


def find(v: DataFrame, keep: Unary) -> DataFrame:
    """The sparse vector of the entries that keep holds for."""
    return v.where(keep(F.col("val"))).select("idx", "val")


def find_inds(v: DataFrame, keep: Unary) -> DataFrame:
    """The qualifying indices, as a dense vector in their order."""
    return enumerate_sorted(find(v, keep).select(F.col("idx").alias("val")), ["val"]).select("idx", "val")


def find_vals(v: DataFrame, keep: Unary) -> DataFrame:
    """The qualifying values, as a dense vector in the order of their indices."""
    return enumerate_sorted(find(v, keep).select(F.col("idx").alias("was"), "val"), ["was"]).select("idx", "val")


def select(v: DataFrame, dense: DataFrame, keep: Unary) -> DataFrame:
    """Entries of v whose dense counterpart passes."""
    return _pair(v, dense, "inner").where(keep(F.col("b"))).select("idx", F.col("a").alias("val"))


def select_apply(v: DataFrame, dense: DataFrame, keep: Unary, op: Binary) -> DataFrame:
    """As select, with op(value, dense value)."""
    return _pair(v, dense, "inner").where(keep(F.col("b"))).select("idx", op(F.col("a"), F.col("b")).alias("val"))


def filter_by_val(v: DataFrame, selector: DataFrame, f: Unary, by_index: bool) -> DataFrame:
    """v without the entries whose f(value) is an index (or value) of selector."""
    out = selector.select(F.col("idx" if by_index else "val").alias("gone")).distinct()
    return v.withColumn("key", f(F.col("val"))).join(out, F.col("key") == F.col("gone"), "left_anti").select("idx", "val")


def concatenate(vectors: list[tuple[DataFrame, int]]) -> DataFrame:
    """Vectors of given lengths, one after the other."""
    parts, at = [], 0
    for v, n in vectors:
        parts.append(v.select((F.col("idx") + at).alias("idx"), "val"))
        at += n
    return fold(DataFrame.unionByName, parts)


def ewise_mult(v: DataFrame, dense: DataFrame, exclude: bool = False, zero=0) -> DataFrame:
    """exclude: v where dense is zero; else v times dense where dense is not zero."""
    rows = _pair(v, dense, "inner")
    if exclude:
        return rows.where(F.col("b") == zero).select("idx", F.col("a").alias("val"))
    return rows.where(F.col("b") != zero).select("idx", (F.col("a") * F.col("b")).alias("val"))


def ewise_apply(v: DataFrame, w: DataFrame, op: Binary, pred: Binary | None = None, v_nulls: bool = False, w_nulls: bool = False, v_zero=None, w_zero=None, intersect: bool = True) -> DataFrame:
    """op on pairs; v_nulls lets v miss an index that w has (v_zero stands in), w_nulls the other way round.

    intersect=False drops the indices that both have: with one flag the set difference, with both the symmetric one.
    """
    how = {(False, False): "inner", (False, True): "left", (True, False): "right", (True, True): "full"}[v_nulls, w_nulls]
    rows = _pair(v, w, how)
    if not intersect:
        rows = rows.where(~(F.col("has_a") & F.col("has_b")))
    a, b = F.coalesce("a", F.lit(v_zero)), F.coalesce("b", F.lit(w_zero))
    rows = rows.select("idx", a.alias("a"), b.alias("b"))
    if pred is not None:
        rows = rows.where(pred(F.col("a"), F.col("b")))
    return rows.select("idx", op(F.col("a"), F.col("b")).alias("val"))


def ewise_update(dense: DataFrame, other: DataFrame, op: Binary, pred: Binary | None = None, apply_nulls: bool = False, null=None) -> DataFrame:
    """dense with op(own, other) where other has the index (apply_nulls: everywhere, null standing in) and pred holds."""
    rows = _pair(dense, other, "left")
    b = F.coalesce("b", F.lit(null)) if apply_nulls else F.col("b")
    use = F.lit(True) if apply_nulls else F.col("has_b")
    if pred is not None:
        use = use & F.coalesce(pred(F.col("a"), b), F.lit(False))
    return rows.select("idx", F.when(use, op(F.col("a"), b)).otherwise(F.col("a")).alias("val"))


def gather(v: DataFrame, at: DataFrame, default=0) -> DataFrame:
    """out[k] = v[at[k]]; default where v has no such index."""
    return at.select(F.col("idx").alias("k"), F.col("val").alias("want")).join(v, F.col("want") == F.col("idx"), "left").select(F.col("k").alias("idx"), F.coalesce("val", F.lit(default)).alias("val"))


def gget(v: DataFrame, dense: DataFrame, index: Binary, null=None) -> DataFrame:
    """For each entry of v the dense element at index(val, idx), null standing in."""
    return gather(dense, v.select("idx", index(F.col("val"), F.col("idx")).alias("val")), null)


def reduce(v: DataFrame, agg: Callable[[Column], Column], zero=None, unary: Unary | None = None) -> DataFrame:
    """One row val: agg of the values, zero for no rows."""
    x = F.col("val") if unary is None else unary(F.col("val"))
    return v.agg(agg(x).alias("val")).select(F.coalesce("val", F.lit(zero)).alias("val"))


def count(v: DataFrame, keep: Unary) -> DataFrame:
    return v.agg(F.count_if(keep(F.col("val"))).alias("n"))


def nnz(v: DataFrame) -> DataFrame:
    return v.agg(F.count(F.lit(1)).alias("n"))


def min_element(v: DataFrame) -> DataFrame:
    """(idx, val) of the least value, ties to the smallest index."""
    return v.agg(F.min(F.struct("val", "idx")).alias("m")).select("m.idx", "m.val")


def uniq(v: DataFrame) -> DataFrame:
    """One index, the smallest, per distinct value."""
    return v.groupBy("val").agg(F.min("idx").alias("idx")).select("idx", "val")


def add(v: DataFrame, w: DataFrame, sign: int = 1) -> DataFrame:
    """Union of indices, values added (sign -1: subtracted)."""
    return v.select("idx", "val").unionByName(w.select("idx", (F.col("val") * sign).alias("val"))).groupBy("idx").agg(F.sum("val").alias("val"))


def setminus(v: DataFrame, w: DataFrame) -> DataFrame:
    return v.join(w.select(F.col("idx").alias("gone")), F.col("idx") == F.col("gone"), "left_anti").select("idx", "val")


def equal(v: DataFrame, w: DataFrame) -> DataFrame:
    """One row same: whether both hold the same rows, counted."""
    keys = [c for c in v.columns]
    both = v.select(*keys, F.lit(1).alias("n")).unionByName(w.select(*keys, F.lit(-1).alias("n")))
    off = both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    return off.agg((F.count(F.lit(1)) == 0).alias("same"))


def invert(v: DataFrame, n: int | None = None, idx: Binary | None = None, val: Binary | None = None) -> DataFrame:
    """Index and value swapped, or both by functions of (val, idx); of equal new indices the smallest value stays."""
    i = F.col("val") if idx is None else idx(F.col("val"), F.col("idx"))
    x = F.col("idx") if val is None else val(F.col("val"), F.col("idx"))
    rows = v.select(i.alias("i"), x.alias("x"))
    if n is not None:
        rows = rows.where((F.col("i") >= 0) & (F.col("i") < n))
    return rows.groupBy(F.col("i").alias("idx")).agg(F.min("x").alias("val"))


def assign(dense: DataFrame, v: DataFrame) -> DataFrame:
    """dense overwritten where v has an entry."""
    return _pair(dense, v, "left").select("idx", F.coalesce("b", "a").alias("val"))


def scatter(dense: DataFrame, v: DataFrame, idx: Binary, val: Binary) -> DataFrame:
    """dense overwritten at idx(val, idx) by val(val, idx) of v's entries, ties to the smallest."""
    return assign(dense, invert(v, None, idx, val))


def set_element(v: DataFrame, idx: int, value) -> DataFrame:
    """v with one entry set; a driver-side convenience, not for loops."""
    new = v.sparkSession.range(1).select(F.lit(idx).cast("long").alias("idx"), F.lit(value).alias("val"))
    return v.where(F.col("idx") != idx).select("idx", "val").unionByName(new)


def get_element(v: DataFrame, idx: int) -> DataFrame:
    return v.where(F.col("idx") == idx).select("idx", "val")


def del_element(v: DataFrame, idx: int) -> DataFrame:
    return v.where(F.col("idx") != idx).select("idx", "val")


def sort(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values sorted, permutation): both dense in rank order, the permutation holding old indices; no single-task sort."""
    ranked = enumerate_sorted(v.select(F.col("idx").alias("was"), "val"), ["val", "was"])
    return ranked.select("idx", "val"), ranked.select("idx", F.col("was").alias("val"))


def top_k(v: DataFrame, k: int) -> DataFrame:
    """The k largest values, ties to the smallest index."""
    return v.orderBy(F.col("val").desc(), "idx").limit(k).select("idx", "val")


def random_permutation(v: DataFrame, seed: int) -> DataFrame:
    """Values in the order of a seeded hash of their index."""
    return enumerate_sorted(v.select(F.xxhash64(F.lit(seed), "idx").alias("h"), F.col("idx").alias("was"), "val"), ["h", "was"]).select("idx", "val")


def sample_roots(spark: SparkSession, n: int, k: int, seed: int = 1) -> DataFrame:
    """k indices of 0..n-1 by a seeded hash, distinct."""
    return spark.range(n).select(F.col("id").alias("val")).orderBy(F.xxhash64(F.lit(seed), "val"), "val").limit(k)


def exclusive_scan(v: DataFrame) -> DataFrame:
    """Sum of the values before each index, by partitions: each partition's total shifts the ones after it."""
    from meshwork.operators.relabel import with_offsets

    return with_offsets(v, ["idx"], F.sum("val"), "before", lambda w: F.coalesce(F.sum("val").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("idx", F.col("before").alias("val"))


def keyed_scan(df: DataFrame, key: str, order: str, value: str, agg: Callable = F.sum, exclusive: bool = False, name: str = "scan") -> DataFrame:
    """df plus the running aggregate (sum, min, max, ...) of value within key, in the order of order; exclusive: of the rows before."""
    rows = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumn(name, agg(value).over(rows))


def shifted(df: DataFrame, key: str, order: str, value: str, by: int = 1, name: str = "shifted") -> DataFrame:
    """df plus the value of the row that is `by` places on (negative: back) within key; null beyond the ends."""
    return df.withColumn(name, F.lead(value, by).over(W.partitionBy(key).orderBy(order)))


def runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, last, n) of each run of equal keys: a partially aggregated group-by, no sort."""
    return df.groupBy(key).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n"))
