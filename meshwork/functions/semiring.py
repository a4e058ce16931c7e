"""Semirings: a multiply of two columns and an aggregate that adds; the aggregate combines on the map side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """add(mul(a, b)); zero is what rows without entries get in a dense result."""

    name: str
    mul: Callable[[Column, Column], Column]
    add: Callable[[Column], Column]
    zero: object
    #: Whether the contribution of the largest inner index counts, whatever add says.
    last: bool = False

    def total(self, product: Column, inner: Column) -> Column:
        """The aggregate of products that come with their inner index."""
        return F.max_by(product, F.struct(inner, product)) if self.last else self.add(product)


def saturating_add(a: Column, b: Column) -> Column:
    """a + b; where that overflows, the largest or smallest long, which no further sum leaves."""
    top, low = (1 << 63) - 1, -(1 << 63)
    bound = F.when(F.greatest(a, b) > 0, F.lit(top)).otherwise(F.lit(low))
    whole = F.when((a == F.lit(top)) | (b == F.lit(top)), F.lit(top)).otherwise(F.coalesce(F.try_add(a, b), bound))
    return F.when(a.isNotNull() & b.isNotNull(), whole)


PLUS_TIMES = Semiring("plus_times", lambda a, b: a * b, F.sum, 0)
MIN_PLUS = Semiring("min_plus", saturating_add, F.min, None)
MAX_TIMES = Semiring("max_times", lambda a, b: a * b, F.max, None)
SELECT_MAX = Semiring("select_max", lambda a, b: b, F.max, None)
#: The order in which contributions arrive is no property of a DataFrame: "the last" is that of the largest inner index.
SELECT_SECOND = Semiring("select_second", lambda a, b: b, F.max, None, last=True)
SELECT_MIN = Semiring("select_min", lambda a, b: b, F.min, None)
COUNT = Semiring("count", lambda a, b: F.lit(1), F.count, 0)
OR_AND = Semiring("or_and", lambda a, b: a.cast("boolean") & b.cast("boolean"), F.bool_or, False)
COPY_FIRST = Semiring("copy_first", lambda a, b: a, F.min, None)
COPY_SECOND = Semiring("copy_second", lambda a, b: b, F.min, None)


def select_random(seed: int) -> Semiring:
    """One contribution by a seeded hash."""
    return Semiring("select_random", lambda a, b: b, lambda v: F.min_by(v, F.xxhash64(F.lit(seed), v)), None)


def filtered(base: Semiring, keep: Callable[[Column], Column]) -> Semiring:
    """Multiplies to null, which no aggregate counts, where the matrix entry fails keep."""
    return Semiring(f"filtered_{base.name}", lambda a, b: F.when(keep(a), base.mul(a, b)), base.add, base.zero)
