"""Invertible 64-bit mixing of ids as column expressions: wrapping arithmetic that holds in ANSI mode too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF


def wrap_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, by halves: no sum exceeds 34 bits before it is shifted back."""
    low = a.bitwiseAND(F.lit(LOW)) + b.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def wrap_mul(a: Column, by: int, plus: int = 0) -> Column:
    """a * by + plus modulo 2^64 (plus small), by limbs of 16 bits: no sum exceeds 36 bits, each limb's sum is used twice."""
    limb = [F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    s = [F.lit(plus if k == 0 else 0).cast("long") for k in range(4)]
    for i in range(4):
        for j in range(4 - i):
            if c := by >> 16 * j & 0xFFFF:
                s[i + j] = s[i + j] + limb[i] * F.lit(c).cast("long")
    low = s[0] + F.shiftleft(s[1].bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(low, 32) + F.shiftright(s[1], 16) + s[2] + F.shiftleft(s[3].bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def _xor_shift(x: Column, by: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, by))


def _undo_xor_shift(x: Column, by: int) -> Column:
    return reduce(lambda a, k: a.bitwiseXOR(F.shiftrightunsigned(x, k)), range(by, 64, by), x)


#: Fixed values of the 64-bit mix: factors (of x, then add ADD once after the first) and the xor-shift after each.
FACTORS, SHIFTS, ADD = (2**21 - 1, 265, 21, 2**31 + 1), (24, 14, 28, None), -1


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _times(factor: int, plus: int = 0):
    return lambda v: wrap_mul(v, factor, plus)


def _shift(by: int):
    return lambda v: _xor_shift(v, by)


def _undo_shift(by: int):
    return lambda v: _undo_xor_shift(v, by)


def mix64(x: Column) -> Column:
    """A bijection of longs; shifts are logical, so that no two ids collide."""
    x = x.cast("long")
    for k, (factor, shift) in enumerate(zip(FACTORS, SHIFTS, strict=True)):
        x = _let(x, _times(factor, ADD if k == 0 else 0))
        x = _let(x, _shift(shift)) if shift else x
    return x


def unmix64(x: Column) -> Column:
    """The inverse of mix64."""
    x = x.cast("long")
    for k, (factor, shift) in reversed(list(enumerate(zip(FACTORS, SHIFTS, strict=True)))):
        x = _let(x, _undo_shift(shift)) if shift else x
        x = _let(x, lambda v: wrap_add(v, F.lit(-ADD).cast("long"))) if k == 0 else x
        x = _let(x, _times(pow(factor, -1, 1 << 64)))
    return x


def permute_ids(edges: DataFrame) -> DataFrame:
    """Both ends of each edge mixed."""
    return edges.select(mix64(F.col("src")).alias("src"), mix64(F.col("dst")).alias("dst"))
