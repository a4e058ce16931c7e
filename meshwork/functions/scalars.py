"""The scalar function library of the algebra: unary and binary operations on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_to(value):
    return lambda x: F.lit(value)


def identity(x: Column) -> Column:
    return x


def totality(x: Column) -> Column:
    return F.lit(True)


def safe_inverse(x: Column) -> Column:
    """1 / x, infinity where x is 0."""
    return F.when(x == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.nullif(x, F.lit(0)))


def exponentiate(power: float):
    return lambda x: F.pow(x, F.lit(power))


def second(a: Column, b: Column) -> Column:
    return b


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def plus(a: Column, b: Column) -> Column:
    return a + b


def minus(a: Column, b: Column) -> Column:
    return a - b


def times(a: Column, b: Column) -> Column:
    return a * b


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def logical_xor(a: Column, b: Column) -> Column:
    return a.cast("boolean") != b.cast("boolean")


def set_if_not_equal(value, sentinel):
    """value where x differs from sentinel, else x."""
    return lambda x: F.when(x != F.lit(sentinel), F.lit(value)).otherwise(x)


def pick(seed: int, a: Column, b: Column) -> Column:
    """One of a and b, by a seeded hash of both: the same on every run."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(2)) == 0, a).otherwise(b)
