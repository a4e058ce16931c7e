import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork.functions.hashing import mix64, unmix64, wrap_add, wrap_mul
from meshwork.operators.edges import _zeta, ks_statistic

LONGS = st.integers(-(2**63), 2**63 - 1)


def signed(x):
    x &= 2**64 - 1
    return x - 2**64 if x >> 63 else x


def mixed(k):
    mask = 2**64 - 1
    k &= mask
    k = (~k + (k << 21)) & mask
    for shift, factor in ((24, 265), (14, 21), (28, 2**31 + 1)):
        k ^= k >> shift
        k = k * factor & mask
    return signed(k)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(LONGS, LONGS), min_size=50, max_size=50))
def test_wrapping_arithmetic_and_mix(spark, pairs):
    df = spark.createDataFrame([*pairs, (0, 0), (-1, 1), (2**63 - 1, 1), (-(2**63), -(2**63)), (5, 9223367638806167546)], "a long, b long")
    c = 0xD6E8FEB86659FD93
    rows = df.select("a", "b", wrap_add(F.col("a"), F.col("b")).alias("s"), wrap_mul(F.col("a"), c, 3).alias("p"), mix64(F.col("a")).alias("h"), unmix64(mix64(F.col("a"))).alias("back")).collect()
    for r in rows:
        assert r.s == signed(r.a + r.b) and r.p == signed(r.a * c + 3) and r.h == mixed(r.a) and r.back == r.a


def test_power_law_fit_tells_laws_apart():
    assert abs(_zeta(2.0, np.array([1.0]))[0] - np.pi**2 / 6) < 1e-9
    rng = np.random.default_rng(1)
    law = np.floor((1 - rng.random(20000)) ** (-1 / 1.5) + 0.5).astype(int)
    flat = rng.integers(50, 100, 20000)
    d_law, alpha, _ = ks_statistic(*np.unique(law, return_counts=True))
    d_flat, *_ = ks_statistic(*np.unique(flat, return_counts=True))
    assert d_law < 0.02 and abs(alpha - 2.5) < 0.2 and d_flat > d_law
