"""Definitions that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of words, without building them: word starts are what one replace leaves of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def settled(x: Column) -> Column:
    """x, computed where it is written: a filter above can't be pushed below it, which would copy all that x is made of
    into the filter and compute shared parts anew for each mention."""
    return F.when(F.spark_partition_id() >= 0, x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Parts of a column of texts that hold at most so many bytes, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, end - at)
        at = end
