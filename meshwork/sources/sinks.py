"""Writers. Text goes through Spark's own committers; binary parts are written under the names of successful tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.relabel import enumerate_sorted
from meshwork.session import cut, qualified
from meshwork.sources.readers import ATTRIBUTED, HEADER, MAGIC


def _parts(df: DataFrame, folder: str, dtype: np.dtype) -> list[str]:
    """One .bin file of packed records per task; files of lost attempts are deleted by the manifest of successful ones."""
    folder = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        out, n = None, 0
        for b in batches:
            if b.num_rows:
                out = out or store.open_output_stream(name)
                rows = np.empty(b.num_rows, dtype)
                for i, f in enumerate(dtype.names):
                    rows[f] = b.column(i).to_numpy(zero_copy_only=False)
                out.write(rows.tobytes())
                n += b.num_rows
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "n"])

    done = {r.path for r in cut(df.mapInArrow(run, "path string, n long")).collect()}
    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(base).type == fs.FileType.Directory:
        for x in store.get_file_info(fs.FileSelector(base)):
            if x.path.endswith(".bin") and x.path not in done:
                store.delete_file(x.path)
    return sorted(done)


def write_binary(edges: DataFrame, path: str, bits: int = 64) -> list[str]:
    """Edges with src < dst as pairs of unsigned integers of 64 or 32 bits, a file per task; ids must fit."""
    rows = edges.where("src < dst").select("src", "dst")
    if bits < 64:
        fits = (F.col("src") >= 0) & (F.col("dst") < 1 << bits)
        rows = rows.select(F.when(fits, F.col("src")).otherwise(F.raise_error(F.lit(f"an id needs more than {bits} bits"))).alias("src"), "dst")
    return _parts(rows, path, np.dtype([("s", f"<u{bits // 8}"), ("d", f"<u{bits // 8}")]))


def write_attributed_binary(edges: DataFrame, path: str) -> list[str]:
    """(src, dst, follower, count, latest) as packed records, a file per task; without latest the seconds are 0."""
    rows = edges.select("src", "dst", F.coalesce(F.unix_timestamp("latest"), F.lit(0)).cast("long"), F.col("count").cast("long"), F.col("follower").cast("int").cast("long"))
    return _parts(rows, path, ATTRIBUTED)


def write_text(edges: DataFrame, path: str, single: bool = True) -> None:
    """`src dst` lines; single: in one file, which one task writes."""
    rows = edges.select(F.concat_ws(" ", "src", "dst").alias("value"))
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


def _lines(rows: DataFrame, keys: list[str], path: str, single: bool) -> None:
    """The column value in the order of keys: sorted by range partitions, in one file or in one for each, in the order of their names."""
    ordered = rows.orderBy(*keys).select("value")
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").text(path)


def write_dot(edges: DataFrame, path: str, single: bool = True) -> None:
    """An undirected Graphviz graph of the edges with src < dst, in order; single: in one file, which one task writes."""
    spark = edges.sparkSession
    body = edges.where("src < dst").select(F.lit(1).alias("k"), "src", "dst", F.concat(F.col("src").cast("string"), F.lit(" -- "), F.col("dst").cast("string"), F.lit(";")).alias("value"))
    ends = spark.createDataFrame([(0, None, None, "graph G {"), (2, None, None, "}")], "k int, src long, dst long, value string")
    _lines(body.unionAll(ends), ["k", "src", "dst"], path, single)


def write_matrix_market(a: DataFrame, path: str, nrows: int, ncols: int, field: str = "real", single: bool = True) -> None:
    """Banner, sizes and 1-based entries in (row, col) order; single: in one file, which one task writes."""
    spark = a.sparkSession
    nnz = a.count()
    head = spark.createDataFrame([(0, None, None, f"%%MatrixMarket matrix coordinate {field} general"), (1, None, None, f"{nrows} {ncols} {nnz}")], "k int, r long, c long, value string")
    text = [F.col("row") + 1, F.col("col") + 1] + ([] if field == "pattern" else [F.col("val")])
    body = a.select(F.lit(2).alias("k"), F.col("row").alias("r"), F.col("col").alias("c"), F.concat_ws(" ", *text).alias("value"))
    _lines(head.unionAll(body), ["k", "r", "c"], path, single)


def write_binary_matrix(a: DataFrame, path: str, nrows: int, ncols: int) -> None:
    """A headed binary file: tasks write parts, which are then joined by streaming copies in order."""
    spark, kind = a.sparkSession, np.dtype([("r", "<i8"), ("c", "<i8"), ("v", "<f8")])
    a = cut(a.select("row", "col", F.col("val").cast("double").alias("val")))
    parts = _parts(a, path + ".parts", kind)
    store, base = fs.FileSystem.from_uri(qualified(spark, path))
    with store.open_output_stream(base) as out:
        out.write(HEADER.pack(MAGIC, 1, kind.itemsize, 1, nrows, ncols, a.count()))
        for p in parts:
            with store.open_input_stream(p) as part:
                while data := part.read(8 << 20):
                    out.write(data)
    store.delete_dir(base + ".parts")


def write_vector(v: DataFrame, path: str) -> None:
    """1-based `idx val` lines in order of idx."""
    v.select("idx", "val").orderBy("idx").select(F.concat_ws(" ", F.col("idx") + 1, F.col("val")).alias("value")).write.mode("overwrite").text(path)


def write_binary_vector(v: DataFrame, path: str) -> list[str]:
    """Records of a 64-bit index and a double, a file per task."""
    return _parts(v.select("idx", F.col("val").cast("double").alias("val")), path, np.dtype([("i", "<i8"), ("v", "<f8")]))


def write_hypergraph(a: DataFrame, path: str, nrows: int, ncols: int, single: bool = True) -> None:
    """Rows as nets, for partitioners: a head line `0 cells nets pins`, then the columns of each row, in order."""
    spark = a.sparkSession
    head = spark.createDataFrame([(-1, f"0 {ncols} {nrows} {a.count()}")], "r long, value string")
    nets = a.groupBy(F.col("row").alias("r")).agg(F.concat_ws(" ", F.sort_array(F.collect_list("col"))).alias("value"))
    _lines(head.unionAll(nets), ["r"], path, single)


def describe(a: DataFrame) -> DataFrame:
    """Rows, partitions and the spread of rows over them, for a look at what is there."""
    per = a.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("parts"), F.min("n").alias("least"), F.max("n").alias("most"))


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with their place in (src, dst) order, equal ones next to each other."""
    return enumerate_sorted(edges.withColumn("nth", F.monotonically_increasing_id()), ["src", "dst", "nth"], "place").select("place", "src", "dst")
