"""Readers: text and binary edge lists, matrices, vectors, attributed edges, de Bruijn graphs of sequencing reads."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators import kmers
from meshwork.operators.components import symmetrise
from meshwork.session import qualified

#: Bytes of a binary file that a task reads at once.
CHUNK = 8 << 20


def read_edge_list(spark: SparkSession, path: str, add_reverse: bool = True, strict: bool = True) -> DataFrame:
    """Lines `u v`. strict: exactly one space between two integers, anything else is no edge. Else any white space
    separates, and what follows the second integer (a weight) is ignored. Lines that start with % are comments."""
    line = F.col("value")
    clean = F.regexp_replace(line, r"\r$", "")
    pattern = r"^(-?\d+) (-?\d+)$" if strict else r"^\s*(-?\d+)\s+(-?\d+)(?:\s.*)?$"
    text = F.col("t")
    rows = spark.read.text(path).select(clean.alias("t")).where(~text.startswith("%") & text.rlike(pattern))
    end = lambda k: F.regexp_extract(text, pattern, k).try_cast("long")
    edges = rows.select(end(1).alias("src"), end(2).alias("dst")).where("src is not null and dst is not null")
    return symmetrise(edges) if add_reverse else edges


def _triples(spark: SparkSession, path: str, pattern: bool, parse: Callable[[Column], Column] | None) -> DataFrame:
    """(row, col, val, n_fields, header rows included) of the lines that are no comment."""
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).select(part.alias("f"))
    value = F.lit(1.0) if pattern else (parse(F.slice("f", F.lit(3), F.size("f"))) if parse else F.get("f", F.lit(2)).try_cast("double"))
    return rows.select(F.get("f", F.lit(0)).try_cast("long").alias("row"), F.get("f", F.lit(1)).try_cast("long").alias("col"), value.alias("val"), F.col("f"))


def _header(spark: SparkSession, path: str) -> tuple[str, tuple[int, int, int]]:
    """(banner or '', (rows, columns, entries)): the first two lines that are no comment, however many comments there are."""
    banner, sizes = "", None
    told = F.col("value").startswith("%%MatrixMarket") | ~F.col("value").startswith("%")
    for r in spark.read.text(path).where("length(trim(value)) > 0").where(told).limit(2).collect():
        line = r[0].strip()
        if line.startswith("%%MatrixMarket"):
            banner = line
        elif sizes is None:
            sizes = tuple(int(x) for x in line.split()[:3])
    if sizes is None or len(sizes) < 3:
        raise ValueError(f"{path} has no header of sizes")
    return banner, sizes


def _body(rows: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """Without one line equal to the header: (m, n, nnz) can't be an entry unless it is in range, and then counts once less."""
    m, n, nnz = sizes
    head = (F.size("f") == 3) & (F.col("row") == m) & (F.col("col") == n) & (F.get("f", F.lit(2)) == str(nnz))
    kept = rows.where(~head)
    extra = rows.where(head).groupBy("row", "col", "val").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("row", "col", "val", F.explode(F.array_repeat(F.lit(1), F.col("k").cast("int") - 1)).alias("one"))
    return kept.select("row", "col", "val").unionAll(extra.select("row", "col", "val"))


def read_triples(spark: SparkSession, path: str, no_num: bool = False, transpose: bool = False, parse: Callable[[Column], Column] | None = None) -> tuple[DataFrame, int, int]:
    """(matrix, rows, columns) of `m n nnz` and 1-based `row col [val]` lines; parse makes a value of the fields after the first two."""
    _, sizes = _header(spark, path)
    rows = _body(_triples(spark, path, no_num, parse), sizes)
    r, c = F.col("row") - 1, F.col("col") - 1
    r, c = (c, r) if transpose else (r, c)
    return rows.select(r.alias("row"), c.alias("col"), "val"), *(sizes[:2] if not transpose else sizes[1::-1])


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(matrix, rows, columns): real, integer or pattern; symmetric ones are mirrored; equal places are summed."""
    banner, sizes = _header(spark, path)
    kind = banner.lower().split()
    if not banner or "coordinate" not in kind:
        raise ValueError(f"{path} has no coordinate banner")
    rows = _body(_triples(spark, path, "pattern" in kind, None), sizes)
    rows = rows.select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "val")
    if "symmetric" in kind:
        rows = rows.unionAll(rows.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    a = rows.groupBy("row", "col").agg(F.sum("val").alias("val"))
    if "integer" in kind or "pattern" in kind:
        a = a.select("row", "col", F.col("val").cast("long").alias("val"))
    return a, sizes[0], sizes[1]


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(idx, val) of 1-based `idx val` lines after a `n [nnz]` header line marked by %%, or without one."""
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).select(part.alias("f")).where(F.size("f") == 2)
    return rows.select((F.get("f", F.lit(0)).try_cast("long") - 1).alias("idx"), F.get("f", F.lit(1)).try_cast("double").alias("val"))


def _ranges(spark: SparkSession, path: str, record: int, skip: int, schema: str, decode: Callable[[np.ndarray], list[np.ndarray]], dtype: np.dtype) -> DataFrame:
    """Fixed records of one file, read by byte ranges of about CHUNK: tasks share no state and hold one range."""
    path = qualified(spark, path)
    store, base = fs.FileSystem.from_uri(path)
    size = store.get_file_info(base).size - skip
    if size % record:
        raise ValueError(f"{path} doesn't hold whole records")
    step = max(CHUNK // record, 1)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                own, at = fs.FileSystem.from_uri(path)
                with own.open_input_file(at) as f:
                    f.seek(skip + k * step * record)
                    data = f.read(min(step, size // record - k * step) * record)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in decode(np.frombuffer(data, dtype))], names)

    return spark.range(-(-(size // record) // step)).mapInArrow(run, schema)


def _binary_parts(spark: SparkSession, path: str, kind: np.dtype, schema: str, decode: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Fixed records of a file, or of all .bin files of a folder."""
    path = qualified(spark, path)
    store, base = fs.FileSystem.from_uri(path)
    root = path.removesuffix(base)
    info = store.get_file_info(base)
    files = [path] if info.type == fs.FileType.File else []
    if info.type == fs.FileType.Directory:
        files = sorted(root + x.path for x in store.get_file_info(fs.FileSelector(base)) if x.path.endswith(".bin"))
    out = spark.createDataFrame([], schema)
    for f in files:
        out = out.unionAll(_ranges(spark, f, kind.itemsize, 0, schema, decode, kind))
    return out


def read_binary_edges(spark: SparkSession, path: str, bits: int = 64) -> DataFrame:
    """Pairs of little-endian unsigned integers of 32 or 64 bits; path is a file or a folder of .bin files."""
    kind = np.dtype([("s", f"<u{bits // 8}"), ("d", f"<u{bits // 8}")])
    return _binary_parts(spark, path, kind, "src long, dst long", lambda x: [x["s"].astype(np.int64), x["d"].astype(np.int64)])


def read_binary_vector(spark: SparkSession, path: str) -> DataFrame:
    """(idx, val) of records of a 64-bit index, 0-based, and a double; path is a file or a folder of .bin files."""
    kind = np.dtype([("i", "<i8"), ("v", "<f8")])
    return _binary_parts(spark, path, kind, "idx long, val double", lambda x: [x["i"], x["v"]])


#: Fixed values of the binary matrix header: magic, then version, object size, format, rows, columns, entries.
MAGIC, HEADER = b"HKDT", struct.Struct("<4s6Q")


def read_binary_matrix(spark: SparkSession, path: str, value: str = "<f8") -> tuple[DataFrame, int, int]:
    """(matrix, rows, columns) of a headed file of (row, col, val) records with 64-bit indices."""
    path = qualified(spark, path)
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(base) as f:
        magic, _, size, _, m, n, nnz = HEADER.unpack(f.read(HEADER.size))
    kind = np.dtype([("r", "<i8"), ("c", "<i8"), ("v", value)])
    if magic != MAGIC or size != kind.itemsize:
        raise ValueError(f"{path} is no such matrix")
    sql = "double" if np.dtype(value).kind == "f" else "long"
    return _ranges(spark, path, kind.itemsize, HEADER.size, f"row long, col long, val {sql}", lambda x: [x["r"], x["c"], x["v"].astype(np.float64 if sql == "double" else np.int64)], kind), m, n


def read_attributed_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, follower, count, latest) of `from to follow count [date time]` lines after an `m n nnz` header, 1-based."""
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)).select(part.alias("f")).where(F.size("f") >= 4)
    at = lambda k: F.get("f", F.lit(k))
    when = F.try_to_timestamp(F.concat_ws(" ", at(4), at(5)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return rows.select((at(0).try_cast("long") - 1).alias("src"), (at(1).try_cast("long") - 1).alias("dst"), (at(2) != "0").alias("follower"), at(3).try_cast("short").alias("count"), F.when(at(3).try_cast("short") > 0, when).alias("latest")).where("src is not null and dst is not null")


#: A packed attributed edge.
ATTRIBUTED = np.dtype([("s", "<i8"), ("d", "<i8"), ("t", "<i8"), ("c", "<i2"), ("f", "u1")])


def read_attributed_binary(spark: SparkSession, path: str) -> DataFrame:
    """The same columns of packed records: two 64-bit ids, 64-bit seconds, 16-bit count, a byte for follower; a file or a folder of .bin files."""
    raw = _binary_parts(spark, path, ATTRIBUTED, "src long, dst long, at long, count long, follower long", lambda x: [x["s"], x["d"], x["t"], x["c"].astype(np.int64), x["f"].astype(np.int64)])
    return raw.select("src", "dst", (F.col("follower") != 0).alias("follower"), F.col("count").cast("short").alias("count"), F.when(F.col("count") > 0, F.timestamp_seconds("at")).alias("latest"))


def kmer_edges(reads: DataFrame, k: int = 31) -> DataFrame:
    """Both directions of an edge for each two successive k-mers of reads (seq); a vertex is the packed canonical k-mer.

    Canonical is the lesser of a k-mer and its reverse complement; A, C, G, T pack as 0..3, two bits each, which fits a
    long up to k = 31. Windows with any other letter make no k-mer.
    """
    return kmers.edges(reads, k)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(seq) of FASTQ reads. A record's sequence is the line between its @ line and its + line.

    Records are taken whole by splitting the file at '\\n@' line starts whose second next line starts with '+'; a file is
    one row group per split of Spark's reader, so that records never straddle tasks.
    """
    lines = spark.read.option("lineSep", "\n@").text(path)
    body = F.split(F.regexp_replace("value", "\r", ""), "\n")
    # a quality line that starts with @ splits a record too: its piece has no '+' line in place and is dropped
    rows = lines.select(body.alias("b")).where((F.size("b") >= 3) & F.get("b", F.lit(2)).startswith("+"))
    return rows.select(F.get("b", F.lit(1)).alias("seq"))


def read_fastq_debruijn(spark: SparkSession, path: str, k: int = 31) -> DataFrame:
    """The de Bruijn graph of FASTQ reads (read_fastq) as edges."""
    return kmer_edges(read_fastq(spark, path), k)
