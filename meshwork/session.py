"""Session settings that the engine relies on, and the one way it cuts lineage."""

from __future__ import annotations

import contextlib
import getpass
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "meshwork", **conf: str) -> SparkSession:
    """A local session for tests and bench.py; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local session that names none (tests) gets a folder of its own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file:///tmp/checkpoints/meshwork-{getpass.getuser()}"
    return at


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark resolves it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark reads it by: without a scheme, those of fs.defaultFS."""
    fs, p = _hadoop(spark, path)
    return re.sub(r"^file:/(?!/)", "file:///", fs.makeQualified(p).toString())


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the application ends."""
    own = f"{checkpoint_dir(spark).rstrip('/')}/meshwork-{spark.sparkContext.applicationId}"
    fs, p = _hadoop(spark, own)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return qualified(spark, f"{own}/{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, **marks: Column) -> DataFrame:
    """Compute now, keep the rows as Parquet in the shared folder, forget the plan and its size estimates.

    A lost executor costs no earlier round. marks are aggregates over the rows, taken while they are written; they
    come as a dict in the result's attribute marks.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "cut")
    seen = Observation() if marks else None
    (df.observe(seen, *(c.alias(k) for k, c in marks.items())) if seen else df).write.parquet(folder)
    kept = spark.read.schema(df.schema).parquet(folder)
    kept.folder, kept.marks = folder, seen.get if seen else {}
    return kept


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut, and the number of rows."""
    kept = cut(df, n=F.count(F.lit(1)))
    return kept, kept.marks["n"]


def release(*kept: DataFrame | None) -> None:
    """Delete what cut has written: nothing that is still to be computed may read it."""
    for df in kept:
        folder = getattr(df, "folder", None) if df is not None else None
        if folder:
            fs, p = _hadoop(df.sparkSession, folder)
            with contextlib.suppress(Exception):
                fs.delete(p, True)


class Growing:
    """A table that grows by parts, each a folder of one tree: all of it is one scan, however many parts there are."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.parts = spark, schema, []
        self.root = work_folder(spark, "growing")

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Write one more part; (the part, its rows)."""
        folder, seen = f"{self.root}/{len(self.parts):05d}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        self.parts.append(folder)
        return self.last(1), seen.get["n"]

    def last(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts[-n:])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.root)
