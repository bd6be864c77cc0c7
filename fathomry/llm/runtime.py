"""Shared plumbing: the cluster's shared folder, written intermediate tables, shipping this package to workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may hold this many rows, in files of this many bytes, at most; beyond it the plain (shuffled) join is used.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20

#: A written table doesn't need the shuffles it came from; without this they stay until the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}
_roots: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="fathomry-")
            atexit.register(shutil.rmtree, _own_dir[app], True)
        base = "file://" + _own_dir[app]
    return f"{base.rstrip('/')}/fathomry-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    """Remove what this application wrote in the shared folder, if it ends with its session still there."""
    for spark, root in _roots:
        try:
            drop_path(spark, root)
        except Exception:  # the session was stopped before
            return


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        _roots.append((spark, self.root))

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        drop_path(self.spark, df._scratch_path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    fd, at = tempfile.mkstemp(prefix="fathomry-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((root / "fathomry").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(at)  # the driver serves it; executors fetch their own copy
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan so small that it has fewer partitions than the cluster has cores; larger scans stay as they are. Runs no job."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores << 22 else df


def small(spark: SparkSession, written: DataFrame) -> bool:
    """Whether a written table is small enough to be broadcast: its rows are counted, its files' bytes summed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written._scratch_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return size <= BROADCAST_BYTES and written.count() <= BROADCAST_ROWS


def semi(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Join with a written key table: broadcast while that is small, shuffled beyond that."""
    return df.join(F.broadcast(keys) if small(df.sparkSession, keys) else keys, on, how)


def source_folder(docs: DataFrame, scratch: Scratch) -> str:
    """The path of an unchanged Parquet scan of one file or of all files of one folder; anything else is written first."""
    plan = docs._jdf.queryExecution().analyzed()
    files = docs.inputFiles() if plan.getClass().getSimpleName() == "LogicalRelation" else []
    folders = {f.rsplit("/", 1)[0] for f in files}
    if len(files) == 1:
        return files[0]
    if len(folders) == 1 and set(docs.sparkSession.read.schema(docs.schema).parquet(folder := folders.pop()).inputFiles()) == set(files):
        return folder
    return scratch.write(docs, "docs")._scratch_path


def identity(scan: DataFrame) -> Column:
    """What tells a row of a scan from all others, ordered by doc_id, nulls last, then by file and row."""
    at = scan.metadataColumn("_metadata")
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), at["file_path"].alias("file"), at["row_index"].alias("row"))


IDENTITY = "struct<no_id:boolean,doc_id:long,file:string,row:long>"


def numbered(df: DataFrame, by: str, name: str, scratch: Scratch) -> DataFrame:
    """The rows with their places in the order of a column that is unique, from 0 on without gaps."""
    sorted_ = df.orderBy(by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = scratch.write(sorted_, "sorted")
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low")).orderBy("_part").collect()  # a row a partition
    shifts, so_far = [], 0
    for r in sizes:
        shifts.append((r["_part"], so_far - r["low"]))
        so_far += r["n"]
    # Columns, not rows: rows would go through Python workers of another kind, with a daemon that stays in every executor.
    shift = pa.table({"_part": pa.array([p for p, _ in shifts], pa.int32()), "_shift": pa.array([s for _, s in shifts], pa.int64())})
    shift = df.sparkSession.createDataFrame(shift)
    return sorted_.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def without(spark: SparkSession, docs: DataFrame, path: str, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of the scan of path whose (file, row) isn't in gone, with the columns of docs."""
    names = [f"{c}_{uuid.uuid4().hex}" for c in ("file", "row")]
    gone = scratch.write(gone.toDF(*names), "gone")
    scan = spark.read.parquet(path)
    at = scan.metadataColumn("_metadata")
    located = scan.select("*", at["file_path"].alias(names[0]), at["row_index"].alias(names[1]))
    return semi(located, gone, names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
