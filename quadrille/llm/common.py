"""Shared plumbing: the shared folder, durable checkpoints, distributed prefix sums, shipping this package."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(top)}_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one if all runs in
    one JVM, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(base)
        return base.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quadrille-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, Path class) of a path, through Spark's own Hadoop client, so that any store works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def drop(*tables: DataFrame | None) -> None:
    """Delete what materialise() wrote, once nothing reads it any more; other DataFrames are left alone."""
    for df in tables:
        path = df.__dict__.get("_written_at") if df is not None else None
        if path:
            fs, path_of = hadoop_fs(df.sparkSession, path)
            fs.delete(path_of(path), True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most `rows` rows, which are whole texts here, for what runs inside; then as they were."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(own) <= 0 else min(int(own), rows)))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialise(df: DataFrame, name: str, compression: str | None = None, level: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    writer = df.write.option("compression", compression) if compression else df.write
    writer = writer.option("parquet.compression.codec.zstd.level", level) if level else writer
    with small_batches(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    return out


def read_columns(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
    """The named columns of a table; other columns, also clashing ones, are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def size_in_bytes(df: DataFrame) -> int:
    """What the optimiser knows of df's size (that of its files, by the share of the columns read); 0 where it knows nothing."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches, rows: int = 512):
    """Arrow batches in views of at most `rows` rows: as Python objects, whole texts take several times their bytes."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def strings(column) -> list[str]:
    """An Arrow column of texts; null is empty."""
    return [t or "" for t in column.to_pylist()]


def prefix_sums(df: DataFrame, key: str, values: list[str], within: list[str] = (), block: int = 1024) -> DataFrame:
    """Exclusive running sums of `values` in the order of the integer `key` (unique per `within` group).

    Two levels: windows over blocks of `block` neighbouring keys run in parallel, and only one row per block goes to
    the window over blocks. Adds columns named <value>_before.
    """
    df = df.withColumn("_block", F.floor(F.col(key) / F.lit(block)).cast("long"))
    inner = Window.partitionBy(*within, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*within, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    totals = totals.select(*within, "_block", *[F.coalesce(F.sum(f"_{v}").over(outer), F.lit(0)).alias(f"_{v}_outer") for v in values])
    out = df.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_{v}_inner") for v in values])
    out = out.join(totals, [*within, "_block"])
    for v in values:
        out = out.withColumn(f"{v}_before", (F.col(f"_{v}_inner") + F.col(f"_{v}_outer")).cast("long"))
    return out.drop("_block", *[f"_{v}_inner" for v in values], *[f"_{v}_outer" for v in values])


_WORKER: dict[str, object] = {}


def trim() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: its allocator decides
        pass


def worker_cache(name: str, make):
    """What a Python worker keeps between tasks, one operator's at a time: Spark reuses workers from stage to stage, and
    what an earlier stage kept would add up."""
    if name not in _WORKER:
        if _WORKER:
            _WORKER.clear()
            trim()
        _WORKER[name] = make()
    return _WORKER[name]
