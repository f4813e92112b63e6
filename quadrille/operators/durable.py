"""Tables and small files in shared folders, which lost executors don't take along."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs in one JVM, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quadrille-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df, written as Parquet to `folder` (a new one among the shared ones) and read back: cuts lineage in loops."""
    spark = df.sparkSession
    path = folder or f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not folder:
        out.__dict__["_written_at"] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete what cut() wrote to a folder of its own, once nothing reads it any more."""
    for df in tables:
        path = df.__dict__.get("_written_at") if df is not None else None
        if path:
            fs, p = _path(df.sparkSession, path)
            fs.delete(p, True)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    fs, p = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file under a name that mustn't exist, whole or not at all; False where the name is taken."""
    fs, p = _path(spark, path)
    try:
        if p.toUri().getScheme() not in ("file", "hdfs", "viewfs", None):  # an object store: a conditional put
            out = fs.create(p, False)
            out.write(bytearray(text.encode()))
            out.close()
            return True
        draft = _path(spark, f"{path}.{uuid.uuid4().hex}")[1]
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        won = not fs.exists(p) and fs.rename(draft, p)
        fs.delete(draft, False)
        return won
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
