"""Session helpers shared by the operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names. Only a local master may do without: it gets a
    temporary folder, as all its tasks share the machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="memspark-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage into reliable storage, so that later rounds survive the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared checkpoint folder that nothing else uses."""
    return f"{checkpoint_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete what was written to ``path`` when the driver's file system closes."""
    fs, jvm_path = _file_system(spark, path)
    fs.deleteOnExit(jvm_path)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back, so that later jobs neither recompute it nor
    depend on executors that may be lost. The folder goes with ``drop``, or when the driver's file system closes."""
    spark = df.sparkSession
    path = shared_path(spark, "stored")
    df.write.option("compression", compression).parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Bytes of a stored table from which the driver is asked for the shuffle files that nothing reads any more.
TIDY_FROM = 8 << 20


def stored_bytes(table: DataFrame) -> int:
    """Bytes on disk of a table that ``stored`` returned."""
    fs, path = _file_system(table.sparkSession, table.stored_at)
    return fs.getContentSummary(path).getLength()


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and that no later step reads."""
    size = 0
    for table in tables:
        size += stored_bytes(table)
        fs, path = _file_system(table.sparkSession, table.stored_at)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
    if tables and size >= TIDY_FROM:
        tidy(tables[0].sparkSession)


def delete_files(spark: SparkSession, path: str) -> None:
    """Delete the files of a folder that are done with; the folder stays."""
    fs, jvm_path = _file_system(spark, path)
    for entry in fs.listStatus(jvm_path):
        if entry.isFile():
            fs.delete(entry.getPath(), False)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver collects the steps' objects, which a
    driver with much free memory seldom does by itself."""
    spark.sparkContext._jvm.System.gc()


def in_rounds(n_bytes: float, most: float) -> int:
    """Rounds in which a step is done that would shuffle ``n_bytes`` at once, ``most`` bytes in each."""
    return max(1, math.ceil(n_bytes / most))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark for broadcast only after counting, and only up to ``max_rows`` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
