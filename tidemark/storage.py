"""The folder that driver and executors share, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of pairs of numbers that one partition holds with ease, and that may be broadcast.
FEW = 100_000


#: MB of an Arrow batch: texts and blocks are long, and a worker holds a batch with what it makes of it.
BATCH = 2


def narrow(spark: SparkSession) -> None:
    """Let the session's Arrow batches have at most BATCH MB, whatever their rows, so that a Python worker's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}m")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only where all
    is one machine's (tests); a cluster must name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder and context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df cut and in as many partitions as its rows need, and their number: steps over few rows are then few tasks."""
    kept = cut(df)
    n = kept.count()
    return kept.coalesce(max(1, -(-n // FEW))), n


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if its counted rows are few; joined as Spark sees fit otherwise."""
    return F.broadcast(df) if rows <= FEW else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: for wide rows, of which later steps read a few columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of finished steps: shuffle files stay on the executors' disks until the driver collects its garbage, which a
    loop of many small steps may not bring about."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
