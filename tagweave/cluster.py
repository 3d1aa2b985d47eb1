"""Small helpers for running on a cluster."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.errors import CurationError

BROADCAST_ROWS = 1_000_000


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side proven to hold at most ``max_rows`` rows.

    Counting stops one row past the bound. A larger side is returned without a
    hint, so the join falls back to a shuffle.
    """
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side


def spread(frame: DataFrame) -> DataFrame:
    """Rows over all cores when the input arrives in fewer splits than that.

    Large inputs have more splits than cores and are returned as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions of the session, by their keys.

    Adaptive execution joins partitions by their compressed size, and names that resemble each other take ten times as much
    memory as that. A stated number of partitions is left alone.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise CurationError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return frame.checkpoint()


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise CurationError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-work-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The rows written once below :func:`work_folder` and read back, for results that are both checked and handed on.

    A checkpoint computes its last stage twice. The files stay for as long as the folder is kept.
    """
    folder = work_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def constant_rows(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Fixed lookup table as an in-plan relation; whole numbers come out as longs.

    The values travel as Arrow data, never as SQL text, so no value is read as anything but itself.
    """
    values = list(zip(*rows)) or [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(column) for column in values], names=columns))
