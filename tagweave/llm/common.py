"""Helpers that the operators share: words, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.errors import CurationError

#: A word is a run of characters that are neither space nor U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


#: Bytes of the batches that workers get, unless the session sets them: a batch is held several times over, by Spark and by its worker.
BATCH_BYTES = 2 << 20


def with_small_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of about ``BATCH_BYTES``; Spark's own go by rows, so by how long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.

    Pure ASCII takes the plain ``lower``; other text is translated by letter.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see, below ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder of its own and a
    cluster is refused, since its executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise CurationError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/tagweave-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends at a table that outlives executors."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found.stored_path = path
    return found


def release(*frames: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once nothing reads them any more."""
    for frame in frames:
        remove(frame.sparkSession, frame.stored_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_beside_text(docs: DataFrame, text: str, with_text: bool) -> tuple[DataFrame, str]:
    """``row`` (struct of the columns, with or without the text) beside ``text``; and the type of the struct."""
    names = [name for name in docs.columns if with_text or name != text]
    row = F.struct(*[F.col(f"`{name}`") for name in names]) if names else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))
    return rows, rows.schema["row"].dataType.simpleString()


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, at least a row each, so what a task makes of one stays small."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes.tolist()):
        held += size
        if held >= most:
            yield batch.slice(start, row + 1 - start)
            start, held = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
