"""Output that changes as a whole: versions written aside, and a pointer file that makes one of them live.

A folder holds ``v-<id>`` folders and ``live/<number>`` files; the file of the highest number names what is live. A writer fills
folders of its own first and creates the next number last. Creating a file that exists fails, so of two writers at once one is
refused, and a writer that breaks off at any point leaves what was live as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.errors import CurationError

POINTERS = "live"
#: Ranges of stems that a metadata store is cut into, and stems looked at to place them.
RANGES, SAMPLED = 64, 20_000
STORED = "stem string, json string"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    found = _files(spark, folder).globStatus(_path(spark, f"{folder}/{POINTERS}/[0-9]*")) or []
    return sorted(int(f.getPath().getName()) for f in found)


def pointer(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the live pointer; 0 and nothing before the first."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{folder}/{POINTERS}/{numbers[-1]:09d}", wholetext=True).first()[0]
    return numbers[-1], json.loads(text)


def point(spark: SparkSession, folder: str, after: int, content: dict) -> None:
    """Make ``content`` live if ``after`` still is; else raise."""
    where = f"{folder}/{POINTERS}/{after + 1:09d}"
    # written whole under a name of its own, then renamed: a name that is taken refuses
    draft = f"{folder}/{POINTERS}/.{uuid.uuid4().hex}"
    files = _files(spark, folder)
    stream = files.create(_path(spark, draft), False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    taken = files.exists(_path(spark, where))
    if taken or not files.rename(_path(spark, draft), _path(spark, where)):
        files.delete(_path(spark, draft), False)
        raise CurationError(f"Written by another run meanwhile: {folder}")


def publish(spark: SparkSession, folder: str, write: Callable[[str], None], *, once: bool = False) -> str:
    """Let ``write`` fill a new version of ``folder``, then make it live; returns its path.

    With ``once`` a folder that has a live version is refused.
    """
    before, _ = pointer(spark, folder)
    if once and before:
        raise CurationError(f"Exists already: {folder}")
    version = f"v-{uuid.uuid4().hex}"
    write(f"{folder}/{version}")
    point(spark, folder, before, {"version": version})
    return f"{folder}/{version}"


def live(spark: SparkSession, folder: str) -> str | None:
    """Path of the live version."""
    _, content = pointer(spark, folder)
    return f"{folder}/{content['version']}" if content else None


# --- metadata by ranges of stems ------------------------------------------------


def _bounds(rows: DataFrame, ranges: int) -> list[str]:
    """Stems at which ranges begin, from a bounded sample; ranges of unlike size cost time, not results."""
    n = rows.count()
    sample = rows.select("stem").sample(min(1.0, 1.2 * SAMPLED / n), seed=7) if n > SAMPLED else rows.select("stem")
    stems = sorted({r["stem"] for r in sample.limit(2 * SAMPLED).collect() if r["stem"] is not None}, key=str.encode)
    return [stems[i * len(stems) // ranges] for i in range(1, ranges)] if len(stems) >= ranges else stems[1:]


def _range_of(stem: Column, bounds: list[str]) -> Column:
    """How many bounds a stem has reached."""
    listed = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<string>")
    return F.size(F.filter(listed, lambda bound: bound <= stem))


def read_records(spark: SparkSession, folder: str, ranges: list[int] | None = None) -> DataFrame:
    """``(stem, json)`` of the live records, of some ranges only if asked."""
    _, content = pointer(spark, folder)
    held = content.get("ranges", {})
    paths = [f"{folder}/{version}/part={number}" for number, version in sorted(held.items()) if ranges is None or int(number) in ranges]
    return spark.read.schema(STORED).parquet(*paths) if paths else spark.createDataFrame([], STORED)


def write_records(changed: DataFrame, folder: str, *, ranges: int = RANGES) -> list[int]:
    """Put records ``(stem, json)`` into the store, each stem once; returns the ranges that were written.

    Only ranges with a changed stem are written, with their other records, aside from the files that are live. The first
    write places the ranges. Work is chosen in stem order, so what one run changes lies in few ranges.
    """
    spark = changed.sparkSession
    before, content = pointer(spark, folder)
    bounds = content["bounds"] if before else _bounds(changed, ranges)
    held = dict(content.get("ranges", {}))
    placed = changed.select("stem", "json").withColumn("part", _range_of(F.col("stem"), bounds))
    touched = [r["part"] for r in placed.select("part").distinct().collect()]  # at most as many as there are ranges
    version = f"v-{uuid.uuid4().hex}"
    others = read_records(spark, folder, touched).join(placed.select("stem"), "stem", "left_anti")
    rows = placed.unionByName(others.withColumn("part", _range_of(F.col("stem"), bounds)))
    rows.repartition("part").sortWithinPartitions("part", "stem").write.partitionBy("part").parquet(f"{folder}/{version}")
    held |= {str(part): version for part in touched}
    point(spark, folder, before, {"bounds": bounds, "ranges": held})
    return sorted(touched)
