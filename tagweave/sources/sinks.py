"""Writing manifests, metadata, prepared data and run snapshots."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.errors import CurationError
from tagweave.functions.geometry import PrepareConfig
from tagweave.sources import versions

MANIFEST_FOLDER = "manifest"
CONFIG_FOLDER = "config"


def write_manifest(rows: DataFrame, path: str, *, order: str = "image", mode: str = "overwrite") -> None:
    """JSON lines with sorted keys, in image order across the part files."""
    kept = sorted(name for name in rows.columns)
    rows.orderBy(order).select(*kept).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_metadata(metadata: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One row per record ``(stem, json)``; VARIANT objects print sorted keys."""
    metadata.select("stem", F.to_json("meta").alias("json")).write.mode(mode).parquet(path)


def write_rows(rows: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Any result as JSON lines."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def training_rows(manifest: DataFrame) -> DataFrame:
    """Manifest as the two columns image trainers read."""
    return manifest.select(F.col("image").alias("file_name"), F.col("caption").alias("text"))


def config_frame(spark: SparkSession, config: PrepareConfig) -> DataFrame:
    values = asdict(config)
    types = {
        "width": T.IntegerType(),
        "height": T.IntegerType(),
        "remove_overlays": T.BooleanType(),
    }
    return spark.range(1).select(
        *[F.lit(values[n]).cast(types.get(n, T.StringType())).alias(n) for n in sorted(values)]
    )


def write_prepared(rows: DataFrame, config: PrepareConfig, folder: str) -> str:
    """Rebuild a prepared dataset: its manifest and the config that made it, live once both are whole."""
    spark = rows.sparkSession

    def write(version: str) -> None:
        write_manifest(rows, f"{version}/{MANIFEST_FOLDER}")
        write_rows(config_frame(spark, config), f"{version}/{CONFIG_FOLDER}")

    return versions.publish(spark, folder, write)


def prepared_parts(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """Paths of the manifest and the config of what is live in a prepared folder; None for one that is not there."""
    version = versions.live(spark, folder)
    paths = {name: f"{version}/{name}" for name in (MANIFEST_FOLDER, CONFIG_FOLDER)}
    return {name: path if version and versions.exists(spark, f"{path}/_SUCCESS") else None for name, path in paths.items()}


def snapshot_run(
    spark: SparkSession, prepared: str, root: str, dataset: str, run: str, plan: DataFrame
) -> str:
    """Copy the prepared manifest under the run, in its order; an existing run is an error.

    The run is live once it is whole: what a run that broke off left behind counts for nothing, and of two runs of
    one name at once one is refused.
    """
    target = f"{root}/dataset={dataset}/run={run}"
    source = prepared_parts(spark, prepared)[MANIFEST_FOLDER]
    if source is None:
        raise CurationError(f"No prepared manifest: {prepared}")

    def write(version: str) -> None:
        lines = spark.read.text(source)
        lines.orderBy(F.get_json_object("value", "$.image"), "value").write.text(f"{version}/{MANIFEST_FOLDER}")
        plan.write.json(f"{version}/{CONFIG_FOLDER}")

    return versions.publish(spark, target, write, once=True)
