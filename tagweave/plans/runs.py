"""Run records: effective settings, run numbers, plans and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.cluster import broadcast_if_small, constant_rows
from tagweave.errors import CurationError, gate
from tagweave.functions import names
from tagweave.operators import datasets
from tagweave.sources import sinks

# Preset, rank, steps, learning rate.
PRESETS = (
    ("concept", 8, 1200, 1e-4),
    ("clothing", 16, 2000, 1e-4),
    ("character", 16, 2200, 1e-4),
    ("style", 32, 2500, 5e-5),
    ("clothing-simple", 8, 1500, 1e-4),
    ("clothing-detailed", 32, 2800, 5e-5),
    ("character-lite", 8, 1600, 1e-4),
    ("character-detail", 16, 2600, 1e-4),
    ("style-soft", 16, 2000, 5e-5),
    ("style-strong", 32, 3000, 5e-5),
)
PRESET_BATCH_SIZE = 1
PRESET_ACCUMULATION = 4
DEFAULTS = {
    "rank": 16,
    "steps": 2000,
    "learning_rate": 1e-4,
    "batch_size": 1,
    "gradient_accumulation": 4,
}


def preset_table(spark: SparkSession) -> DataFrame:
    rows = [(*preset, PRESET_BATCH_SIZE, PRESET_ACCUMULATION) for preset in PRESETS]
    return constant_rows(spark, ["preset", *[f"preset_{name}" for name in DEFAULTS]], rows)


def effective_values(specs: DataFrame) -> DataFrame:
    """Each setting: the explicit value, else the preset's, else the default.

    The preset table is a ten-row constant, so broadcasting it is safe.
    """
    joined = specs.join(F.broadcast(preset_table(specs.sparkSession)), "preset", "left")
    for name, default in DEFAULTS.items():
        joined = joined.withColumn(name, F.coalesce(name, f"preset_{name}", F.lit(default)))
    return joined.drop(*[f"preset_{name}" for name in DEFAULTS])


def next_runs(requested: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Next run name of each requested dataset from ``artifacts(dataset, run)``."""
    number = F.expr(r"try_cast(regexp_extract(run, '^run-([0-9]+)$', 1) AS BIGINT)")
    highest = artifacts.groupBy("dataset").agg(F.max(number).alias("highest"))
    return (
        requested.select("dataset")
        .distinct()
        .join(highest, "dataset", "left")
        .select(
            "dataset",
            names.run_name(F.coalesce("highest", F.lit(0).cast("long")) + 1).alias("run_name"),
        )
    )


def run_plans(specs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Plan of every spec; a given run name is kept. Nothing is written."""
    effective = effective_values(specs)
    upcoming = next_runs(specs, artifacts).withColumnRenamed("run_name", "next_name")
    run = F.coalesce("run_name", "next_name")
    return (
        # one row per dataset; shuffled by dataset, specs would lie in as many tasks as there are datasets
        effective.join(broadcast_if_small(upcoming), "dataset")
        .withColumn("run_name", run)
        .drop("next_name")
        .withColumn("prepare_would_run", ~F.col("no_prepare"))
        .withColumn("artifact_dir", F.concat_ws("/", F.lit("artifacts"), "dataset", "run_name"))
        .withColumn("prepared_dir", F.concat_ws("/", F.lit("prepared"), "dataset"))
    )


def usable_gate(validity: DataFrame) -> None:
    """Refuse prepared datasets that are missing or invalid."""
    gate(validity.where(~F.col("prepared")), "Prepared dataset is missing or invalid", "dataset")


def record_run(
    plan: DataFrame,
    *,
    dataset: str,
    run: str,
    prepared: str,
    root: str,
    manifest: DataFrame,
    images: DataFrame,
    dry_run: bool = False,
) -> str | None:
    """Check the prepared data, then freeze it under the run's folder.

    Whether manifest and config are there is looked up in what is live in ``prepared``.
    """
    if dry_run:
        return None
    spark = plan.sparkSession
    parts = sinks.prepared_parts(spark, prepared)
    present = spark.range(1).select(
        F.lit(dataset).alias("dataset"),
        F.lit(parts[sinks.MANIFEST_FOLDER] is not None).alias("has_manifest"),
        F.lit(parts[sinks.CONFIG_FOLDER] is not None).alias("has_config"),
    )
    usable_gate(datasets.prepared_validity(present, manifest, images))
    if not manifest.take(1):
        raise CurationError(f"Prepared dataset has no training rows: {dataset}")
    return sinks.snapshot_run(spark, prepared, root, dataset, run, plan)
