"""Prepare job: staged images and their metadata to an ordered manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.errors import gate
from tagweave.functions import geometry, names, prompts, variants
from tagweave.functions.geometry import PrepareConfig
from tagweave.operators import datasets
from tagweave.sources import sinks


def target_names(staged_images: DataFrame, config: PrepareConfig) -> DataFrame:
    return staged_images.withColumn(
        "target", names.prepared_name(F.col("file_name"), config.image_format)
    )


def name_collisions(staged_images: DataFrame, config: PrepareConfig) -> DataFrame:
    """Output names several staged images of a dataset would share."""
    return (
        target_names(staged_images, config)
        .groupBy("dataset", "target")
        .agg(F.count("*").alias("n_sources"))
        .where(F.col("n_sources") > 1)
    )


def resolved_rows(
    staged_images: DataFrame, overrides: DataFrame, pool: DataFrame, config: PrepareConfig
) -> DataFrame:
    """Staged images with metadata, output name and what is wrong with them."""
    resolved = datasets.resolve_metadata(target_names(staged_images, config), overrides, pool)
    meta = F.col("meta")
    raw_tags = variants.field(meta, "tags")
    return (
        resolved.withColumn("raw_tags", variants.tags_of(raw_tags))
        .withColumn("caption_text", variants.string_member(meta, "caption"))
        .withColumn(
            "problem",
            F.when(F.col("origin").isNull(), "missing metadata")
            .when(meta.isNull(), "metadata cannot be read")
            .when(raw_tags.isNull(), "metadata has no tags")
            .when(
                F.col("raw_tags").isNull(),
                "tags are neither a list of strings nor categories of strings",
            ),
        )
    )


def manifest_rows(resolved: DataFrame, config: PrepareConfig) -> DataFrame:
    """Manifest rows of usable images; one projection over the resolved rows."""
    tags = F.col("raw_tags")
    prompt = prompts.build_prompt(tags, F.col("caption_text"), config.trigger, config.prompt_type)
    return resolved.where(F.col("problem").isNull()).select(
        "dataset",
        F.concat(F.lit("images/"), F.col("target")).alias("image"),
        prompt.alias("caption"),
        prompts.manifest_tags(tags, config.prompt_type).alias("tags"),
    )


def size_plan(images: DataFrame, config: PrepareConfig) -> DataFrame:
    """Output size per image ``(width, height, mode, has_transparency)``."""
    width, height = F.col("width"), F.col("height")
    return images.withColumn("output", geometry.output_size(width, height, config)).withColumn(
        "alpha_problem",
        # An image of unknown mode may be transparent.
        F.when(F.col("mode").isNull(), F.lit(config.image_format == "jpg")).otherwise(
            geometry.alpha_blocks_jpg(F.col("mode"), F.col("has_transparency"), config.image_format)
        ),
    )


def prepare(
    staged_images: DataFrame,
    overrides: DataFrame,
    pool: DataFrame,
    config: PrepareConfig,
    folder: str | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Check everything, then build (and with ``folder`` write) the manifest.

    Unlike a run that clears its output first, all gates pass before old
    output is replaced.
    """
    config = config.validated()
    gate(name_collisions(staged_images, config), "Several images would get one output name", "target")
    if sizes is not None:
        blocked = size_plan(sizes, config).where(F.col("alpha_problem"))
        gate(blocked, "Images that are or may be transparent do not fit jpg", "path")
    resolved = resolved_rows(staged_images, overrides, pool, config)
    gate(resolved.where(F.col("problem").isNotNull()), "Staged images without usable metadata", "stem")
    rows = manifest_rows(resolved, config)
    if folder is not None:
        sinks.write_prepared(rows.drop("dataset"), config, folder)
    return rows.orderBy("dataset", "image")
