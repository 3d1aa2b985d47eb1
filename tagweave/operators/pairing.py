"""Pairing images with their metadata, and what is left over.

Files come as a listing ``(path)``; nothing here reads file content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.cluster import dealt
from tagweave.errors import gate
from tagweave.functions import names

# Why a file is reported.
NO_JSON = "candidate image has no JSON sibling"
NO_IMAGE = "candidate JSON has no image sibling"
NO_METADATA = "staged image has no metadata"
NO_STAGED_IMAGE = "staged JSON has no matching staged image"


def classify(listing: DataFrame) -> DataFrame:
    """Add name, stem and kind; files of no interest are dropped."""
    name = F.col("name")
    return (
        listing.withColumn("name", names.file_name(F.col("path")))
        .withColumn("kind", names.kind(name))
        .where(F.col("kind").isNotNull())
        .withColumn("stem", names.stem(name))
    )


def pair(files: DataFrame) -> DataFrame:
    """One row per stem with both sides, either of which may be missing.

    Both kinds share one listing, so a full outer join is a single grouped
    pass that also counts repeated files. Files are dealt out first: the least
    of several paths is found by sorting, and a scan task would sort all it reads.
    """
    image = F.col("kind") == "image"
    metadata = F.col("kind") == "metadata"
    return (
        dealt(files, "stem")
        .groupBy("stem")
        .agg(
            F.min(F.when(image, F.col("path"))).alias("image_path"),
            F.min(F.when(metadata, F.col("path"))).alias("metadata_path"),
            F.count_if(image).alias("n_images"),
            F.count_if(metadata).alias("n_metadata"),
        )
        .withColumn(
            "is_broken", F.col("image_path").isNull() | F.col("metadata_path").isNull()
        )
    )


def check_repeats(candidates: DataFrame) -> None:
    """Raise unless every stem of :func:`pair` has at most one file of each kind."""
    several = candidates.where((F.col("n_images") > 1) | (F.col("n_metadata") > 1))
    gate(several, "Several files of one kind share a stem", "stem")


def candidate_list(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("stem")


def repeated(files: DataFrame) -> DataFrame:
    """Stems holding several files of one kind."""
    return (
        files.groupBy("stem", "kind")
        .agg(
            F.count("*").alias("n_files"),
            F.min("path").alias("first_path"),
            F.max("path").alias("last_path"),
        )
        .where(F.col("n_files") > 1)
    )


def pool_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_broken")).alias("valid"),
        F.count_if(F.col("is_broken")).alias("broken"),
    )


def candidate_orphans(candidates: DataFrame) -> DataFrame:
    """The lone side of every broken candidate, with the reason."""
    no_metadata = F.col("metadata_path").isNull()
    return candidates.where(F.col("is_broken")).select(
        F.coalesce("image_path", "metadata_path").alias("path"),
        F.when(no_metadata, NO_JSON).otherwise(NO_IMAGE).alias("reason"),
    )


def staged_flags(staged: DataFrame, pool_metadata: DataFrame) -> DataFrame:
    """Every staged file with the reason it is an orphan, or NULL; ``staged`` is read once.

    ``staged`` is a classified listing with a ``dataset`` column,
    ``pool_metadata`` has one row per stem. The files of one dataset and stem
    differ in their suffix only, so a list of them is short.
    """
    image = F.col("kind") == "image"
    stems = staged.groupBy("dataset", "stem").agg(
        F.count_if(image).alias("n_images"),
        F.count_if(~image).alias("n_overrides"),
        F.collect_list(F.struct("path", "kind")).alias("files"),
    )
    known = pool_metadata.select("stem", F.lit(True).alias("in_pool"))
    return (
        stems.join(known, "stem", "left")
        .withColumn("alone", (F.col("n_overrides") == 0) & F.col("in_pool").isNull())
        .select("dataset", "stem", "alone", "n_images", F.explode("files").alias("file"))
        .select(
            "dataset",
            "stem",
            "file.*",
            F.when((F.col("file.kind") == "image") & F.col("alone"), NO_METADATA)
            .when((F.col("file.kind") == "metadata") & (F.col("n_images") == 0), NO_STAGED_IMAGE)
            .alias("reason"),
        )
    )


def staged_orphans(staged: DataFrame, pool_metadata: DataFrame) -> DataFrame:
    """Staged images without any metadata and staged JSON without an image."""
    flagged = staged_flags(staged, pool_metadata)
    return flagged.where(F.col("reason").isNotNull()).select("path", "reason")


def find_orphans(candidates: DataFrame, staged: DataFrame) -> DataFrame:
    """Every orphan of the pool and of the datasets; order the result to list it."""
    pool_metadata = candidates.where(F.col("metadata_path").isNotNull())
    return candidate_orphans(candidates).unionByName(staged_orphans(staged, pool_metadata))
