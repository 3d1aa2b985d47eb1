"""Named subsets of the pool: membership, overrides, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.errors import CurationError, gate
from tagweave.functions import names, variants


def summary(datasets: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged images per dataset; datasets without any stay with zero."""
    counts = (
        staged.where(F.col("kind") == "image")
        .groupBy("dataset")
        .agg(F.count("*").alias("staged_images"))
    )
    return datasets.join(counts, "dataset", "left").select(
        "dataset", F.coalesce("staged_images", F.lit(0).cast("long")).alias("staged_images")
    )


def resolve_metadata(
    staged_images: DataFrame, overrides: DataFrame, pool: DataFrame
) -> DataFrame:
    """Metadata of every staged image: its dataset's override, else the pool's.

    ``overrides(dataset, stem, meta)`` and ``pool(stem, meta)`` have unique
    keys and a NULL ``meta`` where a record exists but cannot be read. Such a
    record is taken as it is: ``origin`` names it and ``meta`` stays NULL.
    Only the staged side can repeat a stem, and adaptive execution
    splits that side when one stem is hot.
    """
    there = F.lit(True)
    over = overrides.select("dataset", "stem", F.col("meta").alias("override_meta"), there.alias("has_override"))
    base = pool.select("stem", F.col("meta").alias("pool_meta"), there.alias("has_pool"))
    return (
        staged_images.join(over, ["dataset", "stem"], "left")
        .join(base, "stem", "left")
        .withColumn("meta", F.when(F.col("has_override"), F.col("override_meta")).otherwise(F.col("pool_meta")))
        .withColumn("origin", F.when(F.col("has_override"), "override").when(F.col("has_pool"), "candidate"))
        .drop("override_meta", "pool_meta", "has_override", "has_pool")
    )


def manifest_row_valid(row: Column) -> Column:
    """Image and caption are strings and tags is a list."""
    return (
        variants.is_string(variants.field(row, "image"))
        & variants.is_string(variants.field(row, "caption"))
        & variants.is_array(variants.field(row, "tags"))
    )


def prepared_validity(prepared: DataFrame, manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Per prepared dataset, whether every manifest row can be used.

    ``prepared(dataset, has_manifest, has_config)``, ``manifest(dataset, row)``
    with one VARIANT per line (NULL for unreadable lines) and
    ``images(dataset, image)``. A manifest without rows is valid.
    """
    checked = manifest.select(
        "dataset",
        F.coalesce(manifest_row_valid(F.col("row")), F.lit(False)).alias("well_formed"),
        F.try_variant_get("row", "$.image", "string").alias("image"),
    )
    present = images.select("dataset", "image", F.lit(True).alias("found")).distinct()
    per_dataset = (
        checked.join(present, ["dataset", "image"], "left")
        .groupBy("dataset")
        .agg(F.bool_and(F.col("well_formed") & F.coalesce("found", F.lit(False))).alias("rows_valid"))
    )
    return prepared.join(per_dataset, "dataset", "left").select(
        "dataset",
        (
            F.col("has_manifest") & F.col("has_config") & F.coalesce("rows_valid", F.lit(True))
        ).alias("prepared"),
    )


def missing_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows whose image file is absent."""
    return manifest.join(images.select("dataset", "image"), ["dataset", "image"], "left_anti")


def status(
    datasets: DataFrame,
    staged: DataFrame,
    pool: DataFrame,
    validity: DataFrame,
    artifacts: DataFrame,
) -> DataFrame:
    """Counts per dataset; every staged JSON counts as an override."""
    image = F.col("kind") == "image"
    # One pass: files are counted per stem, then stems per dataset.
    stems = staged.groupBy("dataset", "stem").agg(
        F.count_if(image).alias("n_images"), F.count_if(~image).alias("n_overrides")
    )
    known = pool.select("stem", F.lit(True).alias("in_pool"))
    alone = (F.col("n_overrides") == 0) & F.col("in_pool").isNull()
    counted = (
        stems.join(known, "stem", "left")
        .groupBy("dataset")
        .agg(
            F.sum("n_images").alias("staged_images"),
            F.sum("n_overrides").alias("overrides"),
            F.sum(F.when(alone, F.col("n_images")).otherwise(0)).alias("missing_metadata"),
        )
    )
    runs = artifacts.groupBy("dataset").agg(F.count("*").alias("artifacts"))
    joined = datasets
    for part in (counted, validity, runs):
        joined = joined.join(part, "dataset", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "dataset",
        *[
            F.coalesce(name, zero).alias(name)
            for name in ("staged_images", "overrides", "missing_metadata")
        ],
        F.coalesce("prepared", F.lit(False)).alias("prepared"),
        F.coalesce("artifacts", zero).alias("artifacts"),
    )


# --- membership changes -----------------------------------------------------


def resolve_stage_requests(
    requests: DataFrame, files: DataFrame, candidates: DataFrame
) -> DataFrame:
    """Source of every request ``(dataset, image, seq)`` and how it came out.

    A request names a file path, which wins, or a candidate stem. ``files``
    lists the paths that exist.
    """
    known = files.select(F.col("path").alias("image"), F.lit(True).alias("is_path")).distinct()
    pool = candidates.where(F.col("n_images") > 0).select(
        F.col("stem").alias("image"), "image_path", "n_images"
    )
    by_path = F.col("is_path")
    source = F.when(by_path, F.col("image")).otherwise(F.col("image_path"))
    return (
        requests.join(known, "image", "left")
        .join(pool, "image", "left")
        .withColumn("source_path", source)
        .withColumn("file_name", names.file_name(F.col("source_path")))
        .withColumn(
            "outcome",
            F.when(F.col("source_path").isNull(), "not found")
            .when(by_path.isNull() & (F.col("n_images") > 1), "multiple images")
            .when(~names.is_image(F.col("file_name")), "not an image")
            .otherwise("staged"),
        )
        .select("dataset", "image", "seq", "source_path", "file_name", "outcome")
    )


def upsert_staged(staged: DataFrame, resolved: DataFrame) -> DataFrame:
    """Membership after staging; the latest request for a file name wins."""
    new = resolved.where(F.col("outcome") == "staged").select(
        "dataset", "file_name", "source_path", F.col("seq").cast("long").alias("seq")
    )
    old = staged.select("dataset", "file_name", "source_path", F.lit(-1).cast("long").alias("seq"))
    return (
        old.unionByName(new)
        .groupBy("dataset", "file_name")
        .agg(F.max(F.struct("seq", "source_path")).alias("last"))
        .select(
            "dataset",
            "file_name",
            names.stem(F.col("file_name")).alias("stem"),
            F.col("last.source_path").alias("source_path"),
        )
    )


def stage_all(candidates: DataFrame, dataset: str) -> DataFrame:
    """Membership rows for the whole pool, or an error naming the broken stems."""
    repeated = candidates.where(F.col("n_images") > 1)
    gate(repeated, "Stems with several images in the pool", "stem")
    broken = candidates.where(F.col("is_broken"))
    gate(broken, "The pool holds unpaired stems", "stem")
    name = names.file_name(F.col("image_path"))
    return candidates.select(
        F.lit(dataset).alias("dataset"),
        name.alias("file_name"),
        "stem",
        F.col("image_path").alias("source_path"),
    )


def resolve_unstage_requests(requests: DataFrame, staged: DataFrame) -> DataFrame:
    """File each request ``(dataset, image)`` removes: exact name, else unique stem."""
    by_name = staged.select("dataset", F.col("file_name").alias("asked"), F.lit(True).alias("direct")).distinct()
    by_stem = (
        staged.where(names.is_image(F.col("file_name")))
        .groupBy("dataset", F.col("stem").alias("image"))
        .agg(F.count("*").alias("matches"), F.min("file_name").alias("only_name"))
    )
    return (
        requests.withColumn("asked", names.file_name(F.col("image")))
        .join(by_name, ["dataset", "asked"], "left")
        .join(by_stem, ["dataset", "image"], "left")
        .select(
            "dataset",
            "image",
            F.when(F.col("direct"), F.col("asked"))
            .when(F.col("matches") == 1, F.col("only_name"))
            .alias("file_name"),
            F.when(F.col("direct"), "name")
            .when(F.col("matches") == 1, "stem")
            .when(F.col("matches") > 1, "multiple")
            .otherwise("not found")
            .alias("outcome"),
        )
    )


def remove_staged(staged: DataFrame, resolved: DataFrame) -> DataFrame:
    gone = resolved.where(F.col("file_name").isNotNull()).select("dataset", "file_name")
    return staged.join(gone, ["dataset", "file_name"], "left_anti")


# --- lifecycle --------------------------------------------------------------


def check_name(name: str) -> str:
    if name in ("", ".", "..") or "/" in name or "\\" in name:
        raise CurationError(f"Invalid dataset name: {name}")
    return name


def _exists(datasets: DataFrame, name: str) -> bool:
    return bool(datasets.where(F.col("dataset") == name).take(1))


def create(datasets: DataFrame, name: str) -> DataFrame:
    if _exists(datasets, check_name(name)):
        raise CurationError(f"Dataset already exists: {name}")
    row = datasets.sparkSession.range(1).select(F.lit(name).alias("dataset"))
    return datasets.select("dataset").unionByName(row)


def delete(table: DataFrame, name: str) -> DataFrame:
    """``datasets`` or ``staged`` without one dataset; artifacts are left alone."""
    return table.where(F.col("dataset") != check_name(name))


def rename(datasets: DataFrame, table: DataFrame, old: str, new: str) -> DataFrame:
    """``datasets`` or ``staged`` with one dataset renamed."""
    if not _exists(datasets, check_name(old)):
        raise CurationError(f"Dataset not found: {old}")
    if _exists(datasets, check_name(new)):
        raise CurationError(f"Dataset already exists: {new}")
    return table.withColumn(
        "dataset", F.when(F.col("dataset") == old, new).otherwise(F.col("dataset"))
    )


def rename_many(datasets: DataFrame, table: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename by a mapping ``(dataset, new_name)``.

    Names that are taken, new names given twice and unknown datasets are refused.
    """
    twice = renames.groupBy("new_name").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    gate(twice, "Several datasets would get one name", "new_name")
    gate(renames.join(datasets.select("dataset"), "dataset", "left_anti"), "No such datasets", "dataset")
    taken = renames.join(
        datasets.select(F.col("dataset").alias("new_name")), "new_name", "left_semi"
    )
    gate(taken, "Datasets already exist", "new_name")
    return (
        table.join(renames, "dataset", "left")
        .withColumn("dataset", F.coalesce("new_name", "dataset"))
        .drop("new_name")
    )


