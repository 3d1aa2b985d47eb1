"""Bringing downloaded pairs into the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.cluster import dealt
from tagweave.functions import names, variants

# Fixed value: which image of a post is taken first.
MODE_PREFERENCE = ("sample", "preview", "original")


def numeric_ids(listing: DataFrame) -> DataFrame:
    """Distinct ids of files whose stem is a number that fits 64 bits."""
    stem = names.stem(names.file_name(F.col("path")))
    return (
        listing.select(stem.alias("stem"))
        .where(F.col("stem").rlike("^[0-9]+$"))
        .select(F.expr("try_cast(stem AS BIGINT)").alias("post_id"))
        .where(F.col("post_id").isNotNull())
        .distinct()
    )


def complete_ids(image_folders: list[DataFrame], json_folder: DataFrame) -> DataFrame:
    """Ids with an image in any folder and a JSON record."""
    images = image_folders[0].select("path")
    for folder in image_folders[1:]:
        images = images.unionByName(folder.select("path"))
    return numeric_ids(images).intersect(numeric_ids(json_folder))


def restrict(files: DataFrame, only_stems: DataFrame) -> DataFrame:
    return dealt(files, "stem").join(only_stems.select("stem"), "stem", "left_semi")


def complete_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides; incomplete ones vanish without a word."""
    return pairs.where(~F.col("is_broken"))


def chosen_image(posts: DataFrame, existing: DataFrame) -> DataFrame:
    """Image per post: best preferred mode that exists, else the first by name.

    ``posts(post_id, mode, path)`` comes from the catalogue, ``existing(path)``
    lists image files.
    """
    preference = F.array_position(F.array(*[F.lit(m) for m in MODE_PREFERENCE]), F.col("mode"))
    listed = (
        posts.where(F.col("mode").isin(*MODE_PREFERENCE) & F.col("path").isNotNull())
        .join(existing.select("path"), "path", "left_semi")
        .groupBy("post_id")
        .agg(F.min(F.struct(preference.alias("preference"), "path")).alias("best"))
        .select("post_id", F.col("best.path").alias("listed_path"))
    )
    by_name = (
        existing.select("path", names.stem(names.file_name(F.col("path"))).alias("padded"))
        .groupBy("padded")
        .agg(F.min("path").alias("named_path"))
    )
    return (
        posts.select("post_id")
        .distinct()
        .join(listed, "post_id", "left")
        .withColumn("padded", names.padded_id(F.col("post_id")))
        .join(by_name, "padded", "left")
        .select("post_id", F.coalesce("listed_path", "named_path").alias("image_path"))
    )


def json_path(post_id, listed):
    """Record path from the catalogue, else the padded default name."""
    return F.coalesce(listed, F.concat(F.lit("json/"), names.padded_id(post_id), F.lit(".json")))


def actions(sources: DataFrame, targets: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """Import log ``(name, kind, action)``; image and metadata are judged apart."""
    existing = targets.select("name", F.lit(True).alias("exists")).distinct()
    action = (
        F.lit("imported")
        if overwrite
        else F.when(F.col("exists"), "skipped").otherwise("imported")
    )
    return (
        dealt(sources, "name").join(existing, "name", "left").withColumn("action", action).drop("exists")
    )


def pair_files(pairs: DataFrame) -> DataFrame:
    """Both files of each pair as rows, without touching the pairs twice."""
    files = F.array(
        F.struct(F.col("image_path").alias("path"), F.lit("image").alias("kind")),
        F.struct(F.col("metadata_path").alias("path"), F.lit("metadata").alias("kind")),
    )
    return (
        pairs.select("stem", F.explode(files).alias("file"))
        .select("stem", "file.*")
        .withColumn("name", names.file_name(F.col("path")))
    )


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n"))


def import_metadata(records: DataFrame, site: str) -> DataFrame:
    """Pool metadata of downloaded records ``(stem, raw VARIANT)``.

    ``reject`` names what is wrong with a record; good records get ``tags``,
    ``post_id`` and ``source``.
    """
    raw = F.col("raw")
    post_id, tags = variants.field(raw, "id"), variants.field(raw, "tags")
    read = variants.import_tags_of(tags)
    return records.select(
        "stem",
        F.when(~variants.is_object(raw), "not a JSON object")
        .when(~variants.is_integer(post_id), "missing integer id")
        .when(tags.isNull(), "missing tags")
        .when(read.isNull(), "tags are neither a list of strings nor categories of strings")
        .alias("reject"),
        read.alias("tags"),
        F.try_variant_get(raw, "$.id", "long").alias("post_id"),
        F.lit(site).alias("source"),
    )
