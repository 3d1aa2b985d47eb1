"""Import job: downloaded files to pool files, metadata and a log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.cluster import stored
from tagweave.errors import gate
from tagweave.functions import names
from tagweave.operators import imports, pairing


@dataclass(frozen=True)
class ImportPlan:
    """What an import does: file actions and the metadata to store."""

    log: DataFrame
    metadata: DataFrame

    def counts(self) -> DataFrame:
        return imports.action_counts(self.log)


def _planned(
    pairs: DataFrame, records: DataFrame, targets: DataFrame, site: str, overwrite: bool
) -> ImportPlan:
    files = imports.pair_files(pairs)
    log = imports.actions(files, targets, overwrite=overwrite)
    fresh = log.where((F.col("kind") == "metadata") & (F.col("action") == "imported"))
    # Only records about to be stored are checked, each read once: the gate's filter would go below the join and read them all.
    read = stored(imports.import_metadata(records.join(fresh.select("path"), "path", "left_semi"), site))
    gate(read.where(F.col("reject").isNotNull()), "Unusable import metadata", "stem")
    return ImportPlan(log=log, metadata=read.drop("reject"))


def import_folder(
    files: DataFrame,
    records: DataFrame,
    targets: DataFrame,
    *,
    site: str,
    overwrite: bool = False,
    only_stems: DataFrame | None = None,
) -> ImportPlan:
    """Import complete pairs of a recursive listing.

    ``records(path, stem, raw VARIANT)`` are its JSON files, ``targets(name)``
    the files already in the pool.
    """
    classified = pairing.classify(files)
    if only_stems is not None:
        classified = imports.restrict(classified, only_stems)
    listed = stored(pairing.pair(classified))
    pairing.check_repeats(listed)
    pairs = imports.complete_pairs(listed)
    return _planned(pairs, records, targets, site, overwrite)


def import_catalogue(
    seen: DataFrame,
    posts: DataFrame,
    files: DataFrame,
    records: DataFrame,
    targets: DataFrame,
    *,
    query_key: str,
    site: str,
    overwrite: bool = False,
) -> ImportPlan:
    """Import the posts one query has seen, or all complete ones if it saw none.

    Paths in ``posts``, ``files`` and ``records`` are relative to the
    catalogue folder.
    """
    images = files.where(F.col("path").rlike("^images/[^/]+/[^/]+$"))
    json_files = files.where(F.col("path").rlike("^json/[^/]+$"))
    wanted = seen.where(F.col("query_key") == query_key).select("post_id").distinct()
    if not wanted.take(1):
        wanted = imports.complete_ids([images], json_files)
    listed = posts.join(wanted, "post_id", "right").select("post_id", "mode", "path")
    image = imports.chosen_image(listed, images)
    record = listed.groupBy("post_id").agg(
        F.max(F.when(F.col("mode") == "json", F.col("path"))).alias("listed_json")
    )
    pairs = (
        image.join(record, "post_id")
        .withColumn("path", imports.json_path(F.col("post_id"), F.col("listed_json")))
        .join(files.select("path"), "path", "left_semi")
        .where(F.col("image_path").isNotNull())
        .select(
            names.padded_id(F.col("post_id")).alias("stem"),
            "post_id",
            "image_path",
            F.col("path").alias("metadata_path"),
        )
    )
    return _planned(pairs, records, targets, site, overwrite)
