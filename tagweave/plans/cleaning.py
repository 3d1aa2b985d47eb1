"""Clean job: report orphans, or return the listings without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import names
from tagweave.operators import pairing


def report(candidates: DataFrame, staged: DataFrame) -> DataFrame:
    return pairing.find_orphans(candidates, staged).orderBy("path")


def clean(pool_files: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pool and staged listings without their orphans, from the passes that find them.

    A pool stem with several files of a kind raises. What is left is decided
    per stem, so no listing is joined with the orphans found in it.
    """
    candidates = pairing.pair(pool_files)
    pairing.check_repeats(candidates)
    files = F.array(
        F.struct(F.col("image_path").alias("path"), F.lit("image").alias("kind")),
        F.struct(F.col("metadata_path").alias("path"), F.lit("metadata").alias("kind")),
    )
    whole = candidates.where(~F.col("is_broken")).select("stem", F.explode(files).alias("file"))
    kept_pool = whole.select("stem", "file.*").withColumn("name", names.file_name(F.col("path")))
    # A lone pool record is an orphan, yet it still serves the staged images of its stem.
    flagged = pairing.staged_flags(staged, candidates.where(F.col("metadata_path").isNotNull()))
    kept_staged = flagged.where(F.col("reason").isNull()).drop("reason")
    return kept_pool.select("path", "name", "kind", "stem"), kept_staged.withColumn("name", names.file_name(F.col("path")))


def counts(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("reason").agg(F.count("*").alias("n"))


def apply(
    pool_files: DataFrame, staged: DataFrame, orphans: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Pool and staged listings without the orphaned files."""
    gone = orphans.select("path")
    return pool_files.join(gone, "path", "left_anti"), staged.join(gone, "path", "left_anti")
