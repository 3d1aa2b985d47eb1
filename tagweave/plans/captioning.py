"""Captioning job: choose work, tag it, write the results back."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.errors import gate
from tagweave.functions import modeltext, tags, variants
from tagweave.functions.text import let
from tagweave.operators import pairing
from tagweave.sources import versions


# Bytes that a round of the radix selection counts by.
STEP = 2


def metadata_problem(exists: Column, meta: Column) -> Column:
    """Why a stored record must not be touched; NULL for good and for absent ones.

    ``meta`` is NULL both where no record exists and where one cannot be read,
    so ``exists`` tells them apart.
    """
    raw = variants.field(meta, "tags")
    odd = raw.isNotNull() & variants.tags_of(raw).isNull()
    return F.when(exists & meta.isNull(), "metadata cannot be read").when(
        exists & odd, "tags are neither a list of strings nor categories of strings"
    )


def caption_candidates(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Images with their stored metadata: ``(stem, image_path, meta, tagged)``.

    Stems with several files of a kind and records that cannot be read raise
    before any model runs.
    """
    pairing.check_repeats(pairs)
    known = metadata.select("stem", "meta", F.lit(True).alias("exists"))
    joined = pairs.join(known, "stem", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    checked = joined.withColumn("problem", metadata_problem(F.col("exists"), F.col("meta")))
    gate(checked.where(F.col("problem").isNotNull()), "Unusable metadata", "stem")
    return checked.select("stem", "image_path", "meta", has_tags(F.col("meta")).alias("tagged"))


def has_tags(meta: Column) -> Column:
    """Whether stored metadata holds at least one tag; see :func:`metadata_problem` for invalid ones."""
    found = variants.tags_of(variants.field(meta, "tags"))
    return F.coalesce(F.size(found) > 0, F.lit(False))


def select_work(
    candidates: DataFrame, *, all_images: bool = False, limit: int | None = None
) -> DataFrame:
    """Rows an image walk in stem order reports before it stops.

    ``candidates`` holds ``(stem, image_path, tagged)``. Tagged images are
    reported as skipped. The walk stops after ``limit`` images were chosen, so
    the cut is the stem of the last chosen one; counting by prefixes finds it
    without a sort or a running count over the pool.
    """
    images = candidates.where(F.col("image_path").isNotNull()).withColumn(
        "skipped", F.lit(False) if all_images else F.col("tagged")
    )
    if limit is None:
        return images
    if limit <= 0:
        return images.where(F.lit(False))
    chosen = images.where(~F.col("skipped")).select("stem")
    last = _walk_end(chosen, limit)
    # A plain bound on the stem reaches the scan.
    return images if last is None else images.where(F.col("stem") <= last)


def _walk_end(chosen: DataFrame, limit: int) -> str | None:
    """Stem of the ``limit``-th chosen image, or None when there are fewer.

    Radix selection by the bytes of the stems: each round counts the stems of the open range by their next ``STEP``
    bytes, at most 256**STEP + 256 + 1 groups, and goes on with the group that holds the end. What its smallest and largest
    stem share is passed over, so every round fixes one byte at least and no stem is ever sorted.
    """
    stems = chosen.where(F.col("stem").isNotNull()).select("stem")
    left, inside, fixed = limit, stems, 0
    while True:
        step = F.substring(F.col("stem").cast("binary"), fixed + 1, STEP)
        groups = inside.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("stem").alias("low"), F.max("stem").alias("high"))
        for group in sorted(groups.collect(), key=lambda row: bytes(row["step"])):
            if left <= group["n"]:
                break
            left -= group["n"]
        else:
            return None
        low, high = group["low"], group["high"]
        if low == high:
            return low
        fixed = len(os.path.commonprefix([low.encode(), high.encode()]))
        inside = stems.where(F.col("stem").between(low, high))


def requests(work: DataFrame) -> DataFrame:
    """Work items with the stored tags as model context."""
    context = variants.tags_of(variants.field(F.col("meta"), "tags"))
    return work.where(~F.col("skipped")).select(
        "stem",
        "image_path",
        F.coalesce(context, F.array().cast("array<string>")).alias("context_tags"),
    )


def _with_member(members: Column, name: str, value: Column) -> Column:
    """Object members with one replaced; unchanged when ``value`` is NULL."""
    others = F.map_filter(members, lambda key, _: key != name)
    return F.when(value.isNull(), members).otherwise(
        F.map_concat(others, F.create_map(F.lit(name), value))
    )


def _members(value: Column) -> Column:
    empty = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), empty)


def write_back(metadata: DataFrame, results: DataFrame, *, default_source: str) -> DataFrame:
    """Stored metadata after merging tagging results.

    ``metadata(stem, meta)`` may lack a stem; ``results`` hold ``stem, tags,
    caption, draft_caption, caption_backend, editor_backend, sidecar VARIANT``.
    Adds ``added_tags`` for the report. A record that exists but cannot be read,
    or whose tags are invalid, keeps NULL in ``meta`` and says why in ``problem``;
    store such a result through :func:`store` only, which refuses it.
    """
    fresh = F.parse_json(F.to_json(F.struct(F.struct(F.lit(default_source).alias("source")).alias("metadata"))))
    none = F.array().cast("array<string>")
    meta = F.coalesce("meta", fresh)
    existing = F.coalesce(variants.tags_of(variants.field(F.col("meta"), "tags")), none)
    block = modeltext.captioning_block(
        F.col("caption"), F.col("draft_caption"), F.col("caption_backend"), F.col("editor_backend")
    )
    # to_json drops the unknown backends.
    captioning = F.parse_json(F.to_json(block))
    inner = _with_member(
        _with_member(_members(variants.field(meta, "metadata")), "captioning", captioning),
        "tagging",
        F.col("sidecar"),
    )
    touched = F.col("caption").isNotNull() | F.col("sidecar").isNotNull()
    merged = F.to_variant_object(tags.merge_into(existing, F.col("tags")))
    members = _with_member(_members(meta), "tags", merged)
    members = _with_member(members, "caption", F.col("caption").cast("variant"))
    members = _with_member(members, "metadata", F.when(touched, F.to_variant_object(inner)))
    known = metadata.select("stem", "meta", F.lit(True).alias("exists"))
    problem = metadata_problem(F.coalesce("exists", F.lit(False)), F.col("meta"))
    joined = results.join(known, "stem", "left").withColumn("problem", problem)
    good = F.col("problem").isNull()
    return joined.select(
        "stem",
        F.when(good, let(members, F.to_variant_object)).alias("meta"),
        F.when(good, F.array_distinct(tags.added_tags(existing, F.col("tags")))).alias("added_tags"),
        "problem",
    )


def store(written: DataFrame, folder: str) -> list[int]:
    """Put merged metadata into the record store of a folder; nothing is written if any record had a problem.

    Only ranges of stems with a changed record are written; returns them.
    """
    gate(written.where(F.col("problem").isNotNull()), "Unusable metadata", "stem")
    return versions.write_records(written.select("stem", F.to_json("meta").alias("json")), folder)


def report(work: DataFrame, written: DataFrame) -> DataFrame:
    """One row per reported image: what was added, or that it was skipped."""
    none = F.array().cast("array<string>")
    return (
        work.select("stem", "skipped")
        .join(written.select("stem", "added_tags"), "stem", "left")
        .select("stem", "skipped", F.coalesce("added_tags", none).alias("added_tags"))
    )


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(~F.col("skipped")).alias("captioned"),
        F.count_if("skipped").alias("skipped"),
        F.coalesce(F.sum(F.size("added_tags")), F.lit(0).cast("long")).alias("added"),
    )
