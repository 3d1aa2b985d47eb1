"""Overlay scoring: region features to evidence, consensus and decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import overlay
from tagweave.operators import evidence, regions


def region_features(boxes: DataFrame) -> DataFrame:
    """Probabilities that need nothing but a region's box and area."""
    box = [F.col(name) for name in ("x", "y", "w", "h")]
    size = [F.col("width"), F.col("height")]
    return boxes.withColumn("placement_metadata", overlay.placement(*box, *size)).withColumn(
        "scale_subordination", overlay.scale(F.col("area"), box[2], box[3], *size)
    )


def score_regions(boxes: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Decision per probed region of every image.

    ``boxes`` lists all regions ``(image_id, component_id, x, y, w, h, area,
    width, height)``. ``measured`` adds pixel-based channels ``(image_id,
    component_id, channel, p)``; channels nobody measured are absent from the
    consensus and neutral in the decision.
    """
    probed = region_features(regions.rank_regions(boxes))
    like = regions.similar_counts(boxes)
    probed = probed.join(like, ["image_id", "area"]).withColumn(
        "repetition_or_mark_family", overlay.repetition(F.col("similar"))
    )
    own = ["image_id", "component_id"]
    channels = ("placement_metadata", "scale_subordination", "repetition_or_mark_family")
    rows = probed.select(
        *own, F.explode(F.create_map(*[v for c in channels for v in (F.lit(c), F.col(c))])).alias("channel", "p")
    )
    if measured is not None:
        known = measured.join(probed.select(*own), own, "left_semi")
        rows = rows.unionByName(known.select(*own, "channel", "p"))
    keyed = evidence.evidence(rows).withColumn("entity_id", F.struct(*own))
    return evidence.decide(keyed).select("entity_id.*", "*").drop("entity_id")
