"""Evidence consensus over regions.

All statistics are algebraic sums, minima and maxima, so they combine before
the shuffle however many rows one region has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.functions import overlay


def evidence(rows: DataFrame) -> DataFrame:
    """Clip probabilities of known channels and attach their weights."""
    return (
        rows.withColumn("p", overlay.probability(F.col("p")))
        .withColumn("weight", overlay.channel_weight(F.col("channel")))
        .where(F.col("weight").isNotNull())
    )


def _sums() -> list[Column]:
    """Aggregates the consensus is computed from."""

    def root(p: Column) -> Column:
        return F.sum(F.col("weight") * F.sqrt(overlay.clip(p, overlay.EPS, 1.0)))

    total = F.greatest(F.lit(overlay.EPS), F.sum("weight"))
    return [
        (root(F.col("p")) / total).alias("_yes"),
        (root(1.0 - F.col("p")) / total).alias("_no"),
        F.min("p").alias("_low"),
        F.max("p").alias("_high"),
    ]


def _with_consensus(sums: DataFrame) -> DataFrame:
    yes, no = F.col("_yes") * F.col("_yes"), F.col("_no") * F.col("_no")
    share = yes / F.greatest(F.lit(overlay.EPS), yes + no)
    weakest = overlay.weakest_affinity(F.col("_low"), F.col("_high"), F.col("overlay_score"))
    return (
        sums.withColumn("overlay_score", overlay.clip(share, overlay.EPS, 1.0 - overlay.EPS))
        .withColumn("content_score", 1.0 - F.col("overlay_score"))
        .withColumn("agreement", overlay.clip(weakest, overlay.EPS, 1.0))
        .withColumn("dispersion_bits", -F.log2("agreement"))
        .drop("_yes", "_no", "_low", "_high")
    )


def consensus(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """Weighted square-root consensus of ``(entity, channel, p, weight)``.

    Agreement is the weakest overlap of a channel with the consensus. It is
    reached at the smallest or the largest p, so one pass is enough.
    """
    return _with_consensus(rows.groupBy(key).agg(*_sums()))


def decide(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """Consensus, channels and accept decision of every region, in one grouping."""
    named = list(overlay.CHANNEL_WEIGHTS)
    channels = [F.max(F.when(F.col("channel") == n, F.col("p"))).alias(n) for n in named]
    scored = _with_consensus(rows.groupBy(key).agg(*_sums(), *channels))
    return scored.withColumn(
        "selected", overlay.accept(F.col("overlay_score"), {n: F.col(n) for n in named})
    )


def frame_agreement(
    occupancy: DataFrame, frames: list[str] | None = None, key: str = "entity_id"
) -> DataFrame:
    """Weighted support and minimax agreement over the fixed list of frames.

    ``occupancy`` holds ``(entity, frame, occupancy)``, one row per frame at
    most; naming the frames bounds the list built per region. A frame without a
    row saw nothing of the region: it counts with 0 and its whole weight.
    """
    frames = list(overlay.FRAME_WEIGHTS) if frames is None else frames
    unknown = [name for name in frames if name not in overlay.FRAME_WEIGHTS]
    if unknown:
        raise CurationError(f"No weight for the frames {', '.join(unknown)}; there are {', '.join(overlay.FRAME_WEIGHTS)}")
    weights = [overlay.FRAME_WEIGHTS[name] for name in frames]
    seen = [
        F.coalesce(F.max(F.when(F.col("frame") == name, F.col("occupancy"))), F.lit(0.0))
        for name in frames
    ]
    listed = F.array(*seen)
    support = sum((p * w for p, w in zip(seen, weights)), F.lit(0.0)) / max(overlay.EPS, sum(weights))
    return (
        occupancy.where(F.col("frame").isin(*frames))
        .groupBy(key)
        .agg(support.alias("support"), listed.alias("values"))
        .select(key, "support", overlay.agreement(F.col("values")).alias("agreement"))
        .withColumn(
            "detector_support", overlay.detector_support(F.col("support"), F.col("agreement"))
        )
    )


def occupancy(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a region's pixels a frame also marks; 0 for an empty region."""
    return pixels.groupBy(*keys).agg(
        F.coalesce(
            F.count_if("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)
        ).alias("occupancy")
    )


def votes(marks: DataFrame, minimum: int = 2) -> DataFrame:
    """Positions marked by several frames: ``(image_id, pos, frame)``."""
    return (
        marks.select("image_id", "pos", "frame")
        .distinct()
        .groupBy("image_id", "pos")
        .agg(F.count("*").alias("n_frames"))
        .where(F.col("n_frames") >= minimum)
    )


def marked_positions(*frames: DataFrame) -> DataFrame:
    """Union of the positions of all frames."""
    positions = [frame.select("image_id", "pos") for frame in frames]
    stacked = positions[0]
    for part in positions[1:]:
        stacked = stacked.unionByName(part)
    return stacked.distinct()


def entropy(levels: DataFrame, key: str = "entity_id", level: str = "level") -> DataFrame:
    """Entropy in bits of a region's quantised colours."""
    counts = levels.groupBy(key, level).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    bits = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return counts.groupBy(key).agg(F.greatest(F.lit(0.0), bits).alias("entropy_bits"))


def quantised(r: Column, g: Column, b: Column) -> Column:
    """Eight levels per channel packed into one number."""

    def step(value: Column) -> Column:
        return F.floor(value / 32).cast("int")

    return step(r) * 64 + step(g) * 8 + step(b)


def contrast(pixels: DataFrame, key: str = "entity_id") -> DataFrame:
    """Mean and population deviation inside and outside ``(entity, value, inside)``."""
    inside, value = F.col("inside"), F.col("value")
    return pixels.groupBy(key).agg(
        F.avg(F.when(inside, value)).alias("mean_in"),
        F.avg(F.when(~inside, value)).alias("mean_out"),
        F.stddev_pop(F.when(inside, value)).alias("std_in"),
        F.stddev_pop(F.when(~inside, value)).alias("std_out"),
    )


def semi_transparent_share(pixels: DataFrame, key: str = "entity_id") -> DataFrame:
    hits = F.count_if(overlay.is_semi_transparent(F.col("alpha")))
    return pixels.groupBy(key).agg(
        (hits / F.nullif(F.count("alpha"), F.lit(0))).alias("semi_share")
    )


def selection_summary(decisions: DataFrame) -> DataFrame:
    """Mean score and dispersion of the selected regions."""
    chosen = F.col("selected")

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(chosen, F.col(name))), F.lit(0.0)).alias(f"mean_{name}")

    return decisions.agg(
        F.count_if(chosen).alias("selected"), mean("overlay_score"), mean("dispersion_bits")
    )
