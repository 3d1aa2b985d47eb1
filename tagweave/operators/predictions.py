"""Model scores to tags: positional vocabulary join, thresholds, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.cluster import broadcast_if_small
from tagweave.functions import tags

# Fixed values.
SIMPLE_THRESHOLD = 0.2614
SIMPLE_CATEGORIES = (0, 4)
GENERAL_THRESHOLD = 0.35
CHARACTER_THRESHOLD = 0.85
RATING = 9
CHARACTER = 4
ARTIST = 1
COPYRIGHT = 3
META = 5
# Order in which the groups of one record are read out.
GROUP_RANK = {"rating": 0, "general": 1, "characters": 2, "copyrights": 3, "meta": 4}


def label_scores(scores: DataFrame, vocab: DataFrame, *, strict: bool) -> DataFrame:
    """Join ``(stem, scores ARRAY)`` with ``vocab(pos, name, category)`` by position.

    A strict join fails on a length mismatch; otherwise the longer side is cut.
    The vocabulary is broadcast only after its size was checked.
    """
    if strict:
        size = vocab.count()
        same = F.size("scores") == size
        message = F.format_string("%d scores for %d labels", F.size("scores"), F.lit(size))
        scores = scores.withColumn("scores", F.when(same, F.col("scores")).otherwise(F.raise_error(message)))
    return (
        scores.select("stem", F.posexplode("scores").alias("pos", "confidence"))
        .join(broadcast_if_small(vocab), "pos")
        .withColumn("confidence", F.col("confidence").cast("double"))
    )


def simple_tags(
    labelled: DataFrame, threshold: float = SIMPLE_THRESHOLD
) -> DataFrame:
    """General and character labels at or above one threshold."""
    return labelled.where(
        F.col("category").isin(*SIMPLE_CATEGORIES) & (F.col("confidence") >= threshold)
    )


def select_labels(
    labelled: DataFrame,
    general: float = GENERAL_THRESHOLD,
    character: float = CHARACTER_THRESHOLD,
) -> DataFrame:
    """Labels of the art tagger with a bar per category; ratings go elsewhere."""
    category = F.col("category")
    bar = F.when(category == CHARACTER, character).otherwise(general)
    return labelled.where((category != RATING) & (F.col("confidence") >= bar)).withColumn(
        "label_group",
        F.when(category == CHARACTER, "characters")
        .when(category == COPYRIGHT, "copyrights")
        .when(category == ARTIST, "artists")
        .when(category == META, "meta")
        .otherwise("general"),
    )


def by_confidence(selected: DataFrame) -> DataFrame:
    """Selected labels, most confident first, ties in vocabulary order."""
    return selected.orderBy("stem", F.col("confidence").desc(), "pos")


def rating(labelled: DataFrame) -> DataFrame:
    """Most confident rating label per record, the first on ties."""
    return (
        labelled.where(F.col("category") == RATING)
        .groupBy("stem")
        .agg(F.min(F.struct((-F.col("confidence")).alias("behind"), "pos", "name")).alias("best"))
        .select(
            "stem",
            F.col("best.pos").alias("pos"),
            F.col("best.name").alias("name"),
            (-F.col("best.behind")).alias("confidence"),
        )
    )


def route(selected: DataFrame, ratings: DataFrame) -> DataFrame:
    """Namespaced candidates: artists never become tags."""
    group = F.col("label_group")
    ranks = F.create_map(*[F.lit(v) for pair in GROUP_RANK.items() for v in pair])
    namespace = F.when(group.isin("general", "meta"), "booru").when(
        group == "copyrights", "copyright"
    ).otherwise(group)
    labels = selected.where(group != "artists").select(
        "stem",
        ranks[group].alias("group_rank"),
        "pos",
        F.col("name").alias("raw"),
        namespace.alias("namespace"),
        "confidence",
    )
    rated = ratings.select(
        "stem",
        F.lit(GROUP_RANK["rating"]).alias("group_rank"),
        "pos",
        F.col("name").alias("raw"),
        F.lit("rating").alias("namespace"),
        "confidence",
    )
    return rated.unionByName(labels)


def vocabulary(raw: DataFrame) -> DataFrame:
    """Vocabulary from tolerant CSV rows ``(pos, name, tag, tag_name, category)``.

    The first filled name column counts, rows without one go, an unreadable
    category becomes -1, and positions are renumbered by the caller's order.
    """
    filled = [
        F.nullif(F.col(name), F.lit("")) for name in ("name", "tag", "tag_name") if name in raw.columns
    ]
    category = (
        F.coalesce(F.expr("try_cast(trim(category) AS INT)"), F.lit(-1))
        if "category" in raw.columns
        else F.lit(-1)
    )
    return (
        raw.withColumn("name", F.coalesce(*filled))
        .where(F.col("name").isNotNull())
        .withColumn("category", category)
        .withColumn("category_name", tags.category_name(F.col("category")))
        .withColumn("normalized", tags.normalize_tag(F.col("name")))
        .select("pos", "name", "normalized", "category", "category_name")
    )
