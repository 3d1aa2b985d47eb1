"""Tag fusion in long form: one row per (record, tag, source).

``pos`` orders the rows of a record; it may be any orderable column, a struct
included. Every operator groups by record *and* tag, so one huge record is
combined before the shuffle and then spread over its tags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions import tags
from tagweave.functions.text import fold, strip

# Fixed values.
MAX_CANDIDATES = 160
MAX_REJECTED = 40
EDIT_TAGS = 500
EDIT_CHARS = 4000
SEMANTIC_FIELDS = {
    "medium": "medium",
    "scene": "scene",
    "objects": "objects",
    "style": "style",
    "composition": "composition",
    "attributes": "attributes",
    "actions": "actions",
    "abstract_tags": "abstract",
}
JUDGED_FIELDS = (
    "final_tags",
    "objects",
    "scene",
    "medium",
    "style",
    "composition",
    "attributes",
    "actions",
    "booru",
    "characters",
    "abstract_tags",
)


def score_candidates(raw_tags: DataFrame) -> DataFrame:
    """Score ``(stem, pos, raw, source, namespace, confidence)``; empty tags go."""
    return (
        raw_tags.where(~tags.is_empty_tag(F.col("raw")))
        .withColumn("raw", strip(F.col("raw")))
        .withColumn("tag", tags.normalize_tag(F.col("raw")))
        .withColumn("authority", tags.authority(F.col("source"), F.col("namespace")))
        .withColumn("score", tags.score(F.col("confidence"), F.col("authority")))
    )


def place(rank: Column, at: Column) -> Column:
    """Position of an item: its list first, then its place in the list.

    One whole number keeps grouped minima in hash aggregation.
    """
    return F.shiftleft(rank.cast("long"), 40) + at.cast("long")


def _lists(
    records: DataFrame,
    items: Column,
    rank: int,
    source: str,
    namespace: str,
    confidence: float,
) -> DataFrame:
    """A list per record ``(stem, start, raws, source, namespace, confidence)``; ``start`` is the place of its first tag."""
    return records.select(
        "stem",
        place(F.lit(rank), F.lit(0)).alias("start"),
        items.alias("raws"),
        F.lit(source).alias("source"),
        F.lit(namespace).alias("namespace"),
        F.lit(confidence).alias("confidence"),
    )


def list_tags(lists: DataFrame) -> DataFrame:
    """The tags of lists, a row each; further columns go along."""
    others = [F.col(name) for name in lists.columns if name not in ("stem", "start", "raws")]
    # The outer form keeps Spark from computing the lists a second time just to
    # skip empty ones ahead of the explode.
    return (
        lists.select("stem", "start", *others, F.posexplode_outer("raws").alias("at", "raw"))
        .where(F.col("raw").isNotNull())
        .select("stem", (F.col("start") + F.col("at")).alias("pos"), "raw", *others)
    )


def context_lists(records: DataFrame) -> DataFrame:
    """Lists of ``(stem, context_tags)``."""
    return _lists(
        records, F.col("context_tags"), 0, "metadata", "existing", tags.CONTEXT_CONFIDENCE
    )


def context_tags(records: DataFrame) -> DataFrame:
    """Rows of ``(stem, context_tags)``."""
    return list_tags(context_lists(records))


def open_set_lists(records: DataFrame) -> DataFrame:
    """Lists of ``(stem, open_set_tags)``."""
    return _lists(
        records, F.col("open_set_tags"), 1, "ram++", "objects", tags.OPEN_SET_CONFIDENCE
    )


def open_set_tags(records: DataFrame) -> DataFrame:
    """Rows of ``(stem, open_set_tags)``."""
    return list_tags(open_set_lists(records))


def art_tags(predictions: DataFrame) -> DataFrame:
    """Rows of the art tagger, already routed to namespaces."""
    return predictions.select(
        "stem",
        place(F.lit(2) + F.col("group_rank"), F.col("pos")).alias("pos"),
        "raw",
        F.lit("smilingwolf").alias("source"),
        "namespace",
        F.col("confidence").cast("double").alias("confidence"),
    )


def art_lists(predictions: DataFrame) -> DataFrame:
    """Rows of the art tagger as lists of one tag."""
    rows = art_tags(predictions).withColumnRenamed("pos", "start")
    return rows.withColumn("raws", F.array("raw")).drop("raw")


def semantic_lists(semantics: DataFrame) -> DataFrame:
    """Lists of the content type and of the eight tag fields.

    Free text and uncertain items never become tags; failed records are left out.
    """
    usable = semantics.where(F.col("error").isNull()) if "error" in semantics.columns else semantics
    kind = F.col("content_type")
    first = usable.where((strip(kind) != "") & (kind != "unknown"))
    fields = [
        F.struct(
            place(F.lit(rank), F.lit(0)).alias("start"),
            F.col(name).alias("raws"),
            F.lit(namespace).alias("namespace"),
        )
        for rank, (name, namespace) in enumerate(SEMANTIC_FIELDS.items(), 11)
    ]
    # All fields come apart in one pass over the records.
    rows = usable.select("stem", F.explode(F.array(*fields)).alias("list")).where(
        F.col("list.raws").isNotNull()
    )
    return _lists(
        first, F.array(kind), 10, "qwen", "medium", tags.SEMANTIC_CONFIDENCE
    ).unionByName(
        rows.select(
            "stem",
            "list.start",
            "list.raws",
            F.lit("qwen").alias("source"),
            "list.namespace",
            F.lit(tags.SEMANTIC_CONFIDENCE).alias("confidence"),
        )
    )


def semantic_tags(semantics: DataFrame) -> DataFrame:
    """Rows of the content type and of the eight tag fields; see :func:`semantic_lists`."""
    return list_tags(semantic_lists(semantics))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Bag union of the tag sources; their ``pos`` already carries the order."""
    return reduce(DataFrame.unionByName, sources)


def best_per_tag(candidates: DataFrame) -> DataFrame:
    """Highest score per (record, tag), the earliest on ties, and where it first came up."""
    kept = ["raw", "source", "namespace", "confidence", "authority", "score"]
    return (
        candidates.groupBy("stem", "tag")
        .agg(
            F.min(F.struct((-F.col("score")).alias("behind"), "pos", *kept)).alias("best"),
            F.min("pos").alias("first_pos"),
        )
        .select("stem", "tag", "first_pos", *[f"best.{name}" for name in kept])
    )


def merge_candidates(candidates: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The best tags of each record by score; ties keep first-appearance order.

    The limit on row_number lets every task drop all but ``limit`` rows per
    record before the shuffle, so a hot record never piles up in one task.
    """
    order = Window.partitionBy("stem").orderBy(F.col("score").desc(), "first_pos")
    return (
        best_per_tag(candidates)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def first_spelling(rows: DataFrame, keys: list[str], item: str = "tag") -> DataFrame:
    """Ordered, case-insensitive dedup within ``keys``; blanks go.

    Grouping by the folded item replaces a window over the whole group.
    """
    return (
        rows.where(strip(F.col(item)) != "")
        .withColumn("_fold", fold(F.col(item)))
        .groupBy(*keys, "_fold")
        .agg(F.min(F.struct("pos", item)).alias("first"))
        .select(*keys, F.col("first.pos").alias("pos"), F.col(f"first.{item}").alias(item))
    )


def source_tags(candidates: DataFrame) -> DataFrame:
    """Tags by source over the raw, unmerged candidates."""
    # Normalised tags differ when their spellings do, so the first place is all.
    return candidates.groupBy("stem", "source", "tag").agg(F.min("pos").alias("pos"))


def prune(judged: DataFrame, merged: DataFrame) -> DataFrame:
    """Judged tags ``(stem, field, pos, raw)`` that are candidates of the record."""
    normal = judged.where(F.col("field").isin(*JUDGED_FIELDS)).select(
        "stem", "field", "pos", tags.normalize_tag(F.col("raw")).alias("tag")
    )
    allowed = normal.join(merged.select("stem", "tag"), ["stem", "tag"], "left_semi")
    return allowed.groupBy("stem", "field", "tag").agg(F.min("pos").alias("pos"))


def tag_facts(candidates: DataFrame, judged: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Everything the final list needs to know per (record, tag), in one grouping.

    ``judged`` holds the judge's final tags ``(stem, pos, raw)``; ``required``
    names the sources whose tags always stay.
    """
    known = candidates.select("stem", "tag", "pos", "score", "source")
    asked = judged.select(
        "stem", tags.normalize_tag(F.col("raw")).alias("tag"), F.col("pos").alias("judged_at")
    )
    return grouped_facts(known.unionByName(asked, allowMissingColumns=True), required)


def grouped_facts(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Facts of candidates and judged tags ``(stem, tag, pos, score, source, judged_at)`` of one table; judged ones have no score."""
    return (
        rows.groupBy("stem", "tag")
        .agg(
            F.max("score").alias("score"),
            F.min("pos").alias("first_pos"),
            F.min("judged_at").alias("judged_at"),
            *[
                F.min(F.when(F.col("source") == name, F.col("pos"))).alias(f"required_{i}")
                for i, name in enumerate(required)
            ],
        )
        .where(F.col("score").isNotNull())
    )


def final_tags(facts: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """Final tags of :func:`tag_facts`, ordered within a record by ``place``.

    Block 0 holds the judged tags among the best ``limit``; block 1 all of
    those, for records where the judge kept none; later blocks the required
    tags of each source.

    The facts are computed once. A required tag goes on in a lane of its own beside
    the ranked one of its record, so the rank cuts every lane in every task before the
    shuffle, and no window sees more than ``limit`` tags of a record.
    """
    required = sorted(name for name in facts.columns if name.startswith("required_"))
    needed = F.coalesce(*[F.when(F.col(n).isNotNull(), 2 + i) for i, n in enumerate(required)])
    ranking = F.lit(None).cast("string")
    lanes = F.when(needed.isNotNull(), F.array(ranking, F.col("tag"))).otherwise(F.array(ranking))
    lane = Window.partitionBy("stem", "lane")
    ranked = (
        facts.withColumn("lane", F.explode(lanes))
        .withColumn("rank", F.row_number().over(lane.orderBy(F.col("score").desc(), "first_pos")))
        .where(F.col("rank") <= limit)
    )
    kept = F.col("judged_at").isNotNull()
    block = F.when(F.col("lane").isNotNull(), needed).when(kept, 0).when(~F.col("judged"), 1)
    at = [(0, "judged_at"), (1, "rank"), *[(2 + i, n) for i, n in enumerate(required)]]
    places = [F.when(F.col("block") == i, F.col(n)).alias(n) for i, n in at]
    return (
        ranked.withColumn("judged", F.max(kept).over(lane))
        .withColumn("block", block)
        .where(F.col("block").isNotNull())
        .groupBy("stem", "tag")
        .agg(F.min(F.struct("block", *places)).alias("place"))
    )


def merge_back(existing: DataFrame, final: DataFrame) -> DataFrame:
    """Tags a record gains: final ones it does not hold yet."""
    return final.join(existing.select("stem", "tag"), ["stem", "tag"], "left_anti")


def edit_budget(
    rows: DataFrame, max_tags: int = EDIT_TAGS, max_chars: int = EDIT_CHARS
) -> DataFrame:
    """Leading tags of each record that fit an editor prompt.

    ``rows`` holds ``(stem, pos, tag)`` with blanks collapsed. Repeats go
    first. Each later tag costs its length and a two-character separator; the
    first tag is always kept.
    """
    distinct = (
        rows.where(F.col("tag") != "").groupBy("stem", "tag").agg(F.min("pos").alias("pos"))
    )
    order = Window.partitionBy("stem").orderBy("pos")
    spent = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        distinct.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_tags)
        .withColumn(
            "chars",
            F.sum(F.char_length("tag") + F.when(F.col("rank") > 1, 2).otherwise(0)).over(spent),
        )
        .where((F.col("rank") == 1) | (F.col("chars") <= max_chars))
    )


def joined_in_order(rows: DataFrame, keys: list[str], order: str, item: str, sep: str) -> DataFrame:
    """One text per group. Use only where the group size has a bound."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))
    return rows.groupBy(*keys).agg(F.array_join(listed["i"], sep).alias("joined"))


def prune_payload(merged: DataFrame) -> DataFrame:
    """Candidate list of each record as JSON; at most the merge limit per record."""
    entry = F.struct(
        "rank",
        F.struct(
            "tag",
            "raw",
            "source",
            "namespace",
            F.round("score", 4).alias("score"),
            F.round("confidence", 4).alias("confidence"),
        ).alias("payload"),
    )
    listed = F.sort_array(F.collect_list(entry))["payload"]
    return merged.groupBy("stem").agg(
        F.to_json(listed, {"ignoreNullFields": "false"}).alias("payload")
    )
