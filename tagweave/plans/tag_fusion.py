"""Tag-fusion job: several tag sources to one ordered list per record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.cluster import dealt
from tagweave.functions import modeltext, tags
from tagweave.operators import fusion


@dataclass(frozen=True)
class Fusion:
    """Long-form results; ``final`` orders a record's tags by ``place``."""

    candidates: DataFrame
    merged: DataFrame
    final: DataFrame
    sources: DataFrame


def needs_art_tagger(semantics: DataFrame) -> DataFrame:
    """Records worth running the art tagger on: everything but photos."""
    return semantics.where(~tags.is_photo(F.col("content_type")))


def fuse(
    requests: DataFrame,
    open_set: DataFrame,
    art: DataFrame,
    semantics: DataFrame,
    judged: DataFrame,
) -> Fusion:
    """Union, score, merge, prune and complete the tags of every record.

    ``requests(stem, context_tags)``, ``open_set(stem, open_set_tags)``,
    ``art`` as routed predictions, ``semantics`` with the semantic fields,
    ``judged(stem, field, pos, raw)`` as the judge's lists. A record the judge
    failed on simply has no judged rows and keeps all merged tags.

    Lists are dealt out by record while they are still one row; all that groups by record and tag, or by record, then stays
    in its task, and no row of a tag is shuffled or left on disk. A record's lists are no longer than rows of the inputs.
    """
    asked = judged.where(F.col("field") == "final_tags").select(
        "stem", F.col("pos").alias("judged_at"), F.array("raw").alias("raws")
    )
    lists = fusion.union_sources(
        fusion.context_lists(requests),
        fusion.open_set_lists(open_set),
        fusion.art_lists(art),
        fusion.semantic_lists(semantics),
    ).unionByName(asked, allowMissingColumns=True)
    tagged = fusion.score_candidates(fusion.list_tags(dealt(lists, "stem")))
    said = F.col("source").isNotNull()
    candidates = tagged.where(said).drop("judged_at")
    merged = fusion.merge_candidates(candidates)
    # Semantic and open-set tags stay whatever the judge said.
    facts = fusion.grouped_facts(
        tagged.select("stem", "tag", "pos", F.when(said, F.col("score")).alias("score"), "source", "judged_at"),
        required=("qwen", "ram++"),
    )
    return Fusion(
        candidates=candidates,
        merged=merged,
        final=fusion.final_tags(facts),
        sources=fusion.source_tags(candidates),
    )


def final_lists(final: DataFrame) -> DataFrame:
    """Ordered tag array per record.

    A list is no longer than the source arrays of its own record plus the
    merge limit, all of which came out of single rows.
    """
    # Taking the field out of the array keeps the sort in compiled code; under a lambda every comparison is interpreted.
    ordered = F.sort_array(F.collect_list(F.struct("place", "tag")))
    return final.groupBy("stem").agg(
        ordered["tag"].alias("tags"),
        F.min("place.block").alias("first_block"),
    ).withColumn("fell_back", F.col("first_block") != 0).drop("first_block")


def source_lists(sources: DataFrame) -> DataFrame:
    """Map source to ordered tags per record, sources by name."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "tag")))["tag"]
    per_source = sources.groupBy("stem", "source").agg(listed.alias("tags"))
    return per_source.groupBy("stem").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "tags")))).alias(
            "source_tags"
        )
    )


def judged_lists(judged: DataFrame, merged: DataFrame) -> DataFrame:
    """Map of the judge's lists per record: field to the candidates that it kept, in order.

    A list holds at most the merge limit of tags and there are eleven fields.
    """
    kept = fusion.prune(judged, merged)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "tag")))["tag"]
    per_field = kept.groupBy("stem", "field").agg(ordered.alias("tags"))
    return per_field.groupBy("stem").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "tags")))).alias("kept_lists")
    )


def stage_errors(errors: DataFrame) -> DataFrame:
    """Errors per record in stage order, with their traceback where one is known.

    A stage fails once per record at most, so the list is as short as the list of stages.
    """
    trace = F.col("traceback") if "traceback" in errors.columns else F.lit(None).cast("string")
    listed = F.array_sort(F.collect_list(F.struct("stage_rank", "stage", "error", trace.alias("traceback"))))
    return errors.groupBy("stem").agg(
        F.transform(
            listed,
            lambda e: F.struct(e["stage"].alias("stage"), e["error"].alias("error"), e["traceback"].alias("traceback")),
        ).alias("errors")
    )


def plugin_errors(results: DataFrame, stage_rank: int) -> DataFrame:
    """Errors of a plug-in's results in the form of :func:`stage_errors`."""
    failed = results.where(F.col("error").isNotNull())
    return failed.select("stem", F.lit(stage_rank).alias("stage_rank"), "error.stage", "error.error", "error.traceback")


# Fixed value: what stands beside the tags when the judge failed.
JUDGE_STAGE = "qwen_prune"
NO_LISTS = "map<string,array<string>>"


def results(
    fused: Fusion,
    requests: DataFrame,
    semantics: DataFrame,
    judgements: DataFrame,
    judged: DataFrame,
    errors: DataFrame,
    *,
    caption_backend: str,
    editor_backend: str,
) -> DataFrame:
    """One result per request, with captions and the sidecar record.

    ``requests(stem)`` decides which records come out, whether or not they have
    tags. ``semantics`` and ``judgements(stem, caption, ...)`` hold the replies;
    all their columns but a raw reply go into the sidecar. ``judged(stem, field,
    pos, raw)`` holds the judge's lists. A record with an error of the judge keeps
    all merged tags and says so; that is no fallback.
    """
    told = semantics.select("stem", F.struct(*_replies(semantics)).alias("semantic"), F.col("caption").alias("semantic_caption"))
    said = judgements.select("stem", F.struct(*_replies(judgements)).alias("judgement"), F.col("caption").alias("judged_caption"))
    joined = (
        requests.select("stem")
        .join(final_lists(fused.final), "stem", "left")
        .join(source_lists(fused.sources), "stem", "left")
        .join(told, "stem", "left")
        .join(said, "stem", "left")
        .join(judged_lists(judged, fused.merged), "stem", "left")
        .join(stage_errors(errors), "stem", "left")
    )
    none = F.array().cast("array<string>")
    all_tags = F.coalesce("tags", none)
    listed = F.coalesce("errors", F.array().cast("array<struct<stage:string,error:string,traceback:string>>"))
    broken = F.get(F.filter(listed, lambda e: e["stage"] == JUDGE_STAGE), F.lit(0))
    failed = broken.isNotNull()
    lists = F.when(failed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))).otherwise(
        F.coalesce("kept_lists", F.create_map().cast(NO_LISTS))
    )
    empty = F.coalesce(F.size(F.try_element_at(lists, F.lit("final_tags"))), F.lit(0)) == 0
    final = _merged_object(
        F.when(~failed, F.col("judgement")),
        F.map_concat(F.map_filter(lists, lambda name, _: name != "final_tags"), F.create_map(F.lit("final_tags"), all_tags)),
        F.struct(
            broken["error"].alias("error"),
            broken["traceback"].alias("traceback"),
            F.when(failed, "the judge failed; all merged tags are kept").alias("note"),
        ),
    )
    caption = modeltext.final_caption(F.when(~failed, F.col("judged_caption")), F.col("semantic_caption"))
    sidecar = F.map_filter(
        F.create_map(
            F.lit("semantic"), F.parse_json(F.coalesce(F.to_json("semantic"), F.lit("{}"))),
            F.lit("final"), final,
            F.lit("source_tags"), F.parse_json(F.to_json(F.coalesce("source_tags", F.create_map().cast(NO_LISTS)))),
            F.lit("errors"), F.parse_json(F.to_json(listed)),
            F.lit("tag_fallback"), F.when(empty & ~failed & (F.size(all_tags) > 0), F.parse_json(F.lit('"merged_model_outputs"'))),
        ),
        lambda _, value: value.isNotNull(),
    )
    return joined.select(
        "stem",
        all_tags.alias("tags"),
        caption.alias("caption"),
        modeltext.draft_caption(F.col("semantic_caption"), caption).alias("draft_caption"),
        F.lit(caption_backend).alias("caption_backend"),
        F.lit(editor_backend).alias("editor_backend"),
        F.to_variant_object(sidecar).alias("sidecar"),
    )


def _replies(records: DataFrame) -> list[Column]:
    return [F.col(name) for name in records.columns if name not in ("stem", modeltext.RAW_REPLY_FIELD)]


def _merged_object(*parts: Column) -> Column:
    """One VARIANT object out of structs and maps; members of later ones win, NULL ones are left out."""
    maps = [
        F.coalesce(
            F.try_variant_get(F.try_parse_json(F.to_json(part)), "$", "map<string,variant>"),
            F.create_map().cast("map<string,variant>"),
        )
        for part in parts
    ]
    return F.to_variant_object(reduce(_overlaid, maps))


def _overlaid(members: Column, later: Column) -> Column:
    others = F.map_filter(members, lambda name, _: ~F.array_contains(F.map_keys(later), name))
    return F.map_concat(others, later)
