"""Where models and importers plug in.

A tagger maps requests ``(stem, image_path, context_tags)`` to results
``(stem, tags, caption, draft_caption, caption_backend, editor_backend, error)``.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.errors import CurationError

Tagger = Callable[[DataFrame], DataFrame]
Importer = Callable[..., tuple[DataFrame, DataFrame]]

PRESETS = ("natural_language", "image_tags")
_TEXTS = ("caption", "draft_caption", "caption_backend", "editor_backend")
_ERROR = ("stage", "error", "traceback")


def model_tagger(load: Callable[[], Callable[[str, list[str]], Mapping]], stage: str) -> Tagger:
    """Tagger around a Python model of one record, loaded once per task.

    ``load`` returns a function of image path and context tags. An error while
    loading or tagging becomes an error field; the record goes on. The worker
    function refers to nothing of this package, so executors need not have it.
    """

    def load_batches() -> Callable[[list[Mapping]], list[Mapping]]:
        model = load()
        return lambda requests: [model(r["image_path"], r["context_tags"]) for r in requests]

    return batch_tagger(load_batches, stage, batch_size=1)


def batch_tagger(
    load: Callable[[], Callable[[list[Mapping]], list[Mapping]]], stage: str, batch_size: int = 64
) -> Tagger:
    """Tagger around a Python model of many records, loaded once per task.

    ``load`` returns a function of up to ``batch_size`` requests (mappings with ``stem``,
    ``image_path`` and ``context_tags``) that gives one result each. A batch that
    raises is cut in halves that are tried again, so the error stays with its record and one bad record
    costs two calls per halving. Batches are filled across the Arrow batches of a task.
    """
    texts, parts = list(_TEXTS), list(_ERROR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error_type = pa.struct([(name, pa.string()) for name in parts])
        shape = pa.schema(
            [("stem", pa.string()), ("tags", pa.list_(pa.string()))]
            + [(name, pa.string()) for name in texts]
            + [("error", error_type)]
        )

        def failed(error: Exception, where: str) -> dict:
            return dict(zip(parts, (where, repr(error), traceback.format_exc())))

        model, load_error = None, None
        try:
            model = load()
        except Exception as error:  # noqa: BLE001 - reported per record
            load_error = failed(error, f"{stage}_load")

        def answers(requests: list[dict]) -> list[dict]:
            try:
                found = list(model(requests))
                if len(found) != len(requests):
                    raise ValueError(f"{len(found)} results for {len(requests)} requests")
                return [dict(one) for one in found]
            except Exception as error:  # noqa: BLE001 - reported per record
                if len(requests) == 1:
                    return [{"error": failed(error, stage)}]
            half = len(requests) // 2
            return answers(requests[:half]) + answers(requests[half:])

        def tagged(requests: list[dict]) -> pa.RecordBatch:
            rows = [{"stem": request["stem"], "tags": [], "error": load_error} for request in requests]
            if model is not None:
                for row, found in zip(rows, answers(requests)):
                    row.update(found)
            return pa.RecordBatch.from_pylist(rows, schema=shape)

        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            full = len(held) - len(held) % batch_size
            for first in range(0, full, batch_size):
                yield tagged(held[first : first + batch_size])
            held = held[full:]
        if held:
            yield tagged(held)

    schema = (
        "stem STRING, tags ARRAY<STRING>, "
        + ", ".join(f"{name} STRING" for name in _TEXTS)
        + f", error STRUCT<{', '.join(f'{name}: STRING' for name in _ERROR)}>"
    )
    return lambda requests: requests.select("stem", "image_path", "context_tags").mapInArrow(run, schema)


def composite(taggers: Sequence[Tagger]) -> Tagger:
    """All tags of several taggers in order; the last caption given wins."""

    def run(requests: DataFrame) -> DataFrame:
        parts = [t(requests).withColumn("tagger", F.lit(i)) for i, t in enumerate(taggers)]
        caption = F.struct("caption", "draft_caption", "caption_backend", "editor_backend")
        told = F.max_by(caption, F.when(F.col("caption").isNotNull(), F.col("tagger")))
        # One entry per tagger, and the list of taggers is fixed.
        listed = F.array_sort(F.collect_list(F.struct("tagger", "tags")))
        return (
            reduce(DataFrame.unionByName, parts)
            .groupBy("stem")
            .agg(
                listed.alias("listed"),
                told.alias("told"),
                F.min_by("error", F.when(F.col("error").isNotNull(), F.col("tagger"))).alias("error"),
            )
            .select(
                "stem",
                F.array_distinct(F.flatten(F.transform("listed", lambda e: e["tags"]))).alias("tags"),
                "told.*",
                "error",
            )
        )

    return run


def build_tagger(presets: Sequence[str] | None, registry: Mapping[str, Tagger]) -> Tagger:
    """Tagger for a list of presets; natural language replaces the whole list."""
    chosen = list(presets) if presets is not None else ["image_tags"]
    if not chosen:
        raise CurationError("Name a caption preset")
    for name in chosen:
        if name not in PRESETS:
            raise CurationError(f"No caption preset {name}; there are {', '.join(PRESETS)}")
    if "natural_language" in chosen:
        return registry["natural_language"]
    return composite([registry[name] for name in chosen])


def find_importer(name: str, registry: Mapping[str, Importer]) -> Importer:
    """Importer by name or alias."""
    if name not in registry:
        raise CurationError(f"No importer named {name}")
    return registry[name]
