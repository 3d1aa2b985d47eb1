"""Prompt composition for manifest rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.functions.tags import expand_underscores, naturalize
from tagweave.functions.text import strip

PROMPT_TYPES = ("tags", "natural", "caption", "all")


def manifest_tags(tags: Column, prompt_type: str) -> Column:
    """Tag list stored beside the prompt."""
    if prompt_type == "tags":
        return tags
    if prompt_type in ("natural", "caption"):
        return F.transform(tags, naturalize)
    return expand_underscores(tags)


def caption_with_trigger(caption: Column, trigger: str) -> Column:
    return caption if trigger == "" else F.concat(F.lit(f"{trigger}. "), caption)


def build_prompt(tags: Column, caption: Column, trigger: str, prompt_type: str) -> Column:
    """Training prompt of one record."""
    if prompt_type not in PROMPT_TYPES:
        raise CurationError(f"Unsupported prompt type: {prompt_type}")
    named = tags if trigger == "" else F.concat(F.array(F.lit(trigger)), tags)
    raw = F.array_join(named, ", ")
    natural = F.array_join(F.transform(named, naturalize), ", ")
    text = F.nullif(strip(caption), F.lit(""))
    told = caption_with_trigger(text, trigger)
    if prompt_type == "tags":
        return raw
    if prompt_type == "natural":
        return natural
    if prompt_type == "caption":
        return F.coalesce(told, natural)
    return F.concat_ws(". ", F.nullif(raw, F.lit("")), F.nullif(natural, F.lit("")), told)
