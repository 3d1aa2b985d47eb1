"""Reading model replies and writing model requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.text import BLANK, let, non_blank, strip
from tagweave.functions.variants import parse_object

# Labels a reply may start with, tried in this order.
CAPTION_LABELS = ("Corrected caption:", "Caption:", "Output:")
RAW_REPLY_FIELD = "_raw_response"
# Fixed value: layout of an editor request.
EDIT_REQUEST = (
    "Trusted source tags:\n%s\n\nDraft caption:\n%s\n\n"
    "Rewrite the draft as a natural-language training caption."
)


def unfenced(text: Column) -> Column:
    """Reply without its Markdown code fence."""
    cleaned = strip(text)
    opened = strip(F.regexp_replace(cleaned, r"(?i)^```(?:json)?", ""))
    closed = strip(F.regexp_replace(opened, r"```$", ""))
    return F.when(F.startswith(cleaned, F.lit("```")), closed).otherwise(cleaned)


def extract_object(text: Column) -> Column:
    """First JSON object found in a reply, or NULL.

    The whole reply is tried first, then the span from its first ``{`` to its
    last ``}``.
    """
    return let(
        unfenced(text),
        lambda reply: F.coalesce(
            parse_object(reply),
            parse_object(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))),
        ),
    )


def reply_record(text: Column) -> Column:
    """Parsed reply, or the marker record kept for an unreadable one."""
    unreadable = F.to_variant_object(
        F.struct(F.lit(True).alias("parse_error"), strip(text).alias("raw_text"))
    )
    return F.coalesce(extract_object(text), unreadable)


def without_raw_reply(record: Column) -> Column:
    """Record map without the verbatim model reply."""
    return F.map_filter(record, lambda name, _: name != RAW_REPLY_FIELD)


def clean_caption(text: Column) -> Column:
    """Caption without labels, later paragraphs and surrounding quotes."""
    cleaned = strip(text)
    for label in CAPTION_LABELS:
        cleaned = F.regexp_replace(cleaned, rf"(?i)^{label}{BLANK}*", "")
    first = strip(F.substring_index(cleaned, "\n\n", 1))
    return strip(F.btrim(F.btrim(first, F.lit('"')), F.lit("'")))


def final_caption(judged: Column, semantic: Column) -> Column:
    return F.coalesce(non_blank(judged), non_blank(semantic))


def draft_caption(semantic: Column, fallback: Column) -> Column:
    return F.coalesce(semantic, fallback)


def captioning_block(
    caption: Column, draft: Column, caption_backend: Column, editor_backend: Column
) -> Column:
    """Provenance stored with a caption; NULL without one, backends only when known."""
    block = F.struct(
        F.coalesce(F.nullif(draft, F.lit("")), caption).alias("draft_caption"),
        caption.alias("caption"),
        caption_backend.alias("caption_backend"),
        editor_backend.alias("editor_backend"),
    )
    return F.when(caption.isNotNull(), block)


def prune_request(semantic_json: Column, payload_json: Column, max_rejected: int) -> Column:
    """Request asking a judge model to drop unsupported candidate tags."""
    return F.concat(
        F.lit(
            "Keep only the candidate tags the image supports. Answer with one JSON object; "
            f"list at most {max_rejected} rejected tags.\n\nSemantic analysis:\n"
        ),
        semantic_json,
        F.lit("\n\nCandidate tags:\n"),
        payload_json,
    )


def edit_request(tag_text: Column, draft: Column) -> Column:
    """Request asking an editor model to correct a draft caption."""
    return F.format_string(EDIT_REQUEST, tag_text, draft)
