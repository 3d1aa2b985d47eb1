"""Tag expressions: normalising, typed reading, merging, authority, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.text import BLANK, BLANKS, collapse, fold, let, strip

# ---------------------------------------------------------------------------
# Fixed values.
TAG_TRIM = " ,.;:|"
TAG_ALIASES = {
    "automobile": "car",
    "auto": "car",
    "motorcar": "car",
    "bike": "bicycle",
    "cycle": "bicycle",
    "cellphone": "mobile phone",
    "cell phone": "mobile phone",
    "smartphone": "mobile phone",
    "tv": "television",
    "sofa": "couch",
    "settee": "couch",
    "kitty": "cat",
    "kitten": "cat",
    "puppy": "dog",
    "canine": "dog",
    "human": "person",
    "people": "person",
    "man": "male-presenting person",
    "woman": "female-presenting person",
    "boy": "male-presenting child",
    "girl": "female-presenting child",
    "1girl": "female-presenting person",
    "1boy": "male-presenting person",
    "2girls": "multiple female-presenting people",
    "2boys": "multiple male-presenting people",
    "multiple girls": "multiple female-presenting people",
    "multiple boys": "multiple male-presenting people",
    "solo": "solo subject",
}
CATEGORY_ORDER = (
    "general",
    "species",
    "character",
    "copyright",
    "artist",
    "meta",
    "lore",
    "invalid",
    "contributor",
)
IMPORT_CATEGORIES = ("general", "meta")
CATEGORY_NAMES = {
    0: "general",
    1: "artist",
    3: "copyright",
    4: "character",
    5: "meta",
    9: "rating",
}
# (source, namespaces, authority); None stands for every other namespace.
AUTHORITY = (
    ("qwen", ("medium", "style", "scene", "composition", "abstract", "visible_text"), 0.95),
    ("qwen", None, 0.82),
    ("ram++", ("object", "objects", "scene"), 0.90),
    ("ram++", None, 0.72),
    ("smilingwolf", ("booru", "booru_general", "pose", "clothing", "composition"), 0.86),
    ("smilingwolf", ("character", "characters"), 0.72),
    ("smilingwolf", ("rating",), 0.65),
    ("smilingwolf", None, 0.76),
    ("metadata", None, 0.88),
)
OTHER_AUTHORITY = 0.5
MISSING_CONFIDENCE = 0.75
CONTEXT_CONFIDENCE = 0.92
OPEN_SET_CONFIDENCE = 0.78
SEMANTIC_CONFIDENCE = 0.82
# ---------------------------------------------------------------------------


def _cleaned(raw: Column) -> Column:
    """Lower-cased, single-spaced tag without punctuation at its ends."""
    # Blanks at the ends become spaces, which the last trim takes as well.
    spaced = collapse(F.replace(F.lower(raw), F.lit("_"), F.lit(" ")))
    return F.btrim(spaced, F.lit(TAG_TRIM))


def _aliased(tag: Column) -> Column:
    aliases = F.create_map(*[F.lit(part) for pair in TAG_ALIASES.items() for part in pair])
    return F.coalesce(F.try_element_at(aliases, tag), tag)


def normalize_tag(raw: Column) -> Column:
    """Cleaned tag with its alias applied once."""
    return _aliased(_cleaned(raw))


def is_empty_tag(raw: Column) -> Column:
    """Whether a raw tag normalises to nothing: it holds blanks and punctuation only.

    Cheaper than normalising, so filters on it cost little when pushed down.
    """
    return F.btrim(raw, F.lit(BLANKS + "_" + TAG_TRIM)) == ""


def normalize_list(raw: Column) -> Column:
    # Two passes: inside a lambda a shared expression would be computed twice.
    return F.transform(F.transform(raw, _cleaned), _aliased)


def unique_in_order(items: Column) -> Column:
    """Drop blanks and case-insensitive repeats, keeping each first spelling.

    Sorting (key, position) pairs puts repeats side by side, so a list of n
    tags costs n log n instead of comparing every pair.
    """
    keyed = F.transform(
        items, lambda item, at: F.struct(fold(item).alias("key"), at.alias("at"), item.alias("item"))
    )
    kept = let(
        F.array_sort(F.filter(keyed, lambda entry: entry["key"] != "")),
        lambda entries: F.filter(
            entries,
            lambda entry, i: (i == 0) | (F.get(entries, i - 1)["key"] != entry["key"]),
        ),
    )
    ordered = F.array_sort(F.transform(kept, lambda e: F.struct(e["at"].alias("at"), e["item"].alias("item"))))
    return F.transform(ordered, lambda entry: entry["item"])


def clean_list(items: Column) -> Column:
    """Normalised tag list without blanks or repeats; NULL counts as empty."""
    present = F.filter(items, lambda item: item.isNotNull() & (strip(item) != ""))
    normal = normalize_list(present)
    # A normalised tag is its own comparison key, so hashing suffices here.
    return F.coalesce(F.array_remove(F.array_distinct(normal), ""), F.array().cast("array<string>"))


def split_piped(text: Column) -> Column:
    """Tags of one ``a | b | c`` reply."""
    return clean_list(F.split(text, rf"{BLANK}*\|{BLANK}*"))


def split_free_text(text: Column) -> Column:
    """Tags of a free-text reply after an optional short ``label:``."""
    unlabelled = F.regexp_replace(strip(text), rf"^[^:]{{0,40}}:{BLANK}*", "")
    pieces = F.transform(
        F.split(unlabelled, r"[,;\n]+"), lambda piece: strip(F.btrim(strip(piece), F.lit(".")))
    )
    return F.array_remove(F.array_distinct(pieces), "")


def content_type_tags(content_type: Column) -> Column:
    """The content type as a one-tag list, unless it is empty or unknown."""
    none = F.array().cast("array<string>")
    tag = normalize_tag(content_type)
    return F.when(tag.isNull() | tag.isin("", "unknown"), none).otherwise(F.array(tag))


def is_photo(content_type: Column) -> Column:
    return normalize_tag(F.coalesce(content_type, F.lit(""))) == "photo"


def naturalize(tag: Column) -> Column:
    return F.replace(tag, F.lit("_"), F.lit(" "))


def expand_underscores(tags: Column) -> Column:
    """Each underscored tag followed by its spaced form, exact repeats dropped."""
    pairs = F.transform(
        tags,
        lambda tag: F.when(F.contains(tag, F.lit("_")), F.array(tag, naturalize(tag))).otherwise(
            F.array(tag)
        ),
    )
    return F.array_distinct(F.flatten(pairs))


def merge_into(existing: Column, new: Column) -> Column:
    return F.array_union(existing, new)


def added_tags(existing: Column, new: Column) -> Column:
    return F.array_except(new, existing)


def with_required(tags: Column, *required: Column) -> Column:
    return F.array_distinct(F.concat(tags, *required))


def final_or_fallback(final: Column, merged: Column) -> Column:
    """Judged tags, or every merged candidate when none was kept."""
    return F.when(F.size(final) > 0, final).otherwise(merged)


def flatten_categories(by_category: Column) -> Column:
    """Category map to one list: the nine known categories, then the rest by name."""
    order = F.array(*[F.lit(name) for name in CATEGORY_ORDER])

    def ranked(entry: Column) -> Column:
        known = F.array_position(order, entry["key"])
        rank = F.when(known == 0, len(CATEGORY_ORDER) + 1).otherwise(known)
        return F.struct(rank.alias("rank"), entry["key"].alias("name"), entry["value"].alias("tags"))

    entries = F.array_sort(F.transform(F.map_entries(by_category), ranked))
    return F.flatten(F.transform(entries, lambda entry: entry["tags"]))


def keep_import_categories(by_category: Column) -> Column:
    return F.map_filter(by_category, lambda name, _: name.isin(*IMPORT_CATEGORIES))


def authority(source: Column, namespace: Column) -> Column:
    """How far a model is trusted in a namespace."""
    chosen = None
    for name, namespaces, weight in AUTHORITY:
        hit = source == name
        if namespaces is not None:
            hit = hit & namespace.isin(*namespaces)
        chosen = F.when(hit, weight) if chosen is None else chosen.when(hit, weight)
    return chosen.otherwise(OTHER_AUTHORITY)


def score(confidence: Column, weight: Column) -> Column:
    sure = F.coalesce(confidence.cast("double"), F.lit(MISSING_CONFIDENCE))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)) * weight


def category_name(category: Column) -> Column:
    names = F.create_map(*[F.lit(part) for pair in CATEGORY_NAMES.items() for part in pair])
    return F.coalesce(F.try_element_at(names, category), F.lit("unknown"))
