"""File-name expressions: stems, suffixes, output names, run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")
FORMAT_SUFFIX = {"png": ".png", "jpg": ".jpg", "webp": ".webp"}
FORMAT_CODEC = {"png": "PNG", "jpg": "JPEG", "webp": "WEBP"}
SUFFIX_CODEC = {
    ".jpg": "JPEG",
    ".jpeg": "JPEG",
    ".png": "PNG",
    ".webp": "WEBP",
    ".bmp": "BMP",
    ".gif": "GIF",
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _stem_length(name: Column) -> Column:
    return F.char_length(name) - F.char_length(_last_part(name)) - 1


def _has_suffix(name: Column) -> Column:
    # A dot only opens a suffix when something stands on both of its sides.
    return (_last_part(name) != "") & (_stem_length(name) > 0)


def suffix(name: Column) -> Column:
    return F.when(_has_suffix(name), F.concat(F.lit("."), _last_part(name))).otherwise("")


def stem(name: Column) -> Column:
    return F.when(_has_suffix(name), F.substr(name, F.lit(1), _stem_length(name))).otherwise(name)


def _ends_with(name: Column, suffix: str) -> Column:
    return F.endswith(name, F.lit(suffix)) & (F.char_length(name) > len(suffix))


def kind(name: Column) -> Column:
    """``image``, ``metadata`` or NULL for a file of no interest."""
    lower = F.lower(name)
    image = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        image = image | _ends_with(lower, suffix)
    return F.when(is_metadata(name), "metadata").when(image, "image")


def is_image(name: Column) -> Column:
    return F.coalesce(kind(name) == "image", F.lit(False))


def is_metadata(name: Column) -> Column:
    # Only the lower-case suffix marks metadata.
    return _ends_with(name, ".json")


def prepared_name(name: Column, image_format: str) -> Column:
    """Name of the prepared image: kept, or re-suffixed for a target format."""
    if image_format == "original":
        return name
    return F.concat(stem(name), F.lit(FORMAT_SUFFIX[image_format]))


def save_codec(name: Column, image_format: str) -> Column:
    """Codec used on save; NULL when the source suffix is not supported."""
    if image_format != "original":
        return F.lit(FORMAT_CODEC[image_format])
    found = F.lower(suffix(name))
    pairs = iter(SUFFIX_CODEC.items())
    key, codec = next(pairs)
    chosen = F.when(found == key, codec)
    for key, codec in pairs:
        chosen = chosen.when(found == key, codec)
    return chosen


def run_name(number: Column) -> Column:
    # format_string keeps growing past 999; lpad would cut.
    return F.format_string("run-%03d", number)


def padded_id(post_id: Column) -> Column:
    return F.format_string("%012d", post_id)
