"""Image geometry as arithmetic columns; no pixels are touched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.errors import CurationError

MODES = ("copy", "fit", "center-crop", "pad")
IMAGE_FORMATS = ("original", "png", "jpg", "webp")


@dataclass(frozen=True)
class PrepareConfig:
    """Options of a prepare job."""

    mode: str = "fit"
    width: int | None = 512
    height: int | None = 512
    image_format: str = "original"
    trigger: str = ""
    prompt_type: str = "all"
    remove_overlays: bool = True

    def validated(self) -> "PrepareConfig":
        from tagweave.functions.prompts import PROMPT_TYPES

        sized = self.width is not None or self.height is not None
        problems = [
            (self.mode not in MODES, f"Unsupported prepare mode: {self.mode}"),
            (self.image_format not in IMAGE_FORMATS, f"Unsupported image format: {self.image_format}"),
            (self.prompt_type not in PROMPT_TYPES, f"Unsupported prompt type: {self.prompt_type}"),
            (
                self.mode == "copy" and self.image_format != "original",
                "copy mode keeps the original image format",
            ),
            (self.mode == "copy" and sized, "copy mode takes neither width nor height"),
            (self.mode != "copy" and not sized, f"{self.mode} mode needs a width or a height"),
        ]
        for name in ("width", "height"):
            side = getattr(self, name)
            problems.append((side is not None and side <= 0, f"{name} must be greater than zero"))
        for failed, message in problems:
            if failed:
                raise CurationError(message)
        return self


def _side(value: Column) -> Column:
    # Half-even rounding, at least one pixel.
    return F.greatest(F.lit(1), F.rint(value).cast("int"))


def fit_size(width: Column, height: Column, box_w: int | None, box_h: int | None) -> Column:
    """Size after shrinking or growing into a box that may lack one side."""
    target_w = F.lit(box_w) if box_w is not None else _side(width * (F.lit(box_h) / height))
    target_h = F.lit(box_h) if box_h is not None else _side(height * (F.lit(box_w) / width))
    scale = F.least(target_w / width, target_h / height)
    return F.struct(_side(width * scale).alias("width"), _side(height * scale).alias("height"))


def box_size(box_w: int | None, box_h: int | None) -> tuple[int, int]:
    """Target box; a missing side mirrors the other."""
    if box_w is None and box_h is None:
        raise CurationError("a box needs a width or a height")
    return (box_h if box_w is None else box_w), (box_w if box_h is None else box_h)


def pad_plan(width: Column, height: Column, box_w: int, box_h: int, mode: Column) -> Column:
    """Placement of the fitted image on its canvas, and the canvas colour."""
    inner = fit_size(width, height, box_w, box_h)
    return F.struct(
        inner["width"].alias("inner_width"),
        inner["height"].alias("inner_height"),
        F.floor((F.lit(box_w) - inner["width"]) / 2).alias("left"),
        F.floor((F.lit(box_h) - inner["height"]) / 2).alias("top"),
        F.when(mode == "RGBA", "RGBA(0,0,0,0)").otherwise("RGB(255,255,255)").alias("background"),
    )


def crop_window(width: Column, height: Column, box_w: int, box_h: int) -> Column:
    """Centred window of the target aspect ratio, in source pixels."""
    live = width / height
    wanted = F.lit(box_w / box_h)
    crop_w = F.when(live > wanted, wanted * height).otherwise(width.cast("double"))
    crop_h = F.when(live < wanted, width / wanted).otherwise(height.cast("double"))
    return F.struct(
        ((width - crop_w) / 2).alias("left"),
        ((height - crop_h) / 2).alias("top"),
        crop_w.alias("width"),
        crop_h.alias("height"),
    )


def square_plan(width: Column, height: Column) -> Column:
    """Square canvas around an image and the image's offset on it."""
    side = F.greatest(width, height)
    return F.struct(
        side.alias("side"),
        F.floor((side - width) / 2).alias("left"),
        F.floor((side - height) / 2).alias("top"),
    )


def alpha_blocks_jpg(mode: Column, has_transparency: Column, image_format: str) -> Column:
    """True where converting to jpg would drop transparency."""
    if image_format != "jpg":
        return F.lit(False)
    return mode.isin("RGBA", "LA") | ((mode == "P") & F.coalesce(has_transparency, F.lit(False)))


def output_size(width: Column, height: Column, config: PrepareConfig) -> Column:
    """Size of the prepared image under a config."""
    if config.mode == "copy":
        return F.struct(width.alias("width"), height.alias("height"))
    if config.mode == "fit":
        return fit_size(width, height, config.width, config.height)
    box_w, box_h = box_size(config.width, config.height)
    return F.struct(F.lit(box_w).alias("width"), F.lit(box_h).alias("height"))


def scaled_size(width: Column, height: Column, factor: float) -> Column:
    """Working size of one multi-scale detection pass."""
    return F.struct(_side(width * F.lit(factor)).alias("width"), _side(height * F.lit(factor)).alias("height"))
