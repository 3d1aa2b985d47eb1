"""Candidate regions of an image: gates, ranking, likeness, near repeats."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.cluster import broadcast_if_small, cut_lineage
from tagweave.functions import overlay

BOX = ("x1", "y1", "x2", "y2")


def rank_regions(regions: DataFrame, limit: int = overlay.MAX_REGIONS) -> DataFrame:
    """Largest allowed regions per image, weighted towards the edges.

    ``regions`` holds ``(image_id, component_id, x, y, w, h, area, width,
    height)``. The row_number limit is applied in every task before the shuffle.
    """
    edge = overlay.edge_affinity(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    order = Window.partitionBy("image_id").orderBy(F.col("rank_weight").desc(), "component_id")
    return (
        regions.where(overlay.area_allowed(F.col("area"), F.col("width"), F.col("height")))
        .withColumn("rank_weight", overlay.rank_weight(F.col("area"), edge))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def similar_counts(regions: DataFrame) -> DataFrame:
    """Per (image, area), how many regions of the image have a like area.

    Instead of joining regions to regions, areas are counted first and a
    running count is read off at both ends of each area's range. What one
    window sees is bounded by the distinct whole-number areas of one image.
    """
    sizes = regions.groupBy("image_id", "area").agg(F.count("*").alias("n"))
    area = F.greatest(F.lit(1), F.col("area"))

    # Smallest and largest whole area whose ratio is still in range; stepping
    # by one around the product settles what rounding leaves open.
    def fits(other: Column) -> Column:
        ratio = other / area
        return (ratio >= overlay.SIMILAR_LOW) & (ratio <= overlay.SIMILAR_HIGH)

    near_low = F.floor(area * overlay.SIMILAR_LOW)
    near_high = F.ceil(area * overlay.SIMILAR_HIGH)
    low = F.coalesce(
        *[F.when(fits(near_low + step), near_low + step) for step in (-1, 0, 1)], near_low + 2
    )
    high = F.coalesce(
        *[F.when(fits(near_high + step), near_high + step) for step in (1, 0, -1)], near_high - 2
    )
    none = F.lit(None).cast(sizes.schema["area"].dataType)
    zero = F.lit(0).cast("long")
    marks = F.array(
        # Reads before the counts at the low end, after them at the high end.
        F.struct(low.cast("long").alias("at"), F.lit(0).alias("turn"), zero.alias("n"), F.col("area").alias("of"), F.lit(-1).alias("sign")),
        F.struct(F.col("area").cast("long").alias("at"), F.lit(1).alias("turn"), F.col("n"), none.alias("of"), F.lit(0).alias("sign")),
        F.struct(high.cast("long").alias("at"), F.lit(2).alias("turn"), zero.alias("n"), F.col("area").alias("of"), F.lit(1).alias("sign")),
    )
    order = (
        Window.partitionBy("image_id")
        .orderBy("at", "turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sizes.select("image_id", F.explode(marks).alias("mark"))
        .select("image_id", "mark.*")
        .withColumn("running", F.sum("n").over(order))
        .where(F.col("of").isNotNull())
        .groupBy("image_id", F.col("of").alias("area"))
        .agg(F.sum(F.col("running") * F.col("sign")).alias("similar"))
    )


# --- near repeats -----------------------------------------------------------

#: Two boxes that overlap by more than NEAR_IOU have sides that differ by less than this factor, ...
_SIDE_RATIO = 1 / overlay.NEAR_IOU
#: ... and corners less than this share of either one's side apart. Both are widened a little against rounding.
_REACH = (1 / overlay.NEAR_IOU - 1) * 1.01
#: Boxes that a group may hold and still be one tile.
TILE_ROWS = 20_000
#: Widest and narrowest tiles, in sides of the smallest boxes of their size; the narrowest are still wider than a reach.
_WIDEST, _NARROWEST = 12.0, 0.8
#: Boxes of one tile have sides within this factor of each other.
_TILE_SIDES = 3.3
_TILE = ("tile_w", "tile_h", "tile_x", "tile_y")
#: Candidates that a task compares at once.
_PAIRS = 200_000


def _tiles_along(low: Column, side: Column, width: Column) -> Column:
    """Tiles (size, place, own) that a box may have near boxes in along one axis; ``width`` in sides, null for one tile."""
    side = F.greatest(side, F.lit(1)).cast("double")
    level = F.ln(side) / math.log(_TILE_SIDES)
    step = math.log(_SIDE_RATIO) * 1.01 / math.log(_TILE_SIDES)
    own_size = F.floor(level).cast("int")

    def place(at: Column, size: Column) -> Column:
        return F.floor(at / (width * F.pow(F.lit(_TILE_SIDES), size))).cast("long")

    sizes = F.array_distinct(F.array(own_size, F.floor(level - step).cast("int"), F.floor(level + step).cast("int")))
    reach = side * _REACH
    places = F.flatten(F.transform(sizes, lambda size: F.transform(
        F.array_distinct(F.array(place(low, size), place(low - reach, size), place(low + reach, size))),
        lambda at: F.struct(size.alias("size"), at.alias("place"), ((size == own_size) & (at == place(low, size))).alias("own")),
    )))
    one = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("own")))
    return F.when(width.isNull(), one).otherwise(places)


def _tiles() -> Column:
    """Every tile that a box belongs to or borders on, with ``own``: whether it is its own."""
    x = _tiles_along(F.col("x1"), F.col("x2") - F.col("x1") + 1, F.col("width"))
    y = _tiles_along(F.col("y1"), F.col("y2") - F.col("y1") + 1, F.col("width"))
    return F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(
        a["size"].alias("tile_w"), b["size"].alias("tile_h"), a["place"].alias("tile_x"), b["place"].alias("tile_y"), (a["own"] & b["own"]).alias("own"),
    ))))


def _settle(keys: list[str], columns: list[str]):
    """Function over batches sorted by tile and order: what first-come selection can tell of each tile's own boxes.

    A box is kept if no earlier near box is kept or open, dropped if one is kept, else open. Border boxes of
    other tiles are open unless they are known as kept. It refers to nothing of this package, so executors need not have it.
    """
    names, bar, share, pairs = list(BOX), overlay.NEAR_IOU, _REACH, _PAIRS

    def candidates(lefts: np.ndarray, reach: np.ndarray, tile: np.ndarray, by_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``by_x``, which sorts boxes by tile and left side, those of a box's tile begin and end that are within its reach."""
        steps = np.unique(lefts)
        base = tile * (len(steps) + 1)
        at = (base + np.searchsorted(steps, lefts))[by_x]
        low = np.searchsorted(at, base + np.searchsorted(steps, lefts - reach))
        return low, np.maximum(low, np.searchsorted(at, base + np.searchsorted(steps, lefts + reach, "right")))

    def told(boxes: np.ndarray, own: np.ndarray, known: np.ndarray, tile: np.ndarray) -> np.ndarray:
        """0 dropped, 1 kept, 2 open of boxes, which stand in order within their tiles.

        Near boxes are found for many boxes at once, a block of at most ``pairs`` candidates or one box at a time; boxes dropped
        by an earlier block are not looked at again. What a box does to later ones is then told box by box.
        """
        by_x = np.lexsort((boxes[:, 0], tile))
        reach = (boxes[:, 2] - boxes[:, 0] + 1) * share
        low, high = candidates(boxes[:, 0], reach, tile, by_x)
        areas = (boxes[:, 2:] - boxes[:, :2] + 1).prod(axis=1)
        found = np.ones(len(boxes), np.int8)
        shaded = np.zeros(len(boxes), bool)
        ends = np.cumsum(high - low)
        begin = 0
        while begin < len(boxes):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + pairs, "right")))
            ones = begin + np.flatnonzero(found[begin:end])
            counts = (high - low)[ones]
            one = np.repeat(ones, counts)
            other = by_x[np.arange(counts.sum()) + np.repeat(low[ones] - np.cumsum(counts) + counts, counts)]
            later = other > one
            one, other = one[later], other[later]
            corner = np.minimum(boxes[other, 2:], boxes[one, 2:]) - np.maximum(boxes[other, :2], boxes[one, :2]) + 1
            inter = np.clip(corner, 0, None).prod(axis=1)
            near = inter / np.maximum(areas[other] + areas[one] - inter, 1) > bar
            one, other = one[near], other[near]
            cuts = np.searchsorted(one, np.arange(begin, end + 1))
            # a box that is near no later one changes nothing, and shows at the end of its block whether it is open itself
            for i in np.unique(one):
                if not found[i]:
                    continue
                those = other[cuts[i - begin] : cuts[i - begin + 1]]
                if known[i] or (own[i] and not shaded[i]):
                    found[those] = 0
                else:
                    shaded[those] = True
            block = slice(begin, end)
            found[block][(found[block] == 1) & ~known[block] & (~own[block] | shaded[block])] = 2
            begin = end
        return found

    def settled(table: pa.Table) -> pa.RecordBatch:
        """Own boxes that are not dropped, with ``kept``, out of a table of whole tiles."""
        boxes = np.column_stack([table[name].to_numpy().astype(np.float64) for name in names])
        own, known = (table[name].to_numpy().astype(bool) for name in ("own", "kept"))
        change = np.zeros(len(boxes), bool)
        for name in keys:
            codes = table[name].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        tile = np.cumsum(change)
        by_x = np.lexsort((boxes[:, 0], tile))
        # a box whose neighbours to the left and right of it are out of reach is near none
        apart = np.full(len(boxes) + 1, np.inf)
        same = tile[by_x[1:]] == tile[by_x[:-1]]
        apart[1:-1][same] = np.diff(boxes[by_x, 0])[same]
        reach = ((boxes[:, 2] - boxes[:, 0] + 1) * share)[by_x]
        close = np.zeros(len(boxes), bool)
        close[by_x] = (apart[:-1] <= reach) | (apart[1:] <= reach)
        found = np.ones(len(boxes), np.int8)
        rows = np.flatnonzero(close)
        found[rows] = told(boxes[rows], own[rows], known[rows], tile[rows])
        take = np.flatnonzero(own & (found > 0))
        chosen = table.select(columns).take(pa.array(take)).append_column("kept", pa.array(found[take] == 1)).combine_chunks()
        return chosen.to_batches()[0] if take.size else pa.RecordBatch.from_pylist([], schema=chosen.schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last tile of a batch may go on in the next one
            end = [batch[name][batch.num_rows - 1] for name in keys]
            cut = batch.num_rows
            while cut and [batch[name][cut - 1] for name in keys] == end:
                cut -= 1
            first = [batch[name][0] for name in keys]
            if held and first != [held[-1][name][held[-1].num_rows - 1] for name in keys]:
                yield settled(pa.Table.from_batches(held))
                held = []
            if cut:
                yield settled(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield settled(pa.Table.from_batches(held))

    return keep


def drop_near_repeats(
    boxes: DataFrame,
    keys: tuple[str, ...] = ("image_id", "frame"),
    order: tuple[str, ...] = ("pos",),
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Boxes ``(keys, order, x1, y1, x2, y2)`` overlapping no earlier kept box of their group.

    Equal boxes collapse to their earliest first. A group is dealt out in tiles of boxes of like size and place; one of
    up to ``tile_rows`` boxes is one tile, and the tiles of larger ones get narrower with the root of their size. A task settles
    whole tiles, with the boxes of other tiles that border on them. What hangs on an open border box stays open, and the
    next round looks at the tiles of open boxes again, with what is known by then. So rounds follow the tiles that a
    chain of near boxes runs through, and most inputs take one.
    """
    names = list(keys)
    columns = [*names, *order, *BOX]
    sizes = boxes.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > tile_rows)
    large = cut_lineage(sizes)
    tiled = bool(large.take(1))
    distinct = boxes.groupBy(*names, *BOX).agg(F.min(F.struct(*order)).alias("pos")).select(*names, "pos.*", *BOX)
    width = F.lit(None).cast("double")
    if tiled:
        narrow = F.lit(_WIDEST) * F.sqrt(F.lit(float(tile_rows)) / F.col("n"))
        widths = large.select(*[F.col(c).alias(f"large_{c}") for c in names], F.greatest(narrow, F.lit(_NARROWEST)).alias("width"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"large_{c}")) for c in names])
        distinct = distinct.join(broadcast_if_small(widths), same, "left").select(*columns, "width")
        width = F.col("width")
    open_boxes = distinct.select(*columns, width.alias("width"), F.lit(False).alias("kept"))
    if not tiled:
        return _round(open_boxes, names, order, columns).drop("kept", "width")
    kept_rounds: list[DataFrame] = []
    while True:
        found = cut_lineage(_round(open_boxes, names, order, columns, kept_rounds))
        kept_rounds.append(found.where("kept"))
        open_boxes = found.where("NOT kept")
        if not open_boxes.take(1):
            return reduce(DataFrame.unionByName, kept_rounds).select(*columns)


def _round(open_boxes: DataFrame, names: list[str], order: tuple[str, ...], columns: list[str], kept: list[DataFrame] = ()) -> DataFrame:
    """Open boxes after their tiles were settled once, without those dropped; ``kept`` are those of earlier rounds."""
    at = [*names, *_TILE]
    placed = open_boxes.select("*", F.inline(_tiles()))
    if kept:
        known = reduce(DataFrame.unionByName, kept).select("*", F.inline(_tiles()))
        tiles = placed.where("own").select(*[F.col(c).alias(f"open_{c}") for c in at]).distinct()
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"open_{c}")) for c in at])
        # a known box is a border box everywhere: it was put out in its own round
        known = known.join(tiles, same, "left_semi").withColumn("own", F.lit(False))
        placed = placed.unionByName(known)
    dealt = placed.repartition(*at).sortWithinPartitions(*at, *order, *BOX)
    out = [*columns, "width"]
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", kept boolean"
    return dealt.mapInArrow(_settle(at, out), schema)
