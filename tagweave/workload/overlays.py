"""Queries over regions and overlay evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.cluster import spread
from tagweave.functions import overlay
from tagweave.operators import evidence, regions
from tagweave.plans import overlay_scoring
from tagweave.workload.tables import SQL_REGIONS, line_regions, table

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- evidence: users are regions, event types are channels -------------------

CHANNEL_OF = {
    "click": "detector_stability",
    "view": "placement_metadata",
    "purchase": "scale_subordination",
    "signup": "alpha_layer",
    "error": "overlay_simplicity",
}
FRAME_OF = {
    "click": "rgb@0.72",
    "view": "rgb@1.00",
    "purchase": "rgb@1.38",
    "signup": "contrast@1.00",
    "error": "structural_echo",
}


def _mapped(column: str, mapping: dict[str, str]):
    names = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return names[F.col(column)]


def _sql_mapped(column: str, mapping: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CASE {column} {cases} END"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        (F.avg("value") / 100.0).alias("p")
    )
    return evidence.evidence(
        means.select(F.col("user_id").alias("entity_id"), _mapped("event_type", CHANNEL_OF).alias("channel"), "p")
    )


_WEIGHT = {k: f"{overlay.CHANNEL_WEIGHTS[v]}" for k, v in CHANNEL_OF.items()}
_WEIGHT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in _WEIGHT.items()) + " END"
_EVIDENCE = f"""
evidence AS (
  SELECT user_id AS entity_id, {_sql_mapped('event_type', CHANNEL_OF)} AS channel, {_WEIGHT_SQL} AS weight,
    greatest(0.01e0, least(0.99e0, avg(value) / 100.0e0)) AS p
  FROM events GROUP BY user_id, event_type
),
roots AS (
  SELECT entity_id, sum(weight * sqrt(p)) / sum(weight) AS yes, sum(weight * sqrt(1 - p)) / sum(weight) AS no
  FROM evidence GROUP BY 1
),
shares AS (SELECT entity_id, yes * yes / (yes * yes + no * no) AS s FROM roots),
consensus AS (
  SELECT entity_id, any_value(s) AS overlay_score, min(sqrt(p * s) + sqrt((1 - p) * (1 - s))) AS agreement
  FROM evidence JOIN shares USING (entity_id) GROUP BY 1
)"""


@query
def overlay_consensus(spark: SparkSession, d: str) -> DataFrame:
    scored = evidence.consensus(_evidence(spark, d))
    return scored.select("entity_id", *[F.round(c, 6).alias(c) for c in scored.columns if c != "entity_id"])


SQL["overlay_consensus"] = f"""WITH {_EVIDENCE}
SELECT entity_id, round(overlay_score, 6) AS overlay_score, round(1 - overlay_score, 6) AS content_score,
  round(agreement, 6) AS agreement, round(-log2(agreement), 6) AS dispersion_bits
FROM consensus"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return evidence.decide(_evidence(spark, d))


def _sql_accept(p: dict[str, str]) -> str:
    det, pla, sca, alp, lay = (p[k] for k in CHANNEL_OF.values())
    s = "overlay_score"
    return f"""CASE
      WHEN {det} >= 0.54 AND {sca} <= 0.34 AND {pla} <= 0.42 AND {alp} <= 0.56 AND 0.5 <= 0.58 AND 0.5 <= 0.42
        AND {s} < 0.74 THEN false
      WHEN {s} >= 0.68 AND {det} >= 0.50 THEN true
      WHEN {s} >= 0.56 AND {det} >= 0.52 AND greatest(0.5, {pla}, {sca}, {alp}, {lay}, 0.5) >= 0.55 THEN true
      WHEN {det} >= 0.48 AND {pla} >= 0.66 AND {sca} >= 0.58 AND {lay} >= 0.50 THEN true
      WHEN {det} >= 0.50 AND ({alp} >= 0.66 OR 0.5 >= 0.68) AND {s} >= 0.52 THEN true
      WHEN {det} >= 0.66 AND {lay} >= 0.60 AND ({pla} >= 0.50 OR {sca} >= 0.50 OR 0.5 >= 0.50) THEN true
      ELSE false END"""


_DECIDED = f"""{_EVIDENCE},
wide AS (
  SELECT entity_id, {", ".join(f"coalesce(max(p) FILTER (channel = '{c}'), 0.5) AS {c}" for c in CHANNEL_OF.values())}
  FROM evidence GROUP BY 1
),
decided AS (
  SELECT entity_id, overlay_score, agreement, {_sql_accept({c: c for c in CHANNEL_OF.values()})} AS selected
  FROM consensus JOIN wide USING (entity_id)
)"""


@query
def overlay_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("entity_id", F.round("overlay_score", 6).alias("overlay_score"), "selected")


SQL["overlay_decision"] = f"""WITH {_DECIDED}
SELECT entity_id, round(overlay_score, 6) AS overlay_score, selected FROM decided"""


@query
def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    summed = evidence.selection_summary(_decided(spark, d))
    return summed.select("selected", *[F.round(c, 6).alias(c) for c in summed.columns if c != "selected"])


SQL["selection_summary"] = f"""WITH {_DECIDED}
SELECT count(*) FILTER (selected) AS selected,
  round(coalesce(avg(overlay_score) FILTER (selected), 0), 6) AS mean_overlay_score,
  round(coalesce(avg(-log2(agreement)) FILTER (selected), 0), 6) AS mean_dispersion_bits
FROM decided"""


@query
def frame_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Support and minimax agreement of the five detection frames."""
    seen = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.least(F.lit(1.0), F.avg("value") / 100.0).alias("occupancy")
    )
    frames = seen.select(
        F.col("user_id").alias("entity_id"), _mapped("event_type", FRAME_OF).alias("frame"), "occupancy"
    )
    found = evidence.frame_agreement(frames)
    return found.select("entity_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "entity_id"])


SQL["frame_agreement"] = """
WITH frames AS (
  SELECT user_id AS entity_id, least(1.0e0, avg(value) / 100.0e0) AS p,
    CASE event_type WHEN 'signup' THEN 0.85e0 WHEN 'error' THEN 0.75e0 ELSE 1.0e0 END AS weight
  FROM events GROUP BY user_id, event_type
),
regions AS (
  SELECT entity_id, support, ps, list_avg(ps) AS mean, list_median(ps) AS mid FROM (
    SELECT entity_id, sum(p * weight) / 4.6e0 AS support, list_resize(list(p), 5, 0.0e0) AS ps FROM frames GROUP BY 1)
),
tried AS (
  SELECT entity_id, support, ps, unnest(list_concat(list_transform(range(1001), lambda i: i / 1000.0e0), ps, [mean, mid])) AS q
  FROM regions
),
best AS (
  SELECT entity_id, any_value(support) AS support,
    max(list_min(list_transform(ps, lambda p: sqrt(p * q) + sqrt((1 - p) * (1 - q))))) AS agreement
  FROM tried GROUP BY 1
)
SELECT entity_id, round(support, 6) AS support, round(agreement, 6) AS agreement,
  round(greatest(0.01e0, least(0.99e0, 0.25e0 + 0.60e0 * support + 0.15e0 * agreement)), 6) AS detector_support
FROM best"""


@query
def entropy_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Colour entropy, contrast and the probabilities they give, per user."""
    pixels = table(spark, d, "events").select(
        F.col("user_id").alias("entity_id"),
        evidence.quantised(F.col("value"), F.col("value") / 2, F.col("value") / 4).alias("level"),
        (F.col("event_type") == "purchase").alias("inside"),
        "value",
        F.col("value").alias("alpha"),
    )
    bits = evidence.entropy(pixels)
    gap = evidence.contrast(pixels)
    semi = evidence.semi_transparent_share(pixels)
    sides = [F.col(name) for name in ("mean_in", "mean_out", "std_in", "std_out")]
    texture = overlay.texture_gap(*[side / 255.0 for side in sides])
    boundary = overlay.boundary_gap(sides[0] / 255.0, sides[1] / 255.0)
    made = {
        "entropy_bits": F.col("entropy_bits"),
        "simplicity": overlay.simplicity(F.col("entropy_bits"), F.col("semi_share") / 5.0),
        "low_salience": overlay.low_salience(*sides),
        "alpha": overlay.alpha_layer(F.col("semi_share")),
        "texture": texture,
        "restored": overlay.restoration_gain(boundary - 0.01, texture - 0.02),
    }
    return bits.join(gap, "entity_id").join(semi, "entity_id").select(
        "entity_id", *[F.round(value, 6).alias(name) for name, value in made.items()]
    )


SQL["entropy_contrast"] = """
WITH levels AS (
  SELECT user_id, CAST(floor(value / 32) * 64 + floor(value / 64) * 8 + floor(value / 128) AS BIGINT) AS level, count(*) AS n
  FROM events GROUP BY 1, 2
),
bits AS (
  SELECT user_id, greatest(0, -sum(n / t * log2(n / t))) AS h FROM (
    SELECT *, sum(n) OVER (PARTITION BY user_id)::DOUBLE AS t FROM levels)
  GROUP BY 1
),
gaps AS (
  SELECT user_id, avg(value) FILTER (event_type = 'purchase') AS mi, avg(value) FILTER (event_type <> 'purchase') AS mo,
    stddev_pop(value) FILTER (event_type = 'purchase') AS si, stddev_pop(value) FILTER (event_type <> 'purchase') AS so,
    count(*) FILTER (value > 8 AND value < 248) / count(*) AS half_clear
  FROM events GROUP BY 1
),
made AS (
  SELECT *, greatest(0, least(1, (5.2 - h) / 5.2)) AS plain, greatest(0, least(1, half_clear / 5.0 / 0.22)) AS strokes,
    greatest(0, least(1, 0.70 * abs(mi - mo) / 255.0 + 0.20 * least(si / greatest(1.0, so), 2.0) / 2.0)) AS sal,
    coalesce(0.70 * abs(mi - mo) / 255.0 + 0.30 * abs(si - so) / 255.0, 0) AS texture,
    coalesce(abs(mi - mo) / 255.0, 0) AS boundary
  FROM bits JOIN gaps USING (user_id)
)
SELECT user_id AS entity_id, round(h, 6) AS entropy_bits,
  round(greatest(0.01, least(0.99, 0.22 + 0.48 * plain + 0.20 * strokes)), 6) AS simplicity,
  CASE WHEN mi IS NULL OR mo IS NULL THEN 0.5 ELSE round(greatest(0.01, least(0.99, 0.74 - 0.56 * sal)), 6) END AS low_salience,
  round(greatest(0.01, least(0.99, 0.42 + 0.50 * half_clear)), 6) AS alpha, round(texture, 6) AS texture,
  round(greatest(0.01, least(0.99, 0.50 + 0.33 * tanh(2.8 * (boundary - 0.01)) + 0.22 * tanh(2.2 * (texture - 0.02)))), 6) AS restored
FROM made"""


# --- frames over positions ---------------------------------------------------


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("image_id"),
        F.floor("value").alias("pos"),
        F.col("event_type").alias("frame"),
        (F.col("value") > 50).alias("hit"),
    )


@query
def frame_votes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.votes(_marks(spark, d))


SQL["frame_votes"] = """
SELECT user_id AS image_id, CAST(floor(value) AS BIGINT) AS pos, count(DISTINCT event_type) AS n_frames
FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) >= 2"""


@query
def marked_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions either of two detections marks: strong and weak values."""
    marks = _marks(spark, d)
    return evidence.marked_positions(marks.where(F.col("hit")), marks.where(~F.col("hit")))


SQL["marked_positions"] = """
SELECT DISTINCT user_id AS image_id, CAST(floor(value) AS BIGINT) AS pos FROM events"""


@query
def frame_occupancy(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.occupancy(_marks(spark, d), ["image_id", "frame"])
    return found.withColumn("occupancy", F.round("occupancy", 6))


SQL["frame_occupancy"] = """
SELECT user_id AS image_id, event_type AS frame, round(count(*) FILTER (value > 50) / count(*), 6) AS occupancy
FROM events GROUP BY 1, 2"""


# --- regions ----------------------------------------------------------------


@query
def region_features(spark: SparkSession, d: str) -> DataFrame:
    boxes = line_regions(spark, d)
    edge = overlay.edge_affinity(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    return overlay_scoring.region_features(boxes).select(
        "image_id",
        "component_id.*",
        F.round("placement_metadata", 6).alias("placement"),
        F.round("scale_subordination", 6).alias("scale"),
        F.round(edge, 6).alias("edge"),
        overlay.area_allowed(F.col("area"), F.col("width"), F.col("height")).alias("allowed"),
    )


_FEATURES = f"""{SQL_REGIONS},
parts AS (
  SELECT *, (x + 0.5e0 * w) / width AS cx, (y + 0.5e0 * h) / height AS cy,
    greatest(0, least(1, 1 - least(x / width, y / height, (width - x - w) / width, (height - y - h) / height) / 0.18e0)) AS e,
    greatest(0, least(1, 1 - least(x, y, greatest(0, width - x - w), greatest(0, height - y - h)) / (0.18e0 * 768))) AS edge,
    area / (width * height) AS share, greatest(w, h) / greatest(1, least(w, h)) AS slender,
    area BETWEEN 10 AND 173015 AS allowed
  FROM regions
),
features AS (
  SELECT *, greatest(0.01, least(0.99, 0.18 + 0.35 * e
      + 0.26 * greatest(greatest(0, least(1, (cy - 0.74) / 0.20)), greatest(0, least(1, (0.20 - cy) / 0.20)))
      + 0.17 * e * greatest(abs(cx - 0.5), abs(cy - 0.5)) * 2
      - 0.18 * greatest(0, least(1, 1 - sqrt((cx - 0.5) ** 2 + (cy - 0.5) ** 2) / 0.5)))) AS placement,
    greatest(0.01, least(0.99, 0.10 + 0.38 * greatest(0, least(1, (0.040 - share) / 0.040))
      + 0.22 * greatest(0, least(1, (0.18 - h / height) / 0.18)) + 0.12 * greatest(0, least(1, (0.55 - w / width) / 0.55))
      + 0.20 * greatest(0, least(1, (slender - 2.4) / 4.0))
      - 0.34 * greatest(0, least(1, (greatest(h / height, w / width) - 0.32) / 0.34)))) AS scale
  FROM parts
)"""
SQL["region_features"] = f"""WITH {_FEATURES}
SELECT image_id, c1 AS l_linenumber, c2 AS l_partkey, c3 AS l_suppkey, c4 AS l_extendedprice, round(placement, 6) AS placement,
  round(scale, 6) AS scale, round(edge, 6) AS edge, allowed
FROM features"""


@query
def region_rank(spark: SparkSession, d: str) -> DataFrame:
    """The three regions of each picture worth probing."""
    return regions.rank_regions(line_regions(spark, d), limit=3).select("image_id", "component_id.*", "rank")


_RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area * (1 + 0.25e0 * edge) DESC, c1, c2, c3, c4) AS rank
  FROM features WHERE allowed
)"""
SQL["region_rank"] = f"""WITH {_FEATURES}, {_RANKED}
SELECT image_id, c1 AS l_linenumber, c2 AS l_partkey, c3 AS l_suppkey, c4 AS l_extendedprice, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 3"""


@query
def similar_area(spark: SparkSession, d: str) -> DataFrame:
    """Regions of like area per supplier picture, and the probability from it."""
    boxes = line_regions(spark, d).select(F.col("component_id.l_suppkey").alias("image_id"), "area")
    counted = regions.similar_counts(boxes)
    return counted.withColumn("repetition", F.round(overlay.repetition(F.col("similar")), 6))


SQL["similar_area"] = f"""WITH {SQL_REGIONS},
sizes AS (SELECT c3 AS image_id, area, count(*) AS n FROM regions GROUP BY 1, 2),
counted AS (
  SELECT a.image_id, a.area, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS alike
  FROM sizes a LEFT JOIN sizes b ON a.image_id = b.image_id AND b.area / greatest(1, a.area) BETWEEN 0.35e0 AND 2.85e0
  GROUP BY 1, 2
)
SELECT image_id, area, alike AS "similar", round(greatest(0.01e0, least(0.99e0, 0.40e0 + 0.11e0 * least(alike - 1, 5))), 6) AS repetition
FROM counted"""


@query
def scored_regions(spark: SparkSession, d: str) -> DataFrame:
    """Overlay decision per probed region from its box, size and likeness."""
    scored = overlay_scoring.score_regions(line_regions(spark, d))
    return scored.select(
        "image_id", "component_id.*", F.round("overlay_score", 6).alias("overlay_score"),
        F.round("dispersion_bits", 6).alias("dispersion_bits"), "selected",
    )


SQL["scored_regions"] = f"""WITH {_FEATURES}, {_RANKED},
probed AS (
  SELECT image_id, c1, c2, c3, c4, placement, scale, greatest(0.01, least(0.99, 0.40 + 0.11 * least(5, (
    SELECT count(*) FROM regions o WHERE o.image_id = r.image_id AND o.area / greatest(1, r.area) BETWEEN 0.35e0 AND 2.85e0) - 1))) AS rep
  FROM ranked r WHERE rank <= 24
),
roots AS (
  SELECT *, (0.95 * sqrt(placement) + 1.10 * sqrt(scale) + 0.70 * sqrt(rep)) ** 2 AS yes,
    (0.95 * sqrt(1 - placement) + 1.10 * sqrt(1 - scale) + 0.70 * sqrt(1 - rep)) ** 2 AS no
  FROM probed
),
shares AS (SELECT *, yes / (yes + no) AS s FROM roots)
SELECT image_id, c1 AS l_linenumber, c2 AS l_partkey, c3 AS l_suppkey, c4 AS l_extendedprice, round(s, 6) AS overlay_score,
  round(-log2(least(sqrt(placement * s) + sqrt((1 - placement) * (1 - s)), sqrt(scale * s) + sqrt((1 - scale) * (1 - s)),
    sqrt(rep * s) + sqrt((1 - rep) * (1 - s)))), 6) AS dispersion_bits,
  (s >= 0.68 OR (0.5 >= 0.48 AND placement >= 0.66 AND scale >= 0.58) OR (rep >= 0.68 AND s >= 0.52)) AS selected
FROM shares"""


@query
def polygon_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of detector replies, flat lists of boxes and lists of lists, clipped and measured."""
    box = {name: F.col(name).cast("double") for name in ("x", "y", "w", "h")}
    wide = F.array(box["x"] - 5, box["x"] + box["w"] * 3 + 0.5, box["y"] * 1.2, box["y"] * 1.2 + box["h"])
    point, narrow = F.array(box["x"], box["y"]), F.array(box["x"] / 2, box["x"] / 2 + 3, box["y"], box["y"] + 2)
    nested, flat = F.to_variant_object(F.array(F.array(wide, point), F.array(narrow))), F.to_variant_object(F.array(wide, point, narrow))
    reply = F.when(F.col("image_id") % 2 == 0, nested).otherwise(flat)
    # What stands in a generator is interpreted, and computed again for each use; columns of their own are not.
    read = line_regions(spark, d).withColumn("reply", reply).withColumn("boxes", overlay.rectangles(F.col("reply")))
    rows = read.select("image_id", "component_id", "width", "height", F.posexplode_outer("boxes").alias("item", "box")).where("box IS NOT NULL")
    polygon = overlay.rectangle_polygon(*[F.element_at("box", i) for i in (1, 2, 3, 4)])
    clipped = overlay.clip_polygon(polygon, F.col("width"), F.col("height"))
    measured = rows.withColumn("points", clipped).withColumn("bounds", overlay.bounding_box(F.col("points")))
    return measured.select(
        "image_id", "component_id.*", "item", "bounds.*",
        overlay.polygon_area(F.col("points")).alias("polygon_area"),
        overlay.polygon_valid(F.col("points")).alias("valid"),
    )


SQL["polygon_checks"] = f"""WITH {SQL_REGIONS},
boxes AS (
  SELECT *, 0 AS item, x - 5.0e0 AS xa, x + w * 3 + 0.5e0 AS xb, y * 1.2e0 AS ya, y * 1.2e0 + h AS yb FROM regions
  UNION ALL SELECT *, 1, x / 2.0e0, x / 2.0e0 + 3, y::DOUBLE, y + 2.0e0 FROM regions
),
clipped AS (
  SELECT image_id, c1, c2, c3, c4, item,
    CAST(greatest(0, least(1023, round_even(xa, 0))) AS INTEGER) AS x1, CAST(greatest(0, least(1023, round_even(xb, 0))) AS INTEGER) AS x2,
    CAST(greatest(0, least(767, round_even(ya, 0))) AS INTEGER) AS y1, CAST(greatest(0, least(767, round_even(yb, 0))) AS INTEGER) AS y2
  FROM boxes
)
SELECT image_id, c1 AS l_linenumber, c2 AS l_partkey, c3 AS l_suppkey, c4 AS l_extendedprice, item, x1, y1, x2, y2,
  CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS polygon_area, (x2 - x1) * (y2 - y1) >= 9 AS valid
FROM clipped"""


@query
def near_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes per supplier picture and frame that no earlier kept box covers."""
    return regions.drop_near_repeats(_line_boxes(spark, d, F.col("l_suppkey")), order=_LINE_ORDER)


_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey")


def _line_boxes(spark: SparkSession, d: str, image: Column) -> DataFrame:
    """Order lines as boxes in pictures."""

    def whole(name: str, factor: float):
        return F.floor(F.col(name) * factor).cast("int")

    lines = table(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount", "l_linestatus"
    )
    return spread(lines).select(
        image.alias("image_id"),
        F.col("l_returnflag").alias("frame"),
        "l_orderkey", "l_linenumber", "l_partkey",
        (whole("l_quantity", 2)).alias("x1"),
        (whole("l_tax", 200)).alias("y1"),
        (whole("l_quantity", 2) + 40 + whole("l_discount", 100)).alias("x2"),
        (whole("l_tax", 200) + 30 + F.when(F.col("l_linestatus") == "F", 3).otherwise(0)).alias("y2"),
    )


def _sql_near_boxes(image: str) -> str:
    return f"""
WITH RECURSIVE lined AS (
  SELECT {image} AS image_id, l_returnflag AS frame, l_orderkey, l_linenumber, l_partkey,
    CAST(floor(l_quantity * 2) AS INTEGER) AS x1, CAST(floor(l_tax * 200) AS INTEGER) AS y1,
    CAST(floor(l_quantity * 2) + 40 + floor(l_discount * 100) AS INTEGER) AS x2,
    CAST(floor(l_tax * 200) + 30 + CASE l_linestatus WHEN 'F' THEN 3 ELSE 0 END AS INTEGER) AS y2
  FROM lineitem
),
firsts AS (
  SELECT * FROM lined QUALIFY row_number() OVER (
    PARTITION BY image_id, frame, x1, y1, x2, y2 ORDER BY l_orderkey, l_linenumber, l_partkey) = 1
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, frame ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM firsts
),
walk AS (
  SELECT image_id, frame, 1 AS rn, [{{'rn': rn, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM numbered WHERE rn = 1
  UNION ALL
  SELECT w.image_id, w.frame, w.rn + 1, CASE WHEN len(list_filter(w.kept, lambda k:
      greatest(0, least(k.x2, n.x2) - greatest(k.x1, n.x1) + 1) * greatest(0, least(k.y2, n.y2) - greatest(k.y1, n.y1) + 1)
      > 0.86e0 * ((k.x2 - k.x1 + 1) * (k.y2 - k.y1 + 1) + (n.x2 - n.x1 + 1) * (n.y2 - n.y1 + 1)
        - greatest(0, least(k.x2, n.x2) - greatest(k.x1, n.x1) + 1) * greatest(0, least(k.y2, n.y2) - greatest(k.y1, n.y1) + 1)))) > 0
    THEN w.kept ELSE list_append(w.kept, {{'rn': n.rn, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) END
  FROM walk w JOIN numbered n ON n.image_id = w.image_id AND n.frame = w.frame AND n.rn = w.rn + 1
),
kept AS (
  SELECT image_id, frame, unnest(kept).rn AS rn FROM walk
  QUALIFY row_number() OVER (PARTITION BY image_id, frame ORDER BY walk.rn DESC) = 1
)
SELECT n.image_id, n.frame, l_orderkey, l_linenumber, l_partkey, x1, y1, x2, y2
FROM numbered n JOIN kept k ON k.image_id = n.image_id AND k.frame = n.frame AND k.rn = n.rn"""


SQL["near_boxes"] = _sql_near_boxes("l_suppkey")


@query
def near_boxes_in_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The same in eight crowded pictures, each cut into tiles of about a thousand boxes."""
    boxes = _line_boxes(spark, d, F.col("l_suppkey") % 8)
    return regions.drop_near_repeats(boxes, order=_LINE_ORDER, tile_rows=1000)


SQL["near_boxes_in_tiles"] = _sql_near_boxes("l_suppkey % 8")
