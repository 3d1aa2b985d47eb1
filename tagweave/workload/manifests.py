"""Queries that build manifests and plan geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.cluster import work_folder
from tagweave.functions import geometry, names, prompts, tags, variants
from tagweave.functions.geometry import PrepareConfig
from tagweave.operators import datasets, imports
from tagweave.plans import prepare
from tagweave.sources import files, sinks
from tagweave.workload.tables import SQL_DOCUMENT_FILE, document_file, sql_once, sql_strip, table

QUERIES = {}
SQL = {}

CONFIG = PrepareConfig(trigger="wv", image_format="png")


def query(function):
    QUERIES[function.__name__] = function
    return function


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("lang") != "de").select(
        F.col("source").alias("dataset"),
        document_file().alias("file_name"),
        F.col("doc_id").cast("string").alias("stem"),
    )


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of labelled documents: tags by quality, the text as caption.

    Toxic records are broken: their tags hold a number, or are absent.
    """
    documents = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    quality = F.col("quality").cast("string")
    words = [
        F.concat(F.lit("src_"), F.col("source")),
        F.concat(F.lit("lang_"), F.col("lang")),
        F.concat(F.lit("quality "), quality),
    ]
    caption = F.col("text").alias("caption")
    sound = F.to_json(F.struct(F.array(*words).alias("tags"), caption))
    mixed = F.to_json(F.struct(F.array(F.to_variant_object(F.struct("quality"))).alias("tags"), caption))
    bare = F.to_json(F.struct(caption))
    text = (
        F.when(F.col("toxic") == 0, sound).when(F.col("quality") == 1, mixed).otherwise(bare)
    )
    return table(spark, d, "labels").join(documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("stem"), F.parse_json(text).alias("meta")
    )


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    """Override files of the embeddings: tags by category, no caption."""
    label, vec = F.col("label").cast("string"), F.col("vec_id").cast("string")
    categories = F.struct(
        F.array(F.concat(F.lit("set_"), label)).alias("zeta"),
        F.array(F.lit("hi_res")).alias("meta"),
        F.array(F.concat(F.lit("vec_"), vec), F.lit("solo")).alias("general"),
    )
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("src"), label).alias("dataset"),
        vec.alias("stem"),
        F.parse_json(F.to_json(F.struct(categories.alias("tags")))).alias("meta"),
    )


def _resolved(spark: SparkSession, d: str, config: PrepareConfig = CONFIG) -> DataFrame:
    return prepare.resolved_rows(_staged(spark, d), _overrides(spark, d), _pool(spark, d), config)


_RESOLVED = f"""
resolved AS (
  SELECT d.source AS dataset, {SQL_DOCUMENT_FILE.replace('doc_id', 'd.doc_id')} AS file_name,
    CAST(d.doc_id AS VARCHAR) AS stem,
    CASE WHEN e.vec_id IS NOT NULL THEN ['vec_' || e.vec_id, 'solo', 'hi_res', 'set_' || e.label]
      WHEN l.toxic = 0 THEN ['src_' || d.source, 'lang_' || d.lang, 'quality ' || l.quality] END AS tags,
    CASE WHEN e.vec_id IS NULL AND l.toxic = 0 THEN nullif({sql_strip('d.text')}, '') END AS caption,
    CASE WHEN e.vec_id IS NOT NULL OR l.toxic = 0 THEN NULL WHEN l.doc_id IS NULL THEN 'missing metadata'
      WHEN l.quality = 1 THEN 'tags are neither a list of strings nor categories of strings'
      ELSE 'metadata has no tags' END AS problem
  FROM documents d
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND 'src' || e.label = d.source
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  WHERE d.lang <> 'de'
)"""


@query
def manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = prepare.manifest_rows(_resolved(spark, d), CONFIG)
    return rows.withColumn("tags", F.array_join("tags", "|")).orderBy("dataset", "image")


_MANIFEST = f"""{_RESOLVED},
rows AS (
  SELECT dataset, 'images/' || stem || '.png' AS image,
    concat_ws('. ', 'wv, ' || array_to_string(tags, ', '),
      'wv, ' || array_to_string(list_transform(tags, lambda t: replace(t, '_', ' ')), ', '),
      'wv. ' || caption) AS caption,
    array_to_string(flatten(list_transform(tags, lambda t:
      CASE WHEN contains(t, '_') THEN [t, replace(t, '_', ' ')] ELSE [t] END)), '|') AS tags
  FROM resolved WHERE problem IS NULL
)"""
SQL["manifest"] = f"WITH {_MANIFEST} SELECT * FROM rows"


@query
def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).where(F.col("problem").isNotNull()).select("dataset", "file_name", "problem")


SQL["manifest_problems"] = f"""WITH {_RESOLVED}
SELECT dataset, file_name, problem FROM resolved WHERE problem IS NOT NULL"""


@query
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.training_rows(prepare.manifest_rows(_resolved(spark, d), CONFIG))


SQL["training_rows"] = f"WITH {_MANIFEST} SELECT image AS file_name, caption AS text FROM rows"


@query
def prepared_files(spark: SparkSession, d: str) -> DataFrame:
    """The manifest written as a prepared dataset, JSON lines in image order beside its config, and read back with its line's check."""
    folder = work_folder(spark)
    rows = prepare.manifest_rows(_resolved(spark, d), CONFIG)
    image = F.concat_ws("/", F.lit("images"), "dataset", F.substring_index("image", "/", -1)).alias("image")
    sinks.write_prepared(rows.select(image, "caption", "tags"), CONFIG, folder)
    parts = sinks.prepared_parts(spark, folder)
    read, rejects = files.read_manifest(spark, parts["manifest"])
    row = F.col("row")
    good = read.select(
        variants.string_member(row, "image").alias("image"), variants.string_member(row, "caption").alias("caption"),
        F.array_join(variants.tags_of(variants.field(row, "tags")), "|").alias("tags"), datasets.manifest_row_valid(row).alias("valid"),
    )
    bad = rejects.select(F.lit(None).cast("string").alias("image"), F.col("value").alias("caption"), F.col("reason").alias("tags"), F.lit(False).alias("valid"))
    trigger = spark.read.json(parts["config"]).first()["trigger"]
    return good.unionByName(bad).where(F.col("caption").contains(trigger))


SQL["prepared_files"] = f"""WITH {_MANIFEST}
SELECT 'images/' || dataset || '/' || split_part(image, '/', 2) AS image, caption, tags, true AS valid FROM rows WHERE contains(caption, 'wv')"""


# --- prompts ----------------------------------------------------------------


def _part_tags() -> Column:
    return F.array(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
        F.concat(F.lit("type_"), F.lower("p_type")),
        F.col("p_name"),
        F.col("p_brand"),
    )


def _part_caption() -> Column:
    size = F.col("p_size")
    return F.when(size > 25, F.concat(F.lit("  Size "), size.cast("string"), F.lit(" part. "))).when(
        size > 5, F.lit(" \n")
    )


_PARTS = """
parts AS (
  SELECT p_partkey, [replace(p_name, ' ', '_'), 'type_' || lower(p_type), p_name, p_brand] AS tags,
    CASE WHEN p_size > 25 THEN 'Size ' || p_size || ' part.' END AS caption
  FROM part
)"""


@query
def prompt_types(spark: SparkSession, d: str) -> DataFrame:
    """All four prompt types of every part, without and with a trigger."""
    parts = table(spark, d, "part")
    made = F.array(
        *[
            F.struct(
                F.lit(kind).alias("prompt_type"),
                prompts.build_prompt(_part_tags(), _part_caption(), "", kind).alias("plain"),
                prompts.build_prompt(_part_tags(), _part_caption(), "my_word", kind).alias("triggered"),
                F.array_join(prompts.manifest_tags(_part_tags(), kind), "|").alias("tags"),
            )
            for kind in prompts.PROMPT_TYPES
        ]
    )
    return parts.select("p_partkey", F.explode(made).alias("made")).select("p_partkey", "made.*")


def _sql_prompt(kind: str, trigger: str) -> str:
    named = f"list_concat(['{trigger}'], tags)" if trigger else "tags"
    raw = f"array_to_string({named}, ', ')"
    natural = f"replace({raw}, '_', ' ')"
    told = f"'{trigger}. ' || caption" if trigger else "caption"
    return {
        "tags": raw,
        "natural": natural,
        "caption": f"coalesce({told}, {natural})",
        "all": f"concat_ws('. ', {raw}, {natural}, {told})",
    }[kind]


def _sql_manifest_tags(kind: str) -> str:
    spaced = "list_transform(tags, lambda t: replace(t, '_', ' '))"
    doubled = (
        "flatten(list_transform(tags, lambda t: CASE WHEN contains(t, '_') "
        "THEN [t, replace(t, '_', ' ')] ELSE [t] END))"
    )
    return {"tags": "tags", "natural": spaced, "caption": spaced, "all": sql_once(doubled)}[kind]


SQL["prompt_types"] = f"WITH {_PARTS} " + " UNION ALL ".join(
    f"SELECT p_partkey, '{kind}' AS prompt_type, {_sql_prompt(kind, '')} AS plain, "
    f"{_sql_prompt(kind, 'my_word')} AS triggered, "
    f"array_to_string({_sql_manifest_tags(kind)}, '|') AS tags FROM parts"
    for kind in prompts.PROMPT_TYPES
)


@query
def flatten_categories(spark: SparkSession, d: str) -> DataFrame:
    """Category maps flattened in reading order, and what an import keeps of them."""
    by_category = F.create_map(
        F.lit("zz_brand"), F.array("p_brand"),
        F.lit("meta"), F.array(F.lower("p_type"), F.lit("hi_res")),
        F.lit("aa_size"), F.array(F.col("p_size").cast("string")),
        F.lit("general"), F.split("p_name", " "),
        F.lit("artist"), F.array(F.concat(F.lit("by_"), F.col("p_brand"))),
    )
    return table(spark, d, "part").select(
        "p_partkey",
        F.array_join(tags.flatten_categories(by_category), "|").alias("flat"),
        F.array_join(tags.flatten_categories(tags.keep_import_categories(by_category)), "|").alias("imported"),
    )


SQL["flatten_categories"] = """
SELECT p_partkey,
  concat_ws('|', replace(p_name, ' ', '|'), 'by_' || p_brand, lower(p_type), 'hi_res', p_size, p_brand) AS flat,
  concat_ws('|', replace(p_name, ' ', '|'), lower(p_type), 'hi_res') AS imported
FROM part"""


# --- geometry ---------------------------------------------------------------


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey",
        (F.col("p_size") * 17 + 40).alias("width"),
        (F.col("p_partkey") % 900 + 30).cast("int").alias("height"),
        F.when(F.col("p_type") == "ECONOMY", "RGBA").when(F.col("p_type") == "SMALL", "P").otherwise("RGB").alias("mode"),
        (F.col("p_size") > 30).alias("has_transparency"),
        F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".JPEG").otherwise(".webp")).alias("file_name"),
    )


_PICTURES = """
pictures AS (
  SELECT p_partkey, p_size * 17 + 40 AS width, CAST(p_partkey % 900 + 30 AS INTEGER) AS height,
    CASE p_type WHEN 'ECONOMY' THEN 'RGBA' WHEN 'SMALL' THEN 'P' ELSE 'RGB' END AS mode,
    p_size > 30 AS has_transparency, p_partkey || CASE WHEN p_size > 25 THEN '.JPEG' ELSE '.webp' END AS file_name
  FROM part
)"""


@query
def fit_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Fit into a box, and into a box that lacks either side."""
    width, height = F.col("width"), F.col("height")

    def pair(prefix: str, box_w: int | None, box_h: int | None) -> list[Column]:
        size = geometry.fit_size(width, height, box_w, box_h)
        return [size["width"].alias(f"{prefix}_w"), size["height"].alias(f"{prefix}_h")]

    return _pictures(spark, d).select(
        "p_partkey", *pair("box", 512, 300), *pair("wide", 333, None), *pair("tall", None, 77)
    )


def _sql_side(value: str) -> str:
    return f"greatest(1, CAST(round_even({value}, 0) AS INTEGER))"


SQL["fit_sizes"] = f"""WITH {_PICTURES},
sides AS (
  SELECT *, {_sql_side('height * (333.0e0 / width)')} AS wide_box, {_sql_side('width * (77.0e0 / height)')} AS tall_box
  FROM pictures
),
scales AS (
  SELECT *, least(512.0e0 / width, 300.0e0 / height) AS s1, least(333.0e0 / width, wide_box::DOUBLE / height) AS s2,
    least(tall_box::DOUBLE / width, 77.0e0 / height) AS s3
  FROM sides
)
SELECT p_partkey, {_sql_side('width * s1')} AS box_w, {_sql_side('height * s1')} AS box_h,
  {_sql_side('width * s2')} AS wide_w, {_sql_side('height * s2')} AS wide_h,
  {_sql_side('width * s3')} AS tall_w, {_sql_side('height * s3')} AS tall_h
FROM scales"""


@query
def geometry_plan(spark: SparkSession, d: str) -> DataFrame:
    """Pad, crop and square plans with names, codecs and the transparency check."""
    width, height = F.col("width"), F.col("height")
    box_w, box_h = geometry.box_size(256, None)
    pad = geometry.pad_plan(width, height, box_w, box_h, F.col("mode"))
    crop = geometry.crop_window(width, height, 320, 200)
    square = geometry.square_plan(width, height)
    blocked = geometry.alpha_blocks_jpg(F.col("mode"), F.col("has_transparency"), "jpg")
    small = geometry.scaled_size(width, height, 0.72)
    return _pictures(spark, d).select(
        "p_partkey",
        pad["left"].alias("pad_left"),
        pad["top"].alias("pad_top"),
        pad["background"].alias("background"),
        *[F.round(crop[part], 6).alias(f"crop_{part}") for part in ("left", "top", "width", "height")],
        square["side"].alias("side"),
        square["left"].alias("square_left"),
        square["top"].alias("square_top"),
        small["width"].alias("small_w"),
        small["height"].alias("small_h"),
        blocked.alias("jpg_blocked"),
        names.prepared_name(F.col("file_name"), "jpg").alias("target"),
        names.save_codec(F.col("file_name"), "original").alias("codec"),
    )


SQL["geometry_plan"] = f"""WITH {_PICTURES},
fitted AS (
  SELECT *, least(256.0e0 / width, 256.0e0 / height) AS s, width::DOUBLE / height AS live FROM pictures
),
sized AS (
  SELECT *, {_sql_side('width * s')} AS iw, {_sql_side('height * s')} AS ih,
    CASE WHEN live > 1.6e0 THEN 1.6e0 * height ELSE width::DOUBLE END AS cw,
    CASE WHEN live < 1.6e0 THEN width / 1.6e0 ELSE height::DOUBLE END AS ch, greatest(width, height) AS side
  FROM fitted
)
SELECT p_partkey, CAST(floor((256 - iw) / 2) AS BIGINT) AS pad_left, CAST(floor((256 - ih) / 2) AS BIGINT) AS pad_top,
  CASE mode WHEN 'RGBA' THEN 'RGBA(0,0,0,0)' ELSE 'RGB(255,255,255)' END AS background,
  round((width - cw) / 2, 6) AS crop_left, round((height - ch) / 2, 6) AS crop_top,
  round(cw, 6) AS crop_width, round(ch, 6) AS crop_height, side,
  CAST(floor((side - width) / 2) AS BIGINT) AS square_left, CAST(floor((side - height) / 2) AS BIGINT) AS square_top,
  {_sql_side('width * 0.72e0')} AS small_w, {_sql_side('height * 0.72e0')} AS small_h,
  (mode = 'RGBA' OR (mode = 'P' AND has_transparency)) AS jpg_blocked,
  p_partkey || '.jpg' AS target, CASE WHEN file_name LIKE '%.JPEG' THEN 'JPEG' ELSE 'WEBP' END AS codec
FROM sized"""


@query
def output_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Prepared size of every picture under each of the four modes."""
    pictures = _pictures(spark, d)
    configs = (
        PrepareConfig(mode="copy", width=None, height=None),
        PrepareConfig(mode="fit", width=100, height=200),
        PrepareConfig(mode="center-crop", width=96, height=None),
        PrepareConfig(mode="pad", width=None, height=48),
    )
    planned = [
        prepare.size_plan(pictures, config.validated()).select(
            "p_partkey",
            F.lit(config.mode).alias("prepare_mode"),
            F.col("output.width").alias("out_w"),
            F.col("output.height").alias("out_h"),
        )
        for config in configs
    ]
    return planned[0].unionByName(planned[1]).unionByName(planned[2]).unionByName(planned[3])


SQL["output_sizes"] = f"""WITH {_PICTURES}, fitted AS (SELECT *, least(100.0e0 / width, 200.0e0 / height) AS s FROM pictures)
SELECT p_partkey, 'copy' AS prepare_mode, width AS out_w, height AS out_h FROM pictures
UNION ALL SELECT p_partkey, 'fit', {_sql_side('width * s')}, {_sql_side('height * s')} FROM fitted
UNION ALL SELECT p_partkey, 'center-crop', 96, 96 FROM pictures
UNION ALL SELECT p_partkey, 'pad', 48, 48 FROM pictures"""


# --- import records ---------------------------------------------------------


@query
def import_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Parts as downloaded records, some of them unusable."""
    size = F.col("p_size")
    id_text = F.when(size <= 5, F.concat(F.lit('"'), F.col("p_partkey"), F.lit('"'))).otherwise(
        F.col("p_partkey").cast("string")
    )
    categories = F.to_json(
        F.struct(F.array("p_brand").alias("artist"), F.array("p_type").alias("meta"), F.split("p_name", " ").alias("general"))
    )
    listed = F.to_json(F.array("p_name", "p_name", "p_brand"))
    tag_text = (
        F.when(size > 40, listed)
        .when(size.between(6, 8), F.lit(None).cast("string"))
        .when(size.between(9, 10), F.lit('{"general": ["a", 1]}'))
        .when(size.between(11, 12), F.lit('{"artist": 5, "lore": [1]}'))
        .otherwise(categories)
    )
    text = F.concat(
        F.lit('{"id": '), id_text, F.coalesce(F.concat(F.lit(', "tags": '), tag_text), F.lit("")), F.lit("}")
    )
    records = table(spark, d, "part").select(
        F.col("p_partkey").alias("stem"), F.parse_json(text).alias("raw")
    )
    return imports.import_metadata(records, "board").select(
        "stem",
        "reject",
        F.when(F.col("reject").isNull(), F.array_join("tags", "|")).alias("tags"),
        F.when(F.col("reject").isNull(), F.col("post_id")).alias("post_id"),
        "source",
    )


SQL["import_metadata"] = """
SELECT p_partkey AS stem,
  CASE WHEN p_size <= 5 THEN 'missing integer id' WHEN p_size <= 8 THEN 'missing tags'
    WHEN p_size <= 10 THEN 'tags are neither a list of strings nor categories of strings' END AS reject,
  CASE WHEN p_size <= 10 THEN NULL WHEN p_size <= 12 THEN ''
    WHEN p_size > 40 THEN concat_ws('|', p_name, p_name, p_brand)
    ELSE concat_ws('|', replace(p_name, ' ', '|'), p_type) END AS tags,
  CASE WHEN p_size > 10 THEN p_partkey END AS post_id, 'board' AS source
FROM part"""
