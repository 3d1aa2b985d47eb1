"""How the given tables stand in for pools, datasets, predictions and regions.

Each binding comes as a DataFrame and as the same relation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.cluster import spread
from tagweave.functions.tags import TAG_ALIASES, TAG_TRIM
from tagweave.functions.text import BLANK
from tagweave.operators import pairing


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- SQL pieces -------------------------------------------------------------


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_normal(text: str) -> str:
    spaced = f"regexp_replace(replace(lower({sql_strip(text)}), '_', ' '), '{BLANK}+', ' ', 'g')"
    cleaned = f"trim({spaced}, '{TAG_TRIM}')"
    pairs = ", ".join(f"'{a}': '{b}'" for a, b in TAG_ALIASES.items())
    return f"list_transform([{cleaned}], lambda t: coalesce(MAP {{{pairs}}}[t], t))[1]"


def sql_once(items: str) -> str:
    """Ordered distinct of a short list."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


# --- the pool: documents are images, labels are metadata ---------------------

SUFFIX = {"en": ".png", "fr": ".JPG", "es": ".webp"}


def document_file() -> Column:
    lang = F.col("lang")
    chosen = F.lit(".txt")
    for name, suffix in SUFFIX.items():
        chosen = F.when(lang == name, suffix).otherwise(chosen)
    return F.concat(F.col("doc_id").cast("string"), chosen)


SQL_DOCUMENT_FILE = (
    "CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.png' WHEN 'fr' THEN '.JPG' "
    "WHEN 'es' THEN '.webp' ELSE '.txt' END"
)


def pool_files(spark: SparkSession, folder: str) -> DataFrame:
    """Classified pool listing; German documents are text files, not images."""
    images = table(spark, folder, "documents").select(
        F.concat(F.lit("pool/"), document_file()).alias("path")
    )
    metadata = table(spark, folder, "labels").select(
        F.concat(F.lit("pool/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path")
    )
    return pairing.classify(images.unionByName(metadata))


def pool_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.pair(pool_files(spark, folder))


SQL_POOL = f"""
pool_images AS (
  SELECT CAST(doc_id AS VARCHAR) AS stem, 'pool/' || {SQL_DOCUMENT_FILE} AS path
  FROM documents WHERE lang <> 'de'
),
pool_metadata AS (
  SELECT CAST(doc_id AS VARCHAR) AS stem, 'pool/' || doc_id || '.json' AS path FROM labels
),
pairs AS (
  SELECT stem, i.path AS image_path, m.path AS metadata_path,
         (i.path IS NULL OR m.path IS NULL) AS is_broken
  FROM pool_images i FULL OUTER JOIN pool_metadata m USING (stem)
)"""


# --- datasets: documents staged by source, embeddings as override files ------


def staged_files(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "documents").select(
        F.col("source").alias("dataset"),
        F.concat(F.lit("staged/"), F.col("source"), F.lit("/"), document_file()).alias("path"),
    )
    overrides = table(spark, folder, "embeddings").select(
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("dataset"),
        F.concat(
            F.lit("staged/src"), F.col("label").cast("string"), F.lit("/"),
            F.col("vec_id").cast("string"), F.lit(".json"),
        ).alias("path"),
    )
    return pairing.classify(images.unionByName(overrides))


SQL_STAGED = f"""
staged_images AS (
  SELECT source AS dataset, CAST(doc_id AS VARCHAR) AS stem,
         'staged/' || source || '/' || {SQL_DOCUMENT_FILE} AS path
  FROM documents WHERE lang <> 'de'
),
staged_overrides AS (
  SELECT 'src' || label AS dataset, CAST(vec_id AS VARCHAR) AS stem,
         'staged/src' || label || '/' || vec_id || '.json' AS path
  FROM embeddings
)"""


# --- scored tags: orders are records, their lines are tags -------------------


def raw_order_tags(spark: SparkSession, folder: str) -> DataFrame:
    lines = spread(
        table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
        )
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    flag = F.col("l_returnflag")
    kind = F.col("l_suppkey") % 4
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("stem"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.when(flag == "A", F.concat(F.lit("  "), F.upper("p_name")))
        .when(flag == "R", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" ,")))
        .alias("raw"),
        F.when(kind == 0, "metadata")
        .when(kind == 1, "ram++")
        .when(kind == 2, "smilingwolf")
        .otherwise("qwen")
        .alias("source"),
        F.when(kind == 0, "existing")
        .when(kind == 1, "objects")
        .when((kind == 2) & (F.col("l_linestatus") == "F"), "characters")
        .when(kind == 2, "booru")
        .when(F.col("l_linestatus") == "F", "style")
        .otherwise("attributes")
        .alias("namespace"),
        F.when(F.col("l_tax") > 0, F.col("l_discount") * 10 + F.lit(0.0)).alias("confidence"),
        "p_name",
        "p_type",
        "l_returnflag",
        "l_linestatus",
    )


SQL_ORDER_TAGS = f"""
raw_tags AS (
  SELECT l_orderkey AS stem, l_linenumber AS p1, l_partkey AS p2, l_suppkey AS p3,
    CASE l_returnflag WHEN 'A' THEN '  ' || upper(p_name)
      WHEN 'R' THEN replace(p_name, ' ', '_') ELSE p_name || ' ,' END AS raw,
    CASE l_suppkey % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'ram++'
      WHEN 2 THEN 'smilingwolf' ELSE 'qwen' END AS source,
    CASE l_suppkey % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'objects'
      WHEN 2 THEN CASE l_linestatus WHEN 'F' THEN 'characters' ELSE 'booru' END
      ELSE CASE l_linestatus WHEN 'F' THEN 'style' ELSE 'attributes' END END AS namespace,
    CASE WHEN l_tax > 0 THEN l_discount * 10 + 0.0e0 END AS confidence,
    p_name, p_type, l_returnflag, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
scored AS (
  SELECT *, authority * greatest(0.0e0, least(1.0e0, coalesce(confidence, 0.75e0))) AS score
  FROM (
    SELECT stem, p1, p2, p3, {sql_strip('raw')} AS raw, {sql_normal('raw')} AS tag, source, namespace,
      confidence, CASE
        WHEN source = 'qwen' AND namespace = 'style' THEN 0.95e0
        WHEN source = 'qwen' THEN 0.82e0
        WHEN source = 'ram++' THEN 0.90e0
        WHEN source = 'smilingwolf' AND namespace = 'booru' THEN 0.86e0
        WHEN source = 'smilingwolf' THEN 0.72e0
        ELSE 0.88e0 END AS authority
    FROM raw_tags)
  WHERE tag <> ''
)"""

SQL_MERGED = """
best AS (
  SELECT *, row_number() OVER (PARTITION BY stem, tag ORDER BY score DESC, p1, p2, p3) AS rn,
    min({'a': p1, 'b': p2, 'c': p3}) OVER (PARTITION BY stem, tag) AS first_pos
  FROM scored
),
merged AS (
  SELECT * FROM (
    SELECT stem, tag, raw, source, namespace, confidence, authority, score, first_pos,
      row_number() OVER (PARTITION BY stem ORDER BY score DESC, first_pos) AS rank
    FROM best WHERE rn = 1)
  WHERE rank <= 3
)"""


# --- regions: line items as boxes on a 1024 x 768 picture --------------------


def line_regions(spark: SparkSession, folder: str) -> DataFrame:
    def whole(value: Column) -> Column:
        return F.floor(value).cast("int")

    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount"
    )
    return spread(lines).select(
        F.col("l_orderkey").alias("image_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("component_id"),
        whole(F.col("l_quantity") * 15).alias("x"),
        (F.col("l_suppkey") % 700).cast("int").alias("y"),
        (whole(F.col("l_tax") * 1000) + 1).alias("w"),
        (whole(F.col("l_discount") * 500) + 1).alias("h"),
        whole((whole(F.col("l_tax") * 1000) + 1) * (whole(F.col("l_discount") * 500) + 1) * 0.75).alias("area"),
        F.lit(1024).alias("width"),
        F.lit(768).alias("height"),
    )


SQL_REGIONS = """
regions AS (
  SELECT *, CAST(floor(w * h * 0.75e0) AS INTEGER) AS area, 1024 AS width, 768 AS height FROM (
    SELECT l_orderkey AS image_id, l_linenumber AS c1, l_partkey AS c2, l_suppkey AS c3, l_extendedprice AS c4,
      CAST(floor(l_quantity * 15) AS INTEGER) AS x, CAST(l_suppkey % 700 AS INTEGER) AS y,
      CAST(floor(l_tax * 1000) AS INTEGER) + 1 AS w, CAST(floor(l_discount * 500) AS INTEGER) + 1 AS h
    FROM lineitem)
)"""
