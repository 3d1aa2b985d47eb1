"""Queries that import downloaded pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.cluster import work_folder
from tagweave.functions import names
from tagweave.operators import imports, pairing
from tagweave.plans import importing
from tagweave.sources import files as files_source
from tagweave.sources import versions
from tagweave.streaming import incremental
from tagweave.streaming.incremental import unseen
from tagweave.workload.tables import table

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _padded(name: str):
    return names.padded_id(F.col(name))


# --- downloaded files: orders are images, line items are records -------------


def _images(spark: SparkSession, d: str) -> DataFrame:
    """One image per order; urgent ones carry a name that is no number."""
    name = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("x"), F.col("o_orderkey"))).otherwise(
        _padded("o_orderkey")
    )
    return table(spark, d, "orders").select(F.concat(F.lit("images/sample/"), name, F.lit(".png")).alias("path"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    # keys are told apart as numbers, which take a fraction of the memory of paths
    return table(spark, d, "lineitem").select("l_orderkey").distinct().select(
        F.concat(F.lit("json/"), _padded("l_orderkey"), F.lit(".json")).alias("path")
    )


_FILES = """
images AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'x' || o_orderkey ELSE printf('%012d', o_orderkey) END AS stem FROM orders
),
records AS (SELECT DISTINCT printf('%012d', l_orderkey) AS stem FROM lineitem)"""


@query
def complete_ids(spark: SparkSession, d: str) -> DataFrame:
    """Posts with both files, read off the numeric file names."""
    return imports.complete_ids([_images(spark, d)], _records(spark, d)).orderBy("post_id")


SQL["complete_ids"] = f"""WITH {_FILES}
SELECT CAST(stem AS BIGINT) AS post_id FROM images WHERE regexp_full_match(stem, '[0-9]+')
INTERSECT SELECT CAST(stem AS BIGINT) FROM records"""


def _log(spark: SparkSession, d: str, overwrite: bool) -> DataFrame:
    files = pairing.classify(_images(spark, d).unionByName(_records(spark, d)))
    wanted = table(spark, d, "orders").where(F.col("o_orderstatus") != "O").select(_padded("o_orderkey").alias("stem"))
    pairs = imports.complete_pairs(pairing.pair(imports.restrict(files, wanted)))
    orders = table(spark, d, "orders")
    old_images = orders.where(F.col("o_totalprice") > 250000).select(
        F.concat(_padded("o_orderkey"), F.lit(".png")).alias("name")
    )
    old_records = orders.where(F.col("o_orderstatus") == "F").select(
        F.concat(_padded("o_orderkey"), F.lit(".json")).alias("name")
    )
    return imports.actions(imports.pair_files(pairs), old_images.unionByName(old_records), overwrite=overwrite)


_LOG = f"""{_FILES},
pairs AS (
  SELECT stem, o_totalprice, o_orderstatus FROM images JOIN records USING (stem)
  JOIN orders ON printf('%012d', o_orderkey) = stem WHERE o_orderstatus <> 'O'
),
log AS (
  SELECT stem, 'images/sample/' || stem || '.png' AS path, 'image' AS kind, stem || '.png' AS name,
    CASE WHEN o_totalprice > 250000 THEN 'skipped' ELSE 'imported' END AS action FROM pairs
  UNION ALL
  SELECT stem, 'json/' || stem || '.json', 'metadata', stem || '.json',
    CASE WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'imported' END FROM pairs
)"""


@query
def import_pairs(spark: SparkSession, d: str) -> DataFrame:
    """File actions of an import restricted to orders that are not open."""
    return _log(spark, d, False)


SQL["import_pairs"] = f"WITH {_LOG} SELECT * FROM log"


@query
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    return imports.action_counts(_log(spark, d, False))


SQL["import_summary"] = f"WITH {_LOG} SELECT action, count(*) AS n FROM log GROUP BY 1"


@query
def import_job(spark: SparkSession, d: str) -> DataFrame:
    """The import job itself: metadata of complete pairs whose record is not in the pool yet."""
    records = _records(spark, d).select(
        "path",
        names.stem(names.file_name(F.col("path"))).alias("stem"),
        F.parse_json(F.concat(F.lit('{"id": '), F.length("path"), F.lit(', "tags": {"artist": ["by"], "general": ["'), F.substring("path", 6, 12), F.lit('"]}}'))).alias("raw"),
    )
    orders = table(spark, d, "orders")
    targets = orders.where(F.col("o_orderstatus") == "F").select(F.concat(_padded("o_orderkey"), F.lit(".json")).alias("name"))
    plan = importing.import_folder(_images(spark, d).unionByName(_records(spark, d)), records, targets, site="board")
    return plan.metadata.select("stem", F.array_join("tags", "|").alias("tags"), "post_id", "source")


SQL["import_job"] = f"""WITH {_FILES}
SELECT stem, stem AS tags, CAST(22 AS BIGINT) AS post_id, 'board' AS source
FROM images JOIN records USING (stem)
WHERE stem NOT IN (SELECT printf('%012d', o_orderkey) FROM orders WHERE o_orderstatus = 'F')"""


@query
def import_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return imports.action_counts(_log(spark, d, True))


SQL["import_overwrite"] = f"WITH {_LOG} SELECT 'imported' AS action, count(*) AS n FROM log"


@query
def chosen_images(spark: SparkSession, d: str) -> DataFrame:
    """Image per post: sample, preview, original, else the first by name."""
    mode = (
        F.when(F.col("l_returnflag") == "A", "sample")
        .when(F.col("l_returnflag") == "N", "preview")
        .otherwise("original")
    )
    suffix = F.when(F.col("l_linestatus") == "F", ".png").otherwise(".jpg")
    lines = table(spark, d, "lineitem")
    posts = lines.select(
        F.col("l_orderkey").alias("post_id"),
        mode.alias("mode"),
        F.concat_ws("/", F.lit("images"), mode, F.concat(_padded("l_orderkey"), suffix)).alias("path"),
    )
    # Files exist for large lines; small lines only under another folder.
    folder = F.when(F.col("l_quantity") > 20, mode).otherwise(F.concat(F.lit("old_"), F.col("l_returnflag")))
    existing = lines.select(
        F.concat_ws("/", F.lit("images"), folder, F.concat(_padded("l_orderkey"), suffix)).alias("path")
    ).distinct()
    return imports.chosen_image(posts, existing)


SQL["chosen_images"] = """
WITH lines AS (
  SELECT l_orderkey, l_quantity, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'sample' WHEN 'N' THEN 'preview' ELSE 'original' END AS mode,
    printf('%012d', l_orderkey) || CASE l_linestatus WHEN 'F' THEN '.png' ELSE '.jpg' END AS file
  FROM lineitem
),
existing AS (
  SELECT DISTINCT l_orderkey, 'images/' || CASE WHEN l_quantity > 20 THEN mode ELSE 'old_' || l_returnflag END || '/' || file AS path FROM lines
),
listed AS (
  SELECT l_orderkey, 'images/' || mode || '/' || file AS path,
    CASE mode WHEN 'sample' THEN 1 WHEN 'preview' THEN 2 ELSE 3 END AS preference
  FROM lines
),
best AS (
  SELECT l_orderkey, path FROM listed WHERE path IN (SELECT path FROM existing)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY preference, path) = 1
),
named AS (SELECT l_orderkey, min(path) AS path FROM existing GROUP BY 1)
SELECT DISTINCT l.l_orderkey AS post_id, coalesce(b.path, n.path) AS image_path
FROM lines l LEFT JOIN best b ON b.l_orderkey = l.l_orderkey LEFT JOIN named n ON n.l_orderkey = l.l_orderkey"""


# --- incremental forms -------------------------------------------------------


@query
def incremental_import(spark: SparkSession, d: str) -> DataFrame:
    """Orders a query has seen that no earlier batch stored."""
    seen = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("post_id"))
    stored = table(spark, d, "lineitem").where(F.col("l_quantity") > 40).select(F.col("l_orderkey").alias("post_id"))
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), "o_orderpriority")
    return unseen(posts.join(seen, "post_id", "left_semi"), stored, "post_id")


SQL["incremental_import"] = """
SELECT o_orderkey AS post_id, o_orderpriority FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)"""


@query
def resumable_work(spark: SparkSession, d: str) -> DataFrame:
    """Documents a restarted captioning run still has to do."""
    done = table(spark, d, "labels").select("doc_id")
    return unseen(table(spark, d, "documents").select("doc_id", "source"), done, "doc_id")


SQL["resumable_work"] = """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


# --- streams over the tables --------------------------------------------------


@query
def import_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records that come in two runs, before or after their images and posts; each run sees new files only."""
    folder = work_folder(spark)
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    arriving = {
        "records": orders.select(
            _padded("o_orderkey").alias("stem"), F.array("o_orderpriority").alias("tags"), F.col("o_orderkey").alias("post_id"),
            F.lit("board").alias("source"), F.when(F.col("o_orderstatus") == "P", "missing tags").alias("reject"),
        ),
        "images": lines.where("l_quantity > 20").select(_padded("l_orderkey").alias("stem")).distinct(),
        "seen": lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("post_id")).distinct(),
    }

    def stream(name: str) -> DataFrame:
        return spark.readStream.schema(arriving[name].schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")

    for run in (0, 1):
        for name, rows in arriving.items():
            rows.where(F.pmod(F.xxhash64(F.lit(name), rows.columns[0]), F.lit(2)) == run).write.parquet(f"{folder}/{name}/{run}")
        found = incremental.admitted(stream("records"), stream("images"), stream("seen"))
        incremental.store_admitted(found, f"{folder}/pool", f"{folder}/state").awaitTermination()
    stored = spark.read.parquet(f"{folder}/pool").select("stem", "post_id", F.array_join("tags", ",").alias("tags"), "reject")
    rejects = spark.read.parquet(f"{folder}/pool-rejects").select("stem", "post_id", F.array_join("tags", ",").alias("tags"), "reject")
    return stored.unionByName(rejects)


SQL["import_arrivals"] = """
SELECT printf('%012d', o_orderkey) AS stem, o_orderkey AS post_id, o_orderpriority AS tags,
  CASE WHEN o_orderstatus = 'P' THEN 'missing tags' END AS reject
FROM orders
WHERE o_orderstatus = 'P' OR (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))"""


@query
def caption_retries(spark: SparkSession, d: str) -> DataFrame:
    """Documents captioned by a model that fails every third one twice: timers bring those back in later runs without a new file."""
    folder = work_folder(spark)
    requests = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("stem"), F.col("source").alias("image_path"), F.array("lang").alias("context_tags")
    )
    requests.write.json(f"{folder}/requests")

    def tagger(asked: DataFrame) -> DataFrame:
        fails = (F.col("stem").cast("long") % 3 == 0) & (F.col("attempt") < 3)
        error = F.when(fails, F.struct(F.lit("model").alias("stage"), F.lit("busy").alias("error"), F.lit("").alias("traceback")))
        return asked.select("stem", F.col("context_tags").alias("tags"), error.alias("error"))

    for _ in range(3):
        incremental.caption_stream(spark, f"{folder}/requests", f"{folder}/done", f"{folder}/state", tagger, wait_ms=0).awaitTermination()
    return spark.read.parquet(f"{folder}/done").select("stem", "tried", F.array_join("tags", ",").alias("tags"))


SQL["caption_retries"] = """
SELECT CAST(doc_id AS VARCHAR) AS stem, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END AS tried, coalesce(lang, '') AS tags FROM documents"""


# --- files written from the tables and read back --------------------------------


def _seen_lines(lines: DataFrame) -> DataFrame:
    """Text lines ``(flag, at, text)`` of one JSON member per return flag, the list of its orders; a line holds the ids of a thousand keys."""
    flag, ids = F.col("l_returnflag"), F.array_join(F.collect_set(F.col("l_orderkey").cast("string")), ",")
    named = lines.where(flag.isNotNull() & F.col("l_orderkey").isNotNull())
    listed = named.groupBy(flag.alias("flag"), F.expr("l_orderkey DIV 1000").alias("at")).agg(ids.alias("ids"))
    quoted = F.to_json(F.array("flag"))
    start = F.concat(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(':{"seen_post_ids":['))
    there = Window.partitionBy("flag").orderBy("at")
    opening = F.when(F.lag("at").over(there).isNull(), start).otherwise(",")
    # what stands between two members follows the first of them; a flag knows whether it is the last from the greatest
    last = listed.agg(F.max("flag").alias("last"))
    closing = F.when(F.lead("at").over(there).isNull(), F.when(F.col("flag") == F.col("last"), "]}").otherwise("]},")).otherwise("")
    return listed.join(F.broadcast(last)).select("flag", "at", F.concat(opening, "ids", closing).alias("text"))


def _write_catalogue(orders: DataFrame, lines: DataFrame, folder: str) -> None:
    """One download catalogue, a post a line.

    The layout asks for one document, which one task writes. It sorts keys, not texts, and lets go of a line once it is written.
    """
    path = lambda mode: F.concat(F.lit(f"images/{mode}/"), _padded("at"), F.lit(".png"))
    status = F.col("status")
    files = F.struct(
        F.concat(F.lit("json/"), _padded("at"), F.lit(".json")).alias("json"),
        F.struct(
            F.when(status == "P", path("preview")).alias("preview"), F.when(status != "F", path("sample")).alias("sample"),
            path("original").alias("original"),
        ).alias("image_paths"),
    )
    posts = orders.where(F.col("o_orderkey").isNotNull()).select(F.lit(1).alias("part"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    queries = _seen_lines(lines).withColumn("part", F.lit(3))
    frame = orders.sparkSession.sql("""SELECT * FROM VALUES (0, '{"posts":{'), (2, '},"queries":{'), (4, '}}') AS frame(part, text)""")
    rows = posts.unionByName(queries, allowMissingColumns=True).unionByName(frame, allowMissingColumns=True)
    post = F.concat(F.lit('"'), F.col("at").cast("string"), F.lit('":'), F.to_json(F.struct(files.alias("file_paths"))))
    text = F.when(F.col("line") == 1, post).otherwise(F.concat(F.lit(","), post))
    # line 0 opens the document; numbered in a step of its own, since under a condition only some rows would count
    numbered = rows.repartition(1).sortWithinPartitions("part", "flag", "at").withColumn("line", F.monotonically_increasing_id())
    numbered.select(F.when(F.col("part") == 1, text).otherwise(F.col("text"))).write.text(folder)


@query
def catalogue_posts(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their lines as one download catalogue, written as a file and read back: posts of a query and their paths."""
    folder = work_folder(spark)
    _write_catalogue(table(spark, d, "orders"), table(spark, d, "lineitem"), folder)
    seen, paths = files_source.read_catalogue(spark, folder)
    return paths.join(seen.where("query_key = 'R'"), "post_id", "left_semi")


SQL["catalogue_posts"] = """
WITH paths AS (
  SELECT o_orderkey AS post_id, printf('%012d', o_orderkey) AS name, o_orderstatus AS status, unnest(['json', 'preview', 'sample', 'original']) AS mode
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
)
SELECT post_id, mode, CASE mode WHEN 'json' THEN 'json/' || name || '.json' ELSE 'images/' || mode || '/' || name || '.png' END AS path
FROM paths WHERE mode IN ('json', 'original') OR (mode = 'preview' AND status = 'P') OR (mode = 'sample' AND status <> 'F')"""


@query
def record_store(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stored records, then those of one clerk's range written back: read from what is live."""
    folder = work_folder(spark)
    orders = table(spark, d, "orders")
    stem = _padded("o_orderkey").alias("stem")
    versions.write_records(orders.select(stem, F.to_json(F.struct("o_orderpriority")).alias("json")), folder)
    last = orders.agg(F.max("o_orderkey")).first()[0]
    changed = orders.where(F.col("o_orderkey") > last - last // 50)
    versions.write_records(changed.select(stem, F.to_json(F.struct("o_orderstatus", "o_orderpriority")).alias("json")), folder)
    return versions.read_records(spark, folder)


SQL["record_store"] = """
SELECT printf('%012d', o_orderkey) AS stem, CASE WHEN o_orderkey > (SELECT max(o_orderkey) - max(o_orderkey) // 50 FROM orders)
  THEN '{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}'
  ELSE '{"o_orderpriority":"' || o_orderpriority || '"}' END AS json
FROM orders"""


@query
def vocabulary_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a label list, written as CSV and read back; every ninth has its name in another column, every seventh none."""
    folder = work_folder(spark)
    key = F.col("p_partkey")
    named = F.when(key % 7 != 0, F.col("p_name"))
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(key % 9 != 0, named).alias("name"), F.when(key % 9 == 0, named).alias("tag_name"),
        F.when(key % 5 == 0, "x").otherwise((key % 5).cast("string")).alias("category"),
    )
    # the order of the rows is their meaning
    rows.orderBy("p_partkey").coalesce(1).drop("p_partkey").write.option("header", "true").csv(folder)
    return files_source.read_vocabulary(spark, folder).select("pos", "name", "category", "category_name")


SQL["vocabulary_files"] = """
SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_name AS name, category,
  CASE category WHEN 0 THEN 'general' WHEN 1 THEN 'artist' WHEN 3 THEN 'copyright' WHEN 4 THEN 'character' WHEN 5 THEN 'meta' ELSE 'unknown' END AS category_name
FROM (SELECT p_partkey, p_name, CAST(CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_partkey % 5 END AS INTEGER) AS category FROM part WHERE p_partkey % 7 <> 0)"""
