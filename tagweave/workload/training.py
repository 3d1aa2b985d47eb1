"""Queries around runs: settings, run names, training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators import schedule
from tagweave.plans import runs
from tagweave.workload.tables import table

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


PRESET_OF = {
    "1-URGENT": "concept",
    "2-HIGH": "style",
    "3-MEDIUM": "clothing-detailed",
    "5-LOW": "no such preset",
}


def _specs(spark: SparkSession, d: str) -> DataFrame:
    """Every order asks for a run; settings are given for some of them."""
    preset = F.lit(None).cast("string")
    for priority, name in PRESET_OF.items():
        preset = F.when(F.col("o_orderpriority") == priority, name).otherwise(preset)
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit("ds"), F.col("o_orderstatus")).alias("dataset"),
        preset.alias("preset"),
        F.when(F.col("o_orderstatus") == "F", 64).alias("rank"),
        F.lit(None).cast("int").alias("steps"),
        F.when(F.col("o_totalprice") > 200000, 0.001).alias("learning_rate"),
        F.lit(None).cast("int").alias("batch_size"),
        F.lit(None).cast("int").alias("gradient_accumulation"),
        F.when(F.col("o_totalprice") > 400000, F.concat(F.lit("named-"), F.col("o_orderkey"))).alias("run_name"),
        (F.col("o_totalprice") > 300000).alias("no_prepare"),
    )


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Finished runs of the customers, with some folders that are not runs."""
    dataset = F.when(F.col("c_mktsegment") == "BUILDING", "dsF").when(
        F.col("c_mktsegment") == "MACHINERY", "dsP"
    ).otherwise(F.col("c_mktsegment"))
    run = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("run-x"), F.col("c_custkey"))).otherwise(
        F.format_string("run-%03d", F.col("c_custkey"))
    )
    return table(spark, d, "customer").select(dataset.alias("dataset"), run.alias("run"))


_ARTIFACTS = """
artifacts AS (
  SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'dsF' WHEN 'MACHINERY' THEN 'dsP' ELSE c_mktsegment END AS dataset,
    max(c_custkey) FILTER (NOT c_acctbal < 0) AS highest
  FROM customer GROUP BY 1
)"""


@query
def train_plan(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_plans(_specs(spark, d), _artifacts(spark, d))


SQL["train_plan"] = f"""WITH {_ARTIFACTS},
specs AS (
  SELECT *, 'ds' || o_orderstatus AS dataset, CASE o_orderpriority WHEN '1-URGENT' THEN 'concept' WHEN '2-HIGH' THEN 'style'
    WHEN '3-MEDIUM' THEN 'clothing-detailed' WHEN '5-LOW' THEN 'no such preset' END AS preset
  FROM orders
),
named AS (
  SELECT s.*, CASE WHEN o_totalprice > 400000 THEN 'named-' || o_orderkey
    ELSE printf('run-%03d', coalesce(highest, 0) + 1) END AS run_name
  FROM specs s LEFT JOIN artifacts USING (dataset)
)
SELECT o_orderkey, dataset, preset, run_name,
  CASE WHEN o_orderstatus = 'F' THEN 64 WHEN preset = 'concept' THEN 8 WHEN preset IN ('style', 'clothing-detailed') THEN 32 ELSE 16 END AS rank,
  CASE preset WHEN 'concept' THEN 1200 WHEN 'style' THEN 2500 WHEN 'clothing-detailed' THEN 2800 ELSE 2000 END AS steps,
  CASE WHEN o_totalprice > 200000 THEN 0.001e0 WHEN preset IN ('style', 'clothing-detailed') THEN 0.00005e0 ELSE 0.0001e0 END AS learning_rate,
  1 AS batch_size, 4 AS gradient_accumulation, o_totalprice > 300000 AS no_prepare, NOT o_totalprice > 300000 AS prepare_would_run,
  'artifacts/' || dataset || '/' || run_name AS artifact_dir, 'prepared/' || dataset AS prepared_dir
FROM named"""


@query
def next_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.next_runs(_specs(spark, d), _artifacts(spark, d))


SQL["next_runs"] = f"""WITH {_ARTIFACTS}
SELECT dataset, printf('run-%03d', coalesce(highest, 0) + 1) AS run_name
FROM (SELECT DISTINCT 'ds' || o_orderstatus AS dataset FROM orders) LEFT JOIN artifacts USING (dataset)"""


@query
def batch_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Seeded batches of the documents for two and a half epochs."""
    documents = table(spark, d, "documents").select("doc_id")
    count = documents.count()
    return schedule.batch_schedule(
        documents, key="doc_id", steps=-(-5 * count // 24), batch_size=4, accumulation=3, seed=7, rows_per_block=100
    )


SQL["batch_schedule"] = """
WITH n AS (SELECT count(*) AS n, (5 * count(*) + 23) // 24 AS steps, (((count(*) + 3) // 4) + 2) // 3 AS per FROM documents),
places AS (
  SELECT doc_id, epoch, steps, per, row_number() OVER (
    PARTITION BY epoch ORDER BY md5(doc_id || ':' || epoch || ':7'), doc_id) - 1 AS place
  FROM documents, n, (SELECT unnest(range(50)) AS epoch) WHERE epoch <= steps // per
)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, place, place // 4 AS batch, epoch * per + place // 12 + 1 AS step
FROM places WHERE epoch * per + place // 12 + 1 <= steps"""
