"""An import reads every record once, however often its result is looked at."""

from pyspark.sql import functions as F

from tagweave.plans import importing


def test_records_are_read_once(spark):
    """The gate and the result each parsed them, and the gate those of records that stay as well."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(stem):
        read.add(1)
        return '{"id": %s, "tags": ["t"]}' % stem

    stems = spark.range(60).select(F.col("id").cast("string").alias("stem"))
    images = stems.select(F.concat("stem", F.lit(".png")).alias("path"))
    named = stems.select("stem", F.concat("stem", F.lit(".json")).alias("path"))
    records = named.select("path", "stem", F.parse_json(content("stem")).alias("raw"))
    targets = named.where("stem % 3 = 0").select(F.col("path").alias("name"))
    plan = importing.import_folder(images.unionByName(named.select("path")), records, targets, site="board")
    rows = plan.metadata.collect()
    assert sorted(r["post_id"] for r in rows) == [i for i in range(60) if i % 3]
    assert plan.metadata.count() == 40 and read.value <= 60
