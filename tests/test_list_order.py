"""Lists put in order within a group: right, and by compiled comparisons."""

from pyspark.sql import functions as F

from tagweave.operators import fusion
from tagweave.plans import tag_fusion


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_final_lists_are_sorted_in_compiled_code(spark):
    """What stands under a lambda is interpreted, the comparisons of a sort included: 16 million tags took 960 CPU seconds that way."""
    none = F.lit(None).cast("long")
    rows = spark.range(2000).select(
        (F.col("id") % 2).alias("stem"), F.concat(F.lit("t"), F.col("id")).alias("tag"),
        F.struct(F.when(F.col("id") < 1000, 3).otherwise(2).alias("block"), none.alias("judged_at"), (-F.col("id")).alias("required_0")).alias("place"),
    ).repartition(7, "tag")
    lists = tag_fusion.final_lists(rows)
    assert "lambdafunction" not in plan(lists)
    for row in lists.collect():
        late, early = range(1998 + row["stem"], 999, -2), range(998 + row["stem"], -1, -2)
        assert row["tags"] == [f"t{i}" for i in [*late, *early]] and row["fell_back"]


def test_other_lists_are_sorted_in_compiled_code(spark):
    rows = spark.range(300).select(
        (F.col("id") % 3).alias("stem"), F.lit("a").alias("source"), F.lit("objects").alias("field"), (-F.col("id")).alias("pos"),
        (-F.col("id")).alias("rank"), F.col("id").cast("string").alias("tag"), F.col("id").cast("string").alias("raw"),
    )
    joined = fusion.joined_in_order(rows, ["stem"], "rank", "tag", " ")
    assert "lambdafunction" not in plan(joined) + plan(tag_fusion.source_lists(rows))
    expected = {i: [str(n) for n in range(297 + i, -1, -3)] for i in range(3)}
    assert {r["stem"]: r["joined"].split(" ") for r in joined.collect()} == expected
    assert {r["stem"]: r["source_tags"]["a"] for r in tag_fusion.source_lists(rows).collect()} == expected
    assert {r["stem"]: r["kept_lists"]["objects"] for r in tag_fusion.judged_lists(rows, rows).collect()} == expected
