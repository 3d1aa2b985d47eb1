"""What the physical plans of the registered queries must look like."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagweave.operators import fusion, pairing, regions
from tagweave.workload import registry

FOLDER = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(query(spark, FOLDER)) for name, query in registry.QUERIES.items()}


@needs_tables
def test_no_cross_joins_and_no_unpartitioned_windows(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
        lines = text.splitlines()
        for above, below in zip(lines, lines[1:]):
            lone = "Window [" in above and "Exchange SinglePartition" in below
            assert not lone, name


@needs_tables
def test_python_runs_only_for_near_boxes(plans):
    users = {name for name, text in plans.items() if "InPandas" in text or "Arrow" in text or "Python" in text}
    assert "near_boxes" in users and users <= {"near_boxes", "near_boxes_in_tiles"}


@needs_tables
def test_scans_read_only_what_they_need(plans):
    text = plans["pair_candidates"]
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    text = plans["incremental_import"]
    assert "EqualTo(l_returnflag,R)" in text and "GreaterThan(l_quantity,40.0)" in text


def test_one_hot_record_is_cut_before_it_is_shuffled(spark):
    """A third of all rows under one record: each task passes on at most the limit."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("stem"),
        F.col("id").alias("pos"),
        F.concat(F.lit("tag "), F.col("id")).alias("raw"),
        F.lit("qwen").alias("source"),
        F.lit("objects").alias("namespace"),
        (F.col("id") / 30_000).alias("confidence"),
    )
    merged = fusion.merge_candidates(fusion.score_candidates(rows))
    assert plan(merged).count("WindowGroupLimit") == 2  # before and after the shuffle
    hot = merged.where("stem = 0").orderBy("rank").collect()
    assert len(hot) == 160 and hot[0]["tag"] == "tag 29997"
    assert merged.where("stem <> 0").count() == 20_000


@needs_tables
@pytest.mark.parametrize("name", ["merge_candidates", "prune_and_require", "edit_budget", "region_rank", "scored_regions"])
def test_top_k_is_cut_on_both_sides_of_the_shuffle(plans, name):
    text = plans[name]
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text and "Final" in text


@needs_tables
def test_facts_are_planned_once(plans):
    """Judged, ranked and required tags come out of one grouping: two tag sources and the judge's lists, each read once."""
    assert plans["prune_and_require"].count("/lineitem.parquet") == 3


def test_pairing_is_one_grouped_pass(spark):
    files = pairing.classify(spark.createDataFrame([("a.png",)], "path STRING"))
    text = plan(pairing.pair(files))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text and "Join" not in text


def test_likeness_counts_areas_before_any_window(spark):
    boxes = spark.createDataFrame([(1, 10)], "image_id INT, area INT")
    assert "Join" not in plan(regions.similar_counts(boxes))


@needs_tables
@pytest.mark.parametrize("name", ["tag_fusion", "fused_source_counts"])
def test_fusion_deals_out_lists_and_no_tags(spark, name):
    """Lists are shuffled by record before they are exploded; what is made of their tags stays where it is, also in the plan that ran."""
    frame = registry.QUERIES[name](spark, FOLDER)
    ran = frame._jdf.queryExecution()
    assert frame.count() and ran.toRdd().count()
    final = ran.executedPlan().toString().split("== Initial Plan ==")[0]
    above, below = final.split("posexplode(raws", 1)
    assert "isFinalPlan=true" in final and "Aggregate" in above and "Exchange" not in above
    assert "Exchange hashpartitioning(stem" in below.split("Union", 1)[0]
