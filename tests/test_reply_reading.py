"""Replies with boxes are read once, and measured as before."""

import pytest
from pyspark.sql import functions as F

from tagweave.functions import overlay
from tagweave.workload import registry


def test_replies_are_read_outside_the_generator(spark, tmp_path):
    """There the making of a reply and its reading were interpreted, which was most of polygon_checks."""
    line = {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "l_suppkey": 7, "l_extendedprice": 1.0, "l_quantity": 2.0, "l_tax": 0.02, "l_discount": 0.04}
    spark.createDataFrame([line]).write.parquet(f"{tmp_path}/lineitem.parquet")
    checked = registry.QUERIES["polygon_checks"](spark, str(tmp_path))
    (made,) = [line for line in checked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert "variant" not in made and "lambda" not in made
    assert [r["item"] for r in checked.orderBy("item").collect()] == [0, 1]


@pytest.mark.parametrize(
    ("reply", "boxes"),
    [("[[1,2,3,4],[5,6]]", [[1, 2, 3, 4]]), ("[[[1,2,3,4],[5,6]],[[7,8,9,10]]]", [[1, 2, 3, 4], [7, 8, 9, 10]]), ("[]", []),
     ('["a",[1,2,3,4],[[5,6,7,8],[9]],[1,"b",3,4]]', [[1, 2, 3, 4], [5, 6, 7, 8], [1, None, 3, 4]]), ('{"a":1}', []), ('3', []), ("[null,[null],[[1,2,3,4]]]", [[1, 2, 3, 4]]), ("null", [])],
)
def test_rectangles_of_mixed_replies(spark, reply, boxes):
    assert spark.range(1).select(overlay.rectangles(F.parse_json(F.lit(reply)))).first()[0] == boxes


@pytest.mark.parametrize(
    ("points", "area"),
    [([(0, 0), (4, 0), (4, 3), (0, 3)], 12.0), ([(0, 0), (4, 0), (0, 3)], 6.0), ([(1, 1)], 0.0), ([], 0.0), ([(0, 0), (2, 1)], 0.0), (None, None)],
)
def test_area_of_any_number_of_points(spark, points, area):
    frame = spark.createDataFrame([(points,)], "points array<struct<x:int,y:int>>")
    assert frame.select(overlay.polygon_area(F.col("points"))).first()[0] == area
