import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import queries, vector_search


def plain_top(rows, k):
    usable = {}
    for vec, x in rows:
        if vec is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            usable.setdefault(vec, set()).add(tuple(math.floor(1024 * float(np.float32(c))) for c in x))
    out = []
    for query in (q for q in usable if q % 100 == 0):
        scores = {}
        for vec, vectors in usable.items():
            if vec != query:
                found = [sum(a * b for a, b in zip(q, v)) for q in usable[query] for v in vectors if len(q) == len(v)]
                if found:
                    scores[vec] = max(found)
        best = sorted(scores, key=lambda v: (-scores[v], v))[:k]
        out += [(query, rank, vec, scores[vec]) for rank, vec in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, k=10, **options):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id LONG, embedding ARRAY<FLOAT>, v STRING, id STRING")
    return sorted(map(tuple, vector_search.top_k(frame, is_query=F.col("vec_id") % 100 == 0, k=k, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"block_queries": 3}])
def test_top_k_matches_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(vector_search, "SCAN_SCORES", 500)
    chance = np.random.default_rng(5)
    rows = [(i, chance.normal(0, 0.2, 8).tolist()) for i in range(900)]
    rows += [(i, rows[100][1]) for i in range(900, 1300)]  # a third of the rows share a query's vector
    rows += [(1300, None), (1301, [None] * 8), (1302, [float("nan")] * 8), (1303, [float("inf")] * 8), (None, rows[0][1]), (5, rows[5][1])]
    rows += [(1400, [0.5, 0.5]), (1401, [0.25, -1.0]), (1402, []), (1500, []), (1600, rows[0][1]), (1600, rows[1][1])]
    assert found(spark, rows, **options) == plain_top(rows, 10)


def test_few_rows_and_none(spark):
    rows = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert found(spark, rows) == plain_top(rows, 10) and len(found(spark, rows)) == 2
    assert found(spark, [(100, [1.0])]) == [] and found(spark, [(1, [1.0])]) == []
    assert found(spark, rows, k=1) == plain_top(rows, 1)


@pytest.mark.parametrize("size", [2, 8])
def test_ids_at_more_than_k_vectors_match_sql_and_brute_force(spark, tmp_path, size):
    """A candidate and a query that each stand at more vectors than k, all near the top."""
    chance = np.random.default_rng(11)
    rows = [(i, chance.normal(0, 0.2, size).tolist()) for i in range(90, 190)]
    rows += [(7, (np.array(rows[10][1]) * (3 + i / 50)).tolist()) for i in range(30)]
    rows += [(200, (np.array(rows[10][1]) * (4 + i / 50)).tolist()) for i in range(30)]
    expected = []
    usable = {(i, tuple(math.floor(1024 * float(np.float32(c))) for c in v)) for i, v in rows}
    for query in (100, 200):
        pairs = [(-sum(a * b for a, b in zip(q, v)), vec) for i, q in usable if i == query for vec, v in usable if vec != query]
        expected += [(query, rank, vec, -score) for rank, (score, vec) in enumerate(sorted(pairs)[:10], 1)]
    assert found(spark, rows) == expected
    spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(db.execute(queries.SQL["op10_top_k"]).fetchall()) == expected
