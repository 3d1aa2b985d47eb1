"""Exact top-k search by inner product over a vector-approximation file.

Every vector becomes a row of cells, one byte per component, which bounds its inner
product with a query from both sides. A scan of the cells keeps what may still be among
the best; exact vectors are then read from the highest bound down: first the k best
by bound, whose scores tell what further bounds are still open, then only those.

Equal vectors are one class that keeps its k + 1 smallest ids: no result can need more, and
a vector that many rows share costs one row. A candidate is an id at a vector, as in the query's SQL: an id at
several vectors may stand in a result several times. A class that holds the query's own id only is
left out of its bounds, however many vectors that id has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import release, stored

CELLS = 256
#: Scores held at once by a scanning task.
SCAN_SCORES = 1 << 22


def integer_vectors(rows: DataFrame, vector_id: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, v) with v = floor(scale * x); without null ids and null or non-finite vectors."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    sound = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    usable = rows.where(F.col(vector_id).isNotNull() & F.col(vector).isNotNull() & sound & ~F.exists(vector, F.isnan))
    return usable.select(F.col(vector_id).cast("long").alias("id"), whole.alias("v"))


def classes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """Rows (h1, h2, v, ids): each distinct vector with its ``keep`` smallest ids."""
    keyed = vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))
    few = keyed.withColumn("rank", rank).where(F.col("rank") <= keep)
    return few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.collect_set("id").alias("ids"))


def quantisers(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: lowest value and cell width of each component."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, block, _ in by_length(batch["v"]):
                low, high = block.min(0), block.max(0)
                if size in held:
                    low, high = np.minimum(low, held[size][0]), np.maximum(high, held[size][1])
                held[size] = low, high
        for size, (low, high) in held.items():
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * size, pa.int32()), "at": pa.array(range(size), pa.int32()), "low": low, "high": high})

    found = classes.select("v").mapInArrow(extremes, "size int, at int, low long, high long")
    rows = found.groupBy("size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("size", "at").collect()
    out = {0: (np.zeros(0, np.int64), np.ones(0, np.int64))}
    for size in {r["size"] for r in rows}:
        low = np.array([r["low"] for r in rows if r["size"] == size], np.int64)
        high = np.array([r["high"] for r in rows if r["size"] == size], np.int64)
        out[size] = low, (high - low) // CELLS + 1
    return out


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, matrix, places) of the vectors of each length in a batch."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        index = (ends[places] - size)[:, None] + np.arange(size)
        yield int(size), flat[index.astype(np.int64)].reshape(len(places), size), places


def approximate(classes: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The approximation file: rows (h1, h2, only, cells), a byte per component; ``only`` is the id of a class that has just one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[bytes] = [b""] * batch.num_rows
            for size, block, places in by_length(batch["v"]):
                low, width = cells[size]
                rows = ((block - low) // width).astype(np.uint8)
                for place, row in zip(places, rows):
                    packed[place] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch["h1"], batch["h2"], batch["only"], pa.array(packed, pa.binary())], ["h1", "h2", "only", "cells"])

    only = F.when(F.size("ids") == 1, F.element_at("ids", 1))
    return classes.select("h1", "h2", only.alias("only"), "v").mapInArrow(pack, "h1 long, h2 long, only long, cells binary")


def scan(approximations: DataFrame, block: list[tuple[int, int, list[int]]], cells: dict, keep: int) -> DataFrame:
    """What a task cannot rule out for a block of queries (query, id, vector): rows (query, h1, h2, low, high).

    ``low`` and ``high`` bound the score. Classes of a query's own id only are none of its candidates. A task keeps the ``keep`` best lower bounds of every query as it goes.
    """
    sides = {}
    for size in {len(v) for *_, v in block}:
        names = np.array([q for q, _, v in block if len(v) == size], np.int64)
        ids = np.array([i for _, i, v in block if len(v) == size], np.int64)
        matrix = np.array([v for *_, v in block if len(v) == size], np.float64).reshape(len(names), size)
        low, width = cells.get(size, (np.zeros(size, np.int64), np.ones(size, np.int64)))
        reach = matrix * (width - 1)
        slack = 1e-9 * np.abs(matrix) @ (np.abs(low) + width * CELLS).astype(np.float64)
        sides[size] = names, ids, matrix * width, matrix @ low, np.minimum(reach, 0).sum(1) - slack, np.maximum(reach, 0).sum(1) + slack
    shared = approximations.sparkSession.sparkContext.broadcast(sides)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: np.full((len(side[0]), keep), -np.inf) for size, side in shared.value.items()}
        open_: dict[int, list] = {size: [] for size in shared.value}
        for batch in batches:
            h1, h2 = batch["h1"].to_numpy(), batch["h2"].to_numpy()
            single = batch["only"].is_valid().to_numpy(zero_copy_only=False)
            only = batch["only"].fill_null(0).to_numpy()
            packed = batch["cells"].to_pylist()
            sizes = np.array([len(p) for p in packed])
            for size, (names, ids, weighted, base, under, over) in shared.value.items():
                places = np.flatnonzero(sizes == size)
                step = max(1, SCAN_SCORES // max(1, len(names)))
                for start in range(0, len(places), step):
                    part = places[start : start + step]
                    rows = np.frombuffer(b"".join([packed[i] for i in part]), np.uint8).reshape(len(part), size)
                    scores = weighted @ rows.T.astype(np.float64) + base[:, None]
                    for c in np.flatnonzero(single[part] & np.isin(only[part], ids)):
                        scores[ids == only[part[c]], c] = -np.inf
                    joint = np.concatenate([best[size], scores], axis=1)
                    best[size] = np.partition(joint, joint.shape[1] - keep, axis=1)[:, -keep:]
                    limit = best[size].min(1) + under - over
                    q, c = np.nonzero((scores >= limit[:, None]) & (scores > -np.inf))
                    open_[size].append((q, h1[part[c]], h2[part[c]], scores[q, c]))
                    if sum(len(x[0]) for x in open_[size]) > SCAN_SCORES:
                        open_[size] = _still_open(open_[size], limit)
        for size, (names, _, _, _, under, over) in shared.value.items():
            limit = best[size].min(1) + under - over
            for q, a, b, score in _still_open(open_[size], limit):
                yield pa.RecordBatch.from_pydict({"query": names[q], "h1": a, "h2": b, "low": score + under[q], "high": score + over[q]})

    return approximations.mapInArrow(search, "query long, h1 long, h2 long, low double, high double")


def _still_open(parts: list, limit: np.ndarray) -> list:
    if not parts:
        return []
    q, a, b, score = (np.concatenate([p[i] for p in parts]) for i in range(4))
    keep = score >= limit[q]
    return [(q[keep], a[keep], b[keep], score[keep])]


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(
    rows: DataFrame, *, is_query: Column, k: int = 10, vector_id: str = "vec_id", vector: str = "embedding", scale: int = 1024,
    block_queries: int = 4096,
) -> DataFrame:
    """The k highest integer inner products of every query with all other rows: (query_id, rank, vec_id, score).

    ``is_query`` picks the queries by the columns of ``rows``. Ties go to the smaller id. Rows without id or whose vector is
    null or holds null or non-finite components take no part. Vectors of different length are not
    compared; the score of empty vectors is 0. Rows that repeat id and vector count once; a query is not its own result, whatever row
    has its id. An id that stands at several vectors is a candidate with each. A query id that does is searched for each, and its
    k best pairs of own and other row count. Fewer than k pairs give what there is; empty tables give an empty result. Scores are exact below 2**63.
    """
    spark = rows.sparkSession
    classes = stored(classes_of(integer_vectors(rows, vector_id, vector, scale), k + 1))
    cells = quantisers(classes)
    approximations = stored(approximate(classes, cells))
    queries = integer_vectors(rows.where(is_query), vector_id, vector, scale)
    queries = stored(queries.select("id", "v", F.monotonically_increasing_id().alias("query")).dropDuplicates(["id", "v"]))
    blocks = -(-queries.count() // block_queries)
    found = []
    for number in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).select("query", "id", "v").collect()
        bounds = scan(approximations, [(r["query"], r["id"], r["v"]) for r in block], cells, k)
        found.append(stored(bounds))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bounds = reduce(DataFrame.unionByName, found)
    by_low = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    # each class holds a candidate at least
    least = bounds.withColumn("at", by_low).where(F.col("at") <= k).groupBy("query").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    least = least.select("query", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("least"))
    possible = stored(bounds.join(least, "query").where(F.col("high") >= F.col("least")).select("query", "h1", "h2", "high"))
    by_high = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "h1", "h2"))
    first = possible.withColumn("at", by_high).where(F.col("at") <= k).drop("at")

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(classes.withColumnRenamed("v", "candidate"), ["h1", "h2"]).join(queries, "query")
        both = both.select("query", "id", "h1", "h2", dot("v", "candidate").alias("score"), F.explode("ids").alias("vec_id"))
        return both.where(F.col("vec_id") != F.col("id"))

    read = stored(scored(first))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = read.withColumn("at", F.row_number().over(by_score)).where(F.col("at") == k).select("query", F.col("score").alias("kth"))
    rest = possible.join(kth, "query", "left").where("kth IS NULL OR high >= kth").select("query", "h1", "h2")
    rest = rest.join(read.select("query", "h1", "h2").distinct(), ["query", "h1", "h2"], "left_anti")
    every = read.unionByName(scored(rest))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    best = every.withColumn("rank", rank).where(F.col("rank") <= k)
    result = stored(best.select(F.col("id").alias("query_id"), "rank", "vec_id", "score"))
    release(*found, possible, read, approximations, classes, queries)
    return result
