"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a seeded hash, anew in each pass
over the source, so the blocks come in permuted order. Its target fixes how many
whole passes it gets and where its last pass is cut; that is an exact quota of
blocks, the last one cut short. A tree then splits the vector of quotas between
the output shards: a node that stands for shards [a, b) draws its left half's
blocks without replacement from its own. A leaf holds how many blocks of each
source its shard gets; since siblings take neighbouring ranges of a source's
sequence, shards draw disjoint blocks. Rows are shuffled within their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.cluster import constant_rows
from tagweave.errors import CurationError
from tagweave.llm.common import WORD, release, stored

#: Hashes are whole numbers below 2**48; a bin is a run of them.
SPAN = 48
BIN_BITS = 12


@dataclass
class Source:
    name: str | None
    size: int
    target: float = 0.0
    passes: int = 0  # whole ones
    rest: int = 0  # words of the last pass
    cut: int = -1  # hash at which the last pass is cut
    cut_row: tuple[int, int] = (0, 0)  # content and nth of the row at which it is cut, of those with that hash
    cut_words: int = 0  # words that this row gives
    blocks: int = 1
    quota: int = 0


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Share ``share`` of all sizes by weight; none above ``most`` times its size, the excess reshared."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    found = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit >= most * sizes[i]}
        if not full:
            for i in open_:
                found[i] = weights[i] * unit
            break
        for i in full:
            found[i] = float(most * sizes[i])
        left, open_ = left - sum(found[i] for i in full), open_ - full
    return found


def draw_hash(which: Column, seed: int) -> Column:
    """Place of a row in a pass, from what it holds and which of its repeats it is, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), which, F.col("key"), F.col("content"), F.col("nth")), 64 - SPAN)


def numbered(docs: DataFrame, doc: str, size: str, source: str) -> DataFrame:
    """A stored table (row, key, source, size, content, number, nth) of ``docs``.

    ``content`` hashes all columns but maps and variants, ``number`` is the row's own, and ``nth`` counts rows of the same content from 0.
    Repeats are counted within the parts that ``number`` was given by, each offset by the parts before, so no task
    sees more repeats of a row than one part holds.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    words = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = stored(docs.select(
        F.struct("*").alias("row"), F.struct(F.col(doc), F.col(source)).alias("key"), F.col(source).alias("source"), words.alias("size"),
        F.xxhash64(*hashed).alias("content"), F.monotonically_increasing_id().alias("number"),
    ))
    places = rows.select("content", "number", F.shiftright("number", 33).alias("part"))
    repeated = places.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    counts = places.groupBy("content", "part").agg(F.count("*").alias("n")).join(repeated, "content")
    before = F.sum("n").over(Window.partitionBy("content").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(counts.select("content", "part", F.coalesce(before, F.lit(0)).alias("before")))
    here = F.row_number().over(Window.partitionBy("content", "part").orderBy("number")) - 1
    later = stored(places.join(offsets, ["content", "part"]).select("number", (F.col("before") + here).alias("nth")).where("nth > 0"))
    release(offsets)
    return rows.join(later, "number", "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def block_of(at, blocks):
    """Block of a hash; for numbers and for columns."""
    if isinstance(at, int):
        return ((at >> 16) * blocks) >> 32
    return F.shiftright(F.shiftright(at, 16) * blocks, 32)


def _facts(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    kinds = {"si": "int", "name": "string", "target": "double"}
    found = constant_rows(spark, columns, rows)
    return found.select(*[F.col(c).cast(kinds.get(c, "long")) for c in columns])


def _sources(sized: DataFrame, weights, share: float, most: float, block_words: int, max_sources: int) -> list[Source]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise CurationError(f"more than {max_sources} sources")
    found = [Source(r["source"], r["size"]) for r in sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))]
    shares = targets([s.size for s in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    for source, target in zip(found, shares):
        source.target = target
        words = min(round(target), math.floor(most * source.size))
        source.passes, source.rest = divmod(words, source.size) if source.size else (0, 0)
        source.blocks = max(1, math.ceil(source.size / block_words))
    return found


def _find_cuts(spark: SparkSession, hashed: DataFrame, sources: list[Source]) -> None:
    """Where the last pass of each source ends, by digits of the hash.

    A round sums words by bins of the open range of each source (partial sums
    first), runs over at most 2**BIN_BITS bins per source and brings one row per
    source to the driver. The bins of the last round are single hashes.
    """
    open_ = {i: (0, s.rest) for i, s in enumerate(sources) if s.rest}  # start of the range, words before the cut
    for shift in range(SPAN - BIN_BITS, -1, -BIN_BITS):
        if not open_:
            return
        ranges = F.broadcast(constant_rows(spark, ["si", "low", "need"], [(i, a, b) for i, (a, b) in open_.items()]))
        wide = shift + BIN_BITS
        bins = (
            hashed.join(ranges, "si").where(F.shiftright("last_hash", wide) == F.shiftright(F.col("low").cast("long"), wide))
            .groupBy("si", "need", F.shiftright("last_hash", shift).alias("bin")).agg(F.sum("size").alias("words"))
        )
        before = F.sum("words").over(Window.partitionBy("si").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
        hits = bins.where("before < need AND before + words >= need").select("si", "bin", (F.col("need") - F.col("before")).alias("need"))
        open_ = {r["si"]: (r["bin"] << shift, r["need"]) for r in hits.collect()}
    if not open_:
        return
    # rows may still share a hash by chance
    cuts = F.broadcast(constant_rows(spark, ["si", "cut", "need"], [(i, cut, need) for i, (cut, need) in open_.items()]))
    order = Window.partitionBy("si").orderBy("content", "nth")
    met = hashed.join(cuts, "si").where("last_hash = cut")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("before", F.coalesce(before, F.lit(0))).where("before < need AND before + size >= need")
    for r in met.select("si", "cut", "content", "nth", (F.col("need") - F.col("before")).alias("words")).collect():
        found = sources[r["si"]]
        found.cut, found.cut_row, found.cut_words = r["cut"], (r["content"], r["nth"]), r["words"]


def split_tree(quotas: list[int], shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaves [first, last) of the tree as (shard, start of its range by source, count by source).

    Every shard gets as many blocks as the others, but for one. A node's draw depends on
    the seed and its range only, so tasks that share a path draw it alike.
    """
    total = int(sum(quotas))
    bound = lambda shard: total * shard // shards  # noqa: E731  blocks before a shard

    def walk(low: int, high: int, start: np.ndarray, count: np.ndarray):
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, start, count
            return
        middle = (low + high) // 2
        chance = np.random.default_rng([seed, low, high])
        left = chance.multivariate_hypergeometric(count, bound(middle) - bound(low), method="marginals")
        yield from walk(low, middle, start, left)
        yield from walk(middle, high, start + left, count - left)

    yield from walk(0, shards, np.zeros(len(quotas), np.int64), np.array(quotas, np.int64))


def _shard_of_block(spark: SparkSession, sources: list[Source], shards: int, seed: int) -> DataFrame:
    """Rows (si, draw, shard): the shard of each block of each source's sequence."""
    quotas = [s.quota for s in sources]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high in zip(batch["low"], batch["high"]):
                for shard, start, count in split_tree(quotas, shards, low, high, seed):
                    used = np.flatnonzero(count)
                    yield pd.DataFrame({"si": used, "shard": shard, "start": start[used], "stop": start[used] + count[used] - 1})

    step = 64
    spans = spark.range(0, shards, step).select(F.col("id").alias("low"), F.least(F.col("id") + step, F.lit(shards)).alias("high"))
    ranges = spans.mapInPandas(leaves, "si int, shard long, start long, stop long")
    return ranges.select("si", "shard", F.explode(F.sequence("start", "stop")).alias("draw"))


def mix(
    docs: DataFrame, *, doc: str = "doc_id", size: str = "size", source: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, most: float = 2, block_words: int = 1 << 17, shard_blocks: int = 64, seed: int = 20, max_sources: int = 100_000,
) -> DataFrame:
    """Draw documents so that each source gives its target of words.

    ``size`` names a column of word counts (see :func:`word_count`). Sources stand by code point,
    null last, and take the weights in turn. One row per document and pass that takes words of it:
    the columns of ``docs`` in the struct ``row``, ``number`` (one per row of ``docs``), ``size``, ``source_size``, ``target``, ``pass``, ``shard``,
    ``place`` (order within the shard) and ``taken`` (words; below the size only for the document at
    which a source's last pass is cut). A document that is never taken has one row with null
    ``pass``, ``shard`` and ``place`` and 0 ``taken``.

    Documents of null or no size are not taken. A null source is a source. Every row has a place of its own
    in a pass, also where ids are null or repeated; at most one document per source is cut short. An empty table gives an empty result. One row per source passes the driver;
    more than ``max_sources`` raise an error. A mix has at most 10**9 blocks.
    """
    spark = docs.sparkSession
    sized = numbered(docs, doc, size, source)
    sources = _sources(sized, weights, share, most, block_words, max_sources)
    if not sources:
        return sized.select(
            "row", "number", "size", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("source_size", "long"), ("target", "double"), ("pass", "long"), ("shard", "long"), ("place", "int"), ("taken", "long"))]
        )
    passes = _facts(spark, ["si", "name", "passes"], [(i, s.name, s.passes) for i, s in enumerate(sources)])
    hashed = stored(
        sized.join(F.broadcast(passes), F.col("source").eqNullSafe(F.col("name"))).where("size > 0")
        .select("si", "size", "content", "nth", draw_hash(F.col("passes"), seed).alias("last_hash"))
    )
    _find_cuts(spark, hashed, sources)
    release(hashed)
    for s in sources:
        s.quota = s.passes * s.blocks + (block_of(s.cut, s.blocks) + 1 if s.rest else 0)
    shards = max(1, math.ceil(sum(s.quota for s in sources) / shard_blocks))
    facts = _facts(
        spark, ["si", "name", "source_size", "target", "passes", "cut", "cut_content", "cut_nth", "cut_words", "blocks"],
        [(i, s.name, s.size, s.target, s.passes, s.cut, *s.cut_row, s.cut_words, s.blocks) for i, s in enumerate(sources)],
    )
    here = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("name"))).select(
        "row", "number", "key", "content", "nth", "size", "source_size", "target", "si", "passes", "cut", "cut_content", "cut_nth", "cut_words", "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"),
    ).withColumn("at", draw_hash(F.col("pass"), seed))
    here_at, cut_at = F.struct("at", "content", "nth"), F.struct(F.col("cut").alias("at"), F.col("cut_content").alias("content"), F.col("cut_nth").alias("nth"))
    taken = (
        F.when((F.col("pass") < F.col("passes")) | (here_at < cut_at), F.col("size"))
        .when(here_at == cut_at, F.col("cut_words")).otherwise(0)
    )
    here = here.withColumn("taken", taken)
    drawn = here.where("taken > 0").withColumn("draw", F.col("pass") * F.col("blocks") + block_of(F.col("at"), F.col("blocks")))
    never = here.where("taken = 0 AND pass = 0").select(
        "row", "number", "size", "source_size", "target", F.lit(None).cast("long").alias("pass"), F.lit(None).cast("long").alias("shard"),
        F.lit(None).cast("int").alias("place"), "taken",
    )
    placed = drawn.join(_shard_of_block(spark, sources, shards, seed), ["si", "draw"])
    order = F.xxhash64(F.lit(seed), "shard", "pass", "key", "content", "nth")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(order, "content", "nth", "pass"))
    return placed.select("row", "number", "size", "source_size", "target", "pass", "shard", place.alias("place"), "taken").unionByName(never)


def word_count(text: Column) -> Column:
    """Words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
