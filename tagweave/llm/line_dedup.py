"""Line dedup over levelled sorted runs of line hashes, DataFrame functions only.

Documents come in batches of descending ids. A batch is reduced to its line keys
(how many of its documents hold each, and the largest such id), which are
merge-anti-joined with every live run: keys that no run holds are new and keep
their holder, the others only add to the count. Both go into the batch's own
run, sorted and bucketed by key. When a level holds ``fanout`` runs, they are
compacted to one run of the next level. Since later batches have smaller ids,
the holder met first is the largest id that holds the key.

Keys are two 64-bit hashes of the stripped, lower-cased line (128 bits in all).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import BLANKS, ascii_lower, release, remove, shared_folder, shuffle_partitions, stored

KEY = ["k1", "k2"]


class LineRuns:
    """Levels of sorted runs: rows (k1, k2, n_docs, holder), one per key and run.

    A holder is set in the run that met its key first and null in later ones.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark = spark
        self.fanout = fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[tuple[str, str]]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, keys: DataFrame) -> None:
        """One batch: ``keys`` holds k1, k2, n_docs and holder, each key once."""
        keys = stored(keys)
        fresh = keys
        for run in self.runs():
            fresh = fresh.join(run, KEY, "left_anti")
        known = keys
        if self.runs():
            fresh = stored(fresh)
            known = keys.join(fresh, KEY, "left_anti").withColumn("holder", F.lit(None).cast("long"))
            self._write(0, fresh.unionByName(known))
            release(fresh)
        else:
            self._write(0, fresh)
        release(keys)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def totals(self) -> DataFrame:
        """n_docs and holder of every key over all runs."""
        return self._merged([run for level in self.levels for run in level])

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # runs are read as plain files here: a union of bucketed tables would be taken for bucketed itself
        schema = self.spark.table(runs[0][0]).schema
        rows = self.spark.read.schema(schema).parquet(*[path for _, path in runs])
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def drop(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]

    def _write(self, level: int, rows: DataFrame) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_folder(self.spark)
        (
            rows.select(*KEY, "n_docs", "holder").repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        merged = self._merged(old)
        self.levels[level] = []
        self._write(level + 1, merged)
        self._drop(old)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def occurrences(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """Long lines as rows (doc, print, pos, k1, k2); print tells rows of one id apart."""
    lines = docs.select(
        F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("print"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
    ).where("doc IS NOT NULL")
    keyed = lines.select("doc", "print", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "doc", "print", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    )


def dedup_lines(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
    batches: int = 4, fanout: int = 3,
) -> DataFrame:
    """Drop lines whose key is found in ``min_docs`` documents, except in the largest id.

    Returns the columns of ``docs`` in the struct ``row`` (so no name can clash), with ``kept``
    (the remaining lines joined by newline), ``n_lines`` and ``n_dropped``.

    A null or empty text is one empty line. Rows of a null id neither count nor lose lines. Rows
    that share an id count as one document. An empty table gives an empty result. Within its
    holder a line stays as often as it occurs.
    """
    spark = docs.sparkSession
    cuts = docs.agg(
        F.percentile_approx(F.col(doc), [i / batches for i in range(1, batches)], 10_000).alias("cuts")
    ).first()["cuts"] or []
    found = occurrences(docs, doc, text, min_chars)
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc") > cut).cast("int")
    found = stored(found.withColumn("batch", batch))
    runs = LineRuns(spark, fanout)
    for number in range(len(cuts), -1, -1):
        runs.add(
            found.where(F.col("batch") == number).groupBy(*KEY)
            .agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("holder"))
        )
    common = stored(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "holder"))
    runs.drop()
    dropped = (
        found.join(common, KEY).where(F.col("doc") != F.col("holder"))
        .groupBy("doc", "print").agg(F.collect_set("pos").alias("dropped"))
    )
    # the lines are made below the join, so the join's output holds them as one column
    split = docs.select(
        F.struct("*").alias("row"), F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("print"),
        F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"),
    )
    joined = split.join(dropped, ["doc", "print"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(places, lambda p: F.get(F.col("lines"), p)), "\n")
    )
    return joined.select(
        "row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
