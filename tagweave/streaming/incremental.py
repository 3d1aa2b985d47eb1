"""Incremental jobs on file streams with keyed state.

What earlier batches did lies in the state of the streams, by stem or post: no batch reads earlier results, inputs or keys
again. Every micro-batch replaces its own ``batch=<id>`` folder, so a batch repeated after a failure gives the same
result. What could not be used goes to the same folder below ``<target>-rejects``.

State grows with the stems seen, so it is kept in RocksDB, outside the heap; keep the checkpoint on shared storage. A stream has
at most two state partitions a core, since each of them costs files and time in every batch, however little it holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tagweave.functions import names, variants
from tagweave.operators import imports
from tagweave.sources.files import decoded_path

RECORD = "stem string, tags array<string>, post_id long, source string, reject string"
CONTENT = {"tags": "array<string>", "post_id": "long", "source": "string"}
#: Stems share their keyed state by so many hash buckets, fixed for a checkpoint.
BUCKETS = 4096
REQUEST = "stem string, image_path string, context_tags array<string>"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
#: A retry waits this long after the first failure and twice as long after each further one.
RETRY_MS = 60_000
MOST_ATTEMPTS = 8


def unseen(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not stored yet: the batch form of both jobs."""
    return rows if done is None else rows.join(done.select(key), key, "left_anti")


def _store(rows: DataFrame, failed: Column, target: str, batch: int) -> None:
    """Good rows below ``target``, the others beside it."""
    rows = rows.persist()
    try:
        rows.where(failed).write.mode("overwrite").parquet(f"{target}-rejects/batch={batch}")
        rows.where(~failed).write.mode("overwrite").parquet(f"{target}/batch={batch}")
    finally:
        rows.unpersist()


def _started(spark: SparkSession, writer: DataStreamWriter, checkpoint: str, **options: str) -> StreamingQuery:
    """Start a stream over all that has come, with options that the session keeps for this stream only.

    A checkpoint goes on with the store and the partitions that it began with.
    """
    partitions = min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    wanted = {STATE_STORE: ROCKS_DB, PARTITIONS: str(partitions)} | options
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# --- import -----------------------------------------------------------------


def _first_come(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The records of a bucket of stems in a batch: of each stem the first one is imported, later ones are known, several different ones rejected."""
    rows = pd.concat(frames, ignore_index=True)[["stem", "content", "reject"]]
    known = set(state.get[0]) if state.exists else set()
    first: dict[str | None, int] = {}
    differ = set()
    for i, (stem, content, reject) in enumerate(zip(rows["stem"], rows["content"], rows["reject"])):
        if reject is None and stem not in known and rows["content"].iat[first.setdefault(stem, i)] != content:
            differ.add(stem)
    good = [i for stem, i in first.items() if stem not in differ]
    if good:
        state.update(([*known, *rows["stem"].iloc[good]],))
        yield rows.iloc[good]
    bad = rows["reject"].notna()
    repeated = ~bad & rows["stem"].isin(differ)
    if repeated.any():
        rows.loc[repeated, "reject"] = "repeated stem with different content"
    if (bad | repeated).any():
        yield rows[bad | repeated]


def admitted(records: DataFrame, images: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Stream of records that can be imported now, each stem once, and of rejects.

    All arguments are streams: ``records`` holds the columns of ``RECORD``, ``images(stem)`` the images that are there, ``seen(post_id)``
    the posts of the query. A record waits in the state of a join until its image and its post have come, in any order. Records of one
    stem that differ are rejected if they come in one batch; after an import, what comes for its stem is known and dropped.
    """
    ready = records.where(F.col("reject").isNull())
    if images is not None:
        ready = ready.join(images.select("stem").dropDuplicates(["stem"]), "stem")
    if seen is not None:
        ready = ready.join(seen.select("post_id").dropDuplicates(["post_id"]), "post_id")
    content = F.to_json(F.struct(*CONTENT)).alias("content")
    columns = [F.pmod(F.xxhash64("stem"), F.lit(BUCKETS)).alias("bucket"), "stem", content, "reject"]
    every = ready.select(*columns).unionByName(records.where(F.col("reject").isNotNull()).select(*columns))
    # a call per bucket: one per stem costs more than all else
    chosen = every.groupBy("bucket").applyInPandasWithState(_first_come, "stem string, content string, reject string", "imported array<string>", "append", "NoTimeout")
    read = F.from_json("content", ", ".join(f"{name} {kind}" for name, kind in CONTENT.items()))
    return chosen.select("stem", read.alias("content"), "reject").select("stem", "content.*", "reject")


def store_admitted(found: DataFrame, target: str, checkpoint: str, targets: DataFrame | None = None) -> StreamingQuery:
    """Run a stream of :func:`admitted` over all that has come, then stop."""

    def store(batch: DataFrame, batch_id: int) -> None:
        fresh = unseen(batch, targets, "stem")
        _store(fresh, F.col("reject").isNotNull(), target, batch_id)

    return _started(found.sparkSession, found.writeStream.outputMode("append").foreachBatch(store), checkpoint)


def import_stream(
    spark: SparkSession,
    records: str,
    target: str,
    checkpoint: str,
    *,
    site: str,
    seen: str | None = None,
    targets: DataFrame | None = None,
    images: str | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Import new JSON records of a growing folder, then stop.

    ``images`` and ``seen`` are growing folders too, of JSON lines with ``stem`` and ``post_id``: the images that are there and the posts of
    the query. A record whose image or post has not come yet waits in the state for a later run. ``targets(stem)`` lists
    records that the pool holds already. Unreadable records, and those that share a stem in a batch but differ, are rejected.
    """

    def limited(reader):
        return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)

    def listing(folder: str | None, schema: str) -> DataFrame | None:
        return None if folder is None else limited(spark.readStream.schema(schema)).json(folder)

    reader = spark.readStream.format("text").schema("value STRING").option("wholetext", "true")
    lines = limited(reader.option("recursiveFileLookup", "true")).load(records)
    parsed = lines.select(
        names.stem(names.file_name(decoded_path())).alias("stem"),
        variants.parse_object(F.col("value")).alias("raw"),
    )
    found = admitted(imports.import_metadata(parsed, site), listing(images, "stem STRING"), listing(seen, "post_id LONG"))
    return store_admitted(found, target, checkpoint, targets)


# --- captions ---------------------------------------------------------------


def _due(wait_ms: int, most: int):
    """State function over the requests and failures of a bucket of stems: what is to be tried now.

    The state holds a JSON text per stem: path, context, attempt, whether it is being tried, and when it is due again.
    """
    columns = ["stem", "image_path", "context_tags", "attempt", "problem"]

    def due(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {stem: told for stem, *told in map(json.loads, state.get[0])} if state.exists else {}
        asks: list[tuple] = []
        changed = False
        came: dict[str | None, list] = {}
        if not state.hasTimedOut:
            rows = pd.concat(frames, ignore_index=True)
            for row in zip(*(rows[name] for name in ("kind", "stem", "image_path", "context_tags", "attempt", "at"))):
                came.setdefault(row[1], []).append(row)

        def ask(stem: str, path: str | None, context: list | None, attempt: int) -> None:
            held[stem] = [path, context, attempt, True, None]
            asks.append((stem, path, context, attempt, None))

        for stem, events in came.items():
            told = {(path, None if context is None else tuple(context)) for kind, _, path, context, *_ in events if kind == "request"}
            if stem is None or len(told) > 1:
                problem = "no stem" if stem is None else "repeated stem with different requests"
                refused = [(stem, path, context, 0, problem) for kind, _, path, context, *_ in events if kind == "request"]
            if stem is None:  # ticks, and requests that name no stem
                asks += refused
                continue
            path, context, attempt, asked, again = held.get(stem, (None, None, 0, False, None))
            failed = [int(at) for kind, *_, tried, at in events if kind == "failure" and tried == attempt]
            if failed and asked:
                at = max(failed) + wait_ms * 2 ** (attempt - 1)
                held[stem], asked, changed = [path, context, attempt, False, at if attempt < most else None], False, True
                if attempt < most and at <= now:
                    ask(stem, path, context, attempt + 1)
                    continue
            if asked or not told:
                continue
            if len(told) > 1:
                asks += refused
                continue
            # also a request that comes again while a failed one waits
            path, context = told.pop()
            ask(stem, path, None if context is None else list(context), attempt + 1)
        for stem, (path, context, attempt, _, again) in list(held.items()):
            if again is not None and again <= now:
                ask(stem, path, context, attempt + 1)
        if changed or any(problem is None for *_, problem in asks):
            state.update(([json.dumps([stem, *told]) for stem, told in held.items()],))
        waiting = [again for *_, again in held.values() if again is not None]
        if waiting:
            state.setTimeoutDuration(min(waiting) - now)
        if asks:
            yield pd.DataFrame(asks, columns=columns)

    return due


def due_requests(events: DataFrame, wait_ms: int = RETRY_MS, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Stream of requests to try now: the columns of ``REQUEST``, ``attempt`` and ``problem`` (set for requests that cannot be tried).

    ``events`` holds requests and failures by ``kind``: the columns of ``REQUEST``, ``attempt`` and ``at`` (milliseconds; both of failures).
    A stem is asked once. A failure sets a timer in its state, for ``wait_ms`` after the first and twice as long after each
    further one; when it has run out, the request that the state holds is due again, up to ``most_attempts`` times. A bucket of
    stems shares its state and a timer, which runs out with the first of them.
    """
    # a call per bucket: one per stem costs more than all else
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("stem"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(
        _due(wait_ms, most_attempts), f"{REQUEST}, attempt int, problem string", "held array<string>", "append", "ProcessingTimeTimeout",
    )


def caption_stream(
    spark: SparkSession,
    requests: str,
    target: str,
    checkpoint: str,
    tagger: Callable[[DataFrame], DataFrame],
    *,
    max_files: int = 64,
    wait_ms: int = RETRY_MS,
    most_attempts: int = MOST_ATTEMPTS,
) -> StreamingQuery:
    """Tag request files batch by batch, then stop; finished records survive an abort.

    Failed requests are taken up by later runs once their wait is over, without a new file: failures come back to the state
    through files beside the checkpoint, and a run begins with a tick there, so that timers run out even if nothing else is new. A
    tagger sees the number of the attempt in ``attempt``. Requests of one stem that differ within a batch are rejected.
    """
    failures, ticks = f"{checkpoint}-failures", f"{checkpoint}-ticks"
    tick = spark.range(1).select(F.lit(None).cast("string").alias("stem"))
    tick.write.mode("append").json(f"{ticks}/{uuid.uuid4().hex}")
    spark.createDataFrame([], "stem string, attempt int, at long").write.mode("ignore").parquet(f"{failures}/batch=none")

    def events(stream: DataFrame, kind: str) -> DataFrame:
        there = {c: F.col(c) for c in stream.columns}
        absent = {"image_path": "string", "context_tags": "array<string>", "attempt": "int", "at": "long"}
        rest = {c: F.lit(None).cast(t) for c, t in absent.items()}
        return stream.select(F.lit(kind).alias("kind"), *[(rest | there)[c].alias(c) for c in ("stem", *absent)])

    asked = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", max_files).json(requests)
    failed = spark.readStream.schema("stem string, attempt int, at long").option("recursiveFileLookup", "true").parquet(failures)
    ticked = spark.readStream.schema("stem string").option("recursiveFileLookup", "true").json(ticks)
    every = events(asked, "request").unionByName(events(failed, "failure")).unionByName(events(ticked, "tick"))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            tagged = tagger(batch.where("problem IS NULL").drop("problem"))
            if "error" not in tagged.columns:
                tagged = tagged.withColumn("error", F.lit(None).cast("struct<stage:string,error:string,traceback:string>"))
            attempts = batch.where("problem IS NULL").select("stem", F.col("attempt").alias("tried"))
            tagged = tagged.join(attempts, "stem").persist()
            try:
                refused = batch.where("problem IS NOT NULL").select("stem", "problem")
                rows = tagged.withColumn("problem", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)
                bad = F.col("error").isNotNull() | F.col("problem").isNotNull()
                now = F.unix_millis(F.current_timestamp())
                lost = tagged.where(F.col("error").isNotNull()).select("stem", F.col("tried").alias("attempt"), now.alias("at"))
                lost.write.mode("overwrite").parquet(f"{failures}/batch={batch_id}")
                _store(rows, bad, target, batch_id)
            finally:
                tagged.unpersist()
        finally:
            batch.unpersist()

    writer = due_requests(every, wait_ms, most_attempts).writeStream.outputMode("append").foreachBatch(store)
    # timers ask for batches without end; the tick is the one that lets them run out
    return _started(spark, writer, checkpoint, **{NO_DATA: "false"})
