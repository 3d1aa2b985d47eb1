"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words, a window into shingles of five words (of all its words, if it has fewer).
A window can only occur where all of its shingles do, so the prefix that the join needs is one shingle, and the rarest
is the best: shingles are ordered by how often the documents hold them. A window with a shingle that no document holds is
dropped. Neighbouring windows that share their prefix shingle make one probe: the shingle with the words before and after
it that the windows span. Documents are read twice, once to count the shingles of items, once to pick the places of prefix
shingles, each with the few words around it. A place joins the probes of its shingle where both sides leave room for a
window (length and position), and the words around them are compared one by one from the shingle outwards: what agrees, if
it is as long as a window, is a run of occurring windows.

A bitmap of bounded size tells the tasks that read documents which shingles matter; the join is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.bitmaps import bitmap, may_hold
from tagweave.llm.common import release, row_beside_text, stored
from tagweave.llm.near_dedup import mixed

#: Words of a shingle; a window with fewer has one shingle of all its words.
SHINGLE = 5
#: A probe goes on with its shingle while no other one of the window is this many times rarer.
SLACK = 2
#: Texts are looked through together until they hold this many bytes.
BLOCK_BYTES = 4 << 20
#: Letters, digits and all beyond ASCII stand, A-Z in lower case; all else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash for each place at which ``size`` words begin."""
    count = len(words) - size + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    encoded = pa.array(words, pa.binary()).dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in encoded.dictionary), np.uint64, len(encoded.dictionary))
    hashes = each[encoded.indices.to_numpy()]
    rolled = hashes[:count].copy()
    for offset in range(1, size):
        rolled = mixed(rolled) + hashes[offset : offset + count]
    return mixed(rolled + np.uint64(size))


def _blocks(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of texts, in lists that hold about ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(text or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _places(block: list[list[bytes]], sizes: list[int], known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, places in the block, texts, hashes) of shingles that ``known`` may hold and that lie in one text."""
    words = [word for text in block for word in text]
    ends = np.cumsum([len(text) for text in block])
    for size in sizes:
        hashes = shingles(words, size)
        places = np.flatnonzero(may_hold(known, hashes))
        texts = np.searchsorted(ends, places, "right")
        inside = places + size <= ends[texts]
        yield size, places[inside], texts[inside], hashes[places[inside]]


def item_classes(items: DataFrame, item: str, text: str) -> DataFrame:
    """Rows (cls, words, items): items of the same words are one class, with the sorted ids; items without words are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(words_of(content)) for content in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item"], pa.array(words, pa.binary()).cast(pa.string())], ["item", "words"])

    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item string, words string")
    classes = rows.where("words <> ''").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stored(classes.select(F.monotonically_increasing_id().alias("cls"), "words", "items"))


def class_shingles(classes: DataFrame) -> DataFrame:
    """Rows (cls, at, hash, size): the shingles of every class, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, content in zip(batch["cls"].to_pylist(), batch["words"].to_pylist()):
                words = content.encode().split(b" ")
                size = min(SHINGLE, len(words))
                found = shingles(words, size).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "cls": np.full(len(found), cls), "at": np.arange(len(found), dtype=np.int32), "hash": found,
                    "size": np.full(len(found), size, np.int32),
                })

    return stored(classes.select("cls", "words").mapInArrow(run, "cls long, at int, hash long, size int"))


def shingle_counts(docs: DataFrame, text: str, sizes: list[int], known: np.ndarray) -> DataFrame:
    """Rows (hash, n): how often documents hold the shingles that ``known`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(x for batch in batches for x in batch["text"].to_pylist()):
            for _, _, _, hashes in _places(block, sizes, known):
                found, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": found.view(np.int64), "n": counts.astype(np.int64)})

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def probes_of(words: list[str], counts: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """(place of the prefix shingle, first word, end) of the runs of windows that share it; windows with an absent shingle go.

    The prefix shingle of a window is its rarest one (the last of equals), but the one of the window before stays while it
    is in the window and none is ``SLACK`` times rarer.
    """
    window, size = min(width, len(words)), min(SHINGLE, len(words))
    chosen, first, end = None, 0, 0
    for start in range(len(words) - window + 1):
        span = counts[start : start + window - size + 1]
        rarest = min(span)
        if chosen is not None and rarest and chosen >= start and counts[chosen] <= SLACK * rarest:
            end = start + window
            continue
        if chosen is not None:
            yield chosen, first, end
        chosen = None
        if rarest:
            chosen = start + len(span) - 1 - span[::-1].index(rarest)
            first, end = start, start + window
    if chosen is not None:
        yield chosen, first, end


PROBE = "hash long, key string, before array<string>, after array<string>"


def probes(classes: DataFrame, ranked: DataFrame, width: int) -> DataFrame:
    """Rows (cls, window, hash, key, before, after): ``before`` runs from the shingle ``key`` backwards."""
    counts = ranked.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("at", "n", "hash"))).alias("places"))
    rows = classes.join(counts, "cls").select("cls", F.split("words", " ").alias("words"), "places.n", "places.hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cls, words, n, hashes in zip(*(column.to_pylist() for column in batch.columns)):
                size = min(SHINGLE, len(words))
                for at, first, end in probes_of(words, n, width):
                    out.append((cls, min(width, len(words)), hashes[at], " ".join(words[at : at + size]), words[first:at][::-1], words[at + size : end]))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cls", "window", "hash", "key", "before", "after"])

    return rows.mapInArrow(run, f"cls long, window int, {PROBE}")


def candidates(docs: DataFrame, text: str, sizes: list[int], known: np.ndarray, width: int) -> DataFrame:
    """Rows (row, number, n_words, places): the places of prefix shingles in every document, with the words around them."""
    rows, kind = row_beside_text(docs, text, with_text=False)
    around = width - SHINGLE
    place = pa.struct([
        ("hash", pa.int64()), ("at", pa.int32()), ("key", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for block in _blocks(iter(batch["text"].to_pylist())):
                found: list[list[dict]] = [[] for _ in block]
                begins = np.cumsum([0, *(len(words) for words in block)])
                for size, places, texts, hashes in _places(block, sizes, known):
                    for spot, number, hash_ in zip(places.tolist(), texts.tolist(), hashes.view(np.int64).tolist()):
                        words, at = block[number], spot - int(begins[number])
                        found[number].append({
                            "hash": hash_, "at": at, "key": b" ".join(words[at : at + size]).decode(),
                            "before": [w.decode() for w in words[max(0, at - around) : at][::-1]],
                            "after": [w.decode() for w in words[at + size : at + size + around]],
                        })
                part = batch.slice(start, len(block))
                start += len(block)
                yield pa.RecordBatch.from_arrays([
                    part["row"], part["number"], pa.array([len(words) for words in block], pa.int64()), pa.array(found, pa.list_(place)),
                ], ["row", "number", "n_words", "places"])

    numbered = rows.select("row", F.monotonically_increasing_id().alias("number"), "text")
    schema = f"row {kind}, number long, n_words long, places array<struct<hash:bigint,at:int,key:string,before:array<string>,after:array<string>>>"
    return stored(numbered.mapInArrow(run, schema))


def agreeing(x: Column, y: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs == 0, F.least(F.size(x), F.size(y))).otherwise(differs.cast("int") - 1)


def occurrences(places: DataFrame, sought: DataFrame) -> DataFrame:
    """Rows (number, start, end, cls): runs of occurring windows, by word; both sides hold the columns of ``PROBE``."""
    p, s = places.alias("p"), sought.alias("s")
    size = F.size(F.split("p.key", " "))
    room = F.least(F.size("p.before"), F.size("s.before")) + size + F.least(F.size("p.after"), F.size("s.after"))
    met = p.join(s, (F.col("p.hash") == F.col("s.hash")) & (F.col("p.key") == F.col("s.key")) & (room >= F.col("s.window")))
    met = met.select("number", "at", "cls", "window", size.alias("size"), agreeing(F.col("p.before"), F.col("s.before")).alias("back"), agreeing(F.col("p.after"), F.col("s.after")).alias("on"))
    met = met.where(F.col("back") + F.col("size") + F.col("on") >= F.col("window"))
    return met.select("number", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("size") + F.col("on")).alias("end"), "cls")


def merged(spans: DataFrame) -> DataFrame:
    """Rows (number, spans, n_hit): the union of the spans (number, start, end) of every document."""
    order = Window.partitionBy("number").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    joined = opened.withColumn("run", F.sum("opens").over(order)).groupBy("number", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))


def contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10
) -> DataFrame:
    """Which words of ``docs`` lie in windows of ``items``: rows (row, n_words, n_hit, spans, items), one per row of ``docs``.

    ``row`` holds the columns of ``docs`` without the text. Words are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. A window is ``width`` consecutive words of an item, or a whole item of fewer words. ``spans`` are the merged
    runs of hit words (start, end), ``n_hit`` counts their words, ``items`` are the sorted ids, as strings, of the items of
    which a window occurs.

    Null, empty and blank texts have no words: such documents are never hit and such items hit nothing. Rows that repeat an id
    or a text are judged one by one; items that repeat an id hit under it together, items of the same words are looked for once. The words
    of an item without id count as hits, but name no item. Without documents the result is empty, without items no document is hit. A text
    of any length is read whole.
    """
    classes = item_classes(items, item, item_text)
    places = class_shingles(classes)
    sizes = sorted(r["size"] for r in places.select("size").distinct().collect())  # five at most
    counts = stored(shingle_counts(docs, text, sizes, bitmap(places.select("hash").distinct())))
    ranked = places.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sought = stored(probes(classes, ranked, width))
    base = candidates(docs, text, sizes, bitmap(sought.select("hash").distinct()), width)
    release(places, counts)
    found = stored(occurrences(base.select("number", F.inline("places")), sought).distinct())
    release(sought)
    spans = merged(found.select("number", "start", "end").distinct())
    named = found.select("number", "cls").distinct().join(classes.select("cls", "items"), "cls")
    named = named.groupBy("number").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = spans.join(named, "number")
    every = base.select("row", "number", "n_words").join(hit, "number", "left")
    result = stored(every.select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ))
    release(classes, base, found)
    return result
