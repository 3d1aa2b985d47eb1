"""Collocations from count streams in prefix and suffix order.

Counting goes by length: words first, then pairs of words that are frequent by themselves, then longer phrases
all of whose pairs are frequent. A bitmap of bounded size says which words and pairs may be frequent; what it lets through
wrongly falls to the exact threshold. Every part of a frequent phrase is as frequent, so no count that a score needs is missing.

The counts form one stream, from the empty phrase (all words of the language) to the longest ones. Dealt by range and
sorted by words, a phrase follows its prefixes, so one pass with a stack of at most ``longest`` counts yields the
counts of all prefixes and the largest count of a one-word extension to the right. The result, sorted by reversed words,
is read the same way for suffixes and extensions to the left. A range may begin inside a subtree: its ancestors
are handed to it, so that no first word, however frequent its phrases, has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.bitmaps import bitmap, may_hold
from tagweave.llm.common import release, shuffle_partitions, stored
from tagweave.llm.near_dedup import mixed

#: Texts are counted together until they hold this many bytes, so that repeats leave a task once.
BLOCK_BYTES = 8 << 20
#: Breaks between pieces become a newline, blanks a space, A-Z lower case.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes(10 if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
COUNTS = "lang string, phrase string, n long"


class Block:
    """The words of some texts of one language: a dictionary, and per occurrence its number and piece."""

    def __init__(self, lang: str, texts: list[bytes]):
        folded = b"\n".join(texts).translate(FOLD)
        encoded = pa.array(folded.split(), pa.binary()).dictionary_encode()
        self.lang = lang
        self.words: pa.Array = encoded.dictionary
        self.ids = encoded.indices.to_numpy().astype(np.int64)
        signs = np.frombuffer(folded, np.uint8)
        breaks = signs == 10
        inside = ~breaks & (signs != 32)
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        self.pieces = np.cumsum(breaks, dtype=np.int32)[starts]
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py(), seed) for w in self.words), np.uint64, len(self.words))

    def rows(self, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang]).take(pa.array(np.zeros(len(phrases), np.int32))), phrases.cast(pa.string()), pa.array(counts, pa.int64())],
            ["lang", "phrase", "n"],
        )

    def counted(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = pc.value_counts(pa.array(keys))
        return found.field("values").to_numpy(), found.field("counts").to_numpy()

    def joined(self, columns: list[np.ndarray]) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(c)) for c in columns], b" ")

    def pair_hashes(self) -> np.ndarray:
        """A hash per place, of the word there and the next one."""
        words = self.hashes[self.ids]
        return mixed(mixed(words[:-1]) + words[1:])

    def singles(self) -> Iterator[pa.RecordBatch]:
        """All words, and their number under the empty phrase."""
        if len(self.ids):
            yield self.rows(self.words, np.bincount(self.ids, minlength=len(self.words)))
            yield self.rows(pa.array([b""]), np.array([len(self.ids)]))

    def pairs(self, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        good = may_hold(frequent, self.hashes)[self.ids]
        places = np.flatnonzero(good[:-1] & good[1:] & (self.pieces[:-1] == self.pieces[1:]))
        if len(places):
            keys, counts = self.counted(self.ids[places] * len(self.words) + self.ids[places + 1])
            yield self.rows(self.joined([keys // len(self.words), keys % len(self.words)]), counts)

    def longer(self, frequent: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
        """Phrases of three and more words whose pairs may all be frequent."""
        if len(self.ids) < 3:
            return
        good = may_hold(frequent, self.pair_hashes()) & (self.pieces[:-1] == self.pieces[1:])
        places = np.flatnonzero(good)
        # numbers of the distinct phrases that start at each place, one word more in every round
        distinct, numbers = np.unique(self.ids[places] * len(self.words) + self.ids[places + 1], return_inverse=True)
        columns = [distinct // len(self.words), distinct % len(self.words)]
        for length in range(3, longest + 1):
            ahead = places + length - 2
            stays = (ahead < len(good)) & good[np.minimum(ahead, len(good) - 1)]
            places, numbers = places[stays], numbers[stays]
            if not len(places):
                return
            keys = numbers * len(self.words) + self.ids[places + length - 1]
            distinct, numbers, counts = np.unique(keys, return_inverse=True, return_counts=True)
            columns = [c[distinct // len(self.words)] for c in columns] + [distinct % len(self.words)]
            yield self.rows(self.joined(columns), counts)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of one language each, out of batches of (lang, text)."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary())):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from (Block(*item) for item in held.items())
                held, size = {}, 0
    yield from (Block(*item) for item in held.items())


def _counts(texts: DataFrame, count, min_count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield from count(block)

    found = texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(found.where((F.col("n") >= min_count) | (F.col("phrase") == "")))


def _hashes(counts: DataFrame) -> DataFrame:
    """The hash of every phrase of one or two words, as blocks make it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist()):
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                found.append([xxhash.xxh3_64_intdigest(w.encode(), seed) for w in phrase.split(" ")])
            if not found:
                continue
            words = np.array(found, np.uint64)
            hashes = words[:, 0] if words.shape[1] == 1 else mixed(mixed(words[:, 0]) + words[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    return counts.where("phrase <> ''").select("lang", "phrase").mapInArrow(run, "hash long")


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 5, min_count: int = 100) -> DataFrame:
    """Rows (lang, phrase, n): exact counts of all phrases of up to ``longest`` words found ``min_count`` times or more.

    The empty phrase stands for all words of its language. A null language is ``und``; null and blank texts have no words.
    The caller releases the table.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = _counts(texts, Block.singles, min_count)
    known_words = bitmap(_hashes(words))
    pairs = _counts(texts, lambda block: block.pairs(known_words), min_count)
    known_pairs = bitmap(_hashes(pairs))
    more = _counts(texts, lambda block: block.longer(known_pairs, longest), min_count)
    found = stored(words.unionByName(pairs).unionByName(more))
    release(words, pairs, more)
    return found


def _streamed(rows: DataFrame, order: str, parents: str, widest: str) -> DataFrame:
    """``rows`` with the counts of the proper prefixes of the array ``order`` and the largest count of a one-word extension.

    ``rows`` holds lang, ``order``, n and others, each (lang, order) once, beside all prefixes of every one. Two tables are
    stored on the way; the caller releases the one it gets.
    """
    names = rows.columns
    partitions = shuffle_partitions(rows.sparkSession)
    dealt = stored(rows.repartitionByRange(partitions, "lang", order).withColumn("part", F.spark_partition_id()))
    # a part may start inside a subtree: the prefixes of its first phrase are handed to it
    firsts = dealt.groupBy("part").agg(F.min(F.struct("lang", order)).alias("first")).select("part", "first.*").where(F.size(order) > 0)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda k: F.slice(order, F.lit(1), k))
    above = firsts.select("part", "lang", F.explode(prefixes).alias(order)).join(dealt.withColumnRenamed("part", "home"), ["lang", order])
    handed = above.where("home <> part").select("part", *names, F.lit(True).alias("handed"))
    stream = dealt.select("part", *names, F.lit(False).alias("handed")).unionByName(handed)
    stream = stream.repartitionByRange(partitions, "part").sortWithinPartitions("part", "lang", order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    at_words, at_count = stream.columns.index(order), stream.columns.index("n")
    at_lang = stream.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [row, counts of its prefixes, largest extension] of a phrase and, below it, its prefixes
        done: list[list] = []
        place = None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                words, count = row[at_words], row[at_count]
                if place != (row[0], row[at_lang]):
                    done += stack
                    stack, place = [], (row[0], row[at_lang])
                while stack and stack[-1][0][at_words] != words[: len(stack[-1][0][at_words])]:
                    done.append(stack.pop())
                if stack and len(stack) == len(words):
                    stack[-1][2] = max(stack[-1][2], count)
                stack.append([row, [x[0][at_count] for x in stack], 0])
            if done:
                yield gathered(done, batch.schema)
                done = []
        if stack:
            yield gathered(stack, batch.schema)

    def gathered(done: list[list], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(values, field.type) for values, field in zip(zip(*(x[0] for x in done)), schema)]
        columns += [pa.array([x[1] for x in done], pa.list_(pa.int64())), pa.array([x[2] for x in done], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*schema.names, parents, widest])

    read = stored(stream.mapInArrow(run, f"{kinds}, `{parents}` array<long>, `{widest}` long"))
    release(dealt)
    elsewhere = read.where("handed").groupBy("lang", order).agg(F.max(widest).alias("elsewhere"))
    own = read.where("NOT handed").join(elsewhere, ["lang", order], "left")
    found = own.select(*names, parents, F.greatest(widest, F.coalesce("elsewhere", F.lit(0))).alias(widest))
    found.stored_path = read.stored_path
    return found


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)), exactly."""
    a, n, l, r = (x.cast("decimal(20,0)") for x in (a, n, l, r))  # noqa: E741
    return F.call_function("div", F.lit(1000) * a * n, l * r)


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 5, min_count: int = 100, inside: int = 100, top: int = 2000
) -> DataFrame:
    """The first ``top`` collocations of every language: (lang, rank, phrase, a, l, r, n, score).

    Texts are split into pieces at ``.,;:!?`` and U+000A to U+000D, pieces into words at spaces and tabs; A-Z are lower-cased.
    A phrase of 2 to ``longest`` words counts every place inside a piece, overlaps included. With a = its count, n = all words of the
    language, l and r = the counts of its parts at a cut, the score is the least floor(1000 a n / (l r)) over the cuts; of equal ones the
    first cut counts. Only phrases with a >= ``min_count`` stand, and none that lies inside a longer one with a count of at
    least ``inside`` percent of its own. Order: score and a descending, phrase ascending by bytes.

    A null language is ``und``; null, empty and blank texts have no words; rows are never compared, so repeated rows and ids
    count as often as they stand. A language without such phrases has no rows, nor has an empty table. A text of any length is
    read whole, in one block.
    """
    counts = frequent_phrases(docs, text=text, lang=lang, longest=longest, min_count=min_count)
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    forward = _streamed(counts.select("lang", words.alias("words"), "n"), "words", "lefts", "right_most")
    both = _streamed(forward.withColumn("backward", F.reverse("words")), "backward", "rights", "left_most")
    phrases = both.where((F.size("words") > 1) & (100 * F.greatest("left_most", "right_most") < inside * F.col("n")))
    phrases = phrases.withColumnRenamed("n", "a").withColumn("n", F.get("lefts", F.lit(0)))
    length = F.size("words")
    cuts = F.transform(
        F.sequence(F.lit(1), length - 1),
        lambda k: F.struct(
            _score(F.col("a"), F.col("n"), F.get("lefts", k), F.get("rights", length - k)).alias("score"), k.alias("cut"),
            F.get("lefts", k).alias("l"), F.get("rights", length - k).alias("r"),
        ),
    )
    scored = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.array_min(cuts).alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    found = stored(scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    release(counts, forward, both)
    return found
