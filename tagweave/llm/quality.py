"""Quality rules by distribution divergence from language references.

A reference is what all documents of a language look like together: the shares of
character classes, and the shares of the language's most common words with all
others as one. A document is compared with every reference by Jensen-Shannon
distance (base 2, so 0 to 1) and judged by the nearest one. Texts too short to
show a distribution are not judged by it. A reference stands only with enough documents and words
besides the judged one, whose own counts are taken out of it, so no document vouches for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm.common import row_beside_text

#: lower-case letter, other letter, blank, digit, mark of a sentence, mark of layout or code, anything else
CLASSES = 7
SENTENCE = ".,;:!?'\"()-–—‘’“”«»¿¡…"
SYMBOLS = "#*$%&|<>"
MARKUP = SYMBOLS + "=+_/\\^~`@{}[]"
PARTIAL_WORDS = 300_000
#: A reference needs so many documents and words besides the judged document.
LEAST_DOCS, LEAST_WORDS = 20, 1000
MAX_LANGUAGES = 1000


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, CLASSES - 1, np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = 0 if char.islower() else 1
        elif char.isspace():
            table[code] = 2
        elif char.isdigit():
            table[code] = 3
    for char in SENTENCE:
        table[ord(char)] = 4
    for char in MARKUP:
        table[ord(char)] = 5
    return table


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.bincount(class_table()[codes], minlength=CLASSES)


def plain_words(text: str) -> list[bytes]:
    """Words in lower case without marks at their ends."""
    return [w.strip(b".,;:!?'\"()") for w in text.lower().encode().split()]


def repeated_words(words: list[bytes], width: int) -> int:
    """Words in windows of ``width`` words that are found twice or more."""
    if len(words) <= width:
        return 0
    names = dict.fromkeys(words)
    for number, word in enumerate(names):
        names[word] = number
    ids = np.array([names[w] for w in words], np.int64)
    windows = len(ids) - width + 1
    # windows by rank: doubling the width of ranked runs keeps the comparison exact
    rank, held = ids, 1
    while held < width:
        step = min(held, width - held)
        pairs = rank[: len(rank) - step] * np.int64(len(ids) + 1) + rank[step:]
        rank, held = np.unique(pairs, return_inverse=True)[1].astype(np.int64), held + step
    counts = np.bincount(rank)
    hits = np.flatnonzero(counts[rank[:windows]] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    letters = len(b"".join(words).decode())
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    seen, copies = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            copies += line in seen
            seen.add(line)
    return len(words), letters, symbols, copies, repeated_words(words, 8)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


class Reference:
    """Counts of a language: character classes, its common words, all words and documents."""

    def __init__(self, lang: str, classes: np.ndarray, words: dict[bytes, int], total: int, docs: int):
        self.lang, self.classes, self.total, self.docs = lang, classes, total, docs
        self.words, self.counts = list(words), np.array(list(words.values()), float)

    def distances(self, classes: np.ndarray, words: Counter, total: int, own: bool) -> tuple[float, float] | None:
        """By character classes and by common words; ``own``: the document is one of the reference's. None if too little is left."""
        docs, all_words = self.docs - own, self.total - own * total
        if docs < LEAST_DOCS or all_words < LEAST_WORDS:
            return None
        found = np.array([words.get(word, 0) for word in self.words], float)
        theirs = self.counts - own * found
        rest = lambda counts, all_: np.append(counts, all_ - counts.sum())
        return distance(classes, self.classes - own * classes), distance(rest(found, total), rest(theirs, all_words))


def references(docs: DataFrame, text: str, language: str, common: int) -> list[Reference]:
    """One reference per language (null: one more) of more than ``LEAST_DOCS`` documents and ``LEAST_WORDS`` words, from all documents.

    Tasks count classes and words before they are shuffled; what reaches the driver is ``common`` words per such language.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(language), F.lit("")).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: Counter = Counter()

        def emit():
            keys = list(words)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.binary()),
                "class": pa.nulls(len(keys), pa.int32()), "n": pa.array([words[k] for k in keys], pa.int64()),
            })
            words.clear()

        for batch in batches:
            for lang, content in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                found = plain_words(content)
                # the last places count all words and the documents
                classes[lang] = classes.get(lang, 0) + np.append(class_counts(content), [len(found), 1])
                for word, n in Counter(found).items():
                    words[lang, word] += n
                if len(words) > PARTIAL_WORDS:
                    yield from emit()
        yield from emit()
        for lang, counts in classes.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(counts), pa.string()), "word": pa.nulls(len(counts), pa.binary()),
                "class": pa.array(range(len(counts)), pa.int32()), "n": pa.array(counts, pa.int64()),
            })

    sums = rows.mapInArrow(count, "lang string, word binary, class int, n long").groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", F.col("class").isNull()).orderBy(F.desc("n"), "word")
    most = max(common, CLASSES + 2)
    best = sums.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    whole = Window.partitionBy("lang")
    best = best.withColumn("words", F.max(F.when(F.col("class") == CLASSES, F.col("n"))).over(whole))
    best = best.withColumn("docs", F.max(F.when(F.col("class") == CLASSES + 1, F.col("n"))).over(whole))
    best = best.where((F.col("docs") >= LEAST_DOCS) & (F.col("words") >= LEAST_WORDS))
    top = best.limit(2 * most * MAX_LANGUAGES + 1).collect()
    if len(top) > 2 * most * MAX_LANGUAGES:
        raise CurationError(f"more than {MAX_LANGUAGES} languages")
    found = []
    for lang in sorted({r["lang"] for r in top}):
        mine = [r for r in top if r["lang"] == lang]
        counts = np.zeros(CLASSES)
        for r in mine:
            if r["class"] is not None and r["class"] < CLASSES:
                counts[r["class"]] = r["n"]
        words = sorted((r for r in mine if r["word"] is not None and r["at"] <= common), key=lambda r: r["at"])
        found.append(Reference(lang, counts, {bytes(r["word"]): r["n"] for r in words}, mine[0]["words"], mine[0]["docs"]))
    return found


FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"


def rate(
    docs: DataFrame, *, text: str = "text", language: str = "lang", common: int = 50, min_words: int = 20, max_repeat_percent: int = 30,
    guard_words: int = 50, max_class_distance: float = 0.26, max_word_distance: float = 0.46,
    with_text: bool = True,
) -> DataFrame:
    """Base counts and verdict: the columns of ``docs`` in the struct ``row`` (the text among them if ``with_text``), the ``FACTS``, ``base_failed`` and ``kept``.

    A document fails the base rules with fewer than ``min_words`` words or more than ``max_repeat_percent`` percent of its words in
    repeated 8-word windows. Of the others, those with at least ``guard_words`` words go if they lie further from
    their nearest reference than a limit allows, by character classes or by common words; shorter ones stay.

    Null and empty texts have no words and fail. The language column only groups the references; a
    null language is a group of its own. Of its own group's reference a document's counts are taken out first, and references of
    fewer than ``LEAST_DOCS`` documents or ``LEAST_WORDS`` words are passed over, so a document under a rare label is judged by
    the other languages. Without any reference all distances are null and the base rules alone decide. References at the same
    distance judge alike. Repeated rows are rated each, one beside the other in their reference. A text of any length is counted
    whole. An empty table gives an empty result.
    """
    refs = references(docs, text, language, common)
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    rows, kind = row_beside_text(docs, text, with_text)
    rows = rows.select("row", "text", F.coalesce(F.col(f"row.`{language}`"), F.lit("")).alias("label"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, content in zip(batch["label"].to_pylist(), batch["text"]):
                content = content.as_py() or ""
                facts = base_counts(content)
                near: tuple[float | None, float | None] = (None, None)
                if facts[0] and shared.value:
                    classes, words = class_counts(content), plain_words(content)
                    counted = Counter(words)
                    found = (r.distances(classes, counted, len(words), r.lang == lang) for r in shared.value)
                    near = min((f for f in found if f is not None), key=sum, default=near)
                out.append((*facts, *near))
            columns = [pa.array([r[i] for r in out], pa.int64() if i < 5 else pa.float64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch["row"], *columns], ["row", *[f.split()[0] for f in FACTS.split(", ")]])

    found = rows.mapInArrow(judge, f"row {kind}, {FACTS}")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    far = (F.col("class_distance") > max_class_distance) | (F.col("word_distance") > max_word_distance)
    far = F.coalesce(far & (F.col("n_words") >= guard_words), F.lit(False))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
