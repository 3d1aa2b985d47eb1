"""Language identification of mixed texts by expectation-maximisation.

A language is a distribution over hashed character n-grams. A document's n-grams
are taken to be drawn from a mixture of languages; expectation-maximisation finds
the proportions. The set of languages is grown from the likeliest single one:
another language joins if its best mixture gains more log-likelihood than the
penalty for one more proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm.common import row_beside_text, with_small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
MAX_LANGUAGES = 500


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


def ngrams(text: str) -> np.ndarray | None:
    """Buckets of the n-grams of a text's letters, other characters as one blank; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    known = letters()[codes]
    if not known.any():
        return None
    codes = np.where(known, codes, 32).astype(np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    parts, mixed = [], np.zeros(len(codes), np.uint32)
    for order in ORDERS:
        mixed = mixed[: len(codes) - order + 1] * np.uint32(0x9E3779B1) + codes[order - 1 :]
        spread = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order)
        parts.append(spread >> np.uint32(17))
    return np.concatenate(parts)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: probability

    def identify(self, text: str | None, penalty: float, rounds: int) -> tuple[str, float, list[tuple[str, float]]]:
        """Likeliest language, its share, and all shares from largest to smallest."""
        grams = ngrams(text) if text and self.languages else None
        if grams is None:
            return UNKNOWN, 0.0, []
        counts = np.bincount(grams, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        weight, chance = counts[used].astype(float), self.table[used]
        chosen, shares = self._choose(weight, chance, penalty, rounds)
        order = sorted(range(len(chosen)), key=lambda i: (-shares[i], chosen[i]))
        return self.languages[chosen[order[0]]], float(shares[order[0]]), [(self.languages[chosen[i]], float(shares[i])) for i in order]

    @staticmethod
    def _choose(weight: np.ndarray, chance: np.ndarray, penalty: float, rounds: int) -> tuple[list[int], np.ndarray]:
        single = weight @ np.log(chance)
        chosen, shares = [int(single.argmax())], np.ones(1)
        fit, total = float(single.max()), weight.sum()
        # n-grams of all orders overlap, so a text's evidence is that of one order
        price = penalty * len(ORDERS) * np.log(total)
        while len(chosen) < chance.shape[1]:
            mixed = chance[:, chosen] @ shares
            # where adding a little of a language does not help, no share of it does
            slope = (weight / mixed) @ chance / total
            slope[chosen] = 0
            best = None
            for other in np.flatnonzero(slope > 1):
                tried = [*chosen, int(other)]
                found = maximise(weight, chance[:, tried], np.append(shares * 0.9, 0.1), rounds)
                likelihood = float(weight @ np.log(chance[:, tried] @ found))
                if best is None or likelihood > best[0]:
                    best = likelihood, tried, found
            if best is None or best[0] - fit <= price:
                break
            fit, chosen, shares = best
        return chosen, shares


def maximise(weight: np.ndarray, chance: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
    total = weight.sum()
    for _ in range(rounds):
        new = shares * ((weight / (chance @ shares)) @ chance) / total
        done = np.abs(new - shares).max() < 1e-3
        shares = new
        if done:
            break
    return shares


def fit(rows: DataFrame, *, text: str = "text", language: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learn from every row with text and language; rows with a null or without a letter teach nothing.

    Tasks count n-grams before the shuffle. The driver gets at most ``BUCKETS`` counts per language;
    more than ``MAX_LANGUAGES`` languages raise an error.
    """
    with_small_batches(rows.sparkSession)
    usable = rows.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, content in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                grams = ngrams(content)
                if grams is not None:
                    if lang not in held:
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    held[lang] += np.bincount(grams, minlength=BUCKETS)
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": counts[used]})

    sums = usable.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit(BUCKETS * MAX_LANGUAGES + 1).toPandas()
    if len(found) > BUCKETS * MAX_LANGUAGES:
        raise CurationError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(languages)), smoothing)
    for place, lang in enumerate(languages):
        mine = found[found["lang"] == lang]
        table[mine["bucket"].to_numpy(), place] += mine["n"].to_numpy()
    return LanguageModel(languages, table / table.sum(0, keepdims=True) if languages else table)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", penalty: float = 2.0, rounds: int = 25, with_text: bool = True) -> DataFrame:
    """The columns of ``docs`` in the struct ``row`` (the text among them if ``with_text``), ``lang_pred``, ``score`` (its share) and ``shares`` of the chosen set.

    A null text, one without a letter, or any text under an empty model is ``und`` with score 0. Texts are
    read whole, however long. Equal shares go to the first language by code point. Repeated rows are judged alike. An empty table
    gives an empty result.
    """
    with_small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, kind = row_beside_text(docs, text, with_text)
    shares = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.identify(content.as_py(), penalty, rounds) for content in batch["text"]]
            yield pa.RecordBatch.from_arrays([
                batch["row"], pa.array([f[0] for f in found], pa.string()), pa.array([min(1.0, f[1]) for f in found], pa.float64()),
                pa.array([[{"lang": a, "share": b} for a, b in f[2]] for f in found], shares),
            ], ["row", "lang_pred", "score", "shares"])

    return rows.mapInArrow(judge, f"row {kind}, lang_pred string, score double, shares array<struct<lang:string,share:double>>")
