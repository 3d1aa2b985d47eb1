import random
import re
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import bitmaps, collocations

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_collocations(rows, longest, min_count, inside, top):
    """From one dictionary of all phrases of all lengths."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        ranked = []
        for p, a in candidates.items():
            around = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= inside * a for b in around):
                continue
            score, cut = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), found[p[:cut]], found[p[cut:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found_collocations(spark, rows, **options):
    schema = "text STRING, lang STRING, phrase STRING, n LONG, words STRING, part INT"
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema)
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


def corpus(seed):
    chance = random.Random(seed)
    words = ["the", "The", "a", "rare\x01", "é", "漢", "b\x00", "of", "end", *[f"w{i}" for i in range(9)]]
    rows = []
    for _ in range(150):
        text = "".join(chance.choice(words) + chance.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n"]) for _ in range(chance.randint(0, 60)))
        rows.append((text, chance.choice(["en", "en", "en", "de", None, ""])))
    rows += [("new york city hall is open", "en")] * 9 + [("a a a a a a a", "de")] * 4 + [(None, "en"), ("", "fr"), (" . ", "fr"), (None, None)]
    return rows


@pytest.mark.parametrize("seed, options", [
    (1, {"longest": 5, "min_count": 4, "inside": 100, "top": 2000}),
    (2, {"longest": 3, "min_count": 3, "inside": 60, "top": 7}),
    (3, {"longest": 2, "min_count": 1, "inside": 100, "top": 50}),
])
def test_matches_one_dictionary(spark, monkeypatch, seed, options):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)
    rows = corpus(seed)
    expected = plain_collocations(rows, **options)
    assert found_collocations(spark, rows, **options) == expected and len(expected) > 10


def test_ranges_inside_one_subtree(spark):
    """One first word and one last word under all phrases, dealt over more ranges than languages."""
    rows = [(f"top w{i} w{j} end", "en") for i in range(12) for j in range(12)] * 2
    options = {"longest": 4, "min_count": 2, "inside": 100, "top": 500}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found_collocations(spark, rows, **options) == plain_collocations(rows, **options)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_large_counts_are_exact(spark):
    frame = spark.createDataFrame([(10**12, 10**13, 3 * 10**11, 10**12)], "a LONG, n LONG, l LONG, r LONG")
    found = frame.select(collocations._score(frame["a"], frame["n"], frame["l"], frame["r"]).alias("s")).first()["s"]
    assert found == 1000 * 10**12 * 10**13 // (3 * 10**11 * 10**12)


def test_nothing(spark):
    assert found_collocations(spark, [(None, None)]) == []
    docs = spark.createDataFrame([], "text STRING, lang STRING")
    assert collocations.collocations(docs).collect() == []


@pytest.mark.parametrize("most_bits", [1 << 26, 64])
def test_bitmaps_hold_their_members(spark, most_bits):
    hashes = np.random.default_rng(3).integers(-(2**63), 2**63, 5000, np.int64)
    frame = spark.createDataFrame([(int(x),) for x in hashes[:2000]], "hash LONG")
    held = bitmaps.may_hold(bitmaps.bitmap(frame, most_bits), hashes.view(np.uint64))
    assert held[:2000].all() and held[2000:].mean() < 0.1
    assert not bitmaps.may_hold(bitmaps.bitmap(frame.limit(0)), hashes.view(np.uint64)).any()
