import random
import re

import pytest

from tagweave.llm import contamination

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, items, width):
    """(n_words, spans, items) of every text, by looking at every window at every place."""
    windows = {}
    for item, text in items:
        found = words(text)
        size = min(width, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[i : i + size]), set()).add(item)
    out = []
    for text in docs:
        found = words(text)
        hit, named = set(), set()
        for window, ids in windows.items():
            for i in range(len(found) - len(window) + 1):
                if tuple(found[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    named |= ids
        out.append((len(found), sorted(hit), sorted(str(i) for i in named if i is not None)))
    return out


def check(spark, docs, items, width=10):
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(docs)], "doc_id LONG, text STRING, row STRING, number STRING, n_words STRING")
    known = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id LONG, text STRING, cls STRING, hash INT")
    found = contamination.contamination(frame, known, width=width).collect()
    got = {}
    for r in found:
        hit = [w for s in r["spans"] for w in range(s["start"], s["end"])]
        assert hit == sorted(set(hit)) and r["n_hit"] == len(hit)
        got[r["row"]["doc_id"]] = (r["n_words"], hit, list(r["items"]))
        assert set(r["row"].asDict()) == {"doc_id", "row", "number", "n_words"}
    assert [got[i] for i in range(len(docs))] == plain(docs, items, width)
    return got


@pytest.mark.parametrize("seed, width, vocabulary", [(1, 10, 200), (2, 7, 3), (3, 10, 2)])
def test_matches_every_window_at_every_place(spark, monkeypatch, seed, width, vocabulary):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 400)
    chance = random.Random(seed)
    pool = ["the", "é", "漢字", "x1", *[f"w{i}" for i in range(vocabulary)]][-max(vocabulary, 4) :]
    text = lambda low, high: " ".join(chance.choices(pool, k=chance.randint(low, high)))
    items = [(i, text(1 if vocabulary > 3 else 4, 30)) for i in range(25)]
    items += [(3, text(12, 20)), (40, items[0][1]), (41, items[0][1].upper()), (None, text(12, 14)), (42, None), (43, ""), (44, " -.- "), (None, None)]
    docs = []
    for _ in range(60):
        parts = [text(0, 12)]
        for _ in range(chance.randint(0, 3)):
            source = words(chance.choice(items)[1])
            start = chance.randint(0, max(0, len(source) - 5))
            parts += [chance.choice([" ", ", ", "\n-- "]).join(w.title() for w in source[start : start + chance.randint(4, 25)]), text(0, 3)]
        docs.append(" ".join(parts))
    docs += [None, "", "...", docs[0], items[0][1], items[0][1] + " " + items[1][1], (items[5][1] + " ") * 50]
    got = check(spark, docs, items, width)
    assert sum(1 for _, hit, _ in got.values() if hit) > 5


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [item, "zero " + item, item.replace("six", "6"), "two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine", "Yes!", "no yes no"]
    got = check(spark, docs, [(1, item), (2, "yes")])
    assert [len(got[i][1]) for i in range(7)] == [11, 11, 0, 10, 0, 1, 1]
    check(spark, docs, [])
    check(spark, docs[:1], [(1, None)])
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert contamination.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id LONG, text STRING")).collect() == []


def test_neighbouring_windows_share_a_probe():
    words_ = [f"w{i}" for i in range(60)]
    found = list(contamination.probes_of(words_, [7] * 56, 10))
    assert len(found) == 9 and found[0][1] == 0 and found[-1][2] == 60
    counts = [7] * 56
    counts[30] = 0
    assert all(not (first <= 30 and end >= 35 and 26 <= first <= 30) for _, first, end in contamination.probes_of(words_, counts, 10))
    assert list(contamination.probes_of(["a"], [0], 10)) == [] and list(contamination.probes_of(["a"], [3], 10)) == [(0, 0, 1)]
