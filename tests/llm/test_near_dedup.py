import itertools
import random

import numpy as np
import pytest

from tagweave.llm import near_dedup


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, width, percent):
    """Components over all pairs of full sets."""
    sets = [shingle_set(text, width) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least.get(find(i))) for i, ((doc, *_), s) in enumerate(zip(rows, sets))]


def found(docs, **options):
    rows = near_dedup.components(docs, **options).collect()
    for r in rows:
        assert r["kept"] == (r["doc"] == r["component_id"])
    return sorted(map(repr, [(r["doc"], r["n_shingles"], r["component_id"]) for r in rows]))


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(make_docs, corpus, width):
    expected = plain_components(corpus, width, 80)
    assert len({c for _, _, c in expected}) < len(corpus) - 10
    assert found(make_docs(corpus), width=width) == sorted(map(repr, expected))


def test_empty_table_and_texts_without_words(make_docs):
    docs = make_docs([(1, None, "en", "a"), (2, " \n", "en", "a"), (3, "", "en", "a")])
    assert found(docs) == sorted(map(repr, [(i, 0, i) for i in (1, 2, 3)]))
    assert found(docs.limit(0)) == []


def test_a_crowd_that_shares_buckets_without_links(make_docs):
    """Texts at about J = 0.7 to each other, with a chain of links among them: every pivot has to give way."""
    chance = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for doc in range(40):
        words = list(base)
        for place in chance.sample(range(0, 300, 5), 9):
            words[place] = f"x{doc}_{place}"
        rows.append((doc, " ".join(words), "en", "a"))
    for doc in range(40, 60):  # a chain: each is near the one before
        words = rows[doc - 1][1].split()
        for place in chance.sample(range(0, 300, 5), 6):
            words[place] = f"y{doc}_{place}"
        rows.append((doc, " ".join(words), "en", "a"))
    assert found(make_docs(rows), width=4) == sorted(map(repr, plain_components(rows, 4, 80)))


@pytest.mark.parametrize("seed", [1, 2])
def test_crowds_around_the_threshold(make_docs, seed):
    """Edits, cuts and additions of two bases and of each other, most pairs between J = 0.6 and 0.95."""
    chance = random.Random(seed)
    bases = [[f"{name}{i}" for i in range(chance.randint(60, 140))] for name in "ab"]
    rows = []
    for doc in range(130):
        words = list(chance.choice(bases)) if doc < 70 or chance.random() < 0.3 else rows[chance.randrange(doc)][1].split()
        for _ in range(chance.randint(0, 5)):
            place = chance.randrange(len(words))
            new = chance.choice(["x", "y", f"new{doc}", words[0]])
            words[place : place + chance.choice([0, 1, 1, 1, 2, 12])] = [new] * chance.choice([0, 1, 1, 2, 9])
        rows.append((doc, " ".join(words), "en", "a"))
    expected = plain_components(rows, 4, 80)
    assert 5 < len({c for _, _, c in expected}) < 120
    assert found(make_docs(rows), width=4) == sorted(map(repr, expected))


def test_each_class_reads_one_text(make_docs, monkeypatch):
    """Many near copies under a null id: their full sets are made of as many texts, not of all pairs."""
    rows = [(None, " ".join([*(f"w{i}" for i in range(60)), f"end{n}"]), "en", "a") for n in range(30)]
    docs, read = make_docs(rows), []
    frame = type(docs)
    run = frame.mapInArrow

    def spy(self, function, schema, *args, **options):
        if schema == "cls long, items binary":
            read.append(self.count())
        return run(self, function, schema, *args, **options)

    monkeypatch.setattr(frame, "mapInArrow", spy)
    assert found(docs) == sorted(map(repr, plain_components(rows, 5, 80)))
    assert read == [30]


def test_sketch_fills_and_estimates():
    for size in (1, 2, 7, 100, 5000):
        items = near_dedup.mixed(np.arange(1, size + 1, dtype=np.uint64))
        bins = near_dedup.sketch(items)
        assert (bins < np.iinfo(np.uint64).max).all() and (bins == near_dedup.sketch(items[::-1])).all()
    items = near_dedup.mixed(np.arange(1, 1001, dtype=np.uint64))
    agree = (near_dedup.sketch(items[:900]) == near_dedup.sketch(items[100:])).mean()
    assert abs(agree - 0.8) < 0.1  # J = 800 / 1000


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 3), (200, 200)]
    rows = near_dedup.connected(spark.createDataFrame(edges, "a LONG, b LONG")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**{i: 0 for i in range(1, 51)}, 101: 100, 102: 100}
