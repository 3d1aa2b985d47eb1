from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm import mixing


def mixed(docs, **options):
    rows = docs.withColumn("words", mixing.word_count(F.col("text")))
    return mixing.mix(rows, size="words", **options).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "pass", "shard", "place", "taken").collect()


def test_targets_reshare_what_is_above_the_limit():
    found = mixing.targets([100, 10, 100], [5, 2, 1], 1.5, 2)
    assert found == [200.0, 20.0, 95.0]
    assert mixing.targets([0, 50], [1, 1], 1.5, 2) == [0.0, 75.0] and mixing.targets([], [], 1.5, 2) == []


@pytest.mark.parametrize("options", [{}, {"block_words": 50, "shard_blocks": 7}])
def test_mix_meets_its_targets(make_docs, corpus, options):
    docs = make_docs(corpus)
    rows = mixed(docs, **options)
    taken, target, sizes = Counter(), {}, {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]], sizes[r["source"]] = r["target"], r["source_size"]
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 3))
    level = [target[s] / weights[s] for s in sizes if target[s] < 2 * sizes[s] - 1e-6]
    assert max(level) - min(level) < 1e-6 and abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)
    by_doc = Counter()
    for r in rows:
        by_doc[r["doc_id"], r["source"], r["size"]] += r["taken"]
    copies = Counter((d, s) for d, _, _, s in corpus)
    assert all(n <= 2 * size * copies[d, s] for (d, s, size), n in by_doc.items())
    assert {r["doc_id"] for r in rows} == {d for d, *_ in corpus}
    assert sorted(map(repr, mixed(docs.repartition(3), **options))) == sorted(map(repr, rows))


def test_rows_without_an_id_are_drawn_one_by_one(make_docs):
    """Null and repeated ids, repeated rows among them: targets are met, one document per source is cut, lumps spread."""
    rows = [(None, f"t{i} " * (1 + i % 40), "en", "a") for i in range(300)] + [(7, "same text here " * 3, "en", "b")] * 200
    rows += [(i, "x " * 20, "en", "c") for i in range(300)]
    docs = make_docs(rows)
    found = mixed(docs, weights=(2, 1, 3), share=0.4, block_words=100, shard_blocks=4)
    for source in "abc":
        mine = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
        assert sum(0 < r["taken"] < r["size"] for r in mine) <= 1
        assert len({r["shard"] for r in mine if r["taken"]}) > 3
    again = mixed(docs.repartition(3), weights=(2, 1, 3), share=0.4, block_words=100, shard_blocks=4)
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_shards_are_even_and_shuffled(make_docs, corpus):
    rows = [r for r in mixed(make_docs(corpus), block_words=20, shard_blocks=16) if r["taken"]]
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert len(shards) > 5
    for held in shards.values():
        assert sorted(r["place"] for r in held) == list(range(1, len(held) + 1))


def test_tree_splits_quotas_exactly():
    quotas, shards = [100, 7, 0, 33], 9
    leaves = list(mixing.split_tree(quotas, shards, 0, shards, 1))
    assert (sum(count for _, _, count in leaves) == quotas).all()
    assert max(c.sum() for _, _, c in leaves) - min(c.sum() for _, _, c in leaves) <= 1
    held = np.zeros(4, int)
    for _, start, count in leaves:  # neighbouring, disjoint ranges
        assert (start == held).all()
        held = held + count
    part = list(mixing.split_tree(quotas, shards, 3, 5, 1))
    assert [(s, a.tolist(), c.tolist()) for s, a, c in part] == [(s, a.tolist(), c.tolist()) for s, a, c in leaves[3:5]]


def test_mix_of_nothing(make_docs, corpus):
    docs = make_docs(corpus)
    assert mixed(docs.limit(0)) == []
    assert [r["taken"] for r in mixed(docs.where("doc_id IN (160, 161)"))] == [0, 0]
    with pytest.raises(CurationError):
        mixed(docs, max_sources=2)
