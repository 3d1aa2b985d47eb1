"""The registered queries without SQL, on the smallest tables, against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_near_dedup import plain_components
from test_text_models import plain_counts, plain_distances

from tagweave.llm import mixing, queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_mix(spark, documents):
    rows = run(spark, "op1_mix")
    sizes = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in documents}
    sources = {d["doc_id"]: d["source"] for d in documents}
    by_source = Counter()
    for doc, size in sizes.items():
        by_source[sources[doc]] += size
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([by_source[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)))
    # the targets by another way: shares grow with the weight until each is at its target or at twice its source
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(by_source.values())
    for _ in range(200):
        level = (low + high) / 2
        full = sum(min(weights[s] * level, 2 * by_source[s]) for s in names)
        low, high = (level, high) if full < 1.5 * sum(by_source.values()) else (low, level)
    assert all(wanted[s] == pytest.approx(min(weights[s] * low, 2 * by_source[s]), rel=1e-6) for s in names)
    taken = Counter()
    for r in rows:
        source = sources[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[source] and r["target"] == pytest.approx(wanted[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert len(rows) == len(documents) and all(abs(taken[s] - wanted[s]) <= 1 for s in names)
    assert sorted(rows) == sorted(run(spark, "op1_mix"))


def test_op2_near_dedup(spark, documents):
    expected = plain_components([(d["doc_id"], d["text"]) for d in documents], 4, 80)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op2_near_dedup")]
    assert sorted(found) == sorted((d, n, c, d == c) for d, n, c in expected)


def test_op4_quality(spark, documents):
    distances = plain_distances([(d["doc_id"], d["text"], d["lang"], None) for d in documents])
    texts = {d["doc_id"]: d["text"] or "" for d in documents}
    rows = run(spark, "op4_quality")
    assert len(rows) == len(documents)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        by_class, by_word = distances[r["doc_id"]]
        far = by_class is not None and r["n_words"] >= 50 and (by_class > 0.26 or by_word > 0.46)
        assert r["kept"] == (not r["base_failed"] and not far)


def test_op5_language(spark, documents):
    rows = {r["doc_id"]: r for r in run(spark, "op5_language")}
    held = right = 0
    known = {d["lang"] for d in documents if d["lang"] and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1}
    for d in documents:
        r = rows[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in known | {"und"}
        if r["held_out"] and d["lang"] and len((d["text"] or "").split()) >= 20:
            held, right = held + 1, right + (r["lang_pred"] == d["lang"])
    assert held > 20 and right >= 0.95 * held


def test_op6_captures(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    payloads = {p["page_id"]: (p["html"] or "").encode() for p in pages}
    first = {}
    for page in sorted(payloads):
        first.setdefault(payloads[page], page)
    rows = run(spark, "op6_captures")
    assert len(rows) == len(pages)
    for r in rows:
        content = payloads[r["page_id"]]
        assert r["payload_bytes"] == len(content) and r["payload_digest"] == base64.b32encode(hashlib.sha1(content).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[content] == r["page_id"] else ("revisit", first[content]))


def test_op7_token_files(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, start, expected = Tokenizer.from_file(queries.WORD_TOKENIZER), 0, []
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        expected.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op7_token_files")) == expected


def test_op8_pieces(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    expected = []
    for d in documents:
        ids = model.encode(d["text"] or "")
        expected.append((d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op8_pieces")) == sorted(expected)
