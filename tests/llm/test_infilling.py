import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.llm import infilling


def plain_transform(doc, text, seed=1, plain=10, spm=20):
    """Form, lengths and output by slicing the string."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-(2**40), 2**40) | st.none(), st.text("<PSM>aé漢🎈 \x00", max_size=40))
def test_any_text_comes_back(doc, text):
    form, prefix, middle, output = infilling.transform(text, infilling.numbers_of(1, doc), 10, 20)
    assert (len(text), form, prefix, middle, output.decode()) == plain_transform(doc, text)
    assert infilling.restore(bytes(output), form).decode() == text


@given(st.binary(max_size=60), st.data())
def test_three_reversals_exchange_blocks(content, data):
    start, middle, end = sorted(data.draw(st.integers(0, len(content))) for _ in range(3))
    buffer = bytearray(content)
    infilling.rotate(buffer, start, middle, end)
    assert bytes(buffer) == content[:start] + content[middle:end] + content[start:middle] + content[end:]
    infilling.rotate(buffer, start, start + end - middle, end)
    assert bytes(buffer) == content


@pytest.mark.parametrize("options", [{}, {"seed": 9, "plain": 0, "spm": 100}, {"plain": 100}])
def test_tables_match_slicing(make_docs, corpus, options, monkeypatch):
    monkeypatch.setattr(infilling, "OUT_BYTES", 500)
    rows = [*corpus, (170, "a <M> in the text", "en", "a"), (171, "é漢🎈" * 50_000, "en", "a"), (None, None, None, None), (None, "twice", "en", "a"), (None, "twice", "en", "a")]
    turned = infilling.fill_in_middle(make_docs(rows), with_text=True, **options)
    found = infilling.restored(turned).select("row.*", "restored").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_transform(r["row"]["doc_id"], r["row"]["text"], **options)
        assert r["restored"] == (r["row"]["text"] or "") and r["row"]["key"] == "x"
    forms = {r["form"] for r in found}
    assert forms == ({"plain"} if options.get("plain") == 100 else {"plain", "spm"} if options else {"plain", "psm", "spm"})


def test_nothing_and_nulls(spark, make_docs):
    docs = make_docs([(1, "a", "en", "s")]).limit(0)
    assert infilling.restored(infilling.fill_in_middle(docs)).collect() == []
    rows = spark.createDataFrame([(None, "psm"), ("x", None), ("x", "plain")], "output STRING, form STRING")
    assert sorted(map(str, (r["restored"] for r in infilling.restored(rows).collect()))) == ["None", "None", "x"]
