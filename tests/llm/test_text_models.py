import re
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import language_id, quality

TEXTS = {
    "en": "the cat and the dog went to the house with the green door and it was good",
    "de": "die Katze und der Hund gingen zu dem Haus mit der grünen Tür und es war gut",
    "fr": "le chat et le chien sont allés à la maison avec la porte verte et c'était bon",
}


@pytest.fixture(scope="module")
def samples(make_docs, chance):
    rows = []
    for doc in range(300):
        lang = list(TEXTS)[doc % 3]
        rows.append((doc, " ".join(chance.choices(TEXTS[lang].split(), k=chance.randint(5, 60))), lang, "s"))
    odd = [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "12 !? 34", "fr", "s"), (1003, "the cat", None, "s"), (None, "der Hund und die Tür", "de", "s")]
    return make_docs(rows + odd)


def test_held_out_languages(samples):
    model = language_id.fit(samples.where("doc_id % 2 = 0"))
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.table.sum(0), 1)
    rows = language_id.identify(samples, model).select("row.doc_id", "row.lang", "row.size", "lang_pred", "score").collect()
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in rows) and by_id[0]["size"] == "x"


def test_mixtures_are_found(samples):
    model = language_id.fit(samples)
    text = (TEXTS["en"] + " ") * 20 + (TEXTS["fr"] + " ") * 8
    lang, share, shares = model.identify(text, 2.0, 50)
    assert lang == "en" and {x for x, _ in shares} == {"en", "fr"} and 0.6 < share < 0.8
    assert [x for x, _ in model.identify((TEXTS["de"] + " ") * 500, 2.0, 50)[2]] == ["de"]


def test_language_of_nothing(make_docs, samples):
    empty = samples.limit(0)
    model = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(samples, model).collect()} == {"und"}
    assert language_id.identify(empty, language_id.fit(samples)).collect() == []


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_base_counts_match_brute_force(chance):
    for _ in range(300):
        words = chance.choices(["a", "b", "é|", "c#", " x", "d\n", "\n", "\t"], k=chance.randint(0, 60))
        text = " ".join(words)
        assert quality.base_counts(text) == plain_counts(text)
    assert quality.base_counts("w " * 50_000) == (50_000, 50_000, 0, 0, 50_000)


def test_distance():
    assert quality.distance(np.array([1.0, 0]), np.array([0, 3.0])) == 1 and quality.distance(np.array([1.0, 2]), np.array([2.0, 4])) == 0


def plain_distances(rows, common=50):
    """Distances of every text to its nearest reference, without the text's own part in it."""

    def classes(text):
        found = [0] * 7
        for c in text:
            kind = 0 if c.isalpha() and c.islower() else 1 if c.isalpha() else 2 if c.isspace() else 3 if c.isdigit() else None
            found[kind if kind is not None else 4 if c in quality.SENTENCE else 5 if c in quality.MARKUP else 6] += 1
        return found

    def divergence(a, b):
        total = 0.0
        for x, y in zip(a, b):
            x, y = x / sum(a), y / sum(b)
            total += sum(z * np.log2(2 * z / (x + y)) for z in (x, y) if z) / 2
        return np.sqrt(max(0.0, total))

    words = [Counter(quality.plain_words(text or "")) for _, text, *_ in rows]
    kinds = [np.array(classes(text or "")) for _, text, *_ in rows]
    labels = {lang or "" for _, _, lang, _ in rows}
    every = {lang: sum((w for w, r in zip(words, rows) if (r[2] or "") == lang), Counter()) for lang in labels}
    listed = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:common]] for lang, c in every.items()}
    members = {lang: sum(1 for r in rows if (r[2] or "") == lang and r[1] is not None) for lang in labels}
    kinds_of = {lang: sum(k for k, r in zip(kinds, rows) if (r[2] or "") == lang) for lang in labels}
    out = {}
    for i, (doc, text, lang, _) in enumerate(rows):
        near = []
        for label in labels:
            own = (lang or "") == label and text is not None
            left = every[label] - words[i] if own else every[label]
            if members[label] - own < quality.LEAST_DOCS or sum(left.values()) < quality.LEAST_WORDS or not words[i]:
                continue
            share = lambda c, names: [c[w] for w in names] + [sum(c.values()) - sum(c[w] for w in names)]
            near.append((divergence(kinds[i], kinds_of[label] - own * kinds[i]), divergence(share(words[i], listed[label]), share(left, listed[label]))))
        out[doc] = min(near, key=sum, default=(None, None))
    return out


def test_distances_match_recounting(make_docs, chance):
    rows = [(i, " ".join(chance.choices(TEXTS.get(lang, "x y z").split() + [f"{lang}{i}", "12%", "A."], k=chance.randint(30, 70))), lang, "s")
            for i, lang in enumerate(["en"] * 40 + ["de"] * 30 + ["fr"] * 21 + ["xx"] * 3)]
    rows += [(200, "the cat " * 400, "en", "s"), (201, None, "en", "s"), (202, "", None, "s"), (203, "Ω" * 90, None, "s")]
    found = {r["doc_id"]: r for r in quality.rate(make_docs(rows)).select("row.doc_id", "class_distance", "word_distance", "n_words", "base_failed", "kept").collect()}
    for doc, (by_class, by_word) in plain_distances(rows).items():
        r = found[doc]
        if by_class is None:
            assert r["class_distance"] is None and r["word_distance"] is None
            continue
        assert (r["class_distance"], r["word_distance"]) == pytest.approx((by_class, by_word), abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and not (r["n_words"] >= 50 and (by_class > 0.26 or by_word > 0.46)))


def test_no_document_vouches_for_itself(make_docs, chance):
    clean = [(i, " ".join(chance.choices(TEXTS["en"].split(), k=90)), "en", "s") for i in range(60)]
    junk = " ".join("".join(chance.choices("ABCDEFGHIJ#$%", k=9)) for _ in range(300))
    for label in ("own", "en", None):
        rated = {r["doc_id"]: r["kept"] for r in quality.rate(make_docs([*clean, (500, junk, label, "s")])).select("row.doc_id", "kept").collect()}
        assert not rated[500] and all(rated[i] for i in range(60))
    few = quality.rate(make_docs([(1, junk, "en", "s")])).first()
    assert few["kept"] and few["class_distance"] is None


def test_verdicts(make_docs, samples, chance):
    clean = [(i, " ".join(chance.choices(TEXTS["en"].split(), k=90)), "en", "s") for i in range(60)]
    noisy = (500, " ".join(w + "###$$$" for w in chance.choices(TEXTS["en"].split(), k=90)), "en", "s")
    strange = (501, " ".join("".join(chance.choices("abcdefghij", k=5)) for _ in range(90)), "en", "s")
    rows = clean + [noisy, strange, (502, None, None, "s"), (503, "", "en", "s"), (504, "# " * 30, "en", "s"), (505, "few words only", "en", "s")]
    rated = {r["doc_id"]: r for r in quality.rate(make_docs(rows)).select("row.doc_id", "n_words", "base_failed", "kept").collect()}
    assert all(rated[i]["kept"] for i in range(60))
    assert not any(rated[i]["kept"] for i in (500, 501, 502, 503, 504, 505))
    assert [rated[i]["base_failed"] for i in (500, 501, 502, 503, 504, 505)] == [False, False, True, True, True, True]
    docs = make_docs(rows)
    assert quality.rate(docs.limit(0)).collect() == []
    assert [r["kept"] for r in quality.rate(docs.where("text IS NULL")).collect()] == [False]
