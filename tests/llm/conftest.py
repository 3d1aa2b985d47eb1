import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(n, T.StringType()) for n in ("row", "doc", "size", "lines", "key", "pass", "cls", "root", "batch")],
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with clashing extra columns from (doc_id, text, lang, source) tuples."""

    def make(rows):
        return spark.createDataFrame([(*row, None, *["x"] * 9) for row in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def chance():
    return random.Random(7)


WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def corpus(chance):
    """Null, blank, short, long and repeated texts, near copies, shared lines, a hot source."""
    rows = []
    for doc in range(120):
        lines = [" ".join(chance.choices(WORDS, k=chance.randint(3, 30))) for _ in range(chance.randint(1, 6))]
        rows.append((doc, "\n".join(lines), chance.choice(["en", "de", None]), chance.choice(["a", "a", "a", "b", "c", "d", None])))
    base = chance.choices(WORDS, k=200)
    for doc in range(120, 150):  # near copies of one text
        words = list(base)
        for _ in range(chance.randint(0, 9)):
            words[chance.randrange(200)] = "edit%d" % doc
        rows.append((doc, " ".join(words), "en", "a"))
    shared = "This Line Is Shared By Many Documents, And It Is Long Enough"
    for doc in range(150, 160):
        rows.append((doc, f"own {doc}\n  {shared.upper() if doc % 2 else shared}\t\nend\n{shared}", "de", "b"))
    rows += [
        (160, None, None, None), (161, "", "en", "e"), (162, " \t\n ", "en", "a"), (163, "one", "en", "a"), (164, "ONE", "en", "a"),
        (165, "one two three", "en", "b"), (166, "word " * 20_000, "en", "f"), (-5, "minus five is an id too", "en", "a"),
        (None, "no id here at all, but a text", "en", "a"), (167, rows[3][1], "en", "a"), (3, rows[3][1], "en", rows[3][3]),
    ]
    return rows
