from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tagweave.llm import language_id, mixing, near_dedup, pieces, queries
from tagweave.workload.check import connect, differences

FOLDER = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_native_operators_run_no_python(spark):
    for name in ("op3_lines", "op9_urls"):
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stages_take_effect(spark, make_docs, corpus, tmp_path):
    docs = make_docs(corpus)
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        result = stage(spark, docs, "")
        result.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "pieces":
            assert docs.columns == columns
        if name == "language":
            found = language_id.identify(before, language_id.fit(before)).where("lang_pred <> 'und' AND score >= 0.5")
            assert sorted(map(repr, docs.collect())) == sorted(map(repr, found.select("row.*").collect()))
            assert docs.where("text IS NULL OR text = ''").count() == 0
    lines = kept["lines"].where("text LIKE '%shared by many%' OR text LIKE '%Shared By Many%' OR text LIKE '%SHARED BY MANY%'")
    assert [r["doc_id"] for r in lines.collect()] == [159]
    near = {r["doc_id"] for r in kept["near_copies"].collect()}
    assert 163 in near and 164 not in near and len(near & set(range(120, 150))) < 30
    by_source = Counter()
    for r in kept["near_copies"].withColumn("n", mixing.word_count(F.col("text"))).collect():
        by_source[r["source"]] += r["n"]
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    wanted = mixing.targets([by_source[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    taken = Counter()
    for r in kept["mix"].withColumn("n", mixing.word_count(F.col("text"))).collect():
        taken[r["source"]] += r["n"]
    assert all(abs(taken[s] - t) <= 2 for s, t in zip(names, wanted))
    model = pieces.ChunkEncoder(queries.PIECE_MODEL).model
    expected = sorted((repr(r["doc_id"]), model.encode(r["text"])) for r in kept["mix"].collect())
    assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in docs.collect()) == expected


def test_documents_without_any_label_stay(spark, make_docs):
    docs = make_docs([(1, "a clean text", None, "a"), (2, "Ελλάδα", None, "a"), (3, "12 !?", None, "a"), (4, None, None, "a"), (5, "", None, "a")])
    assert sorted(r["doc_id"] for r in pipeline.keep_known_languages(spark, docs, "").collect()) == [1, 2]


def test_near_copies_are_judged_row_by_row(spark, make_docs):
    base = [f"w{i}" for i in range(60)]
    copy, near = " ".join(base), " ".join([*base[:59], "edit"])
    rows = [
        (None, copy, "en", "a"), (None, copy, "en", "a"), (None, near, "en", "a"),  # a group without any id
        (1, "one text here that comes twice", "en", "a"), (1, "one text here that comes twice", "en", "a"),
        (2, "the text of two", "en", "b"), (3, "The Text of two", "en", "b"), (3, "a text of its own at the same id", "en", "b"),
        (4, "same as a row without id", "en", "c"), (None, "same as a row without id", "en", "c"), (None, "nothing like it", "en", "c"),
        (None, None, "en", "c"), (None, " ", "en", "c"),
    ]
    kept = [(r["doc_id"], r["text"]) for r in pipeline.keep_one_of_near_copies(spark, make_docs(rows), "").collect()]
    group = [k for k in kept if k in ((None, copy), (None, near))]
    assert len(group) == 1
    rest = [(1, rows[3][1]), (2, rows[5][1]), (3, rows[7][1]), (4, rows[8][1]), (None, rows[10][1]), (None, None), (None, " ")]
    assert sorted(map(repr, kept)) == sorted(map(repr, rest + group))


def test_pipeline_of_nothing(spark, make_docs):
    docs = make_docs([(1, "a", "en", "s")]).limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").count() == 0
    assert pipeline.encode_text(spark, docs, "").count() == 0


@needs_tables
def test_run(spark):
    found = pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"] and found.count() > 0


@pytest.mark.parametrize("operator", ["fit", "identify", "pieces", "near_copies"])
def test_workers_get_texts_in_small_batches(spark, operator):
    own = spark.newSession()
    docs = own.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.concat(F.lit("word"), "id", F.lit(" ")), 40_000).alias("text")).coalesce(1)
    if operator == "fit":
        language_id.fit(docs.limit(1))
    elif operator == "identify":
        language_id.identify(docs, language_id.LanguageModel([], None))
    elif operator == "pieces":
        pieces.encode_pieces(docs, queries.PIECE_MODEL)
    else:
        near_dedup.components(docs.limit(1))
    sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches), "size long").collect()
    assert sum(r["size"] for r in sizes) > 8_000_000 and max(r["size"] for r in sizes) < 4_000_000
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    language_id.fit(docs.limit(1))
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "64m"
