"""What only larger or unlike tables show, on small tables of that kind."""

import json

import pandas as pd
import pytest

from tagweave import errors
from tagweave.operators import imports, pairing
from tagweave.plans import runs
from tagweave.sources import files
from tagweave.streaming import incremental
from tagweave.workload import registry
from tagweave.workload.check import differences


def against_sql(spark, folder, name, **tables):
    """Differences of a registered query from its SQL on tables given as frames."""
    import duckdb

    connection = duckdb.connect()
    for table, frame in tables.items():
        frame.toPandas().to_parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return differences(registry.QUERIES[name](spark, str(folder)), connection, registry.SQL[name])


@pytest.mark.parametrize("labelled", [0, 2, 5])
def test_broken_stems_beyond_those_named(spark, tmp_path, monkeypatch, labelled):
    """More broken stems than a message names, and none at all."""
    monkeypatch.setattr(errors, "NAMED", 2)
    documents = spark.sql("SELECT id AS doc_id, 'en' AS lang FROM range(5)")
    labels = spark.range(labelled).withColumnRenamed("id", "doc_id")
    assert against_sql(spark, tmp_path, "broken_stems", documents=documents, labels=labels) == []


CATALOGUE = {
    "schema_version": 3,
    "queries": {
        'a, "b" [x': {"key": "a, [", "other": [7, 8, 9], "seen_post_ids": [*range(2000), None, 5000], "more": [1, 2, 3]},
        "strings": {"seen_post_ids": ["1", "2", "3"]}, "none": {"seen_post_ids": []}, "odd": {"seen_post_ids": [1, 2, "x", 3]},
        "deep": {"seen_post_ids": {"seen_post_ids": [1, 2, 3]}},
    },
    "extra": {"posts": {"9": {"file_paths": {"json": "no"}}}, "list": [1, [2, {"a": "}"}], 3]},
    "posts": {
        str(i): {"tags": ["x", "},{"], "sizes": [1, 2, 3], "file_paths": {"json": f'json/{{"{i}",\\.json', "image_paths": {"preview": None, "sample": f"s,{i}", "original": "é\n"}}}
        for i in range(1500)
    },
    "last": None,
}


@pytest.mark.parametrize("indent", [None, 2])
def test_catalogue_in_any_layout_and_splits(spark, tmp_path, indent):
    """One document read in many splits gives what a JSON reader gives, whatever its strings hold and wherever it is cut."""
    (tmp_path / "manifest.json").write_text(json.dumps(CATALOGUE, indent=indent, ensure_ascii=False))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1001")
    try:
        seen, posts = files.read_catalogue(spark, str(tmp_path / "manifest.json"))
        seen, posts = sorted(map(tuple, seen.collect())), sorted(map(tuple, posts.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert seen == sorted([('a, "b" [x', i) for i in [*range(2000), 5000]] + [(key, i) for key in ("odd", "strings") for i in (1, 2, 3)])
    listed = [(int(k), v["file_paths"]) for k, v in CATALOGUE["posts"].items()]
    assert posts == sorted(
        [(k, "json", f["json"]) for k, f in listed] + [(k, m, f["image_paths"][m]) for k, f in listed for m in ("sample", "original")]
    )


@pytest.mark.parametrize("indent", [None, 2])
def test_catalogue_in_small_blocks(spark, tmp_path, monkeypatch, indent):
    """Running sums, entries and lists go on from one block of pieces to the next."""
    path = str(tmp_path / "manifest.json")
    (tmp_path / "manifest.json").write_text(json.dumps(CATALOGUE, indent=indent, ensure_ascii=False))
    whole = [sorted(map(tuple, part.collect())) for part in files.read_catalogue(spark, path)]
    monkeypatch.setattr(files, "_BLOCK_BITS", 2)
    assert whole == [sorted(map(tuple, part.collect())) for part in files.read_catalogue(spark, path)] and len(whole[1]) == 4500


def test_catalogue_is_written_line_by_line(spark, tmp_path, monkeypatch):
    """No row holds the document: a line has one post, or ids of a thousand keys. Orders that come twice are two posts of one key."""
    read, texts = files.read_catalogue, []

    def looked_at(session, path):
        texts.extend(session.read.text(path).toPandas()["value"])
        assert len(session.read.text(path).inputFiles()) == 1
        return read(session, path)

    monkeypatch.setattr(files, "read_catalogue", looked_at)
    orders = spark.sql("SELECT id - 5 AS o_orderkey, substr('FOP', 1 + id % 3, 1) AS o_orderstatus FROM range(3000) UNION ALL SELECT 7, 'F'")
    lines = spark.sql("SELECT id % 2900 AS l_orderkey, nullif(substr('RAN ', 1 + id % 4, 1), ' ') AS l_returnflag FROM range(9000)")
    assert against_sql(spark, tmp_path, "catalogue_posts", orders=orders, lineitem=lines) == []
    document = json.loads("\n".join(texts))
    assert len(document["posts"]) == 3000 and set(document["queries"]) == set("RAN")
    assert len(texts) == 3 + 3001 + 3 * 3 and max(map(len, texts)) < 8000


@pytest.mark.parametrize("tables", ["orders", "lineitem", "both"])
def test_catalogue_without_rows(spark, tmp_path, tables):
    orders = spark.sql("SELECT id AS o_orderkey, 'O' AS o_orderstatus FROM range(3)").where("false" if tables in ("orders", "both") else "true")
    lines = spark.sql("SELECT id AS l_orderkey, 'R' AS l_returnflag FROM range(3)").where("false" if tables in ("lineitem", "both") else "true")
    assert against_sql(spark, tmp_path, "catalogue_posts", orders=orders, lineitem=lines) == []


def test_broken_catalogue_gives_no_rows(spark, tmp_path):
    for text in ('{"posts": {"1": {"file_paths": {"json": "a"}}, "2": {"file', '{"posts": {"1": {"file_paths": {"json": "a"}}}', "[1, 2]", ""):
        (tmp_path / "manifest.json").write_text(text)
        seen, posts = files.read_catalogue(spark, str(tmp_path / "manifest.json"))
        assert seen.collect() == [] and posts.collect() == []


class Held:
    """Keyed state of one group."""

    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def test_one_call_imports_many_stems():
    """Stems share a call and a state; each is judged alone."""
    state = Held()

    def told(*rows):
        frame = pd.DataFrame(rows, columns=["bucket", "stem", "content", "reject"])
        found = pd.concat([pd.DataFrame(columns=["stem", "content", "reject"]), *incremental._first_come((0,), iter([frame]), state)])
        return sorted((s, c, None if pd.isna(r) else r) for s, c, r in found.itertuples(index=False))

    different = "repeated stem with different content"
    first = told((0, "a", "1", None), (0, "b", "1", None), (0, "b", "2", None), (0, "c", "3", "bad"), (0, "a", "1", None), (0, "c", "4", None))
    assert first == [("a", "1", None), ("b", "1", different), ("b", "2", different), ("c", "3", "bad"), ("c", "4", None)]
    assert told((0, "a", "2", None), (0, "b", "2", None), (0, "c", "5", "bad")) == [("b", "2", None), ("c", "5", "bad")]
    assert told((0, "a", "1", None), (0, "b", "1", None)) == []


def test_files_are_paired_in_all_shuffle_partitions(spark):
    """However well their names compress, files stay dealt out, so that a task sorts its share only."""
    listing = pairing.classify(spark.sql("SELECT id || '.png' AS path FROM range(50)"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairing.pair(listing)
    log = imports.actions(imports.pair_files(pairs), spark.createDataFrame([], "name string"))
    assert n > 1 and pairs.rdd.getNumPartitions() == n and log.rdd.getNumPartitions() == n


def test_specs_are_not_shuffled_by_dataset(spark):
    """Many specs of few datasets stay where they were read."""
    presets = "CAST(NULL AS STRING) AS preset, CAST(NULL AS STRING) AS run_name, false AS no_prepare"
    numbers = ", ".join(f"CAST(NULL AS {'DOUBLE' if name == 'learning_rate' else 'INT'}) AS {name}" for name in runs.DEFAULTS)
    specs = spark.sql(f"SELECT 'd' || id % 3 AS dataset, {presets}, {numbers} FROM range(90)")
    artifacts = spark.createDataFrame([("d1", "run-007")], "dataset string, run string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = runs.run_plans(specs, artifacts)
        top = plans._jdf.queryExecution().sparkPlan().toString()
        found = {(r["dataset"], r["run_name"]) for r in plans.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == {("d0", "run-001"), ("d1", "run-008"), ("d2", "run-001")} and plans.count() == 90
    # the only join by sorting is that of datasets with their artifacts
    assert top.count("SortMergeJoin") == 1 and "BroadcastHashJoin" in top
