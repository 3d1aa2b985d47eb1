"""Jobs, files and streams end to end on temporary folders."""

import json
import pathlib
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave import plugins
from tagweave.cluster import broadcast_if_small, spread
from tagweave.errors import CurationError, GateError
from tagweave.functions import variants
from tagweave.functions.geometry import PrepareConfig
from tagweave.operators import datasets, imports, pairing
from tagweave.plans import captioning, importing, prepare, runs, tag_fusion
from tagweave.sources import files, sinks, versions
from tagweave.streaming import incremental


def write_png(path, width, height, rgba=False):
    path.parent.mkdir(parents=True, exist_ok=True)

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    row = b"\x00" + bytes(4 if rgba else 3) * width
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if rgba else 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(row * height)) + chunk(b"IEND", b"")
    )


def write_json(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def post(post_id, general=("anthro", "solo")):
    return {"id": post_id, "tags": {"artist": ["artist_name"], "general": list(general), "meta": ["hi_res"], "species": ["fox"]}}


def metas(spark, *rows):
    frame = spark.createDataFrame([(s, json.dumps(m)) for s, m in rows], "stem STRING, text STRING")
    return frame.select("stem", F.parse_json("text").alias("meta"))


NO_OVERRIDES = "dataset STRING, stem STRING, meta VARIANT"


# --- files ------------------------------------------------------------------


def test_scan_and_metadata(spark, tmp_path):
    pool = tmp_path / "pool"
    write_png(pool / "best+one two.png", 4, 2)
    write_json(pool / "best+one two.json", {"tags": ["a"], "n": 1})
    write_json(pool / "list.json", [1])
    write_json(pool / "bad.json", '{"a": 1} x')
    write_json(pool / "deep" / "x.json", {})
    listed = files.list_files(spark, str(pool))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    pairs = pairing.pair(pairing.classify(listed))
    assert {r["stem"]: r["is_broken"] for r in pairs.collect()} == {"best+one two": False, "list": True, "bad": True}
    read = files.read_metadata(spark, str(pool))
    assert sorted(r["stem"] for r in files.metadata_rejects(read).collect()) == ["bad", "list"]
    assert json.loads(files.show(read, "best+one two").first()["json"]) == {"n": 1, "tags": ["a"]}
    with pytest.raises(CurationError, match="not found"):
        files.show(read, "nope")
    assert files.list_files(spark, str(pool), recursive=True).count() == 5


def test_manifest_round_trip_and_line_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("images/b.png", "é told", ["x"]), ("images/a.png", "c", [])], "image STRING, caption STRING, tags ARRAY<STRING>")
    sinks.write_manifest(rows, str(tmp_path / "out"))
    good, bad = files.read_manifest(spark, str(tmp_path / "out"))
    assert good.count() == 2 and bad.count() == 0
    line = next(p for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size).read_text(encoding="utf-8").splitlines()[0]
    assert list(json.loads(line)) == ["caption", "image", "tags"] and json.loads(line)["image"] == "images/a.png"
    assert sinks.training_rows(rows).columns == ["file_name", "text"]

    lines = ['{"image": 1}', "", "   ", "[1]", '{"ok": true}', '{"a": 1} tail'] + ['{"k": %d}' % i for i in range(3000)] + ["oops"]
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        good, bad = files.read_manifest(spark, str(tmp_path / "m.jsonl"))
        assert good.rdd.getNumPartitions() > 1
        assert good.count() == 3002
        assert sorted((r["line"], r["reason"]) for r in bad.collect()) == [
            (4, "not a JSON object"), (6, "invalid JSON"), (3007, "invalid JSON"),
        ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_vocabulary_and_sizes(spark, tmp_path):
    (tmp_path / "tags.csv").write_text("tag_id,name,category\n1,1girl,0\n2,,1\n3,Some_One,4\n4,x,?\n", encoding="utf-8")
    vocab = files.read_vocabulary(spark, str(tmp_path / "tags.csv"))
    assert [(r["pos"], r["name"], r["normalized"], r["category_name"]) for r in vocab.orderBy("pos").collect()] == [
        (0, "1girl", "female-presenting person", "general"), (1, "Some_One", "some one", "character"), (2, "x", "x", "unknown"),
    ]
    (tmp_path / "strict.csv").write_text("name,category\na,0\nb,4\n", encoding="utf-8")
    assert [r["name"] for r in files.read_strict_vocabulary(spark, str(tmp_path / "strict.csv")).orderBy("pos").collect()] == ["a", "b"]
    (tmp_path / "short.csv").write_text("tag,kind\na,0\n", encoding="utf-8")
    with pytest.raises(CurationError, match="category, name"):
        files.read_strict_vocabulary(spark, str(tmp_path / "short.csv"))
    write_png(tmp_path / "img" / "a.png", 100, 50)
    write_png(tmp_path / "img" / "b.png", 3, 4, rgba=True)
    sizes = files.read_image_sizes(spark, str(tmp_path / "img"))
    assert sorted((r["width"], r["height"], r["mode"]) for r in sizes.collect()) == [(3, 4, "RGBA"), (100, 50, "RGB")]


def chunked(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + bytes(4) for k, b in chunks)


def little(*values):
    return b"".join(v.to_bytes(n, "little") for v, n in values)


HEADERS = {
    "gray.png": (chunked((b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 0, 0, 0, 0)), (b"IDAT", b"")), (7, 9, "L", False)),
    "gray_alpha.png": (chunked((b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 4, 0, 0, 0))), (7, 9, "LA", True)),
    "palette.png": (chunked((b"IHDR", struct.pack(">IIBBBBB", 70, 9, 8, 3, 0, 0, 0)), (b"PLTE", bytes(9)), (b"IDAT", b"")), (70, 9, "P", False)),
    "clear.png": (chunked((b"IHDR", struct.pack(">IIBBBBB", 70, 9, 8, 3, 0, 0, 0)), (b"PLTE", bytes(9)), (b"tRNS", b"\0"), (b"IDAT", b"")), (70, 9, "P", True)),
    "large_exif.jpg": (b"\xff\xd8\xff\xe1\xff\xf0" + bytes(0xFFEE) + b"\xff\xff\xc4\x00\x04ab\xff\xc2\x00\x11\x08" + struct.pack(">HHB", 300, 400, 3), (400, 300, "RGB", False)),
    "gray.jpg": (b"\xff\xd8\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 3, 4, 1), (4, 3, "L", False)),
    "clear.gif": (b"GIF89a" + little((5, 2), (6, 2)) + b"\x80\0\0" + bytes(6) + b"!\xfe\x02hi\x00" + b"!\xf9\x04\x01\0\0\0\0,", (5, 6, "P", True)),
    "plain.gif": (b"GIF87a" + little((5, 2), (6, 2)) + b"\0\0\0,", (5, 6, "P", False)),
    "rgb.bmp": (b"BM" + bytes(12) + little((40, 4), (8, 4)) + (-9).to_bytes(4, "little", signed=True) + little((1, 2), (24, 2)), (8, 9, "RGB", False)),
    "alpha.bmp": (b"BM" + bytes(12) + little((124, 4), (8, 4), (9, 4), (1, 2), (32, 2)) + bytes(36) + b"\0\0\0\xff", (8, 9, "RGBA", True)),
    "lossy.webp": (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + little((33, 2), (44, 2)), (33, 44, "RGB", False)),
    "lossless.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + little((32 | 43 << 14 | 1 << 28, 4)), (33, 44, "RGBA", True)),
    "extended.webp": (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + little((32, 3), (43, 3)), (33, 44, "RGBA", True)),
    "cut.png": (b"\x89PNG\r\n\x1a\n\0\0", (None,) * 4), "empty.png": (b"", (None,) * 4), "text.jpg": (b"not an image at all", (None,) * 4),
}


def test_image_headers(spark, tmp_path):
    (tmp_path / "img" / "deep").mkdir(parents=True)
    for name, (content, _) in HEADERS.items():
        (tmp_path / "img" / name).write_bytes(content)
    (tmp_path / "img" / "deep" / "a.gif").write_bytes(HEADERS["plain.gif"][0])
    rows = files.read_image_sizes(spark, str(tmp_path / "img")).collect()
    assert {r["path"].rsplit("/", 1)[1]: tuple(r)[2:] for r in rows} == {name: want for name, (_, want) in HEADERS.items()}
    listed = {(r["path"], r["length"]) for r in files.list_files(spark, str(tmp_path / "img"), recursive=True).collect()}
    found = {(r["path"], r["length"]) for r in files.read_image_sizes(spark, f"file:{tmp_path}/img", recursive=True).collect()}
    assert {f for f in found if f[1]} == listed and len(found) == len(HEADERS) + 1  # Spark's own listing leaves empty files out
    # transparent palettes and WebP images reach the gate, others pass it
    plan = prepare.size_plan(files.read_image_sizes(spark, str(tmp_path / "img")), PrepareConfig(image_format="jpg"))
    blocked = {r["path"].rsplit("/", 1)[1] for r in plan.where("alpha_problem").collect()}
    assert blocked == {n for n, (_, want) in HEADERS.items() if want[3] is not False}
    (tmp_path / "none").mkdir()
    assert files.read_image_sizes(spark, str(tmp_path / "none")).collect() == []


def test_other_sinks(spark, tmp_path):
    meta = metas(spark, ("a", {"z": 1, "a": {"y": 2, "b": 3}}))
    sinks.write_metadata(meta, str(tmp_path / "meta"))
    assert spark.read.parquet(str(tmp_path / "meta")).first()["json"] == '{"a":{"b":3,"y":2},"z":1}'
    sinks.write_rows(spark.range(3), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 3


# --- prepare and runs -------------------------------------------------------


def members(spark, *names):
    frame = spark.createDataFrame([("ds", n) for n in names], "dataset STRING, file_name STRING")
    return frame.withColumn("stem", F.regexp_replace("file_name", r"\.[^.]+$", ""))


def test_prepare_writes_and_gates(spark, tmp_path):
    none = spark.createDataFrame([], NO_OVERRIDES)
    pool = metas(spark, ("wide", {"tags": ["wide"]}), ("same", {"tags": ["s"]}), ("odd", {"tags": ["a", 1]}), ("bare", {}))
    folder = str(tmp_path / "prepared")
    config = PrepareConfig(width=50, height=50, trigger="word")
    prepare.prepare(members(spark, "wide.png"), none, pool, config, folder)
    parts = sinks.prepared_parts(spark, folder)
    good, _ = files.read_manifest(spark, parts["manifest"])
    assert json.loads(good.select(F.to_json("row").alias("j")).first()["j"]) == {
        "caption": "word, wide. word, wide", "image": "images/wide.png", "tags": ["wide"],
    }
    assert spark.read.json(parts["config"]).first()["trigger"] == "word"
    with pytest.raises(GateError, match="one output name: same.png"):
        prepare.prepare(members(spark, "same.png", "same.jpg"), none, pool, PrepareConfig(image_format="png"), folder)
    for name in ("lonely.png", "odd.png", "bare.png"):
        with pytest.raises(GateError, match="without usable metadata"):
            prepare.prepare(members(spark, name), none, pool, config, folder)
    sizes = spark.createDataFrame([("wide.png", 10, 10, "RGBA", False)], "path STRING, width INT, height INT, mode STRING, has_transparency BOOLEAN")
    with pytest.raises(GateError, match="transparent"):
        prepare.prepare(members(spark, "wide.png"), none, pool, PrepareConfig(image_format="jpg"), folder, sizes)
    # Failed runs left the earlier output alone.
    assert sinks.prepared_parts(spark, folder) == parts and files.read_manifest(spark, parts["manifest"])[0].count() == 1


def test_override_wins_in_manifest(spark):
    over = metas(spark, ("item", {"tags": ["override"]})).select(F.lit("ds").alias("dataset"), "stem", "meta")
    pool = metas(spark, ("item", {"tags": ["candidate"], "caption": "x"}))
    row = prepare.prepare(members(spark, "item.png"), over, pool, PrepareConfig()).first()
    assert row["caption"] == "override. override"


def test_run_names_and_settings(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset STRING")
    done = spark.createDataFrame([("a", "run-002"), ("a", "run-x9"), ("a", "run-010"), ("b", "other"), ("c", "run-999")], "dataset STRING, run STRING")
    names = {r["dataset"]: r["run_name"] for r in runs.next_runs(wanted, done).collect()}
    assert names == {"a": "run-011", "b": "run-001", "c": "run-1000"}
    specs = spark.createDataFrame(
        [("style", None, 7, None, None, None), ("style", 4, None, 1.0, 2, 3), (None, None, None, None, None, None)],
        "preset STRING, rank INT, steps INT, learning_rate DOUBLE, batch_size INT, gradient_accumulation INT",
    )
    got = runs.effective_values(specs).select(*runs.DEFAULTS).collect()
    assert sorted(map(tuple, got)) == [(4, 2500, 1.0, 2, 3), (16, 2000, 1e-4, 1, 4), (32, 7, 5e-5, 1, 4)]


def test_record_run(spark, tmp_path):
    none = spark.createDataFrame([], NO_OVERRIDES)
    pool = metas(spark, ("item", {"tags": ["t"]}))
    folder, root = str(tmp_path / "prepared"), str(tmp_path / "artifacts")
    prepare.prepare(members(spark, "item.png"), none, pool, PrepareConfig(), folder)
    manifest = files.read_manifest(spark, sinks.prepared_parts(spark, folder)["manifest"])[0].select(F.lit("ds").alias("dataset"), "row")
    images = spark.createDataFrame([("ds", "images/item.png")], "dataset STRING, image STRING")
    plan = spark.createDataFrame([("ds", "run-001")], "dataset STRING, run_name STRING")
    args = dict(dataset="ds", run="run-001", prepared=folder, root=root, manifest=manifest)
    assert runs.record_run(plan, images=images, dry_run=True, **args) is None
    assert not (tmp_path / "artifacts").exists()
    with pytest.raises(GateError, match="missing or invalid"):
        runs.record_run(plan, images=images.where("false"), **args)
    target = runs.record_run(plan, images=images, **args)
    assert spark.read.json(f"{target}/manifest").count() == 1
    with pytest.raises(CurationError, match="Exists already"):
        runs.record_run(plan, images=images, **args)
    # presence is looked up: without the config the run is refused
    version = pathlib.Path(versions.live(spark, folder))
    (version / "config").rename(tmp_path / "moved")
    with pytest.raises(GateError, match="missing or invalid"):
        runs.record_run(plan, images=images, **(args | {"run": "run-002"}))


def test_a_failed_publish_leaves_what_was_live(spark, tmp_path):
    folder = str(tmp_path / "out")

    def write(value, fail=False):
        def run(version):
            spark.range(value).write.parquet(f"{version}/rows")
            if fail:
                raise RuntimeError("broke off")
        return run

    assert versions.live(spark, folder) is None
    versions.publish(spark, folder, write(1))
    with pytest.raises(RuntimeError):
        versions.publish(spark, folder, write(2, fail=True))
    assert spark.read.parquet(f"{versions.live(spark, folder)}/rows").count() == 1
    versions.publish(spark, folder, write(3))
    assert spark.read.parquet(f"{versions.live(spark, folder)}/rows").count() == 3
    number, _ = versions.pointer(spark, folder)
    with pytest.raises(CurationError, match="another run"):  # a run that began before the last one ended
        versions.point(spark, folder, number - 1, {"version": "late"})
    with pytest.raises(CurationError, match="Exists already"):
        versions.publish(spark, folder, write(4), once=True)


def test_write_back_touches_changed_ranges_only(spark, tmp_path):
    folder = str(tmp_path / "records")
    rows = spark.range(5000).select(F.format_string("%06d", "id").alias("stem"), F.lit("{}").alias("json"))
    assert versions.write_records(rows, folder) == list(range(64))

    def stamps():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "records").rglob("*.parquet")}

    before = stamps()
    changed = spark.range(1000, 1050).select(F.format_string("%06d", "id").alias("stem"), F.lit('{"a":1}').alias("json"))
    fresh = spark.createDataFrame([("000001x", "{}"), ("zz", "{}")], "stem STRING, json STRING")
    touched = versions.write_records(changed.union(fresh), folder)
    assert len(touched) <= 4 and {k: v for k, v in stamps().items() if k in before} == before
    assert len(stamps()) - len(before) == len(touched)
    stored = {r["stem"]: r["json"] for r in versions.read_records(spark, folder).collect()}
    assert len(stored) == 5002 and sum(j != "{}" for j in stored.values()) == 50 and stored["001049"] == '{"a":1}'
    assert versions.write_records(changed.limit(0), folder) == [] and versions.read_records(spark, folder).count() == 5002


# --- imports ----------------------------------------------------------------


def folder_tables(spark, root):
    def relative(column):
        return F.regexp_replace(column, f"^.*{root.name}/", "").alias("path")

    listed = files.list_files(spark, str(root), recursive=True).select(relative("path"))
    records = files.read_metadata(spark, str(root), recursive=True)
    return listed, records.select(relative("path"), "stem", F.col("meta").alias("raw"))


def test_import_folder(spark, tmp_path):
    root = tmp_path / "download"
    write_png(root / "0001.png", 1, 1)
    write_json(root / "sub" / "0001.json", post(1))
    write_png(root / "broken.png", 1, 1)
    listed, records = folder_tables(spark, root)
    empty = spark.createDataFrame([], "name STRING")
    first = importing.import_folder(listed, records, empty, site="board")
    assert sorted((r["name"], r["action"]) for r in first.log.collect()) == [("0001.json", "imported"), ("0001.png", "imported")]
    row = first.metadata.first()
    assert (row["tags"], row["post_id"], row["source"]) == (["anthro", "solo", "hi_res"], 1, "board")
    second = importing.import_folder(listed, records, first.log.select("name"), site="board")
    assert second.counts().collect() == [("skipped", 2)] and second.metadata.count() == 0
    third = importing.import_folder(listed, records, first.log.select("name"), site="board", overwrite=True)
    assert third.counts().collect() == [("imported", 2)]
    nothing = importing.import_folder(listed, records, empty, site="board", only_stems=spark.createDataFrame([("x",)], "stem STRING"))
    assert nothing.log.count() == 0
    write_png(root / "sub" / "0001.gif", 1, 1)
    with pytest.raises(GateError, match="Several files"):
        importing.import_folder(*folder_tables(spark, root), empty, site="board")


@pytest.mark.parametrize(
    "record, reason",
    [({"tags": []}, "missing integer id"), ({"id": "1", "tags": []}, "missing integer id"), ({"id": 1}, "missing tags"),
     ({"id": 1, "tags": "x"}, "tags are neither a list of strings nor categories of strings"), ([1], "not a JSON object")],
)
def test_import_rejects(spark, record, reason):
    frame = metas(spark, ("a", record)).withColumnRenamed("meta", "raw")
    assert imports.import_metadata(frame, "s").first()["reject"] == reason


def catalogue(root, *post_ids, seen):
    for post_id in post_ids:
        write_png(root / "images" / "sample" / f"{post_id:012d}.png", 1, 1)
        write_json(root / "json" / f"{post_id:012d}.json", post(post_id))
    posts = {
        str(i): {"id": str(i), "file_paths": {"json": f"json/{i:012d}.json", "image_paths": {"preview": None, "sample": f"images/sample/{i:012d}.png", "original": None}}}
        for i in post_ids
    }
    write_json(root / "manifest.json", {"schema_version": 3, "queries": {"q:fox": {"key": "q:fox", "seen_post_ids": seen}}, "posts": posts})


def test_import_catalogue(spark, tmp_path):
    root = tmp_path / "cache"
    assert not files.is_catalogue(spark, str(tmp_path))
    catalogue(root, 1, 2, seen=[2, 77])
    assert files.is_catalogue(spark, str(root))
    seen, posts = files.read_catalogue(spark, str(root / "manifest.json"))
    listed, records = folder_tables(spark, root)
    empty = spark.createDataFrame([], "name STRING")
    plan = importing.import_catalogue(seen, posts, listed, records, empty, query_key="q:fox", site="board")
    assert sorted(r["name"] for r in plan.log.collect()) == ["000000000002.json", "000000000002.png"]
    assert [r["post_id"] for r in plan.metadata.collect()] == [2]
    # A query that saw nothing takes every complete post.
    every = importing.import_catalogue(seen, posts, listed, records, empty, query_key="q:cat", site="board")
    assert sorted(r["name"] for r in every.log.collect() if r["kind"] == "image") == ["000000000001.png", "000000000002.png"]


# --- captioning and plug-ins -------------------------------------------------


def loaders():
    """Loaders defined here travel to the workers by value."""

    def load_model():
        def model(path, context):
            if path.endswith("bad.png"):
                raise ValueError("unreadable")
            return {"tags": [*context, "new_tag"], "caption": f"About {path}.", "caption_backend": "m"}

        return model

    def load_nothing():
        raise RuntimeError("no weights")

    return load_model, load_nothing


def plain_tags(requests):
    none = F.lit(None).cast("string")
    error = F.lit(None).cast("struct<stage:string,error:string,traceback:string>")
    return requests.select(
        "stem", F.array(F.lit("solo"), F.lit("new_tag")).alias("tags"), none.alias("caption"),
        none.alias("draft_caption"), none.alias("caption_backend"), none.alias("editor_backend"), error.alias("error"),
    )


def request_table(spark):
    return spark.createDataFrame(
        [("a", "a.png", ["fox"]), ("b", "bad.png", [])], "stem STRING, image_path STRING, context_tags ARRAY<STRING>"
    )


def test_model_errors_stay_with_their_record(spark):
    load_model, load_nothing = loaders()
    rows = {r["stem"]: r for r in plugins.model_tagger(load_model, "tagger")(request_table(spark)).collect()}
    assert rows["a"]["tags"] == ["fox", "new_tag"] and rows["a"]["error"] is None
    assert rows["b"]["tags"] == [] and rows["b"]["error"]["stage"] == "tagger" and "unreadable" in rows["b"]["error"]["error"]
    failed = plugins.model_tagger(load_nothing, "tagger")(request_table(spark)).collect()
    assert {r["error"]["stage"] for r in failed} == {"tagger_load"}


def test_composite_and_registry(spark):
    model = plugins.model_tagger(loaders()[0], "tagger")
    rows = {r["stem"]: r for r in plugins.composite([model, plain_tags])(request_table(spark)).collect()}
    assert rows["a"]["tags"] == ["fox", "new_tag", "solo"]
    assert rows["a"]["caption"] == "About a.png." and rows["b"]["error"]["stage"] == "tagger"
    registry = {"natural_language": model, "image_tags": plain_tags}
    assert plugins.build_tagger(["natural_language", "image_tags"], registry) is model
    assert plugins.build_tagger(None, registry)(request_table(spark)).count() == 2
    for bad in ([], ["other"], ["natural_language", "other"]):
        with pytest.raises(CurationError):
            plugins.build_tagger(bad, registry)
    assert plugins.find_importer("alias", {"alias": 1, "name": 1}) == 1
    with pytest.raises(CurationError, match="No importer"):
        plugins.find_importer("zzz", {})


def caption_candidates(spark):
    return spark.createDataFrame(
        [("a", "a.png", True), ("b", "b.png", False), ("c", None, False), ("d", "d.png", True), ("e", "e.png", False), ("f", "f.png", True)],
        "stem STRING, image_path STRING, tagged BOOLEAN",
    )


@pytest.mark.parametrize(
    "options, expected",
    [
        ({}, [("a", True), ("b", False), ("d", True), ("e", False), ("f", True)]),
        ({"limit": 1}, [("a", True), ("b", False)]),
        ({"limit": 2}, [("a", True), ("b", False), ("d", True), ("e", False)]),
        ({"limit": 3}, [("a", True), ("b", False), ("d", True), ("e", False), ("f", True)]),
        ({"limit": 0}, []),
        ({"all_images": True, "limit": 2}, [("a", False), ("b", False)]),
    ],
)
def test_select_work(spark, options, expected):
    rows = captioning.select_work(caption_candidates(spark), **options)
    assert sorted((r["stem"], r["skipped"]) for r in rows.collect()) == expected


def rounds_of(spark, chosen, limit):
    """The end of a walk and how many jobs with results at the driver it took."""
    spark.sparkContext.setJobGroup(f"walk-{limit}", "walk")
    found = captioning._walk_end(chosen, limit)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk-{limit}"))


@pytest.mark.parametrize("count, limit", [(40_000, 20_000), (40_000, 40_000), (400_000, 203_942), (400_000, 1)])
def test_long_walks_end(spark, count, limit):
    chosen = spark.range(count).select(F.format_string("image_%06d", "id").alias("stem"))
    found, jobs = rounds_of(spark, chosen, limit)
    assert found == f"image_{limit - 1:06d}" and jobs <= 2 * len(found)
    assert captioning._walk_end(chosen, count + 1) is None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab\x00é漢🎈", max_size=5), min_size=1, max_size=30), st.data())
def test_walk_ends_at_its_rank_by_bytes(spark, stems, data):
    limit = data.draw(st.integers(1, len(stems) + 1))
    chosen = spark.createDataFrame([(s,) for s in stems] + [(None,)], "stem STRING")
    ordered = sorted(stems, key=str.encode)
    assert captioning._walk_end(chosen, limit) == (ordered[limit - 1] if limit <= len(stems) else None)


def test_write_back(spark):
    stored = metas(
        spark,
        ("a", {"tags": {"meta": ["hi_res"], "general": ["anthro"]}, "x": [1], "metadata": {"source": "test"}}),
        ("b", {"tags": ["one"], "metadata": 5}),
    )
    results = spark.createDataFrame(
        [("a", ["anthro", "fox"], "Told.", "", "m", None, '{"k": 1}'), ("b", ["one"], None, None, None, None, None), ("new", ["t"], None, None, None, None, '{"i": 0}')],
        "stem STRING, tags ARRAY<STRING>, caption STRING, draft_caption STRING, caption_backend STRING, editor_backend STRING, side STRING",
    ).withColumn("sidecar", F.parse_json("side"))
    written = captioning.write_back(stored, results, default_source="curation")
    rows = {r["stem"]: (json.loads(r["j"]), r["added_tags"]) for r in written.select("stem", F.to_json("meta").alias("j"), "added_tags").collect()}
    assert rows["a"] == (
        {"tags": ["anthro", "hi_res", "fox"], "x": [1], "caption": "Told.",
         "metadata": {"source": "test", "captioning": {"draft_caption": "Told.", "caption": "Told.", "caption_backend": "m"}, "tagging": {"k": 1}}},
        ["fox"],
    )
    assert rows["b"] == ({"tags": ["one"], "metadata": 5}, [])
    odd = spark.createDataFrame([("a", '{"tags": "one, two", "keep": 1}'), ("b", "[1]"), ("new", None)], "stem STRING, j STRING").select("stem", variants.parse_object(F.col("j")).alias("meta"))
    refused = captioning.write_back(odd, results, default_source="curation")
    assert {r["stem"]: (r["meta"], r["problem"] is None) for r in refused.collect()} == {s: (None, False) for s in ("a", "b", "new")}
    with pytest.raises(GateError, match="Unusable metadata"):
        captioning.store(refused, "never written")
    pairs = pairing.pair(pairing.classify(spark.createDataFrame([("a.png",), ("a.json",), ("c.png",)], "path STRING")))
    with pytest.raises(GateError, match="Unusable metadata: a"):
        captioning.caption_candidates(pairs, odd)
    assert sorted(tuple(r) for r in captioning.caption_candidates(pairs, stored).select("stem", "tagged").collect()) == [("a", True), ("c", False)]
    twice = pairing.pair(pairing.classify(spark.createDataFrame([("a.png",), ("a.jpg",)], "path STRING")))
    with pytest.raises(GateError, match="share a stem: a"):
        captioning.caption_candidates(twice, stored)
    assert rows["new"] == ({"tags": ["t"], "metadata": {"source": "curation", "tagging": {"i": 0}}}, ["t"])
    work = captioning.select_work(spark.createDataFrame([("a", "a.png", False), ("b", "b.png", True)], "stem STRING, image_path STRING, tagged BOOLEAN"))
    assert tuple(captioning.summary(captioning.report(work, written)).first()) == (1, 1, 1)
    asked = captioning.requests(work.join(stored, "stem", "left")).first()
    assert asked["context_tags"] == ["anthro", "hi_res"]
    assert [r["t"] for r in stored.select(captioning.has_tags(F.col("meta")).alias("t")).collect()] == [True, True]


def test_fusion_job(spark):
    requests = spark.createDataFrame([("a", ["anthro"]), ("p", [])], "stem STRING, context_tags ARRAY<STRING>")
    open_set = spark.createDataFrame([("a", ["fox", "tree"]), ("p", ["potty"])], "stem STRING, open_set_tags ARRAY<STRING>")
    semantics = spark.createDataFrame(
        [("a", "Rough.", "digital_art", ["Tree"]), ("p", None, "photo", None)], "stem STRING, caption STRING, content_type STRING, objects ARRAY<STRING>"
    )
    for name in ("medium", "scene", "style", "composition", "attributes", "actions", "abstract_tags"):
        semantics = semantics.withColumn(name, F.lit(None).cast("array<string>"))
    assert [r["stem"] for r in tag_fusion.needs_art_tagger(semantics).collect()] == ["a"]
    art = spark.createDataFrame([("a", 1, 0, "Anthro", "booru", 0.9), ("a", 0, 5, "safe", "rating", 0.5)], "stem STRING, group_rank INT, pos INT, raw STRING, namespace STRING, confidence DOUBLE")
    judged = spark.createDataFrame([("a", "final_tags", 0, "FOX"), ("a", "final_tags", 1, "invented"), ("a", "scene", 0, "tree")], "stem STRING, field STRING, pos LONG, raw STRING")
    requests = requests.union(spark.createDataFrame([("bare", None)], requests.schema))
    fused = tag_fusion.fuse(requests, open_set, art, semantics, judged)
    errors = spark.createDataFrame([("p", 2, "qwen_prune", "E2"), ("p", 1, "ram++", "E1")], "stem STRING, stage_rank INT, stage STRING, error STRING")
    judgements = spark.createDataFrame([("a", " Final. ", "mood", "raw"), ("bare", "Only told.", None, None)], "stem STRING, caption STRING, tone STRING, _raw_response STRING")
    out = {r["stem"]: r for r in tag_fusion.results(fused, requests, semantics, judgements, judged, errors, caption_backend="m", editor_backend="e").withColumn("sidecar", F.to_json("sidecar")).collect()}
    assert out["a"]["tags"] == ["fox", "digital art", "tree"] and out["a"]["caption"] == "Final." and out["a"]["draft_caption"] == "Rough."
    side = json.loads(out["a"]["sidecar"])
    assert side["source_tags"] == {"metadata": ["anthro"], "qwen": ["digital art", "tree"], "ram++": ["fox", "tree"], "smilingwolf": ["safe", "anthro"]}
    assert side["errors"] == [] and "tag_fallback" not in side
    assert side["final"] == {"caption": " Final. ", "tone": "mood", "final_tags": ["fox", "digital art", "tree"], "scene": ["tree"]}
    assert side["semantic"] == {"caption": "Rough.", "content_type": "digital_art", "objects": ["Tree"]}
    side = json.loads(out["p"]["sidecar"])
    assert out["p"]["tags"] == ["photo", "potty"] and "tag_fallback" not in side  # the judge failed
    assert side["final"]["error"] == "E2" and side["final"]["final_tags"] == ["photo", "potty"] and "note" in side["final"]
    assert [e["stage"] for e in side["errors"]] == ["ram++", "qwen_prune"]
    assert out["bare"]["tags"] == [] and out["bare"]["caption"] == "Only told."
    none = judged.where("false")
    kept = tag_fusion.fuse(requests, open_set, art, semantics, none)
    out = {r["stem"]: r["side"] for r in tag_fusion.results(kept, requests, semantics, judgements, none, errors.where("false"), caption_backend="m", editor_backend="e").select("stem", F.to_json("sidecar").alias("side")).collect()}
    assert json.loads(out["a"])["tag_fallback"] == "merged_model_outputs" and "tag_fallback" not in json.loads(out["bare"])


# --- streams ----------------------------------------------------------------


class Growing:
    """A folder of JSON lines that gets a file with what is new."""

    def __init__(self, path, name):
        self.path, self.name, self.known = path, name, set()
        path.mkdir()

    def add(self, *values):
        fresh = [v for v in values if v not in self.known]
        self.known |= set(fresh)
        if fresh:
            write_json(self.path / f"{len(self.known)}.json", "\n".join(json.dumps({self.name: v}) for v in fresh))
        return str(self.path)


def test_import_stream_is_incremental(spark, tmp_path):
    source, target, checkpoint = tmp_path / "json", str(tmp_path / "pool"), str(tmp_path / "cp")
    seen = Growing(tmp_path / "seen", "post_id").add(1, 2, 4)

    def run():
        query = incremental.import_stream(spark, str(source), target, checkpoint, site="board", seen=seen)
        query.awaitTermination()
        return sorted((r["stem"], r["batch"]) for r in spark.read.parquet(target).collect())

    write_json(source / "1.json", post(1))
    assert run() == [("1", 0)]
    write_json(source / "2.json", post(2))
    write_json(source / "3.json", post(3))
    assert run() == [("1", 0), ("2", 1)]
    assert run() == [("1", 0), ("2", 1)]
    # A record that comes again is not stored twice, whatever it holds.
    write_json(source / "again" / "1.json", post(1))
    write_json(source / "other" / "2.json", post(2, ("another",)))
    write_json(source / "4.json", post(4))
    assert run() == [("1", 0), ("2", 1), ("4", 2)]


def test_import_stream_checks_images_targets_and_rejects(spark, tmp_path):
    source, target, checkpoint = tmp_path / "json", str(tmp_path / "pool"), str(tmp_path / "cp")
    images = Growing(tmp_path / "images", "stem").add("1", "2", "3", "4")
    held = spark.createDataFrame([("2",)], "stem STRING")

    def run():
        incremental.import_stream(spark, str(source), target, checkpoint, site="board", targets=held, images=images).awaitTermination()
        return sorted(r["stem"] for r in spark.read.parquet(target).collect())

    write_json(source / "1.json", post(1))
    write_json(source / "twice" / "1.json", post(1))
    write_json(source / "2.json", post(2))  # in the pool already
    write_json(source / "3.json", "[1]")  # no record
    write_json(source / "9.json", post(9))  # no image
    assert run() == ["1"]
    assert [r["stem"] for r in spark.read.parquet(f"{target}-rejects").collect()] == ["3"]
    write_json(source / "again" / "3.json", post(3))
    assert run() == ["1", "3"]


def test_import_stream_loses_no_record(spark, tmp_path):
    source, target, checkpoint = tmp_path / "json", str(tmp_path / "pool"), str(tmp_path / "cp")
    images, seen = Growing(tmp_path / "images", "stem"), Growing(tmp_path / "seen", "post_id")

    def run(stems, posts):
        options = {"images": images.add(*stems), "seen": seen.add(*posts)}
        incremental.import_stream(spark, str(source), target, checkpoint, site="board", **options).awaitTermination()
        return sorted(r["stem"] for r in spark.read.parquet(target).collect())

    def rejects():
        return sorted((r["stem"], r["reject"]) for r in spark.read.parquet(f"{target}-rejects").collect())

    for n in (1, 2, 3):
        write_json(source / f"{n}.json", post(n))
    write_json(source / "4.json", "[1]")
    write_json(source / "5.json", post(5))
    write_json(source / "twice" / "5.json", post(1))  # another record of the same stem
    assert run(["1", "3", "5"], [1, 2, 5]) == ["1"]
    assert [s for s, _ in rejects()] == ["4", "5", "5"] and "different" in rejects()[1][1]
    # No new file comes, the image does.
    assert run(["2"], []) == ["1", "2"]
    assert run(["2"], [3]) == ["1", "2", "3"]
    assert run([], []) == ["1", "2", "3"] and len(rejects()) == 3


def test_no_batch_reads_earlier_results(spark, tmp_path):
    """What was stored may be gone: the state alone knows the stems."""
    source, target, checkpoint = tmp_path / "json", tmp_path / "pool", str(tmp_path / "cp")
    for n in (1, 2):
        write_json(source / str(n) / "1.json", post(1))
        incremental.import_stream(spark, str(source), str(target), checkpoint, site="board").awaitTermination()
        first = target / "batch=0"
        if n == 1:
            first.rename(tmp_path / "moved")
    assert spark.read.parquet(str(target / "batch=1")).count() == 0


def caption_model(broken):
    def load():
        def model(path, tags):
            if path in broken:
                raise ValueError(path)
            return {"tags": [path]}
        return model
    return plugins.model_tagger(load, "m")


def ask(stem, path=None, tags=()):
    return json.dumps({"stem": stem, "image_path": path or f"{stem}.png", "context_tags": list(tags)})


def test_caption_stream_retries_failures(spark, tmp_path):
    source, target, checkpoint = tmp_path / "requests", str(tmp_path / "done"), str(tmp_path / "cp")

    def run(broken, wait_ms=0, most=8):
        incremental.caption_stream(spark, str(source), target, checkpoint, caption_model(broken), wait_ms=wait_ms, most_attempts=most).awaitTermination()
        return sorted((r["stem"], r["tried"]) for r in spark.read.parquet(target).collect())

    write_json(source / "0.json", "\n".join([ask("a"), ask("b"), ask("a"), ask("c"), ask("d"), ask("d", "other.png"), ask("e")]))
    assert run({"b.png", "c.png", "e.png"}) == [("a", 1)]
    refused = {(r["stem"], r["problem"]) for r in spark.read.parquet(f"{target}-rejects").where("problem IS NOT NULL").collect()}
    assert refused == {("d", "repeated stem with different requests")}
    # no new file comes: what failed is tried again, and what fails again waits on
    assert run({"c.png", "e.png"}) == [("a", 1), ("b", 2)]
    # a failed request that comes again is tried at once
    write_json(source / "1.json", "\n".join([ask("c"), ask("a"), ask("b")]))
    assert run({"e.png"}) == [("a", 1), ("b", 2), ("c", 3)]
    assert run(set(), most=3) == [("a", 1), ("b", 2), ("c", 3)]  # the third attempt of e was its last
    errors = spark.read.parquet(f"{target}-rejects").where("error IS NOT NULL").groupBy("stem").count().collect()
    assert {r["stem"]: r["count"] for r in errors} == {"b": 1, "c": 2, "e": 3}


def test_caption_timers_wait(spark, tmp_path):
    source, target, checkpoint = tmp_path / "requests", str(tmp_path / "done"), str(tmp_path / "cp")

    def run(broken):
        incremental.caption_stream(spark, str(source), target, checkpoint, caption_model(broken), wait_ms=12_000).awaitTermination()
        return sorted((r["stem"], r["tried"]) for r in spark.read.parquet(target).collect())

    write_json(source / "0.json", "\n".join([ask("a"), ask("b", tags=["x"])]))
    started = time.time()
    assert run({"b.png"}) == [("a", 1)]
    if time.time() - started < 8:
        assert run(set()) == [("a", 1)]  # the timer is set, it is too early
    else:
        run({"b.png"})
    time.sleep(max(0, 14 - (time.time() - started)))
    for _ in range(3):
        found = run(set())
    assert [s for s, _ in found] == ["a", "b"]


def test_batch_model(spark):
    def load():
        def model(requests):
            if any(r["stem"] == "bad" for r in requests):
                raise ValueError("bad batch")
            return [{"tags": [f"{r['stem']} of {len(requests)}"]} for r in requests]
        return model

    requests = spark.createDataFrame([(s, f"{s}.png", []) for s in ("a", "b", "c", "bad", "e")], "stem STRING, image_path STRING, context_tags ARRAY<STRING>").coalesce(1)
    rows = {r["stem"]: r for r in plugins.batch_tagger(load, "m", batch_size=3)(requests).collect()}
    assert rows["a"]["tags"] == ["a of 3"] and rows["e"]["tags"] == ["e of 1"]
    assert "bad batch" in rows["bad"]["error"]["error"] and rows["bad"]["error"]["stage"] == "m"


def test_one_bad_record_costs_few_calls(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def model(requests):
            with open(calls, "a") as file:
                file.write(f"{len(requests)}\n")
            if any(r["stem"] == "37" for r in requests):
                raise ValueError("bad record")
            return [{"tags": [r["stem"]]} for r in requests]
        return model

    requests = spark.range(128).coalesce(1).select(F.col("id").cast("string").alias("stem"), F.lit("x").alias("image_path"), F.array().cast("array<string>").alias("context_tags"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = {r["stem"]: r for r in plugins.batch_tagger(load, "m", batch_size=64)(requests).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [int(x) for x in open(calls).read().split()]
    assert len(sizes) == 14 and sizes[0] == 64 and sizes[-1] == 64  # Arrow batches of 10 fill batches of 64
    assert [s for s, r in rows.items() if r["error"]] == ["37"] and len(rows) == 128 and rows["36"]["tags"] == ["36"]


def test_caption_stream_resumes(spark, tmp_path):
    source, target, checkpoint = tmp_path / "requests", str(tmp_path / "done"), str(tmp_path / "cp")
    for i, stems in enumerate((["a", "b"], ["b", "c"])):
        rows = [json.dumps({"stem": s, "image_path": f"{s}.png", "context_tags": []}) for s in stems]
        write_json(source / f"{i}.json", "\n".join(rows))
    incremental.caption_stream(spark, str(source), target, checkpoint, plain_tags, max_files=1).awaitTermination()
    done = spark.read.parquet(target)
    assert sorted(r["stem"] for r in done.collect()) == ["a", "b", "c"]
    assert done.select("batch").distinct().count() == 2


def test_cluster_helpers(spark):
    small = spark.range(10)
    assert "BroadcastHashJoin" in spark.range(10**6).join(broadcast_if_small(small), "id")._jdf.queryExecution().executedPlan().toString()
    assert broadcast_if_small(small, 5) is small
    assert spread(small.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_missing_image_rows(spark):
    manifest = spark.createDataFrame([("ds", "a"), ("ds", "b")], "dataset STRING, image STRING")
    there = spark.createDataFrame([("ds", "a")], "dataset STRING, image STRING")
    assert [r["image"] for r in datasets.missing_images(manifest, there).collect()] == ["b"]
