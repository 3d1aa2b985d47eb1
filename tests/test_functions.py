"""Exact values of column expressions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.functions import geometry, modeltext, names, overlay, prompts, tags, text, variants
from tagweave.functions.geometry import PrepareConfig


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("out")).first()["out"]


def strings(*items):
    return F.array(*[F.lit(item) for item in items]).cast("array<string>")


@pytest.mark.parametrize(
    "name, stem, suffix, kind",
    [
        ("a.png", "a", ".png", "image"),
        ("a.b.JPEG", "a.b", ".JPEG", "image"),
        (".png", ".png", "", None),
        ("a.", "a.", "", None),
        ("a.json", "a", ".json", "metadata"),
        ("a.JSON", "a", ".JSON", None),
        ("..gif", ".", ".gif", "image"),
        ("plain", "plain", "", None),
    ],
)
def test_names(spark, name, stem, suffix, kind):
    n = F.lit(name)
    row = spark.range(1).select(
        names.stem(n).alias("stem"), names.suffix(n).alias("suffix"), names.kind(n).alias("kind")
    ).first()
    assert (row["stem"], row["suffix"], row["kind"]) == (stem, suffix, kind)


@pytest.mark.parametrize(
    "raw, tag",
    [
        ("  Blue_Eyes ", "blue eyes"),
        (" tv ", "television"),
        ("1GIRL.", "female-presenting person"),
        (",;:|", ""),
        ("a \t\n b", "a b"),
        ("cell__phone", "mobile phone"),
        ("solo", "solo subject"),
        ("_ . _", ""),
    ],
)
def test_normalize_tag(spark, raw, tag):
    assert one(spark, tags.normalize_tag(F.lit(raw))) == tag
    assert one(spark, tags.is_empty_tag(F.lit(raw))) == (tag == "")


def test_strip_and_words(spark):
    padded = "　\x1c a b \x85"
    assert one(spark, text.strip(F.lit(padded))) == "a b"
    assert one(spark, text.words(F.lit(padded))) == ["a", "b"]


def test_unique_in_order_keeps_first_spelling(spark):
    items = strings("Fox", " fox ", "", "  ", "Cat", "FOX", "cat", "dog")
    assert one(spark, tags.unique_in_order(items)) == ["Fox", "Cat", "dog"]
    assert one(spark, tags.unique_in_order(strings())) == []


def test_unique_in_order_properties(spark):
    """A subsequence of the input that holds every key once, at its first place, and no blank."""
    rng = random.Random(3)
    lists = [[rng.choice(["a", "A ", " b", "B", "", "c c"]) for _ in range(rng.randint(0, 12))] for _ in range(80)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i INT, x ARRAY<STRING>")
    for row in frame.select("x", tags.unique_in_order(F.col("x")).alias("got")).collect():
        keys = [item.strip().lower() for item in row["x"]]
        found = [item.strip().lower() for item in row["got"]]
        assert sorted(found) == sorted(set(keys) - {""})
        places = [keys.index(key) for key in found]
        assert places == sorted(places) and row["got"] == [row["x"][i] for i in places]


def test_tag_lists(spark):
    assert one(spark, tags.clean_list(strings("Tree", " ", "tree_", "Sofa", None))) == ["tree", "couch"]
    assert one(spark, tags.clean_list(F.lit(None).cast("array<string>"))) == []
    assert one(spark, tags.split_piped(F.lit("potty | Toddler|| floor"))) == ["potty", "toddler", "floor"]
    assert one(spark, tags.split_free_text(F.lit(" Tags: a, b.; c\nA,a "))) == ["a", "b", "c", "A"]


@pytest.mark.parametrize(
    "kind, expected", [("digital_art", ["digital art"]), ("photo", ["photo"]), ("unknown", []), (None, [])]
)
def test_content_type(spark, kind, expected):
    value = F.lit(kind).cast("string")
    assert one(spark, tags.content_type_tags(value)) == expected
    assert one(spark, tags.is_photo(value)) is (kind == "photo")


def test_expand_merge_require(spark):
    assert one(spark, tags.expand_underscores(strings("hi_res", "solo"))) == ["hi_res", "hi res", "solo"]
    assert one(spark, tags.expand_underscores(strings("blue_eyes", "blue eyes"))) == ["blue_eyes", "blue eyes"]
    assert one(spark, tags.with_required(strings("qwen tag", "potty"), strings("potty", "toddler", "floor"))) == [
        "qwen tag", "potty", "toddler", "floor",
    ]
    assert one(spark, tags.final_or_fallback(strings(), strings("animal", "potty"))) == ["animal", "potty"]
    assert one(spark, tags.final_or_fallback(strings("kept"), strings("animal"))) == ["kept"]
    assert one(spark, tags.merge_into(strings("existing"), strings("new_tag", "solo", "existing"))) == [
        "existing", "new_tag", "solo",
    ]
    assert one(spark, tags.added_tags(strings("existing"), strings("new_tag", "existing"))) == ["new_tag"]


@pytest.mark.parametrize(
    "source, namespace, expected",
    [
        ("qwen", "visible_text", 0.95),
        ("qwen", "objects", 0.82),
        ("ram++", "objects", 0.90),
        ("ram++", "mood", 0.72),
        ("smilingwolf", "pose", 0.86),
        ("smilingwolf", "characters", 0.72),
        ("smilingwolf", "rating", 0.65),
        ("smilingwolf", "copyright", 0.76),
        ("metadata", "existing", 0.88),
        ("other", "x", 0.5),
    ],
)
def test_authority(spark, source, namespace, expected):
    assert one(spark, tags.authority(F.lit(source), F.lit(namespace))) == expected


@pytest.mark.parametrize("confidence, expected", [(None, 0.75), (2.0, 1.0), (-1.0, 0.0), (0.4, 0.4)])
def test_score(spark, confidence, expected):
    assert one(spark, tags.score(F.lit(confidence).cast("double"), F.lit(1.0))) == expected


# --- JSON -------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw",
    ['{"a":1}', ' {"a": [1, "x"]} ', "{}", '{"a":1} x', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1}] x', "[1]", '"s"', "1",
     "{", "", "nonsense", '{"a":1}\n', '{"a":{"b":[{}]}}', '{"a":"}"}'],
)
def test_parse_object_agrees_with_python(spark, raw):
    try:
        expected = json.loads(raw)
        expected = expected if isinstance(expected, dict) else None
    except json.JSONDecodeError:
        expected = None
    got = one(spark, F.to_json(variants.parse_object(F.lit(raw))))
    assert (None if got is None else json.loads(got)) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('["a", "a", "b"]', ["a", "a", "b"]),
        ("[]", []),
        ('["a", 1]', None),
        ('["a", null]', None),
        ('[["a"]]', None),
        ('"a"', None),
        ('{"meta": ["hi_res"], "zeta": ["z"], "general": ["anthro", "solo"], "alpha": ["q"], "species": ["fox"]}',
         ["anthro", "solo", "fox", "hi_res", "q", "z"]),
        ('{"general": ["a", 1]}', None),
        ('{"general": "a"}', None),
        ("{}", []),
    ],
)
def test_tags_of(spark, raw, expected):
    assert one(spark, variants.tags_of(F.parse_json(F.lit(raw)))) == expected


def test_flatten_order(spark):
    raw = '{"artist": ["artist_name"], "general": ["anthro", "solo"], "species": ["fox"], "meta": ["hi_res"]}'
    read = variants.tags_of(F.parse_json(F.lit(raw)))
    assert one(spark, tags.expand_underscores(read)) == [
        "anthro", "solo", "fox", "artist_name", "artist name", "hi_res", "hi res",
    ]
    assert one(spark, variants.import_tags_of(F.parse_json(F.lit(raw)))) == ["anthro", "solo", "hi_res"]
    # Categories an import leaves out are not checked.
    assert one(spark, variants.import_tags_of(F.parse_json(F.lit('{"artist": 5, "meta": ["m"]}')))) == ["m"]


@pytest.mark.parametrize(
    "reply, expected",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('```JSON {"a": 1}```', {"a": 1}),
        ('Sure: {"a": {"b": 2}} done', {"a": {"b": 2}}),
        (" [1] ", {"parse_error": True, "raw_text": "[1]"}),
        ("no { json", {"parse_error": True, "raw_text": "no { json"}),
        ('{"a": 1} and {"b": 2}', {"parse_error": True, "raw_text": '{"a": 1} and {"b": 2}'}),
    ],
)
def test_reply_record(spark, reply, expected):
    assert json.loads(one(spark, F.to_json(modeltext.reply_record(F.lit(reply))))) == expected


def test_captions(spark):
    raw = 'Corrected caption: "anthro fox, solo. A fox in a forest."\n\nI changed it.'
    assert one(spark, modeltext.clean_caption(F.lit(raw))) == "anthro fox, solo. A fox in a forest."
    assert one(spark, modeltext.clean_caption(F.lit("OUTPUT: Caption: x"))) == "Caption: x"
    none = F.lit(None).cast("string")
    assert one(spark, modeltext.final_caption(F.lit(" \n"), F.lit(" told "))) == "told"
    assert one(spark, modeltext.final_caption(none, none)) is None
    assert one(spark, modeltext.draft_caption(none, F.lit("final"))) == "final"
    stored = one(spark, modeltext.without_raw_reply(F.create_map(F.lit("caption"), F.lit("A"), F.lit("_raw_response"), F.lit("raw"))))
    assert stored == {"caption": "A"}
    block = modeltext.captioning_block(F.lit("c"), none, F.lit("m"), none)
    assert json.loads(one(spark, F.to_json(block))) == {"draft_caption": "c", "caption": "c", "caption_backend": "m"}


# --- prompts ----------------------------------------------------------------

TAGS = ("anthro", "blue_eyes", "looking_at_viewer")
CAPTION = "An anthropomorphic character with blue eyes looks at the viewer."


@pytest.mark.parametrize(
    "kind, prompt, listed",
    [
        ("tags", "iztli, anthro, blue_eyes, looking_at_viewer", list(TAGS)),
        ("natural", "iztli, anthro, blue eyes, looking at viewer", ["anthro", "blue eyes", "looking at viewer"]),
        ("caption", f"iztli. {CAPTION}", ["anthro", "blue eyes", "looking at viewer"]),
        (
            "all",
            "iztli, anthro, blue_eyes, looking_at_viewer. iztli, anthro, blue eyes, looking at viewer. iztli. " + CAPTION,
            ["anthro", "blue_eyes", "blue eyes", "looking_at_viewer", "looking at viewer"],
        ),
    ],
)
def test_prompts(spark, kind, prompt, listed):
    assert one(spark, prompts.build_prompt(strings(*TAGS), F.lit(f" {CAPTION} "), "iztli", kind)) == prompt
    assert one(spark, prompts.manifest_tags(strings(*TAGS), kind)) == listed


def test_prompt_edges(spark):
    none = F.lit(None).cast("string")
    assert one(spark, prompts.build_prompt(strings("blue_eyes"), none, "", "caption")) == "blue eyes"
    assert one(spark, prompts.build_prompt(strings(), F.lit("told"), "", "all")) == "told"
    assert one(spark, prompts.build_prompt(strings("override"), none, "", "all")) == "override. override"
    assert one(spark, prompts.build_prompt(strings("wide"), none, "my_w", "all")) == "my_w, wide. my w, wide"
    with pytest.raises(CurationError):
        prompts.build_prompt(strings(), none, "", "other")


# --- geometry ---------------------------------------------------------------


@pytest.mark.parametrize(
    "size, config, expected",
    [
        ((100, 50), PrepareConfig(width=50, height=50), (50, 25)),
        ((100, 50), PrepareConfig(mode="center-crop", width=40, height=40), (40, 40)),
        ((100, 50), PrepareConfig(mode="pad", width=40, height=40), (40, 40)),
        ((100, 50), PrepareConfig(mode="copy", width=None, height=None), (100, 50)),
        ((20, 100), PrepareConfig(width=40, height=None), (40, 200)),
        ((20, 100), PrepareConfig(mode="pad", width=None, height=40), (40, 40)),
        ((1000, 1), PrepareConfig(width=10, height=10), (10, 1)),
    ],
)
def test_output_size(spark, size, config, expected):
    out = one(spark, geometry.output_size(F.lit(size[0]), F.lit(size[1]), config.validated()))
    assert tuple(out) == expected


def test_pad_and_square(spark):
    plan = one(spark, geometry.pad_plan(F.lit(100), F.lit(50), 41, 40, F.lit("RGBA")))
    assert (plan["inner_width"], plan["inner_height"], plan["left"], plan["top"]) == (41, 20, 0, 10)
    assert plan["background"] == "RGBA(0,0,0,0)"
    assert tuple(one(spark, geometry.square_plan(F.lit(10), F.lit(7)))) == (10, 0, 1)


@pytest.mark.parametrize(
    "bad",
    [
        PrepareConfig(mode="copy", width=32, height=None),
        PrepareConfig(mode="copy", width=None, height=None, image_format="png"),
        PrepareConfig(mode="copy"),
        PrepareConfig(mode="stretch"),
        PrepareConfig(width=None, height=None),
        PrepareConfig(width=0),
        PrepareConfig(image_format="tiff"),
        PrepareConfig(prompt_type="x"),
    ],
)
def test_bad_configs(bad):
    with pytest.raises(CurationError):
        bad.validated()


def test_jpg_alpha_and_codecs(spark):
    no, yes = F.lit(False), F.lit(True)
    assert one(spark, geometry.alpha_blocks_jpg(F.lit("RGBA"), no, "jpg")) is True
    assert one(spark, geometry.alpha_blocks_jpg(F.lit("P"), yes, "jpg")) is True
    assert one(spark, geometry.alpha_blocks_jpg(F.lit("P"), no, "jpg")) is False
    assert one(spark, geometry.alpha_blocks_jpg(F.lit("RGBA"), no, "png")) is False
    assert one(spark, names.prepared_name(F.lit("a.b.JPG"), "png")) == "a.b.png"
    assert one(spark, names.save_codec(F.lit("a.JPG"), "original")) == "JPEG"
    assert one(spark, names.run_name(F.lit(1234))) == "run-1234"
    assert one(spark, names.padded_id(F.lit(7))) == "000000000007"


# --- overlay formulas -------------------------------------------------------


def test_agreement_closed_form(spark):
    """With angles t = asin(sqrt(p)), the best common value lies midway between the extremes: cos of half their distance."""
    rng = random.Random(5)
    lists = [[round(rng.random(), rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    lists += [[0.0, 1.0], [0.0], [1.0, 1.0], [0.5, 0.5], [0.0, 0.0, 1.0]]
    frame = spark.createDataFrame([(x,) for x in lists], "x ARRAY<DOUBLE>")
    for row in frame.select("x", overlay.agreement(F.col("x")).alias("got")).collect():
        angles = [math.asin(math.sqrt(p)) for p in row["x"]]
        bound = math.cos((max(angles) - min(angles)) / 2)
        assert 0 < row["got"] <= bound + 1e-9, row["x"]
        if min(row["x"]) == max(row["x"]):
            assert row["got"] == pytest.approx(1.0)
    swapped = frame.select(overlay.agreement(F.col("x")).alias("a"), overlay.agreement(F.transform("x", lambda p: 1 - p)).alias("b"), overlay.agreement(F.reverse("x")).alias("c"))
    for row in swapped.collect():
        assert row["a"] == pytest.approx(row["b"], abs=1e-9) and row["a"] == row["c"]
    assert one(spark, overlay.agreement(F.array().cast("array<double>"))) == 0.0


def test_polygon_helpers(spark):
    square = overlay.rectangle_polygon(F.lit(-3.0), F.lit(10.5), F.lit(1.0), F.lit(30.0))
    clipped = overlay.clip_polygon(square, F.lit(100), F.lit(20))
    assert [tuple(p) for p in one(spark, clipped)] == [(0, 1), (10, 1), (10, 19), (0, 19)]
    assert one(spark, overlay.polygon_area(clipped)) == 180.0
    assert tuple(one(spark, overlay.bounding_box(clipped))) == (0, 1, 10, 19)
    nested = F.to_variant_object(F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(*[F.lit(float(i)) for i in range(4)]))))
    assert one(spark, overlay.rectangles(nested)) == [[0.0, 1.0, 2.0, 3.0]]


def test_replies_of_mixed_depth(spark):
    reply = F.parse_json(F.lit("[[1, 2, 3, 4], [[5, 6, 7, 8], [9, 9]], 7, []]"))
    assert one(spark, overlay.rectangles(reply)) == [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]]
    reply = F.parse_json(F.lit("[[[0, 0], [1, 0], [1, 1]], [[[2, 2], [3, 2], [3, 3], [2, 3]], [[1, 1]]]]"))
    assert one(spark, F.transform(overlay.polygons(reply), F.size)) == [3, 4]
    assert one(spark, overlay.rectangles(F.parse_json(F.lit("null")))) == []
    reply = F.parse_json(F.lit("[[[[0, 0], [1, 0]], [[2, 2], [3, 2], [3, 3]]], []]"))
    assert one(spark, overlay.polygons(reply)) == [[[2.0, 2.0], [3.0, 2.0], [3.0, 3.0]]]


def test_accept_rules(spark):
    def decide(score, **p):
        return one(spark, overlay.accept(F.lit(score), {k: F.lit(v) for k, v in p.items()}))

    assert decide(0.7, detector_stability=0.5) is True
    assert decide(0.55, detector_stability=0.6) is False
    assert decide(0.57, detector_stability=0.6, placement_metadata=0.56) is True
    assert decide(0.1, detector_stability=0.48, placement_metadata=0.66, scale_subordination=0.58) is True
    assert decide(0.53, detector_stability=0.5, alpha_layer=0.7) is True
    assert decide(0.1, detector_stability=0.66, overlay_simplicity=0.6) is True
    assert (
        decide(
            0.73, detector_stability=0.9, scale_subordination=0.3, placement_metadata=0.4, alpha_layer=0.5,
            repetition_or_mark_family=0.5, low_scene_salience=0.4,
        )
        is False
    )
