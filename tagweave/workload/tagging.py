"""Queries over tags: normalising, predictions, fusion, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.cluster import spread
from tagweave.functions import modeltext, tags
from tagweave.functions.text import BLANK
from tagweave.functions.text import words as cut_words
from tagweave.operators import fusion, predictions
from tagweave.plans import tag_fusion as job
from tagweave.workload.tables import (
    SQL_MERGED,
    SQL_ORDER_TAGS,
    raw_order_tags,
    sql_normal,
    sql_once,
    sql_strip,
    table,
)

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- normalising ------------------------------------------------------------


@query
def tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """How often each normalised phrase of the conversations occurs."""
    phrases = table(spark, d, "conversations").select(
        F.explode(F.split("text", r"[,.\n]+")).alias("raw")
    )
    normal = phrases.select(tags.normalize_tag(F.col("raw")).alias("tag")).where(F.col("tag") != "")
    return normal.groupBy("tag").agg(F.count("*").alias("n"))


SQL["tag_vocabulary"] = rf"""
SELECT tag, count(*) AS n FROM (
  SELECT {sql_normal('raw')} AS tag
  FROM (SELECT unnest(string_split_regex(text, '[,.\n]+')) AS raw FROM conversations))
WHERE tag <> '' GROUP BY 1"""


@query
def tag_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Messy spellings made from parts, aliases included, and what they become."""
    size = F.col("p_size")
    raw = (
        F.when(size <= 10, F.concat(F.lit(" "), F.upper("p_name"), F.lit("_\t;")))
        .when(size <= 20, F.lit("  Cell_Phone, "))
        .when(size <= 30, F.concat(F.lit("|1Girl"), F.lit(".")))
        .when(size <= 40, F.lit("Multiple__Girls"))
        .otherwise(F.concat_ws("_", F.lit("solo"), F.lower("p_type")))
    )
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey",
        tags.normalize_tag(F.col("raw")).alias("tag"),
        F.array_join(tags.content_type_tags(F.col("raw")), "|").alias("as_content_type"),
        tags.is_photo(F.col("raw")).alias("is_photo"),
    )


SQL["tag_aliases"] = f"""
WITH spelled AS (
  SELECT p_partkey, CASE WHEN p_size <= 10 THEN ' ' || upper(p_name) || '_' || chr(9) || ';' WHEN p_size <= 20 THEN '  Cell_Phone, '
    WHEN p_size <= 30 THEN '|1Girl.' WHEN p_size <= 40 THEN 'Multiple__Girls' ELSE 'solo_' || lower(p_type) END AS raw
  FROM part
), normal AS (SELECT p_partkey, {sql_normal('raw')} AS tag FROM spelled)
SELECT p_partkey, tag, tag AS as_content_type, tag = 'photo' AS is_photo FROM normal"""


@query
def tag_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parts as piped replies, free-text replies and open lists."""
    piped = F.concat_ws(" | ", F.upper("p_name"), F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit("Sofa"))
    free = F.concat(F.lit("Tags: "), F.col("p_name"), F.lit("; "), F.col("p_type"), F.lit(".,"), F.col("p_name"), F.lit("\n"), F.col("p_brand"))
    listed = F.array(F.col("p_name"), F.concat(F.lit(" "), F.upper("p_name")), F.lit("  "), F.col("p_type"), F.col("p_brand"))
    return table(spark, d, "part").select(
        "p_partkey",
        F.array_join(tags.split_piped(piped), "|").alias("piped"),
        F.array_join(tags.split_free_text(free), "|").alias("free"),
        F.array_join(tags.clean_list(listed), "|").alias("cleaned"),
        F.array_join(tags.unique_in_order(listed), "|").alias("first_spellings"),
    )


SQL["tag_lists"] = """
SELECT p_partkey,
  concat_ws('|', lower(p_name), lower(p_type), 'couch') AS piped,
  concat_ws('|', p_name, p_type, p_brand) AS free,
  concat_ws('|', lower(p_name), lower(p_type), lower(p_brand)) AS cleaned,
  concat_ws('|', p_name, p_type, p_brand) AS first_spellings
FROM part"""


@query
def merge_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every word of a document merged into a few tags it already has."""
    words = cut_words(F.lower("text"))
    existing = F.array(F.lit("the"), F.col("source"), F.col("lang"))
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang"))
    return documents.select("doc_id", existing.alias("existing"), words.alias("words")).select(
        "doc_id",
        F.size(tags.merge_into(F.col("existing"), F.col("words"))).alias("n_merged"),
        F.size(tags.added_tags(F.col("existing"), F.col("words"))).alias("n_added"),
        F.md5(F.array_join(tags.merge_into(F.col("existing"), F.col("words")), " ")).alias("merged_md5"),
        F.md5(F.array_join(tags.with_required(F.col("words"), F.col("existing")), " ")).alias("required_md5"),
    )


SQL["merge_tags"] = f"""
WITH listed AS (
  SELECT doc_id, ['the', source, lang] AS existing,
    list_filter(string_split_regex(lower(text), '{BLANK}+'), lambda w: w <> '') AS words
  FROM documents
),
placed AS (
  SELECT doc_id, w, i FROM (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed)
),
both_ways AS (
  SELECT doc_id, w, min(i) AS last_i, min(i) AS first_i, false AS own FROM placed GROUP BY ALL
  UNION ALL
  SELECT doc_id, unnest(existing), 10000000 + generate_subscripts(existing, 1),
    generate_subscripts(existing, 1) - 10, true FROM listed
),
merged AS (
  SELECT doc_id, w, min(first_i) AS f, min(last_i) AS l, bool_or(own) AS own FROM both_ways GROUP BY 1, 2
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_merged, CAST(count(*) FILTER (NOT own) AS INTEGER) AS n_added,
  md5(string_agg(w, ' ' ORDER BY f)) AS merged_md5, md5(string_agg(w, ' ' ORDER BY l)) AS required_md5
FROM merged GROUP BY 1"""


# --- predictions ------------------------------------------------------------

LABELS = 64
GENERAL_BAR, CHARACTER_BAR, SIMPLE_BAR = 0.1, 0.2, 0.05


def _vocabulary(spark: SparkSession) -> DataFrame:
    """One label per embedding dimension, categories in turn."""
    raw = spark.range(LABELS).select(
        F.col("id").cast("int").alias("pos"),
        F.concat(F.lit("Label_"), F.col("id")).alias("name"),
        (F.col("id") % 10).cast("string").alias("category"),
    )
    return predictions.vocabulary(raw)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("stem"), F.col("embedding").alias("scores")
    )
    return predictions.label_scores(scores, _vocabulary(spark), strict=True)


_LABELLED = """
labelled AS (
  SELECT vec_id AS stem, pos, 'Label_' || pos AS name, pos % 10 AS category, CAST(embedding[pos + 1] AS DOUBLE) AS confidence
  FROM embeddings, (SELECT CAST(unnest(range(64)) AS INTEGER) AS pos)
),
selected AS (
  SELECT *, CASE category WHEN 4 THEN 'characters' WHEN 3 THEN 'copyrights' WHEN 1 THEN 'artists'
    WHEN 5 THEN 'meta' ELSE 'general' END AS label_group
  FROM labelled WHERE category <> 9 AND confidence >= CASE category WHEN 4 THEN 0.2e0 ELSE 0.1e0 END
),
ratings AS (
  SELECT stem, pos, name, confidence FROM labelled WHERE category = 9
  QUALIFY row_number() OVER (PARTITION BY stem ORDER BY confidence DESC, pos) = 1
)"""


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return predictions.select_labels(_labelled(spark, d), GENERAL_BAR, CHARACTER_BAR)


@query
def selected_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels over their bars, ranked within a record (at most one per label)."""
    order = Window.partitionBy("stem").orderBy(F.col("confidence").desc(), "pos")
    ranked = _selected(spark, d).withColumn("rank", F.row_number().over(order))
    return predictions.by_confidence(ranked).select(
        "stem", "rank", "normalized", "category_name", "label_group", F.round("confidence", 6).alias("confidence")
    )


SQL["selected_labels"] = f"""WITH {_LABELLED}
SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY confidence DESC, pos) AS INTEGER) AS rank,
  'label ' || pos AS normalized, CASE category WHEN 0 THEN 'general' WHEN 1 THEN 'artist' WHEN 3 THEN 'copyright'
    WHEN 4 THEN 'character' WHEN 5 THEN 'meta' ELSE 'unknown' END AS category_name,
  label_group, round(confidence, 6) AS confidence
FROM selected"""


@query
def simple_labels(spark: SparkSession, d: str) -> DataFrame:
    return predictions.simple_tags(_labelled(spark, d), SIMPLE_BAR).select("stem", "pos", "name")


SQL["simple_labels"] = f"""WITH {_LABELLED}
SELECT stem, pos, name FROM labelled WHERE category IN (0, 4) AND confidence >= 0.05e0"""


@query
def ratings(spark: SparkSession, d: str) -> DataFrame:
    return predictions.rating(_labelled(spark, d)).select(
        "stem", "name", F.round("confidence", 6).alias("confidence")
    )


SQL["ratings"] = f"WITH {_LABELLED} SELECT stem, name, round(confidence, 6) AS confidence FROM ratings"


@query
def routed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Namespaced candidates of the art tagger; artists are left out."""
    labelled = _labelled(spark, d)
    routed = predictions.route(
        predictions.select_labels(labelled, GENERAL_BAR, CHARACTER_BAR), predictions.rating(labelled)
    )
    return routed.select("stem", "group_rank", "pos", "raw", "namespace")


_ROUTED = """
routed AS (
  SELECT stem, 0 AS group_rank, pos, name AS raw, 'rating' AS namespace, confidence FROM ratings
  UNION ALL
  SELECT stem, CASE label_group WHEN 'general' THEN 1 WHEN 'characters' THEN 2 WHEN 'copyrights' THEN 3 ELSE 4 END,
    pos, name, CASE label_group WHEN 'characters' THEN 'characters' WHEN 'copyrights' THEN 'copyright' ELSE 'booru' END,
    confidence
  FROM selected WHERE label_group <> 'artists'
)"""
SQL["routed_labels"] = """
SELECT stem, CASE category WHEN 9 THEN 0 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 4 ELSE 1 END AS group_rank, pos, 'Label_' || pos AS raw,
  CASE category WHEN 9 THEN 'rating' WHEN 4 THEN 'characters' WHEN 3 THEN 'copyright' ELSE 'booru' END AS namespace
FROM (
  SELECT *, min(CASE WHEN category = 9 AND confidence = highest THEN pos END) OVER (PARTITION BY stem) AS rated
  FROM (
    SELECT *, max(CASE WHEN category = 9 THEN confidence END) OVER (PARTITION BY stem) AS highest
    FROM (
      SELECT stem, CAST(place - 1 AS INTEGER) AS pos, CAST((place - 1) % 10 AS INTEGER) AS category, CAST(score AS DOUBLE) AS confidence
      FROM (SELECT vec_id AS stem, unnest(embedding) AS score, generate_subscripts(embedding, 1) AS place FROM embeddings)
    )
  )
)
WHERE pos = rated OR (category NOT IN (1, 9) AND confidence >= CASE category WHEN 4 THEN 0.2e0 ELSE 0.1e0 END)"""


@query
def cut_labels(spark: SparkSession, d: str) -> DataFrame:
    """Scores against a shorter vocabulary: the longer side is cut."""
    scores = table(spark, d, "embeddings").select(F.col("vec_id").alias("stem"), F.col("embedding").alias("scores"))
    short = _vocabulary(spark).where("pos < 40")
    return predictions.simple_tags(predictions.label_scores(scores, short, strict=False), SIMPLE_BAR).select("stem", "pos", "name")


SQL["cut_labels"] = f"""WITH {_LABELLED}
SELECT stem, pos, name FROM labelled WHERE pos < 40 AND category IN (0, 4) AND confidence >= 0.05e0"""


# --- scoring and merging ----------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_order_tags(spark, d).select("stem", "pos", "raw", "source", "namespace", "confidence")
    return fusion.score_candidates(raw)


@query
def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(
        "stem", "pos.*", "raw", "tag", "source", "namespace", "authority",
        F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"),
    )


SQL["score_candidates"] = f"""WITH {SQL_ORDER_TAGS}
SELECT stem, p1 AS l_linenumber, p2 AS l_partkey, p3 AS l_suppkey, raw, tag, source, namespace, authority,
  round(confidence, 6) AS confidence, round(score, 6) AS score
FROM scored"""


@query
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three best tags of every order."""
    return fusion.merge_candidates(_scored(spark, d), limit=3).select(
        "stem", "tag", "rank", "raw", "source", "namespace", F.round("score", 6).alias("score")
    )


SQL["merge_candidates"] = f"""WITH {SQL_ORDER_TAGS}, {SQL_MERGED}
SELECT stem, tag, CAST(rank AS INTEGER) AS rank, raw, source, namespace, round(score, 6) AS score FROM merged"""


@query
def source_tags(spark: SparkSession, d: str) -> DataFrame:
    return fusion.source_tags(_scored(spark, d)).select("stem", "source", "tag", "pos.*").orderBy("stem", "source")


SQL["source_tags"] = f"""WITH {SQL_ORDER_TAGS}
SELECT stem, source, tag, p1 AS l_linenumber, p2 AS l_partkey, p3 AS l_suppkey FROM scored
QUALIFY row_number() OVER (PARTITION BY stem, source, tag ORDER BY p1, p2, p3) = 1"""


@query
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First spelling of each raw tag per order, ignoring case and blanks."""
    raw = raw_order_tags(spark, d).select("stem", "pos", "raw")
    return fusion.first_spelling(raw, ["stem"], item="raw").select("stem", "raw", "pos.*")


SQL["ordered_dedup"] = f"""WITH {SQL_ORDER_TAGS}
SELECT stem, raw, p1 AS l_linenumber, p2 AS l_partkey, p3 AS l_suppkey FROM raw_tags
WHERE {sql_strip('raw')} <> ''
QUALIFY row_number() OVER (PARTITION BY stem, lower({sql_strip('raw')}) ORDER BY p1, p2, p3) = 1"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The judge keeps returned lines, and names part types nobody proposed."""
    lines = raw_order_tags(spark, d)
    kept = lines.where(F.col("l_returnflag") == "R").select("stem", "pos", F.upper("p_name").alias("raw"))
    invented = lines.where(F.col("l_linestatus") == "F").select("stem", "pos", F.col("p_type").alias("raw"))
    return kept.unionByName(invented).withColumn("field", F.lit("final_tags"))


_KEPT = f"""
kept AS (
  SELECT stem, tag, min({{'a': p1, 'b': p2, 'c': p3}}) AS pos FROM (
    SELECT stem, {sql_normal('p_name')} AS tag, p1, p2, p3 FROM raw_tags WHERE l_returnflag = 'R'
    UNION ALL
    SELECT stem, {sql_normal('p_type')}, p1, p2, p3 FROM raw_tags WHERE l_linestatus = 'F')
  WHERE (stem, tag) IN (SELECT (stem, tag) FROM merged)
  GROUP BY 1, 2
)"""


@query
def pruned_tags(spark: SparkSession, d: str) -> DataFrame:
    merged = fusion.merge_candidates(_scored(spark, d), limit=3)
    return fusion.prune(_judged(spark, d), merged).select("stem", "field", "tag", "pos.*")


SQL["pruned_tags"] = f"""WITH {SQL_ORDER_TAGS}, {SQL_MERGED}, {_KEPT}
SELECT stem, 'final_tags' AS field, tag, pos.a AS l_linenumber, pos.b AS l_partkey, pos.c AS l_suppkey FROM kept"""


@query
def prune_and_require(spark: SparkSession, d: str) -> DataFrame:
    """Kept tags or the fallback, then the tags of two sources that always stay."""
    facts = fusion.tag_facts(_scored(spark, d), _judged(spark, d), required=("qwen", "ram++"))
    return fusion.final_tags(facts, limit=3).select("stem", "tag", F.col("place.block").alias("block"))


SQL["prune_and_require"] = f"""WITH {SQL_ORDER_TAGS}, {SQL_MERGED}, {_KEPT}
SELECT stem, tag, min(block) AS block FROM (
  SELECT stem, tag, 0 AS block FROM kept
  UNION ALL SELECT stem, tag, 1 FROM merged WHERE stem NOT IN (SELECT stem FROM kept)
  UNION ALL SELECT stem, tag, 2 FROM scored WHERE source = 'qwen'
  UNION ALL SELECT stem, tag, 3 FROM scored WHERE source = 'ram++')
GROUP BY 1, 2"""


@query
def gained_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags an order gains over those it holds from metadata."""
    scored = _scored(spark, d)
    held = scored.where(F.col("source") == "metadata")
    new = scored.where(F.col("source") != "metadata").select("stem", "tag").distinct()
    return fusion.merge_back(held, new)


SQL["gained_tags"] = f"""WITH {SQL_ORDER_TAGS}
SELECT DISTINCT stem, tag FROM scored WHERE source <> 'metadata'
EXCEPT SELECT stem, tag FROM scored WHERE source = 'metadata'"""


@query
def prune_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per order with its merged candidates as JSON."""
    merged = fusion.merge_candidates(_scored(spark, d), limit=3)
    semantic = F.to_json(F.struct(F.col("stem").alias("order")))
    return fusion.prune_payload(merged).select(
        "stem", modeltext.prune_request(semantic, F.col("payload"), fusion.MAX_REJECTED).alias("request")
    )


SQL["prune_requests"] = f"""WITH {SQL_ORDER_TAGS}, {SQL_MERGED}
SELECT stem, 'Keep only the candidate tags the image supports. Answer with one JSON object; list at most 40 rejected tags.'
  || chr(10) || chr(10) || 'Semantic analysis:' || chr(10) || '{{"order":' || stem || '}}' || chr(10) || chr(10)
  || 'Candidate tags:' || chr(10) || '[' || string_agg(
    '{{"tag":' || to_json(tag) || ',"raw":' || to_json(raw) || ',"source":' || to_json(source) || ',"namespace":'
    || to_json(namespace) || ',"score":' || to_json(round(score, 4)) || ',"confidence":'
    || coalesce(CAST(to_json(round(confidence, 4)) AS VARCHAR), 'null') || '}}', ',' ORDER BY rank) || ']' AS request
FROM merged GROUP BY stem"""


# --- budgets ----------------------------------------------------------------


def _conversation_words(spark: SparkSession, d: str) -> DataFrame:
    words = cut_words(F.col("text"))
    return (
        table(spark, d, "conversations")
        .select(F.col("conv_id").alias("stem"), "turn", F.posexplode(words).alias("at", "tag"))
        .select("stem", fusion.place(F.col("turn"), F.col("at")).alias("pos"), "tag")
    )


def _budget(spark: SparkSession, d: str) -> DataFrame:
    return fusion.edit_budget(_conversation_words(spark, d), max_tags=120, max_chars=600)


_BUDGET = f"""
words AS (
  SELECT stem, tag, min({{'t': turn, 'i': i}}) AS pos FROM (
    SELECT conv_id AS stem, turn, unnest(w) AS tag, generate_subscripts(w, 1) AS i FROM (
      SELECT conv_id, turn, string_split(regexp_replace({sql_strip('text')}, '{BLANK}+', ' ', 'g'), ' ') AS w FROM conversations))
  WHERE tag <> '' GROUP BY 1, 2
),
spent AS (
  SELECT *, row_number() OVER o AS rank, sum(length(tag) + 2) OVER o - 2 AS chars
  FROM words WINDOW o AS (PARTITION BY stem ORDER BY pos)
),
budget AS (SELECT * FROM spent WHERE rank = 1 OR (rank <= 120 AND chars <= 600))"""


@query
def edit_budget(spark: SparkSession, d: str) -> DataFrame:
    """Leading distinct words of each conversation within 120 words and 600 characters."""
    return _budget(spark, d).select("stem", "tag", "rank", "chars")


SQL["edit_budget"] = f"WITH {_BUDGET} SELECT stem, tag, CAST(rank AS INTEGER) AS rank, CAST(chars AS BIGINT) AS chars FROM budget"


@query
def edit_requests(spark: SparkSession, d: str) -> DataFrame:
    """Editor request per conversation: budgeted words and the last reply as draft."""
    listed = fusion.joined_in_order(_budget(spark, d), ["stem"], "rank", "tag", ", ")
    drafts = (
        table(spark, d, "conversations")
        .where(F.col("role") == "assistant")
        .groupBy(F.col("conv_id").alias("stem"))
        .agg(F.max_by("text", "turn").alias("draft"))
    )
    return listed.join(drafts, "stem").select(
        "stem", modeltext.edit_request(F.col("joined"), F.col("draft")).alias("request")
    )


SQL["edit_requests"] = f"""WITH {_BUDGET},
drafts AS (SELECT conv_id AS stem, arg_max(text, turn) AS draft FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT stem, 'Trusted source tags:' || chr(10) || string_agg(tag, ', ' ORDER BY rank) || chr(10) || chr(10) || 'Draft caption:'
  || chr(10) || any_value(draft) || chr(10) || chr(10) || 'Rewrite the draft as a natural-language training caption.' AS request
FROM budget JOIN drafts USING (stem) GROUP BY stem"""


# --- fusion -----------------------------------------------------------------


def _semantics(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    documents = table(spark, d, "documents").select("doc_id", "source", "lang")
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    none = F.lit(None).cast("array<string>")
    own = {
        "objects": F.array(F.col("source"), F.lit("Puppy")),
        "style": F.array(F.concat(F.col("lang"), F.lit("_style")), F.lit(None).cast("string")),
    }
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("stem"),
        F.when(quality & ~toxic, "digital_art")
        .when(quality & toxic, "photo")
        .when(toxic, "painting")
        .otherwise("unknown")
        .alias("content_type"),
        *[own.get(name, none).alias(name) for name in fusion.SEMANTIC_FIELDS],
    )


def _judge_lists(spark: SparkSession, d: str, fields: tuple[str, ...] = ("final_tags",)) -> DataFrame:
    """The judge's lists of every document of good quality, the same in each field."""
    asked = F.array(F.upper("source"), F.lit("nobody said this"), F.concat(F.lit("lang_"), F.col("lang")))
    return (
        table(spark, d, "documents").select("doc_id", "source", "lang")
        .join(table(spark, d, "labels").where(F.col("quality") == 1), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("stem"), F.posexplode(asked).alias("pos", "raw"))
        .select("stem", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), F.col("pos").cast("long").alias("pos"), "raw")
    )


@query
def tagging_results(spark: SparkSession, d: str) -> DataFrame:
    """Whole results of a job without open-set tags: one per document, judged, failed, bare or fallen back.

    Toxic documents are those that the judge failed on; German ones get no tag from any source.
    """
    documents = table(spark, d, "documents").select("doc_id", "source", "lang")
    none = F.array().cast("array<string>")
    requests = documents.select(
        F.col("doc_id").alias("stem"), F.when(F.col("lang") == "de", none).otherwise(F.array("source", "lang")).alias("context_tags")
    )
    replies = table(spark, d, "labels").join(documents, "doc_id").where("lang <> 'de'")
    semantics = replies.select(
        F.col("doc_id").alias("stem"), F.concat(F.lit("a text of "), F.col("source")).alias("caption"), F.lit("photo").alias("content_type"),
        *[(F.array("lang") if name == "scene" else F.lit(None).cast("array<string>")).alias(name) for name in fusion.SEMANTIC_FIELDS],
    )
    judged = _judge_lists(spark, d, fusion.JUDGED_FIELDS)
    errors = table(spark, d, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("stem"), F.lit(2).alias("stage_rank"), F.lit("qwen_prune").alias("stage"), F.lit("E").alias("error"), F.lit("T").alias("traceback")
    )
    fine = judged.join(errors.select("stem"), "stem", "left_anti")
    told = replies.where("toxic = 0 AND quality = 1").select(F.col("doc_id").alias("stem"), F.lit(" Judged. ").alias("caption"), F.lit("calm").alias("mood"))
    empty = requests.select("stem", none.alias("open_set_tags"))
    art = spark.sql("SELECT 0L AS stem, 0 AS group_rank, 0 AS pos, '' AS raw, '' AS namespace, 0D AS confidence WHERE false")
    fused = job.fuse(requests, empty, art, semantics, fine)
    rows = job.results(fused, requests, semantics, told, fine, errors, caption_backend="m", editor_backend="e")
    side = F.col("sidecar")
    return rows.select(
        "stem", F.array_join("tags", "|").alias("tags"), "caption", F.to_json(F.try_variant_get(side, "$.final", "variant")).alias("final"),
        F.to_json(F.try_variant_get(side, "$.semantic", "variant")).alias("semantic"),
        F.to_json(F.try_variant_get(side, "$.errors", "variant")).alias("errors"),
        F.try_variant_get(side, "$.tag_fallback", "string").alias("fallback"),
    )


SQL["tagging_results"] = """
WITH known AS (
  SELECT doc_id AS stem, source, lang, lang <> 'de' AS tagged, coalesce(toxic = 1, false) AS failed,
    quality IS NOT NULL AND lang <> 'de' AS semantic, coalesce(quality = 1 AND toxic = 0, false) AND lang <> 'de' AS fine
  FROM documents LEFT JOIN labels USING (doc_id)
),
listed AS (
  SELECT *, CASE WHEN NOT tagged THEN [] WHEN fine THEN [source, 'photo', lang] WHEN semantic THEN [source, lang, 'photo'] ELSE [source, lang] END AS tags,
    '":["' || source || '"],"' AS one
  FROM known
),
shown AS (
  SELECT *, CASE WHEN tagged THEN '["' || array_to_string(tags, '","') || '"]' ELSE '[]' END AS tags_json FROM listed
)
SELECT stem, array_to_string(tags, '|') AS tags, CASE WHEN fine THEN 'Judged.' WHEN semantic THEN 'a text of ' || source END AS caption,
  CASE WHEN failed THEN '{"error":"E","final_tags":' || tags_json || ',"note":"the judge failed; all merged tags are kept","traceback":"T"}'
    WHEN fine THEN '{"abstract_tags' || one || 'actions' || one || 'attributes' || one || 'booru' || one || 'caption":" Judged. ","characters' || one
      || 'composition' || one || 'final_tags":' || tags_json || ',"medium' || one || 'mood":"calm","objects' || one || 'scene' || one || 'style":["' || source || '"]}'
    ELSE '{"final_tags":' || tags_json || '}' END AS final,
  CASE WHEN semantic THEN '{"caption":"a text of ' || source || '","content_type":"photo","scene":["' || lang || '"]}' ELSE '{}' END AS semantic,
  CASE WHEN failed THEN '[{"error":"E","stage":"qwen_prune","traceback":"T"}]' ELSE '[]' END AS errors,
  CASE WHEN tagged AND NOT failed AND NOT fine THEN 'merged_model_outputs' END AS fallback
FROM shown"""


def _fused(spark: SparkSession, d: str) -> job.Fusion:
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang"))
    semantics = _semantics(spark, d)
    # An open-set model names each tag once.
    words = F.array_distinct(cut_words(F.lower("text")))
    labelled = _labelled(spark, d)
    art = predictions.route(
        predictions.select_labels(labelled, GENERAL_BAR, CHARACTER_BAR), predictions.rating(labelled)
    ).join(job.needs_art_tagger(semantics).select("stem"), "stem", "left_semi")
    judged = _judge_lists(spark, d)
    return job.fuse(
        requests=documents.select(
            F.col("doc_id").alias("stem"),
            F.array(F.col("source"), F.concat(F.lit("lang_"), F.col("lang"))).alias("context_tags"),
        ),
        open_set=documents.select(F.col("doc_id").alias("stem"), words.alias("open_set_tags")),
        art=art,
        semantics=semantics,
        judged=judged,
    )


@query
def tag_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Final tag list per document from context, words, labels and semantics."""
    return job.final_lists(_fused(spark, d).final).select(
        "stem", F.size("tags").alias("n_tags"), F.md5(F.array_join("tags", "|")).alias("tags_md5"), "fell_back"
    )


_FUSION = f"""{_LABELLED}, {_ROUTED},
sem AS (
  SELECT doc_id AS stem, source, lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'digital_art' WHEN quality = 1 THEN 'photo'
    WHEN toxic = 1 THEN 'painting' ELSE 'unknown' END AS content_type, quality
  FROM labels JOIN documents USING (doc_id)
),
words AS (
  SELECT doc_id AS stem, unnest(w) AS raw, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, string_split_regex(lower(text), '{BLANK}+') AS w FROM documents)
),
cands AS (
  SELECT stem, {sql_normal('raw')} AS tag, source, r, i,
    greatest(0.0e0, least(1.0e0, c)) * CASE
      WHEN source = 'metadata' THEN 0.88e0 WHEN source = 'ram++' THEN 0.9e0
      WHEN source = 'qwen' AND ns IN ('medium', 'style') THEN 0.95e0 WHEN source = 'qwen' THEN 0.82e0
      WHEN ns = 'booru' THEN 0.86e0 WHEN ns = 'characters' THEN 0.72e0 WHEN ns = 'rating' THEN 0.65e0 ELSE 0.76e0 END AS score
  FROM (
    SELECT doc_id AS stem, source AS raw, 'metadata' AS source, 'existing' AS ns, 0 AS r, 0 AS i, 0.92e0 AS c FROM documents
    UNION ALL SELECT doc_id, 'lang_' || lang, 'metadata', 'existing', 0, 1, 0.92e0 FROM documents
    UNION ALL SELECT stem, raw, 'ram++', 'objects', 1, i, 0.78e0 FROM words
    UNION ALL SELECT stem, raw, 'smilingwolf', namespace, 2 + group_rank, pos, confidence
      FROM routed SEMI JOIN (SELECT stem FROM sem WHERE content_type <> 'photo') s USING (stem)
    UNION ALL SELECT stem, content_type, 'qwen', 'medium', 10, 0, 0.82e0 FROM sem WHERE content_type <> 'unknown'
    UNION ALL SELECT stem, source, 'qwen', 'objects', 13, 0, 0.82e0 FROM sem
    UNION ALL SELECT stem, 'Puppy', 'qwen', 'objects', 13, 1, 0.82e0 FROM sem
    UNION ALL SELECT stem, lang || '_style', 'qwen', 'style', 14, 0, 0.82e0 FROM sem)
),
facts AS (
  SELECT stem, tag, max(score) AS score, min(r * 1000000 + i) AS first_pos FROM cands WHERE tag <> '' GROUP BY 1, 2
),
merged AS (
  SELECT *, row_number() OVER (PARTITION BY stem ORDER BY score DESC, first_pos) AS rank FROM facts QUALIFY rank <= 160
),
asked AS (
  SELECT doc_id AS stem, lower(source) AS tag, 0 AS i FROM documents UNION ALL SELECT doc_id, 'lang ' || lang, 2 FROM documents
),
kept AS (
  SELECT stem, tag, i FROM asked SEMI JOIN (SELECT doc_id AS stem FROM labels WHERE quality = 1) USING (stem)
  WHERE (stem, tag) IN (SELECT (stem, tag) FROM merged)
),
final AS (
  SELECT stem, tag, min(block * 100000000 + spot) AS place FROM (
    SELECT stem, tag, 0 AS block, i AS spot FROM kept
    UNION ALL SELECT stem, tag, 1, rank FROM merged WHERE stem NOT IN (SELECT stem FROM kept)
    UNION ALL SELECT stem, tag, 2, r * 1000000 + i FROM cands WHERE source = 'qwen' AND tag <> ''
    UNION ALL SELECT stem, tag, 3, r * 1000000 + i FROM cands WHERE source = 'ram++' AND tag <> '')
  GROUP BY 1, 2
)"""
SQL["tag_fusion"] = f"""WITH {_FUSION}
SELECT stem, CAST(count(*) AS INTEGER) AS n_tags, md5(string_agg(tag, '|' ORDER BY place)) AS tags_md5, min(place) >= 100000000 AS fell_back
FROM final GROUP BY stem"""


@query
def fused_source_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tags every source gave each document."""
    return _fused(spark, d).sources.groupBy("stem", "source").agg(F.count("*").alias("n_tags"))


SQL["fused_source_counts"] = f"""WITH {_FUSION}
SELECT stem, source, count(DISTINCT tag) AS n_tags FROM cands WHERE tag <> '' GROUP BY 1, 2"""
