"""Queries that read model replies and captions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import plugins
from tagweave.functions import modeltext
from tagweave.workload.tables import sql_strip, table

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    """Event properties wrapped as models tend to: fenced, in prose, or cut off."""
    turn = F.col("event_id") % 5
    props = F.col("props")
    reply = (
        F.when(turn == 0, F.concat(F.lit(" ```json\n"), props, F.lit("\n```")))
        .when(turn == 1, F.concat(F.lit("Sure: "), props, F.lit(" and that is all.")))
        .when(turn == 2, F.concat(F.lit("{ "), props))
        .when(turn == 3, F.concat(props, F.lit("]")))
        .otherwise(props)
    )
    record = modeltext.reply_record(reply)
    return table(spark, d, "events").select("event_id", record.alias("record")).select(
        "event_id",
        F.try_variant_get("record", "$.k", "long").alias("k"),
        F.coalesce(F.try_variant_get("record", "$.parse_error", "boolean"), F.lit(False)).alias("parse_error"),
        F.try_variant_get("record", "$.raw_text", "string").alias("raw_text"),
    )


SQL["extract_json"] = """
SELECT event_id,
  CASE WHEN event_id % 5 <> 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  event_id % 5 = 2 AS parse_error,
  CASE WHEN event_id % 5 = 2 THEN '{ ' || props END AS raw_text
FROM events"""


@query
def stored_replies(spark: SparkSession, d: str) -> DataFrame:
    """Reply records kept without the verbatim reply."""
    record = F.create_map(
        F.lit("caption"), F.col("event_type"), F.lit("_raw_response"), F.col("props"), F.lit("k"), F.col("props")
    )
    return table(spark, d, "events").select(
        "event_id", F.to_json(modeltext.without_raw_reply(record)).alias("stored")
    )


SQL["stored_replies"] = """
SELECT event_id, CAST(json_object('caption', event_type, 'k', props) AS VARCHAR) AS stored FROM events"""


@query
def clean_captions(spark: SparkSession, d: str) -> DataFrame:
    """Replies with labels, quotes and remarks around them."""
    turn = F.col("turn") % 4
    reply = (
        F.when(turn == 0, F.concat(F.lit('Corrected CAPTION:  "'), F.col("text"), F.lit('"\n\nI changed it.')))
        .when(turn == 1, F.concat(F.lit(" caption: Output: '"), F.col("text"), F.lit("' ")))
        .when(turn == 2, F.concat(F.lit("Output: Caption: "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return table(spark, d, "conversations").select(
        "conv_id", "turn", modeltext.clean_caption(reply).alias("caption")
    )


def _sql_first_paragraph(text: str) -> str:
    return sql_strip(f"split_part({text}, chr(10) || chr(10), 1)")


def _sql_unquoted(text: str) -> str:
    return sql_strip(f"trim(trim({text}, '\"'), '''')")


SQL["clean_captions"] = f"""
WITH replies AS (
  SELECT conv_id, turn, CASE turn % 4
    WHEN 0 THEN '"' || text || '"' || chr(10) || chr(10) || 'I changed it.'
    WHEN 1 THEN '''' || text || ''' ' WHEN 2 THEN 'Caption: ' || text ELSE text END AS reply
  FROM conversations
)
SELECT conv_id, turn, {_sql_unquoted(_sql_first_paragraph(sql_strip('reply')))} AS caption FROM replies"""


def _captions(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: the first reply as semantic caption, the last as judged one."""
    said = F.col("role") == "assistant"
    return (
        table(spark, d, "conversations")
        .groupBy("conv_id")
        .agg(
            F.min_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))).alias("semantic"),
            F.max_by(F.when(said, F.col("text")), F.when(said & (F.col("turn") > 2), F.col("turn"))).alias("judged"),
            F.count("*").alias("n_turns"),
        )
        .withColumn("judged", F.when(F.col("n_turns") == 4, F.lit("  \n")).otherwise(F.col("judged")))
    )


_CAPTIONS = """
captions AS (
  SELECT conv_id, semantic, CASE WHEN n_turns = 4 THEN NULL ELSE judged END AS judged, n_turns FROM (
    SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS semantic,
      arg_max(text, turn) FILTER (role = 'assistant' AND turn > 2) AS judged, count(*) AS n_turns
    FROM conversations GROUP BY conv_id)
)"""


@query
def final_captions(spark: SparkSession, d: str) -> DataFrame:
    """Judged caption, else the semantic one; the draft and the stored provenance."""
    final = modeltext.final_caption(F.col("judged"), F.col("semantic"))
    draft = modeltext.draft_caption(F.col("semantic"), final)
    block = modeltext.captioning_block(
        final, draft, F.lit("vision-model"), F.when(F.col("n_turns") > 2, "editor-model")
    )
    return _captions(spark, d).select(
        "conv_id", final.alias("caption"), draft.alias("draft"), F.to_json(block).alias("captioning")
    )


SQL["final_captions"] = f"""WITH {_CAPTIONS},
final AS (
  SELECT *, coalesce(nullif({sql_strip('judged')}, ''), nullif({sql_strip('semantic')}, '')) AS caption FROM captions
)
SELECT conv_id, caption, coalesce(semantic, caption) AS draft, CASE WHEN caption IS NOT NULL THEN
    '{{"draft_caption":' || to_json(coalesce(semantic, caption)) || ',"caption":' || to_json(caption)
    || ',"caption_backend":"vision-model"' || CASE WHEN n_turns > 2 THEN ',"editor_backend":"editor-model"' ELSE '' END
    || '}}' END AS captioning
FROM final"""


def _captioner(turns: DataFrame, first: int) -> Callable[[DataFrame], DataFrame]:
    """A tagger that says what the assistant said from a turn on, in one of three turns, with the role and turn as tags."""
    said = turns.where((F.col("role") == "assistant") & (F.col("turn") % 6 == first)).groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("caption"), F.collect_set(F.concat("role", F.lit(" "), F.col("turn").cast("string"))).alias("told")
    )

    def run(requests: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        answers = requests.join(said.select(F.col("conv_id").cast("string").alias("stem"), "caption", "told"), "stem", "left")
        return answers.select(
            "stem", F.array_sort(F.concat(F.col("context_tags"), F.coalesce("told", F.array().cast("array<string>")))).alias("tags"), "caption",
            none.alias("draft_caption"), F.lit(f"captioner {first}").alias("caption_backend"), none.alias("editor_backend"),
            F.lit(None).cast("struct<stage:string,error:string,traceback:string>").alias("error"),
        )

    return run


@query
def several_captioners(spark: SparkSession, d: str) -> DataFrame:
    """Three captioners on every conversation: all their tags in order, the last caption given with its origin."""
    turns = table(spark, d, "conversations")
    requests = turns.groupBy(F.col("conv_id").cast("string").alias("stem")).agg(F.array(F.min("role")).alias("context_tags"))
    requests = requests.withColumn("image_path", F.lit("x"))
    told = plugins.composite([_captioner(turns, first) for first in (1, 3, 5)])(requests)
    return told.select("stem", F.array_join("tags", "|").alias("tags"), "caption", F.when(F.col("caption").isNotNull(), F.col("caption_backend")).alias("backend"))


SQL["several_captioners"] = """
WITH said AS (
  SELECT conv_id, turn % 6 AS captioner, arg_max(text, turn) AS caption, list(DISTINCT role || ' ' || turn) AS told
  FROM conversations WHERE role = 'assistant' AND turn % 6 IN (1, 3, 5) GROUP BY 1, 2
),
stems AS (SELECT conv_id, min(role) AS context FROM conversations GROUP BY 1),
lists AS (
  SELECT s.conv_id, c.captioner, a.caption, list_sort(list_append(coalesce(a.told, []), s.context)) AS tags
  FROM stems s CROSS JOIN (SELECT unnest([1, 3, 5]) AS captioner) c LEFT JOIN said a ON a.conv_id = s.conv_id AND a.captioner = c.captioner
),
places AS (
  SELECT conv_id, tag, min(captioner * 100000 + place) AS first_place
  FROM (SELECT conv_id, captioner, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM lists) GROUP BY 1, 2
),
joined AS (SELECT conv_id, string_agg(tag, '|' ORDER BY first_place) AS tags FROM places GROUP BY 1),
last AS (
  SELECT conv_id, arg_max(caption, captioner) FILTER (caption IS NOT NULL) AS caption, max(captioner) FILTER (caption IS NOT NULL) AS captioner
  FROM lists GROUP BY 1
)
SELECT CAST(j.conv_id AS VARCHAR) AS stem, j.tags, l.caption, 'captioner ' || l.captioner AS backend FROM joined j JOIN last l USING (conv_id)"""


@query
def last_captions(spark: SparkSession, d: str) -> DataFrame:
    """Of several captioners, turn by turn, the last one that said anything wins."""
    told = F.when(F.col("role") == "assistant", F.col("turn"))
    caption = F.struct("text", "role")
    return (
        table(spark, d, "conversations")
        .groupBy("conv_id")
        .agg(F.max_by(caption, told).alias("told"))
        .select("conv_id", "told.*")
    )


SQL["last_captions"] = """
SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS text,
  max(role) FILTER (role = 'assistant') AS role
FROM conversations GROUP BY conv_id"""
