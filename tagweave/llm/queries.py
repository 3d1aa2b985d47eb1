"""Registered queries of the operators, with SQL where SQL can state them."""

from __future__ import annotations

from functools import wraps


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import collocations, contamination, infilling, language_id, line_dedup, mixing, near_dedup, pieces, quality, token_files, url_filters, vector_search, warc
from tagweave.llm.common import shared_folder, table, with_package

QUERIES = {}
SQL = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [
    url_filters.Rule("allow", "org/"),
    url_filters.Rule("block", "example.org/es/"),
    url_filters.Rule("block", "example.org/en/1"),
    url_filters.Rule("allow", "com/fr/"),
    url_filters.Rule("block", "com/de/"),
]


def query(function):
    @wraps(function)
    def run(spark: SparkSession, d: str) -> DataFrame:
        with_package(spark)
        return function(spark, d)

    QUERIES[function.__name__] = run
    return run


@query
def op1_mix(spark: SparkSession, d: str) -> DataFrame:
    """Words that a mix at weights 5, 2, 1 takes of every document."""
    docs = table(spark, d, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.groupBy("number", "row.doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("number")


@query
def op3_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the lines that five or more of them share."""
    kept = line_dedup.dedup_lines(table(spark, d, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op3_lines"] = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
common AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT l.doc_id, pos, line, holder IS NOT NULL AND l.doc_id <> holder AS dropped FROM lines l LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op6_captures(spark: SparkSession, d: str) -> DataFrame:
    """Pages written to archives, read back and placed in the merged capture index."""
    pages = table(spark, d, "pages")
    instant = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("page_id", F.lit(31_536_000)))
    time = F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    index = warc.write_archives(pages, shared_folder(spark), time=time)
    records = warc.read_archives(spark, index)
    histories = warc.capture_histories(index).select("archive", "offset", "part", "place", "capture")
    facts = warc.payload_facts(records).join(histories, ["archive", "offset"])
    return facts.select(
        F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to",
        F.col("part").alias("history_part"), F.col("place").alias("history_place"),
    )


@query
def op7_token_files(spark: SparkSession, d: str) -> DataFrame:
    """Token ids written to framed files and read back."""
    folder = shared_folder(spark)
    tokenizer = WORD_TOKENIZER
    docs = table(spark, d, "documents")
    shards = token_files.write_token_files(docs, folder, lambda: token_files.word_encoder(tokenizer).encode, end_id=1)
    return token_files.read_token_files(spark, folder, shards).select(
        F.col("doc").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents encoded to pieces and decoded again."""
    coded = pieces.encode_pieces(table(spark, d, "documents"), PIECE_MODEL)
    return coded.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_urls(spark: SparkSession, d: str) -> DataFrame:
    """Every URL judged by rule, else by whether its host is listed."""
    judged = url_filters.judge_urls(table(spark, d, "pages"), URL_RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


SQL["op9_urls"] = r"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM parsed
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bool_or(coalesce(rule IN ('example.org/en/1', 'example.org/es/', 'com/de/'), false)) OVER (PARTITION BY host) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled"""


@query
def op10_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector."""
    return vector_search.top_k(table(spark, d, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


SQL["op10_top_k"] = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 10"""


@query
def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    """Base counts and verdict by divergence of every document."""
    rated = quality.rate(table(spark, d, "documents").select("doc_id", "text", "lang"), with_text=False)
    return rated.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


def held_out(doc: str):
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % 3 == 1, F.lit(False))


@query
def op5_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    found = language_id.identify(docs.select("doc_id", "text"), model, with_text=False)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@query
def op2_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    found = near_dedup.components(table(spark, d, "documents"), width=4, percent=80)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op11_infilling(spark: SparkSession, d: str) -> DataFrame:
    """Every document rearranged for fill-in-middle, and put together again."""
    turned = infilling.fill_in_middle(table(spark, d, "documents").select("doc_id", "text"))
    back = infilling.restored(turned)
    return back.select(
        "row.row.doc_id", "row.n", "row.form", "row.prefix_chars", "row.middle_chars",
        F.sha2("row.output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


SQL["op11_infilling"] = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
numbered AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
),
cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
),
parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""


@query
def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return collocations.collocations(table(spark, d, "documents").select("text", "lang"))


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
    repeat(chr(10), 9) || ' '), chr(10))) AS piece FROM documents
),
split AS (
  SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS words FROM pieces
),
places AS (
  SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM split WHERE len(words) > 0
),
counts AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL
),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM counts WHERE k > 1 AND f >= 100),
cuts AS (
  SELECT lang, phrase, words, a, unnest(generate_series(1, k - 1)) AS cut, k FROM candidates
),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, t.n,
    (1000 * CAST(c.a AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1 : c.k], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')
      AND 100 * c.a >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000"""


@query
def op12_contamination(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document lies in ten-word windows of benchmark items."""
    found = contamination.contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op12_contamination"] = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS number, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
),
item_places AS (
  SELECT item_id, words, least(10, len(words)) AS size, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS i
  FROM item_words WHERE len(words) > 0
),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS win FROM item_places),
doc_places AS (
  SELECT number, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i
  FROM doc_words, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
),
found AS (
  SELECT p.number, p.i, p.size, w.item_id
  FROM (SELECT number, i, size, array_to_string(words[i : i + size - 1], ' ') AS win FROM doc_places) p JOIN windows w USING (size, win)
),
hits AS (
  SELECT number, count(DISTINCT place) AS n_hit FROM (SELECT number, unnest(generate_series(i, i + size - 1)) AS place FROM found) GROUP BY number
),
named AS (
  SELECT number, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items
  FROM (SELECT DISTINCT number, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY number
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (number) LEFT JOIN named USING (number)"""
