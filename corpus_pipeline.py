"""Corpus pipeline: language, lines, near copies, mix, pieces; each stage reads what the one before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``docs``. Stages read text, lang, source and doc_id; other columns pass through.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import language_id, line_dedup, mixing, near_dedup, pieces
from tagweave.llm.common import shared_folder, stored, table, with_package
from tagweave.llm.queries import PIECE_MODEL

#: Below this share of its main language a text has none.
LEAST_SHARE = 0.5


def with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` out of the struct ``row``, with the text replaced."""
    return rows.select(*[F.col(text).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a main language; null texts, texts without letters and even mixtures go.

    The model is learned from all labelled documents of the stage's input. If that gives no language, as where ``lang``
    is null throughout, every document with a letter stays.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them. Documents stay, if need be without text.

    A null or empty text becomes an empty one. Rows of one id count as one document, rows of a null id lose nothing; repeated rows stay.
    """
    return with_text(docs, line_dedup.dedup_lines(docs), "kept")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies on five-word shingles at 0.8; rows without words stay.

    Rows are judged one by one, by a number written with the table: a null or repeated ``doc_id`` ties nothing together.
    The row of the smallest id stays (null last), of several such rows the one of the smallest text hash.
    """
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")))
    found = near_dedup.components(numbered, doc="number", text="row.text", number="number", width=5, percent=80)
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row.text"), "number")
    named = found.select(F.col("doc").alias("number"), "component_id").join(numbered.select("number", order.alias("order")), "number")
    stays = named.groupBy("component_id").agg(F.min("order").alias("first")).select("first.number")
    return numbered.join(stays, "number", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it; where a source's last pass is cut, with the words taken.

    Rows without words are never taken. A null source is a source. Rows of a null or repeated id, and repeated rows, are each drawn on their own.
    """
    sized = docs.select(F.struct("*").alias("all"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sized).where("taken > 0")
    text = F.col("row.all.text")
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("taken") == F.col("size"), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), ""))
    return mixed.select(*[cut.alias(c) if c == "text" else F.col(f"row.all.`{c}`").alias(c) for c in docs.columns])


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text that they decode to; none and empty for null and empty texts, repeated rows each."""
    return pieces.encode_pieces(docs.select("doc_id", "source", "text"), PIECE_MODEL).select(
        "row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded"
    )


def _ready(stage):
    """The stage, run with workers that find the package."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with_package(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language", _ready(keep_known_languages)),
    ("lines", _ready(drop_common_lines)),
    ("near_copies", _ready(keep_one_of_near_copies)),
    ("mix", _ready(mix_sources)),
    ("pieces", _ready(encode_text)),
]

#: A mix by seeded hashes and a tokenizer's ids cannot be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
