"""A training corpus from raw documents: quality rules, line dedup, near-duplicate removal, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.line_dedup import line_dedup
from lexmill.llm.mixing import mix_sources
from lexmill.llm.ngram_join import ngram_join
from lexmill.llm.piece_codec import piece_codec
from lexmill.llm.quality import quality_rules
from lexmill.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled rule reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; no document does. ``n_chars`` is counted anew. Copies count as one place of a line, since
    the next stage is to keep one of them whole."""
    cleaned = line_dedup(docs, around=24).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 on five-word shingles one row stays: the least id, null last, and the
    least hash of the text. Texts without words are in no group and stay."""
    first = ngram_join(docs, width=5, percent=80, firsts=True).filter("is_first")
    # Rows repeated with id and text are few, and only they are shuffled again.
    again = first.filter("n_same > 1 and n_shingles > 0").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    return first.filter("n_same = 1 or n_shingles = 0").select(*COLUMNS).unionByName(again.select("doc_id", "text", "row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the square-root mixture of sources, globally shuffled."""
    return mix_sources(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each repetition, and whether decoding gives the text back."""
    import public_tokenizers

    coded = piece_codec(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]

#: The join's components and the encoding are beyond SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
