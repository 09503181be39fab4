"""One registered query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .byte_codec import byte_codec
from .chat_format import assembled, chat_format
from .collocations import collocations
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mixing import mix_sources
from .ngram_join import ngram_join
from .piece_codec import piece_codec
from .quality import quality_rules
from .shared import whole_text
from .spelling import spelling_groups
from .suffix_dedup import suffix_dedup
from .token_count import token_count, word_pieces
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column: str):
    return F.sha2(F.encode(whole_text(column), "UTF-8"), 256)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy_no", "n_copies", "mix_key", _sha("text").alias("text_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = word_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count(_table(spark, sf_dir, "documents").select("doc_id", "text"), *pieces).select("doc_id", "n_words", "n_tokens")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(chat_format(_table(spark, sf_dir, "conversations")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed_lines", _sha("text").alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text_sha256", _sha("text"))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        _sha("decoded").alias("decoded_sha256"),
    )


def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_codec(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_mixing, op3_quality, op4_token_count, op5_chat_format, op6_line_dedup, op7_exact_dedup, op8_suffix_dedup, op9_toxicity,
        op10_piece_codec, op11_byte_codec, op12_spelling, op13_collocations,
    )
}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
