"""Retrieval metrics with hierarchical id matching."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import strip_namespace
from ..session import ship, stored

#: Expected ids (repeats included) of a question that are held in an array.
HELD_IDS = 1000
#: Bytes of texts whose runs of words are hashed together.
RUN_BYTES = 4_000_000
#: Odd factor of the hashes of runs.
RUN_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def matched(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """``retrieved`` with ``hit``: the first expected id that is the chunk id or a ``::``-prefix of it.

    Prefixes are tried in turn: the raw id's longest first, then those of the id without its namespace. A question's
    expected ids come to its rows as an array; those of more than HELD_IDS are met by an equi-join on the prefixes.
    """

    many = stored(expected.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HELD_IDS).select("question_id"))
    if many.isEmpty():
        return held(retrieved, expected)
    few = held(retrieved.join(many, "question_id", "left_anti"), expected.join(many, "question_id", "left_anti")).select(*retrieved.columns, "hit")
    rest = retrieved.join(many, "question_id", "left_semi")
    tried = F.concat(prefixes(F.col("chunk_id")), prefixes(strip_namespace(F.col("chunk_id"))))
    candidates = rest.select("question_id", "rank", "chunk_id", F.posexplode(tried).alias("at", "candidate"))
    first = (
        candidates.join(expected.select("question_id", F.col("expected_id").alias("candidate")).distinct(), ["question_id", "candidate"])
        .groupBy("question_id", "rank", "chunk_id")
        .agg(F.min_by("candidate", "at").alias("hit"))
    )
    return few.unionByName(rest.join(first, ["question_id", "rank", "chunk_id"], "left").select(*retrieved.columns, "hit"))


def prefixes(column: Column) -> Column:
    """The id and what stands before each ``::`` in it, longest first; of three colons in a row two pairs are tried."""
    parts = F.split(column, "::")

    def ends(n):
        whole = F.array_join(F.slice(parts, 1, n), "::")
        return F.when(F.startswith(column, F.concat(whole, F.lit(":::"))), F.array(F.concat(whole, F.lit(":")), whole)).otherwise(F.array(whole))

    return F.flatten(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), ends))


def held(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """``retrieved`` with ``hit``: the longest of the question's expected ids, which are few, that stands before its id."""
    by_length = F.sort_array(F.collect_set(F.struct(F.length("expected_id").alias("n"), "expected_id")), asc=False)
    ids = expected.filter("expected_id is not null").groupBy("question_id").agg(by_length["expected_id"].alias("_ids"))
    rows = retrieved.join(ids, "question_id", "left").withColumn("_bare", strip_namespace(F.col("chunk_id")))

    def longest(column):
        return F.get(F.filter("_ids", lambda x: (column == x) | F.startswith(column, F.concat(x, F.lit("::")))), F.lit(0))

    return rows.select(*retrieved.columns, F.coalesce(longest(F.col("chunk_id")), longest(F.col("_bare"))).alias("hit"))


def runs(frame: DataFrame, text: str, width: int, at: int | None = None, least: int = 0) -> DataFrame:
    """A row for each run of ``width`` words in ``text``: the other columns and ``h``, a hash. Only the run ``at``, of texts of ``least`` words, where given.

    Words are what ASCII white space parts, so bytes decide.
    """
    ship(frame.sparkSession)
    others = [c for c in frame.columns if c != text]
    form = StructType([*(frame.schema[c] for c in others), StructField("h", LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(others)), "")
            part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // RUN_BYTES
            cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                row, place, h, words = text_runs(texts.slice(start, end - start), width)
                wanted = (words >= least) & (True if at is None else place == at)
                taken = pa.array(row[wanted] + start)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in others), pa.array(h[wanted])], [*others, "h"])

    return frame.select(*others, text).mapInArrow(hashed, form)


def text_runs(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``width`` words: its text's number, its place there, its hash, and how many words the text has."""
    lists = pc.ascii_split_whitespace(texts)
    words, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    filled = pc.not_equal(pc.binary_length(words), 0)
    row, coded = row[filled.to_numpy(zero_copy_only=False)], pc.dictionary_encode(words.filter(filled).cast(pa.binary()))
    of = np.fromiter(map(zlib.crc32, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
    n = max(len(row) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * RUN_FACTOR + of[k : k + n]
    lengths = np.bincount(row, minlength=len(lists))
    whole = row[:n] == row[width - 1 : width - 1 + n]
    first, row = (np.cumsum(lengths) - lengths)[row[:n][whole]], row[:n][whole]
    return row, np.arange(n)[whole] - first, h[whole].view(np.int64), lengths[row]


def containing(docs: DataFrame, questions: DataFrame, width: int = 4) -> DataFrame:
    """(question_id, doc_id) where a document's text holds a question's.

    A question's second to fifth words stand whole in any text that holds it, so their hash finds candidates by an
    equi-join with the hashes of all runs of four words; questions of fewer than six words are compared with every text.
    """
    texts = questions.select("question_id", "question").distinct()
    asked = stored(runs(texts.withColumn("text", F.col("question")), "text", width, at=1, least=width + 2))
    # Hashes meet before texts do: only the texts of candidates are looked at.
    met = stored(runs(docs.select("doc_id", "text"), "text", width).join(asked.select("question_id", "h"), "h").select("question_id", "doc_id").distinct())
    held = docs.select("doc_id", "text").join(met, "doc_id").join(asked.select("question_id", "question"), "question_id")
    found = held.filter(F.contains("text", F.col("question"))).select("question_id", "doc_id")
    short = stored(texts.join(asked, ["question_id", "question"], "left_anti"))
    if not short.isEmpty():
        found = found.unionByName(docs.join(short, F.contains("text", F.col("question"))).select("question_id", "doc_id"))
    return stored(found.distinct())  # texts are searched once


def metrics(retrieved: DataFrame, expected: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Recall, precision, hit, MRR and NDCG at ``k`` for every question; unlabelled ones score 0."""
    hits = matched(retrieved, expected)
    again = F.row_number().over(Window.partitionBy("question_id", "hit").orderBy("rank"))
    hits = hits.withColumn("first", F.col("hit").isNotNull() & (again == 1))
    in_k = F.col("rank") <= k
    per = hits.groupBy("question_id").agg(
        F.countDistinct(F.when(in_k, F.col("hit"))).alias("found"),
        F.count_if(in_k & F.col("hit").isNotNull()).alias("good"),
        F.count(F.lit(1)).alias("retrieved"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first_rank"),
        F.sum(F.when(in_k & F.col("first"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    wanted = expected.groupBy("question_id").agg(F.countDistinct("expected_id").alias("expected"))
    joined = questions.select("question_id").join(per, "question_id", "left").join(wanted, "question_id", "left").fillna(0)
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("expected"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0)
    )
    labelled = F.col("expected") > 0

    def rate(value):
        return F.round(F.coalesce(F.when(labelled, value), F.lit(0.0)), 6)

    return joined.select(
        "question_id",
        rate(F.try_divide("found", "expected")).alias("recall"),
        rate(F.try_divide("good", F.least(F.lit(k), F.col("retrieved")))).alias("precision"),
        F.when(labelled & (F.col("good") > 0), 1).otherwise(0).alias("hit"),
        rate(F.try_divide(F.lit(1.0), F.nullif("first_rank", F.lit(0)))).alias("mrr"),
        rate(F.col("dcg") / ideal).alias("ndcg"),
    )


def summary(per_question: DataFrame, digits: int = 4) -> DataFrame:
    """Means over all questions."""
    return per_question.agg(
        F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(F.col(c).cast("double")), digits).alias(c) for c in ("recall", "precision", "hit", "mrr", "ndcg")]
    )
