"""Okapi BM25 over sections: an index in shards of sections, and all questions answered by each shard for itself.

A shard holds the postings of a bounded number of words' worth of sections, as arrays in one row. It is made where the
sections are read, without a shuffle; only document frequencies are summed over shards. A batch of questions is sent
to the shards, each scores its sections by array operations and hands back its ``k`` best of a question, and only
those meet. Scores are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ws_tokens
from ..session import ship, stored

# The ranking's constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
KEY = ["doc_id", "section_pos"]
#: Words of a shard (below a megabyte); a task makes shards of its own rows, the last may be smaller.
SHARD_WORDS = 100_000
#: (question, word) rows that are broadcast at a time; more go through in blocks of questions.
ASKED_ROWS = 200_000
DIGITS = 9
#: Java's Unicode white space.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@dataclass
class Bm25Index:
    """shards, terms(term, df, idf) and stats(n, mean_length).

    A shard's row: keys of its sections in order, their number ``n`` and ``words``, its terms, how many of its sections
    have each (``df``), and packed (32-bit numbers, compressed): the sections' lengths, and for each term in turn those
    sections and how often they have it.
    """

    shards: DataFrame
    terms: DataFrame
    stats: DataFrame


def _tokens(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all rows in order, as ``ws_tokens`` has them, and the row of each.

    Arrow splits at Unicode white space too, but also at four separators (U+001C to U+001F): texts that have one go by
    a regular expression.
    """
    if pc.any(pc.match_substring_regex(lowered, "[\x1c-\x1f]")).as_py():
        lists = pa.array([SPACE.split(text) for text in lowered.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(lowered)
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    filled = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(filled), np.repeat(np.arange(len(lists)), lengths)[filled.to_numpy(zero_copy_only=False)]


def _shard(held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    keys = pa.Table.from_batches([k for k, _, _ in held])
    n, before = keys.num_rows, np.cumsum([0] + [k.num_rows for k, _, _ in held])
    order = pc.sort_indices(keys, [(c, "ascending") for c in KEY])
    place = np.empty(n, np.int64)
    place[order.to_numpy()] = np.arange(n)
    section = place[np.concatenate([rows + first for (_, _, rows), first in zip(held, before)])]
    coded = pc.dictionary_encode(pa.concat_arrays([w for _, w, _ in held]))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, tf = np.unique(code * n + section, return_counts=True)
    df = np.bincount(pair // max(n, 1), minlength=len(coded.dictionary)).astype(np.int32)
    packed = _packed(np.concatenate([np.bincount(section, minlength=n), pair % max(n, 1), tf]))
    lists = [*(keys.column(c).take(order).combine_chunks() for c in KEY), coded.dictionary, pa.array(df)]
    ids, positions, terms, dfs = (pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)
    return pa.RecordBatch.from_arrays([ids, positions, pa.array([n], pa.int32()), pa.array([len(section)], pa.int64()), terms, dfs, pa.array([packed], pa.binary())], schema=schema)


def _packed(numbers: np.ndarray) -> bytes:
    raw = numbers.astype("<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), "<i4")


def build(sections: DataFrame) -> Bm25Index:
    """The index of ``sections(doc_id, section_pos, content)``, read once."""
    ship(sections.sparkSession)
    lowered = sections.select(*KEY, F.coalesce(F.lower("content"), F.lit("")).alias("lowered"))
    kinds = [kind for _, kind in lowered.dtypes[:2]]
    form = f"{KEY[0]} array<{kinds[0]}>, {KEY[1]} array<{kinds[1]}>, n int, words bigint, terms array<string>, df array<int>, postings binary"

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        lists = {KEY[0]: types[kinds[0]], KEY[1]: types[kinds[1]], "terms": pa.string(), "df": pa.int32()}
        plain = {"n": pa.int32(), "words": pa.int64(), "postings": pa.binary()}
        schema = pa.schema([(c, plain[c] if c in plain else pa.list_(lists[c])) for c in (*KEY, "n", "words", "terms", "df", "postings")])
        held, size = [], 0
        for batch in batches:
            held.append((batch.select(KEY), *_tokens(batch.column(2))))
            size += len(held[-1][1])
            if size >= SHARD_WORDS:
                yield _shard(held, schema)
                held, size = [], 0
        if sum(k.num_rows for k, _, _ in held):
            yield _shard(held, schema)

    if any(k not in ("int", "bigint", "string") for k in kinds):
        raise TypeError(f"keys must be int, bigint or string, not {kinds}")
    shards = stored(lowered.mapInArrow(sharded, form))
    stats = stored(shards.agg(F.sum("n").cast("long").alias("n"), (F.sum("words").cast("double") / F.sum("n")).alias("mean_length")))
    return Bm25Index(shards, stored(term_stats(shards, stats)), stats)


def term_stats(shards: DataFrame, stats: DataFrame) -> DataFrame:
    """Document frequency and idf; a negative idf becomes EPSILON times the mean idf."""
    df = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean_idf"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def save(index: Bm25Index, path: str) -> None:
    for name in ("shards", "terms", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in ("shards", "terms", "stats")))


def query_terms(questions: DataFrame) -> DataFrame:
    """Terms of each question with their repeats."""
    return questions.select("question_id", F.explode(ws_tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


class Asked:
    """A block of questions: numbered, with the numbers and weights of their terms."""

    def __init__(self, questions: list[int], terms: list[str], weights: list[float]):
        self.terms = sorted(set(terms))
        number = {t: i for i, t in enumerate(self.terms)}
        self.of: dict[int, list[tuple[int, float]]] = {}
        for q, t, w in zip(questions, terms, weights):
            self.of.setdefault(q, []).append((number[t], w))

    def scored(self, shard: dict, mean_length: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(question, scores of all sections, whether they share a term) for one shard."""
        n, df = shard["n"], shard["df"]
        numbers = _unpacked(shard["postings"])
        base = K1 * (1 - B + B * numbers[:n] / mean_length) if n else np.zeros(0)
        ends = np.cumsum(df)
        rows, tf = numbers[n : n + ends[-1]] if len(df) else numbers[:0], numbers[n + ends[-1] :] if len(df) else numbers[:0]
        place = pc.index_in(pa.array(self.terms, pa.string()), shard["terms"]).to_pylist()
        impacts = {}
        for term, at in enumerate(place):
            if at is not None:
                of = slice(int(ends[at - 1]) if at else 0, int(ends[at]))
                impacts[term] = rows[of], tf[of] * (K1 + 1) / (tf[of] + base[rows[of]])
        for question, weighted in self.of.items():
            score, met = np.zeros(n), np.zeros(n, bool)
            for term, weight in weighted:
                if term in impacts:
                    at, impact = impacts[term]
                    score[at] += weight * impact
                    met[at] = True
            yield question, np.round(score, DIGITS), met


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, the first of equals."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.nonzero(score > least)[0]
    return np.concatenate([above, np.nonzero(score == least)[0][: k - len(above)]])


def _answered(index: Bm25Index, questions: DataFrame, k: int | None) -> DataFrame:
    """question_id, doc_id, section_pos, score: each shard's ``k`` best of a question, or all that share a term."""
    spark = questions.sparkSession
    ship(spark)
    # Questions are numbered by a hash of their ids, so that ids of any type can be sent; every question has a row.
    ids = questions.select("question_id").distinct().withColumn("number", F.xxhash64("question_id"))
    weighted = query_terms(questions).join(index.terms, "term").select("question_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    asked = stored(ids.join(weighted, "question_id", "left").select("number", F.coalesce("term", F.lit("")).alias("term"), F.coalesce("weight", F.lit(0.0)).alias("weight")))
    blocks = max(1, -(-asked.count() // ASKED_ROWS))
    row = index.stats.first()
    mean_length = float(row["mean_length"] or 0.0) if row else 0.0
    kinds = [index.shards.schema[c].dataType.elementType.simpleString() for c in KEY]
    found = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod("number", F.lit(blocks)) == i)
        table = block.toArrow()
        sent = spark.sparkContext.broadcast(Asked(*(c.to_pylist() for c in table.columns)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in range(batch.num_rows):
                    one = batch.slice(j, 1)
                    keys = [one.column(c).flatten() for c in KEY]
                    shard = {c: one.column(c)[0].as_py() for c in ("n", "postings")} | {"terms": one.column("terms").flatten(), "df": one.column("df").flatten().to_numpy()}
                    parts: tuple[list, list, list] = ([], [], [])
                    for question, score, met in sent.value.scored(shard, mean_length):
                        at = np.nonzero(met)[0] if k is None else best(score, k)
                        parts[0].append(np.full(len(at), question)), parts[1].append(at), parts[2].append(score[at])
                    if parts[0]:
                        numbers, at, score = (np.concatenate(p) for p in parts)
                        taken = [values.take(pa.array(at)) for values in keys]
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *taken, pa.array(score, pa.float64())], ["number", *KEY, "score"])

        one = index.shards.select(*KEY, "n", "terms", "df", "postings").mapInArrow(scan, f"number long, doc_id {kinds[0]}, section_pos {kinds[1]}, score double")
        found = one if found is None else found.unionByName(one)
    return found.join(ids, "number").select("question_id", *KEY, "score")


def scores(index: Bm25Index, questions: DataFrame) -> DataFrame:
    """question_id, doc_id, section_pos, score for all chunks that share a term."""
    return _answered(index, questions, None)


def top_k(index: Bm25Index, questions: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` chunks of each question, ties by position; chunks without a shared term score 0."""
    by = Window.partitionBy("question_id").orderBy(F.desc("score"), *KEY)
    ranked = _answered(index, questions, k).withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= k)
    return ranked.withColumn("chunk_id", F.concat_ws("::", *KEY))
