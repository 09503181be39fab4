"""Merging of retrieval traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_traces(traces: list[DataFrame], k: int = 5) -> DataFrame:
    """Traces (question_id, chunk_id, score, rank) merged: first sight of a chunk counts, best raw scores stay."""
    union = None
    for i, trace in enumerate(traces):
        part = trace.select("question_id", "chunk_id", "score", "rank").withColumn("trace", F.lit(i))
        union = part if union is None else union.unionByName(part)
    sight = F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy("trace", "rank"))
    first = union.withColumn("sight", sight).filter("sight = 1")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "trace", F.col("rank")))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= k).select("question_id", "chunk_id", "score", F.col("trace"), "place")


def reciprocal_rank_fusion(traces: list[DataFrame], k: int = 5, constant: int = 60) -> DataFrame:
    """Chunks by the sum of 1 / (constant + rank) over the traces that have them."""
    union = None
    for trace in traces:
        part = trace.select("question_id", "chunk_id", "rank")
        union = part if union is None else union.unionByName(part)
    scored = union.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("rrf"), "chunk_id"))
    return scored.withColumn("place", place.cast("long")).filter(F.col("place") <= k)
