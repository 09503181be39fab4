"""A hierarchy of summaries over embedded texts: a two-level quantiser makes clusters, a provider their summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from . import generation
from .provider import STUB, Provider

#: Vectors of a cell, which is clustered in one task; larger cells are split by FAN of their own vectors.
CELL, FAN = 2000, 16
#: Vectors of a part of a large cell that are dealt to its seeds together.
PART = 20_000
# Members of a cluster on average, rounds, least number of summaries for a second level.
MEMBERS, ROUNDS, SECOND_FROM = 5, 15, 10
BETWEEN = "\n\n---\n\n"


def _units(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def fine_clusters(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Cosine k-means of unit vectors from evenly spaced ones; the first of equal centroids wins, empty ones stay."""
    if len(x) <= k:
        return np.arange(len(x))
    centroids, found = x[np.linspace(0, len(x) - 1, k, dtype=int)].copy(), np.zeros(len(x), int)
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        if np.array_equal(nearest, found):
            break
        found = nearest
        sums = np.zeros_like(centroids)
        np.add.at(sums, found, x)
        count = np.bincount(found, minlength=k)
        mean = sums[count > 0] / count[count > 0, None]
        centroids[count > 0] = mean / (np.linalg.norm(mean, axis=1, keepdims=True) + 1e-8)
    return found


def _clustered(rows: pa.Table) -> pa.Table:
    order = [tuple(p.values()) for p in rows.column("pos").to_pylist()]
    rows = rows.take(sorted(range(len(order)), key=order.__getitem__))
    cluster = fine_clusters(_units(rows.column("embedding")), max(1, rows.num_rows // MEMBERS))
    return pa.table({"vec_id": rows.column("vec_id"), "cell": rows.column("cell"), "cluster": pa.array(cluster, pa.int32())})


def _dealt(rows: pa.Table, seeds: pa.Table) -> pa.Table:
    """The nearest seed of each vector; seeds in order of their number."""
    seeds = seeds.sort_by("seed")
    nearest = (_units(rows.column("embedding")) @ _units(seeds.column("vector")).T).argmax(axis=1)
    return pa.table({"vec_id": rows.column("vec_id"), "nearest": pa.array(nearest, pa.int32())})


def cells(vectors: DataFrame, limit: int = CELL, fan: int = FAN) -> DataFrame:
    """``vectors(vec_id, pos, embedding)`` with ``cell``: parts of at most ``limit`` vectors that lie near each other.

    All are one cell at first. A larger cell is split by ``fan`` of its own vectors, chosen by a hash; if they leave it in one
    piece, as equal vectors do, by a hash of the ids. Seeds are a table; parts of a cell are dealt by many tasks.
    """
    held = stored(vectors.withColumn("cell", F.lit("")))
    while True:
        sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        large = stored(sizes.filter(F.col("size") > limit).withColumn("parts", F.ceil(F.col("size") / PART).cast("int")))
        if large.isEmpty():
            return held
        rows = held.join(large, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))  # both are tables; vectors are not written again
        by = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
        seeds = rows.withColumn("seed", F.row_number().over(by)).filter(F.col("seed") <= fan)
        seeds = seeds.select(F.col("cell").alias("cell"), "seed", F.col("embedding").alias("vector"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
        dealt = rows.select("vec_id", "cell", "part", "embedding").groupBy("cell", "part").cogroup(seeds.groupBy("cell", "part"))
        kind = dict(vectors.dtypes)["vec_id"]
        nearest = stored(dealt.applyInArrow(_dealt, f"vec_id {kind}, nearest int"))
        placed = rows.join(nearest, "vec_id")
        whole = placed.groupBy("cell").agg((F.min("nearest") == F.max("nearest")).alias("whole"))
        by_hash = F.pmod(F.xxhash64("vec_id", F.col("cell")), F.lit(fan)).cast("int")
        split = placed.join(whole, "cell").withColumn("cell", F.concat_ws(".", F.nullif("cell", F.lit("")), F.when(F.col("whole"), by_hash).otherwise(F.col("nearest"))))
        held = stored(held.join(large, "cell", "left_anti").unionByName(split.select(held.columns)))


def level(rows: DataFrame, tag: str, provider: Provider = STUB, limit: int = CELL) -> DataFrame:
    """The next level above ``rows(vec_id, pos, text, embedding)``: a summary for each cluster, in the same columns and ``n_texts``.

    Clusters have five members on average. The first twenty texts of a cluster, in order, are summarised, and the summary
    embedded. Up to ``limit`` rows are clustered as one; beyond that cell by cell.
    """
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["vec_id"]
    clusters = stored(cells(rows.select("vec_id", "pos", "embedding"), limit).groupBy("cell").applyInArrow(_clustered, f"vec_id {kind}, cell string, cluster int"))
    named = clusters.select("vec_id", F.concat_ws("_", F.lit(f"{tag}_cluster"), F.nullif("cell", F.lit("")), F.col("cluster")).alias("cluster"))
    members = rows.select("vec_id", "pos", "text").join(named, "vec_id")
    texts = generation.cluster_texts(members, BETWEEN).select("cluster", "text").join(members.groupBy("cluster").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_texts")), "cluster")
    summed = stored(texts.select(F.col("cluster").alias("vec_id"), "pos", provider.summarize(F.col("text")).alias("text"), "n_texts"))  # asked for once
    return stored(summed.withColumn("embedding", provider.embed(F.col("text"))))


def levels(chunks: DataFrame, provider: Provider = STUB, limit: int = CELL) -> list[DataFrame]:
    """Level 0, the chunks, and above them one or two levels of summaries: a second where the first has ten or more.

    ``chunks(vec_id, pos, text, embedding)``; ``pos`` is a struct whose order is that of the texts.
    """
    found = [chunks]
    first = level(chunks, "l1", provider, limit)
    found.append(first)
    if first.count() >= SECOND_FROM:
        found.append(level(first.drop("n_texts"), "l2", provider, limit))
    return found
