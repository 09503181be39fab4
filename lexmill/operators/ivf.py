"""Vector search by inverted lists: every vector stands in the list of its nearest centroid, queries probe a few lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import ship, stored
from .hierarchy import fine_clusters
from .vector import CELLS, Queries, _matrix, _size, cosine_top_k, ranked

#: Vectors that the centroids are fitted on at most, chosen by a hash of their ids; every vector is indexed.
SAMPLE = 50_000
#: Lists at most, so that centroids stay a few megabytes.
LISTS = 4096
#: Queries whose exact neighbours say how many lists must be probed, and how many neighbours of each.
TRIALS, TRIAL_K = 200, 10
#: Vectors and queries that meet in a task.
PART, QUERY_PART = 50_000, 5_000


@dataclass
class ListIndex:
    """vectors(list, vec_id, embedding, other columns), sizes(list, size), the centroids, and how many lists to probe."""

    vectors: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    probes: int = 8


def probes_for(index: ListIndex, target: float) -> int:
    """The least number of probes that finds the share ``target`` of the exact neighbours of some of the index's own vectors.

    ``TRIALS`` of them, chosen by a hash, are compared with all; of each neighbour it is seen how many lists stand before
    its own for the query.
    """
    trials = stored(index.vectors.filter(F.size("embedding") > 0).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(TRIALS))
    exact = cosine_top_k(index.vectors, trials, TRIAL_K).select("query_id", "vec_id").join(index.vectors.select("vec_id", "list"), "vec_id")
    rows = exact.join(trials.withColumnRenamed("vec_id", "query_id"), "query_id").select("embedding", "list").toArrow()  # TRIALS x TRIAL_K rows
    if not rows.num_rows:
        return 1
    score = np.round(_matrix(rows.column("embedding").combine_chunks(), index.centroids.shape[1]) @ index.centroids.T, 9)
    own = score[np.arange(len(score)), rows.column("list").to_numpy()][:, None]
    return int(np.quantile((score > own).sum(axis=1), target, method="higher")) + 1


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, target: float = 0.95) -> ListIndex:
    """Lists over ``vectors(vec_id, embedding)``; other columns are kept, for filters.

    Centroids are cosine k-means of a bounded ``sample``; by default there are as many lists as the square root of the
    number of vectors. As many lists are probed as find the share ``target`` of the neighbours of a few hundred of the
    vectors, which are compared with all. Vectors without direction (null, empty, zero) are in a list like others.
    """
    ship(vectors.sparkSession)
    size, n = _size(vectors), vectors.count()
    lists = min(LISTS, lists or max(1, round(n**0.5)))
    chosen = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x = _matrix(chosen.column("embedding").combine_chunks(), size) if chosen.num_rows else np.zeros((0, size))
    found = fine_clusters(x, lists)
    sums = np.zeros((min(lists, len(x)), size))
    np.add.at(sums, found, x)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    centroids = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assigned(batches):
        for batch in batches:
            nearest = (_matrix(batch.column(1), size) @ sent.value.T).argmax(axis=1) if len(sent.value) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], [*batch.schema.names, "list"])

    order = ["vec_id", "embedding", *(c for c in vectors.columns if c not in ("vec_id", "embedding", "list"))]
    form = StructType([*vectors.select(order).schema.fields, StructField("list", IntegerType())])
    held = stored(vectors.select(order).mapInArrow(assigned, form))
    index = ListIndex(held, stored(held.groupBy("list").agg(F.count(F.lit(1)).alias("size"))), centroids)
    index.probes = probes_for(index, target)
    return index


def search(index: ListIndex, queries: DataFrame, k: int = 5, probes: int | None = None, where: Column | None = None, exclude_self: bool = True) -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` best that ``probes`` lists (by default the index's number) hold, for each of ``queries(vec_id, embedding)``.

    ``where`` is a condition on the index's columns that holds before the search, so ``k`` vectors that meet it are found
    where the probed lists have them. With as many probes as lists the search is exact. A list is dealt to tasks by parts
    of bounded size, and so are the queries that probe it.
    """
    ship(queries.sparkSession)
    probes = probes or index.probes
    size, kind = index.centroids.shape[1], dict(index.vectors.dtypes)["vec_id"]
    asked = stored(queries.select(F.col("vec_id").alias("query_id"), "embedding", F.xxhash64("vec_id").alias("number")))
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def probed(batches):
        for batch in batches:
            score = -np.round(_matrix(batch.column(1), size) @ sent.value.T, 9)
            nearest = np.argsort(score, axis=1, kind="stable")[:, :probes]
            numbers = np.repeat(batch.column(0).to_numpy(), nearest.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(nearest.reshape(-1), pa.int32())], ["number", "list"])

    wanted = stored(asked.select("number", "embedding").mapInArrow(probed, "number long, list int"))
    blocks = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_PART).cast("int").alias("blocks"))
    dealt = F.broadcast(index.sizes.join(blocks, "list").select("list", "blocks", F.ceil(F.col("size") / PART).cast("int").alias("parts")))  # a row a list
    rows = index.vectors if where is None else index.vectors.filter(where)
    rows = rows.select("list", "vec_id", "embedding").join(dealt, "list").select("list", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sides = wanted.join(dealt, "list").select("list", "number", F.pmod(F.col("number"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sides = sides.join(asked, "number")

    def met(vectors: pa.Table, block: pa.Table) -> pa.Table:
        queries_, found = Queries(block, size), []
        step = max(1, CELLS // max(1, block.num_rows))
        for low in range(0, vectors.num_rows, step):
            part = vectors.slice(low, step).combine_chunks()
            found.append(queries_.best(part.column("vec_id").combine_chunks(), part.column("embedding").combine_chunks(), k, exclude_self))
        return pa.Table.from_batches(found, pa.schema([("number", pa.int64()), ("vec_id", vectors.schema.field("vec_id").type), ("score", pa.float64())]))

    keys = ["list", "part", "block"]
    found = rows.groupBy(keys).cogroup(sides.groupBy(keys)).applyInArrow(met, f"number long, vec_id {kind}, score double")
    return ranked(found.join(asked.select("query_id", "number"), "number").select("query_id", "vec_id", "score"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact(query_id, vec_id)`` that ``found`` has."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
