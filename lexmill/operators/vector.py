"""Exact cosine search of a batch of queries, and spherical k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored

#: Queries are broadcast only up to this many rows (of one vector each); more go through in blocks.
QUERY_BLOCK = 20_000
#: Scores that are held at a time.
CELLS = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows of a column of lists; null and empty lists are zeros."""
    found = np.zeros((len(column), size))
    full = pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False)
    if full.any():
        found[full] = column.filter(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    found = np.nan_to_num(found, nan=0.0)
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, norm, out=np.zeros_like(found), where=norm > 0)


class Queries:
    """A block of queries: numbers, ids and unit vectors."""

    def __init__(self, table: pa.Table, size: int):
        self.number = table.column("number").to_numpy()
        self.at = {v: i for i, v in enumerate(table.column("query_id").to_pylist())}
        self.units = _matrix(table.column("embedding").combine_chunks(), size)
        self.size = size

    def best(self, ids: pa.Array, vectors: pa.Array, k: int, exclude_self: bool) -> pa.RecordBatch:
        """(number, vec_id, score) of the ``k`` best of each query; of equals the least ids."""
        order = pc.sort_indices(ids)
        ids = ids.take(order)
        score = np.round(self.units @ _matrix(vectors.take(order), self.size).T, 6)
        if exclude_self:
            for j, i in enumerate(ids.to_pylist()):
                if i in self.at:
                    score[self.at[i], j] = -np.inf
        k = min(k, score.shape[1])
        if k < score.shape[1]:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
            above, level = score > least, score == least
            chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        else:
            chosen = np.ones(score.shape, bool)
        q, j = np.nonzero(chosen & np.isfinite(score))
        return pa.RecordBatch.from_arrays([pa.array(self.number[q]), ids.take(pa.array(j)), pa.array(score[q, j])], ["number", "vec_id", "score"])


def query_blocks(queries: DataFrame, size: int):
    """Blocks of at most about QUERY_BLOCK of ``queries(query_id, embedding)`` as broadcast variables, and their numbered ids."""
    spark = queries.sparkSession
    numbered = stored(queries.select("query_id", "embedding", F.xxhash64("query_id").alias("number")))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    for i in range(blocks):
        block = numbered if blocks == 1 else numbered.filter(F.pmod("number", F.lit(blocks)) == i)
        yield block.select("query_id", "number"), spark.sparkContext.broadcast(Queries(block.toArrow(), size))


def _size(vectors: DataFrame) -> int:
    row = vectors.select(F.size("embedding").alias("n")).filter("n > 0").first()
    return row["n"] if row else 0


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= k)


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, exclude_self: bool = True) -> DataFrame:
    """query_id, vec_id, score, rank: a stated query set against all vectors, exactly.

    Both sides hold (vec_id, embedding). The corpus is scanned once for each block of queries, without a shuffle of
    vectors: each Arrow batch is multiplied with the block, and its own best ``k`` of a query are all that is sent on.
    """
    ship(corpus.sparkSession)
    size, found = _size(corpus), None
    kind = dict(corpus.dtypes)["vec_id"]
    for ids, sent in query_blocks(queries.select(F.col("vec_id").alias("query_id"), "embedding"), size):

        def scan(batches, sent=sent):
            block = sent.value
            step = max(1, CELLS // max(1, len(block.number)))
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    yield block.best(part.column(0), part.column(1), k, exclude_self)

        scored = corpus.select("vec_id", "embedding").mapInArrow(scan, f"number long, vec_id {kind}, score double")
        one = scored.join(ids, "number").select("query_id", "vec_id", "score")
        found = one if found is None else found.unionByName(one)
    return ranked(found, k)


def spaced(vectors: DataFrame, k: int) -> list[np.ndarray]:
    """``k`` unit vectors at evenly spaced places in order of ``vec_id``: the driver sees those, and counts of ranges."""
    part = vectors.repartitionByRange("vec_id").withColumn("part", F.spark_partition_id())
    held = stored(part.select("part", "vec_id", "embedding"))
    sizes = {r["part"]: r["count"] for r in held.groupBy("part").count().collect()}
    n = sum(sizes.values())
    if not n:
        return []
    starts, before = [], 0
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    wanted = [int(x) for x in np.linspace(0, n - 1, min(k, n))]
    spark = vectors.sparkSession
    offsets = spark.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("vec_id")) - 1
    rows = held.withColumn("nth", place).join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("nth"))
    rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(wanted))], "at long")), "at")
    found = {r["at"]: np.asarray(r["embedding"], np.float64) for r in rows.select("at", "embedding").collect()}
    return [found[i] / (np.linalg.norm(found[i]) or 1.0) for i in wanted]


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 15) -> DataFrame:
    """(vec_id, cluster): cosine k-means from evenly spaced vectors; the first of equal centroids wins.

    Each round is one pass: tasks assign their vectors and sum them by cluster, and only the sums (k vectors of a
    task, combined before the driver sees k of them) move.
    """
    data = vectors.select("vec_id", "embedding")
    n = data.count()
    chosen = spaced(data, k)
    centroids = np.array(chosen).reshape(len(chosen), -1)

    def placing(current: np.ndarray):
        def nearest(column) -> tuple[np.ndarray, np.ndarray]:
            x = np.array(column.to_pylist(), dtype=np.float64)
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
            return x, (x @ current.T).argmax(axis=1) if len(current) else np.zeros(len(x), int)

        return nearest

    def sums(current: np.ndarray):
        nearest = placing(current)

        def run(batches):
            total, count = np.zeros_like(current), np.zeros(len(current), np.int64)
            for batch in batches:
                x, c = nearest(batch.column(0))
                np.add.at(total, c, x)
                count += np.bincount(c, minlength=len(current))
            rows = [(int(c), d, float(v)) for c in np.nonzero(count)[0] for d, v in enumerate(total[c])]
            c, d, v = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(v, pa.float64())], ["cluster", "d", "x"])

        return run

    for _ in range(rounds if n > k else 0):
        moved = centroids.copy()
        found = data.select("embedding").mapInArrow(sums(centroids), "cluster int, d int, x double").groupBy("cluster", "d").agg(F.sum("x").alias("x"))
        fresh: dict[int, np.ndarray] = {}
        for row in found.collect():
            fresh.setdefault(row["cluster"], np.zeros(centroids.shape[1]))[row["d"]] = row["x"]
        for c, v in fresh.items():
            moved[c] = v / (np.linalg.norm(v) + 1e-8)
        if np.allclose(moved, centroids, atol=1e-12):
            break
        centroids = moved

    def assign(batches):
        nearest = placing(centroids)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest(batch.column(1))[1], pa.int32())], ["vec_id", "cluster"])

    return data.mapInArrow(assign, "vec_id long, cluster int")
