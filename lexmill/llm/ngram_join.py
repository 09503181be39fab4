"""Jaccard self-join of word-shingle sets by count vectors in R-trees.

1. Shingles are put in the order of their hashes. Sets that link share the least ``k`` shingles of their
   intersection, and these lie among the ``size - least overlap + k`` least of either: the prefix. A set enters a
   bucket for each shingle of its prefix. It needs ``k`` of these in common with a partner, so it leaves its
   ``k - 1`` fullest buckets, and all of them if it has fewer than ``k`` that others share.
2. Each member of a bucket is compared with the bucket's most connected set. Buckets whose members are then all
   connected are settled, so that a group of near copies costs one comparison a member.
3. In a bucket that is not, each set is a point of counts: its shingles are hashed into groups, a coordinate is
   the number in a group. The overlap of two sets is at most the sum of the smaller counts; an R-tree finds the
   pairs whose bound is high enough, and these pairs, over all buckets, connect the candidate clusters.
4. In a cluster the same index proposes pairs again, now over the whole sets; they are verified unless links have
   connected them already. A set is sent once for its cluster, not once for each bucket.

Equal sets are one class throughout. Full buckets and large clusters are compared block by block: sets connected with
the centre, or the cluster's largest part, stay in their block, the others visit every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, shingle_sets, sum_by, text_blocks
from .shared import NO_ID, own_columns, row_id, ship, whole_text, written

#: Points in a leaf; the least and, unless a count needs more, the largest number of coordinates of a count vector.
LEAF, COARSE, FINE = 32, 64, 4096
#: Shingles (8 bytes each) and sets of one block of a bucket, which is what a task holds beside one batch.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 20_000
#: A set must share one prefix shingle, and one more for so many that it has.
NEED_EVERY = 16
#: Keys that a task pre-aggregates at a time.
CHUNK_KEYS = 2_000_000
#: A key is busy if so many of the sets that a task counts together have it, and this share of them.
BUSY_LEAST, BUSY_SHARE = 32, 0.01
#: Parts over which the entries of a busy key are dealt.
HOT_PARTS = 256
#: Busy keys that are broadcast (8 bytes each), the busiest; without a key there the result is the same.
BUSY_KEYS = 500_000


def prefixes(hashes: np.ndarray, of: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket keys, set numbers, how many of its keys each set shares at least with any different set it links to).

    A set of ``n`` overlaps with what it links to in ``n * percent / 100`` or more, whichever is larger.
    """
    least = (sizes * percent + 99) // 100
    need = np.minimum(least, 1 + sizes // NEED_EVERY)
    able = sizes * (100 - percent) >= percent  # smaller sets link to equal ones only
    length = np.where(able, sizes - least + need, 0)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    use = np.arange(len(hashes)) - first[of] < length[of]
    return hashes[use], of[use], need


def signatures(hashes: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set."""
    n = len(sizes)
    one = mix(sum_by(of, mix(hashes + np.uint64(1)), n) + sizes.astype(np.uint64))
    two = mix(sum_by(of, mix(hashes ^ np.uint64(0x5555555555555555)), n))
    return one.view(np.int64), two.view(np.int64)


def busy(keys: list[np.ndarray], least: float) -> pa.RecordBatch:
    """Rows (count, 0, -1, key, 0) for the bucket keys that ``least`` of a task's sets have."""
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    many = count >= least
    key, count = key[many].view(np.int64), count[many].astype(np.int64)
    none = np.zeros(len(key), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (count, none, none - 1, key, none)], ["rid", "hash", "n", "node", "node2"])


def _features(width: int, percent: int, least: int, share: float):
    """(rid, hash, n, node, node2): size and names of each row's set; rows with n = -1 name busy keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, seen = [], 0, 0
        for batch in batches:
            sizes, one, two = [], [], []
            for _, _, data, cuts in text_blocks(batch.column(2)):
                hashes, of, n = shingle_sets(data, cuts, width)
                a, b = signatures(hashes, of, n)
                sizes.append(n), one.append(a), two.append(b)
                keys.append(prefixes(hashes, of, n, percent)[0])
                held, seen = held + len(keys[-1]), seen + len(n)
                if held >= CHUNK_KEYS:
                    yield busy(keys, max(least, share * seen))
                    keys, held, seen = [], 0, 0
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(np.concatenate(x)) for x in (sizes, one, two))],
                    ["rid", "hash", "n", "node", "node2"],
                )
        if held:
            yield busy(keys, max(least, share * seen))

    return run


def _entries(width: int, percent: int):
    """(key, node, need): the bucket rows of one partition, once for each bucket, set and chunk."""

    def flush(keys: list[np.ndarray], nodes: list[np.ndarray], needs: list[np.ndarray]) -> pa.RecordBatch:
        key, node, need = np.concatenate(keys), np.concatenate(nodes), np.concatenate(needs)
        order = np.lexsort((node, key))
        key, node, need = key[order], node[order], need[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        return pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(node[new]), pa.array(need[new].astype(np.int32))], ["key", "node", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for _, _, data, cuts in text_blocks(batch.column(0)):
                hashes, of, n = shingle_sets(data, cuts, width)
                key, owner, need = prefixes(hashes, of, n, percent)
                for part, values in zip(held, (key, signatures(hashes, of, n)[0][owner], need[owner])):
                    part.append(values)
                size += len(key)
                if size >= CHUNK_KEYS:
                    yield flush(*held)
                    held, size = ([], [], []), 0
        if size:
            yield flush(*held)

    return run


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall in each group, a power of two of groups: about four a group, and never above 255."""
    d = COARSE
    while d < FINE and d * 4 < len(shingles):
        d *= 2
    while True:
        counts = np.bincount((shingles & np.uint64(d - 1)).astype(np.int64), minlength=d)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8)
        d *= 2


def folded(counts: np.ndarray, d: int) -> np.ndarray:
    """Count vectors (last axis) over ``d`` groups, each the union of finer ones."""
    if counts.shape[-1] == d:
        return counts
    return counts.reshape(*counts.shape[:-1], -1, d).sum(axis=-2, dtype=np.int32)


def _sets(width: int):
    """(node, n, set, counts): hashes of the shingles in order, 8 bytes each, and the count vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, cuts in text_blocks(batch.column(1)):
                hashes, _, n = shingle_sets(data, cuts, width)
                sets = np.split(hashes, np.cumsum(n)[:-1])
                columns = [pa.array([x.tobytes() for x in made], pa.binary()) for made in (sets, map(count_vector, sets))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(n), *columns], ["node", "n", "set", "counts"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, given as ordered hashes, link."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _verify(percent: int):
    """Those pairs (u, v, set of u, set of v) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


class CountTree:
    """A bulk-loaded R-tree of count vectors; each node keeps coordinate maxima and the least set size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / min(percent, 99)))
        self.order = np.lexsort((*counts.T[7::-1], band))  # sizes that may link, then the leading coordinates
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels = []
        high, low = self.counts, self.sizes
        while len(low) > LEAF:
            cut = np.arange(0, len(low), LEAF)
            high, low = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low, cut)
            self.levels.append((high, low))

    def _fits(self, high: np.ndarray, low: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
        return np.minimum(high, count).sum(axis=1, dtype=np.int64) * (100 + self.percent) >= self.percent * (low + size)

    def candidates(self, count: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap bound allows a link with a set of ``size`` and these counts."""
        spots = None
        for high, low in reversed(self.levels):
            spots = np.arange(len(low)) if spots is None else self._children(spots, len(low))
            spots = spots[self._fits(high[spots], low[spots], count, size)]
        spots = np.arange(len(self.sizes)) if spots is None else self._children(spots, len(self.sizes))
        return self.order[spots[self._fits(self.counts[spots], self.sizes[spots], count, size)]]

    @staticmethod
    def _children(spots: np.ndarray, n: int) -> np.ndarray:
        below = (spots[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        return below[below < n]


class CountIndex:
    """Trees of count vectors, one for each number of groups; vectors of unlike numbers meet folded to the smaller."""

    def __init__(self, counts: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.percent = percent
        of = np.array([len(c) for c in counts])
        self.parts = []
        for d in np.unique(of).tolist():
            at = np.nonzero(of == d)[0]
            self.parts.append((d, at, np.stack([counts[i] for i in at]), sizes[at], int(sizes[at].min()), int(sizes[at].max())))
        self.trees: dict[tuple[int, int], CountTree] = {}

    def candidates(self, counts: np.ndarray, size: int) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for d, at, vectors, sizes, low, high in self.parts:
            if high * 100 >= self.percent * size and size * 100 >= self.percent * low:
                m = min(d, len(counts))
                if (d, m) not in self.trees:
                    self.trees[d, m] = CountTree(folded(vectors, m), sizes, self.percent)
                found.append(at[self.trees[d, m].candidates(folded(counts, m), size)])
        return np.concatenate(found)


class Block:
    """One block of a bucket or cluster, and the pairs found between its sets, and between them and visitors.

    With whole sets (``exact``), pairs are links, and sets that have one root or that links found here connect are
    not compared, unless ``every`` link is asked for. With count vectors, pairs are what the bound allows between
    different roots, and only as many as connect the same sets.
    """

    def __init__(self, percent: int, exact: bool, every: bool = False):
        self.percent, self.exact, self.every = percent, exact, every and exact
        self.nodes: list[int] = []
        self.roots: list[int] = []
        self.majors: list[bool] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.index: CountIndex | None = None
        self.found: list[tuple[int, int]] = []
        #: Pairs of the block, pairs within the bound, pairs verified.
        self.pairs = self.bounded = self.compared = 0

    def add(self, node: int, root: int, major: bool, size: int, raw: np.ndarray) -> None:
        self.nodes.append(node), self.roots.append(root), self.majors.append(major), self.sizes.append(size), self.held.append(raw)

    def _counts(self, raw: np.ndarray) -> np.ndarray:
        return count_vector(raw) if self.exact else raw

    def _merge(self, a: int, b: int) -> None:
        """Give the sets of label ``a`` the label ``b``."""
        self.label[self.label == a] = b
        self.now[a] = b

    def _label_of(self, root: int) -> int | None:
        label = self.label_of.get(root)
        while label in self.now:
            label = self.now[label]
        return label

    def _fit(self, a: np.ndarray, b: np.ndarray) -> bool:
        self.compared += 1
        return not self.exact or linked(a, b, self.percent)

    def close(self) -> None:
        """Index the block and compare its sets with each other."""
        counts = [self._counts(x) for x in self.held]
        self.root = np.array(self.roots, np.int64)
        self.major = np.array(self.majors, bool)
        self.index = CountIndex(counts, np.array(self.sizes, np.int64), self.percent)
        names = self.root if self.exact else np.array(self.nodes, np.int64)
        named, self.label = np.unique(names, return_inverse=True)
        self.label_of = dict(zip(named.tolist(), range(len(named))))
        self.now: dict[int, int] = {}  # labels that were merged into others
        settled = False
        for i in range(len(self.held)):
            self.pairs += i
            if settled:
                continue
            near = self.index.candidates(counts[i], self.sizes[i])
            near = near[near < i]
            self.bounded += len(near)
            if not self.every:
                near = near[(self.label[near] != self.label[i]) & (self.root[near] != self.root[i])]
            for j in near.tolist():
                if not self.every and self.label[i] == self.label[j]:
                    continue
                if self._fit(self.held[i], self.held[j]):
                    self.found.append((self.nodes[i], self.nodes[j]))
                    if not self.every:
                        self._merge(int(self.label[i]), int(self.label[j]))
                        settled = bool((self.label == self.label[0]).all())

    def visit(self, node: int, root: int, later: bool, size: int, raw: np.ndarray) -> None:
        """Compare a set of another block with those that stay in theirs, and with the others if it is ``later``."""
        if self.index is None:
            self.close()
        near = self.index.candidates(self._counts(raw), size)
        if not later:
            near = near[self.major[near]]
        self.pairs += len(self.held)
        self.bounded += len(near)
        name = root if self.exact else node
        for j in near.tolist():
            mine = self._label_of(name)
            if not self.every and (mine == self.label[j] or root == self.root[j]):
                continue
            if self._fit(raw, self.held[j]):
                self.found.append((node, self.nodes[j]))
                if not self.every:
                    if mine is None:
                        self.label_of[name] = int(self.label[j])
                    else:
                        self._merge(mine, int(self.label[j]))


def _compare_blocks(percent: int, exact: bool, every: bool):
    """Pairs (u, v) of blocks whose rows come together, the block's own sets first.

    A last row of each task, with u = v, has how many pairs the blocks held, the bound let through and were verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, Block(percent, exact, every)
        found: list[tuple[int, int]] = []
        done = [0, 0, 0]

        def close() -> None:
            if block.index is None and len(block.held) > 1:
                block.close()
            found.extend(block.found)
            for k, n in enumerate((block.pairs, block.bounded, block.compared)):
                done[k] += n

        def batch_of(last: bool) -> pa.RecordBatch:
            rows = [(u, v, 0, 0, 0) for u, v in found] + ([(0, 0, *done)] if last else [])
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["u", "v", "pairs", "bounded", "compared"])

        for batch in batches:
            keys, ats, visiting, later, nodes, roots, majors, sizes = (batch.column(k).to_pylist() for k in range(8))
            for key, visits, is_later, node, root, major, size, raw in zip(zip(keys, ats), visiting, later, nodes, roots, majors, sizes, batch.column(8)):
                values = np.frombuffer(raw.as_buffer(), np.uint64 if exact else np.uint8)
                if key != group:
                    close()
                    group, block = key, Block(percent, exact, every)
                if not visits:
                    block.add(node, root, major, size, values)
                elif block.held:
                    block.visit(node, root, is_later, size, values)
            if len(found) > 10_000:
                yield batch_of(False)
                found.clear()
        close()
        yield batch_of(True)

    return run


def compared_blocks(rows: DataFrame, held: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """(u, v, pairs, bounded, compared) of ``rows(key, node, root, major, blocks)`` with their sets or count vectors."""
    exact = "set" in held.columns
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    stays = F.when(F.col("major"), F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = placed.withColumn("at", F.explode(stays)).withColumns({"visiting": F.col("at") != F.col("block"), "later": F.col("at") > F.col("block")})
    columns = ["key", "at", "visiting", "later", "node", "root", "major", "n", "set" if exact else "counts"]
    ordered = sent.join(held, "node").select(columns).repartition("key", "at").sortWithinPartitions("key", "at", "visiting", "node")
    return written(ordered.mapInArrow(_compare_blocks(percent, exact, every), "u long, v long, pairs long, bounded long, compared long"))


def bucket_rows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, node, shared): members of the buckets that are left of ``rows(key, node, need)``.

    Only buckets of two different sets or more count. The order "fewest entries first" is the same for all sets, so
    two sets that share ``need`` buckets still share one when each leaves its ``need - 1`` last ones. Busy keys
    (``hot(key)``, a bounded number) are dealt over parts and stand last in that order without being counted: any
    order that is the same for all sets will do, and a bucket of one set does no harm.
    """
    flagged = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    parts = flagged.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(HOT_PARTS))).otherwise(0))
    whole = Window.partitionBy("key", "part")
    counted = parts.withColumns({"low": F.min("node").over(whole), "high": F.max("node").over(whole), "held": F.count(F.lit(1)).over(whole)})
    entered = counted.filter("hot or low < high").withColumn("held", F.when(F.col("hot"), F.lit(1 << 40)).otherwise(F.col("held")))
    shared = entered.groupBy("key", "part", "node").agg(F.max("need").alias("need"), F.max("held").alias("held"))
    mine = Window.partitionBy("node")  # at most the shingles of one text
    ranked = shared.withColumns({"shared": F.count(F.lit(1)).over(mine), "place": F.row_number().over(mine.orderBy("held", "key"))})
    return ranked.filter("place <= shared - need + 1").select("key", "node", "shared")


def blocks_of(sets: Column | None = None, shingles: Column | None = None) -> Column:
    """How many blocks so many sets and shingles make."""
    sets, shingles = F.count(F.lit(1)) if sets is None else sets, F.sum("n") if shingles is None else shingles
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int").alias("blocks")


@own_columns
def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False, firsts: bool = False) -> DataFrame:
    """``docs`` with ``n_shingles`` (size of the set) and ``component_id`` (least id reachable by links).

    Sets link when their Jaccard similarity is ``percent`` / 100 or more. Texts without words (null, empty or
    blank) have an empty set and are linked with nothing: their component is their own id. Repeated rows are
    equal sets, hence linked; a null id is passed over when a component has another, and else stays null. Empty
    tables give empty results; columns of ``docs`` named like the results are replaced.

    With ``links``, every candidate pair of different sets is verified, not only those that connect more, and
    ``n_links`` is how many other rows a row is linked with; equal sets are counted, not paired.

    With ``firsts``, ``is_first`` says whether id and text are those that stand first in their component, by id (null
    last) and a hash of the text, and ``n_same`` how many rows have that id and text. Sets that are empty are first.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_shingles", "component_id", *(["n_links"] if links else []), *(["is_first", "n_same"] if firsts else []))
    text = whole_text(text_col)
    keyed = docs.select(row_id(id_col).alias("rid"), F.xxhash64(text).alias("hash"), text.alias("text"))
    made = written(keyed.mapInArrow(_features(width, percent, BUSY_LEAST, BUSY_SHARE), "rid long, hash long, n long, node long, node2 long"))
    sets = made.filter("n >= 0")
    hot = made.filter("n = -1").groupBy(F.col("node").alias("key")).agg(F.sum("rid").alias("count")).orderBy(F.desc("count"), "key").limit(BUSY_KEYS).select("key")
    real = F.when(F.col("rid") != NO_ID, F.col("rid"))
    # One class for each different set: combined on the map side, so copies never meet in one task.
    classes = written(
        sets.filter("n > 0")
        .groupBy("node", "node2")
        .agg(F.min(F.struct((F.col("rid") == NO_ID).alias("no_id"), "rid", "hash")).alias("first"), F.max("n").alias("n"), F.min(real).alias("least_id"), F.count(F.lit(1)).alias("copies"))
    )
    kept = written(bucket_rows(keyed.select("text").mapInArrow(_entries(width, percent), "key long, node long, need int"), hot))
    # A bucket's centre is its set with the most shared buckets.
    buckets = kept.groupBy("key").agg(F.max(F.struct("shared", "node"))["node"].alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(kept.join(buckets, "key").select("key", "node", "centre"))
    wanted = members.select("node").distinct().join(classes, "node").select("node", F.col("first.rid").alias("rid"), F.col("first.hash").alias("hash"))
    # One strategy at every size; the members are the build side, so texts are not sorted.
    texts = keyed.join(written(wanted).hint("shuffle_hash"), ["rid", "hash"]).dropDuplicates(["node"])
    held = written(texts.select("node", "text").mapInArrow(_sets(width), "node long, n long, set binary, counts binary"))
    if links:
        verified = spark.createDataFrame([], "u long, v long")
        labels = members.select("node", F.col("node").alias("root")).distinct()
    else:
        pairs = members.filter("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
        of_u, of_v = held.select(F.col("node").alias("u"), F.col("set").alias("set_u")), held.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
        verified = written(pairs.join(of_u, "u").join(of_v, "v").select("u", "v", "set_u", "set_v").mapInArrow(_verify(percent), "u long, v long"))
        labels = components(verified)
    labels = held.select("node", "n").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(members.join(labels, "node"))
    # The root of the centre is the bucket's major one; buckets of one root are settled.
    buckets = rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("node") == F.col("centre"), F.col("root"))).alias("major_root"), blocks_of()
    )
    points = rooted.join(buckets.filter("low < high"), "key").withColumn("major", F.col("root") == F.col("major_root")).select("key", "node", "root", "major", "blocks")
    near = compared_blocks(points, held.select("node", "n", "counts"), percent)
    clusters = components(near.filter("u <> v").select("u", "v")).withColumnRenamed("root", "key").join(labels, "node")
    parts = written(clusters.groupBy("key", "root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")))
    large = parts.groupBy("key").agg(F.max(F.struct("sets", "root"))["root"].alias("major_root"), blocks_of(F.sum("sets"), F.sum("shingles")))
    members = clusters.join(large, "key").withColumn("major", F.lit(not links) & (F.col("root") == F.col("major_root"))).select("key", "node", "root", "major", "blocks")
    compared = compared_blocks(members, held.select("node", "n", "set"), percent, links)
    verified = verified.unionByName(compared.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    roots = components(verified)
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("least_id"), *([F.min("first").alias("lead")] if firsts else []))
    by_class = named.select("node", "node2", "root", "copies").join(least, "root").drop("root")
    if links:
        ends = verified.unionByName(verified.select(F.col("v").alias("u"), F.col("u").alias("v")))
        others = ends.join(classes.select(F.col("node").alias("v"), "copies"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("others"))
        by_class = by_class.join(others, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    same = sets.groupBy("rid", "hash", "n", "node", "node2").agg(F.count(F.lit(1)).alias("n_same")) if firsts else sets.dropDuplicates(["rid", "hash"])
    is_first = F.coalesce((F.col("lead.rid") == F.col("rid")) & (F.col("lead.hash") == F.col("hash")), F.lit(True))
    of_row = same.join(by_class, ["node", "node2"], "left").select(
        F.col("rid").alias("_lm_rid"), F.col("hash").alias("_lm_hash"), F.col("n").alias("_lm_n"), F.col("least_id").alias("_lm_least"), *([F.col("n_links").alias("_lm_links")] if links else []),
        *([is_first.alias("_lm_first"), F.col("n_same").alias("_lm_same")] if firsts else []),
    )
    found = docs.withColumns({"_lm_rid": row_id(id_col), "_lm_hash": F.xxhash64(text)}).join(of_row, ["_lm_rid", "_lm_hash"])
    return found.select(
        *docs.columns,
        F.col("_lm_n").alias("n_shingles"),
        F.coalesce("_lm_least", F.col(id_col).cast("long")).alias("component_id"),
        *([F.coalesce("_lm_links", F.lit(0)).cast("long").alias("n_links")] if links else []),
        *([F.col("_lm_first").alias("is_first"), F.col("_lm_same").alias("n_same")] if firsts else []),
    )
