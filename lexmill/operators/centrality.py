"""Betweenness as supersteps over tables: trees fold into what they hang on, breadth-first searches run from all nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Rows (source, node) of the searches that run together; more sources go through in batches.
SEARCH_ROWS = 50_000_000
#: Rounds in which nodes of one link are folded; what is deeper is searched like the rest.
FOLDS = 16


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles: both sides grow with the graph, and broadcast tables go through the driver, however well they pack."""
    return left.join(right.hint("merge"), on, how)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each two linked nodes, in both directions, without loops."""
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").distinct()
    return stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def connected(links: DataFrame) -> DataFrame:
    """(fqn, root): the least node of each node's component, by least neighbours and pointer jumping."""
    state = stored(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "fqn"))
    while True:
        near = met(links, state.select(F.col("fqn").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = stored(met(state, near.withColumnRenamed("a", "fqn"), "fqn").select("fqn", "root", F.least("root", "near").alias("to")))
        ahead = step.select(F.col("fqn").alias("to"), F.col("to").alias("further"))
        moved = stored(met(step, ahead, "to").select("fqn", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("changed")))
        state = moved.select("fqn", "root")
        if moved.filter("changed").isEmpty():
            return state


def folded(links: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes with one link fold into their neighbour, round by round: (links of the rest, nodes, each round's (a, b): a into b).

    ``nodes(fqn, stands, squares)``: how many nodes each stands for, itself included, and the sum of the squares of
    those numbers over what was folded into it.
    """
    nodes = stored(links.select(F.col("a").alias("fqn")).distinct().select("fqn", F.lit(1).cast("long").alias("stands"), F.lit(0).cast("double").alias("squares")))
    rounds = []
    for _ in range(folds):
        leaves = links.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("a", "b")
        # Of two nodes that only have each other one folds.
        other = leaves.select(F.col("a").alias("b"), F.lit(True).alias("leaf"))
        fold = stored(met(leaves, other, "b", "left").filter("leaf is null or a > b").select("a", "b"))
        if fold.isEmpty():
            break
        rounds.append(fold)
        held = met(fold, nodes.withColumnRenamed("fqn", "a"), "a")
        adds = held.groupBy(F.col("b").alias("fqn")).agg(F.sum("stands").alias("more"), F.sum(F.col("stands").cast("double") ** 2).alias("square"))
        nodes = stored(
            met(nodes, adds, "fqn", "left").select("fqn", (F.col("stands") + F.coalesce("more", F.lit(0))).alias("stands"), (F.col("squares") + F.coalesce("square", F.lit(0.0))).alias("squares"))
        )
        links = stored(met(met(links, fold.select("a"), "a", "left_anti"), fold.select(F.col("a").alias("b")), "b", "left_anti"))
    return links, nodes, rounds


def component_sizes(rest: DataFrame, nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(fqn, size) of every node's component: searched among the rest only, and handed back to what was folded, the last first."""
    roots = connected(rest)
    totals = met(roots, nodes, "fqn").groupBy("root").agg(F.sum("stands").alias("size"))
    left = nodes
    for fold in rounds:
        left = met(left, fold.select(F.col("a").alias("fqn")), "fqn", "left_anti")
    # A tree that folded whole is its last node, which stands for all of it.
    sizes = stored(met(left, met(roots, totals, "root").select("fqn", "size"), "fqn", "left").select("fqn", F.coalesce("size", "stands").alias("size")))
    for fold in reversed(rounds):
        sizes = sizes.unionByName(stored(met(fold, sizes.withColumnRenamed("fqn", "b"), "b").select(F.col("a").alias("fqn"), "size")))
    return sizes


def searched(links: DataFrame, weights: DataFrame, sources: DataFrame) -> DataFrame:
    """(fqn, part): what the shortest paths from ``sources(s, from_weight)`` add to each node between.

    One superstep a distance: path counts go forward, and shares of the paths back again. ``weights(fqn, weight)``
    says for how many nodes each stands.
    """
    level = stored(sources.select("s", F.col("s").alias("fqn"), F.lit(1.0).alias("paths")))
    levels = [level]
    while True:
        ahead = met(level, links, F.col("fqn") == F.col("a")).groupBy("s", "b").agg(F.sum("paths").alias("paths")).withColumnRenamed("b", "fqn")
        for seen in levels[-2:]:  # a neighbour is one step nearer, as far, or one step further
            ahead = met(ahead, seen.select("s", "fqn"), ["s", "fqn"], "left_anti")
        level = stored(ahead)
        if level.isEmpty():
            break
        levels.append(level)
    share = None
    found = sources.sparkSession.createDataFrame([], "s string, fqn string, share double")
    for level in reversed(levels[1:]):
        own = met(level, weights, "fqn")
        if share is None:
            share = own.select("s", "fqn", "paths", "weight", F.lit(0.0).alias("share"))
        else:
            share = met(own, share, ["s", "fqn"], "left").select("s", "fqn", "paths", "weight", (F.col("paths") * F.coalesce("back", F.lit(0.0))).alias("share"))
        share = stored(share)
        found = found.unionByName(share.select("s", "fqn", "share"))
        back = share.select("s", "fqn", ((F.col("weight") + F.col("share")) / F.col("paths")).alias("each"))
        share = met(back, links, F.col("fqn") == F.col("a")).groupBy("s", "b").agg(F.sum("each").alias("back")).withColumnRenamed("b", "fqn")
    return stored(met(found, sources, "s").groupBy("fqn").agg(F.sum(F.col("share") * F.col("from_weight")).alias("part")))


def betweenness(edges: DataFrame, search_rows: int = SEARCH_ROWS, folds: int = FOLDS) -> DataFrame:
    """(fqn, betweenness): normalised undirected betweenness of every node with an edge.

    Trees that hang on the graph are counted in closed form, from sizes of components and of what is folded; the rest
    is searched from all its nodes, weighted by the trees on them, ``search_rows`` (source, node) rows at a time. No
    graph is collected: the driver sees counts only. The exact measure costs nodes times edges of what is not folded.
    Loops and repeated edges count once; an empty table gives no rows.
    """
    links = both_ways(edges)
    rest, nodes, rounds = folded(links, folds)
    sizes = component_sizes(rest, nodes, rounds)
    below, others = (F.col("stands") - 1).cast("double"), F.col("size") - F.col("stands")
    parts = met(nodes, sizes, "fqn").select("fqn", (below * below - F.col("squares") + 2 * below * others).alias("part"))
    n = nodes.count()
    core = met(rest.select(F.col("a").alias("fqn")).distinct(), nodes, "fqn").select("fqn", F.col("stands").alias("weight"))
    core = stored(core)
    count = core.count()
    batches = -(-count * count // search_rows)
    for i in range(batches):
        sources = core.filter(F.pmod(F.xxhash64("fqn"), F.lit(batches)) == i).select(F.col("fqn").alias("s"), F.col("weight").alias("from_weight"))
        parts = parts.unionByName(searched(rest, core, sources))
    scale = (n - 1) * (n - 2) if n > 2 else 1
    return parts.groupBy("fqn").agg(F.round(F.sum("part") / scale, 6).alias("betweenness"))


def hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nodes of highest betweenness, ties by name: (fqn, betweenness)."""
    return betweenness(edges).orderBy(F.desc("betweenness"), "fqn").limit(k)
