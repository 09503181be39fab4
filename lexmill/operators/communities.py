"""Communities by modularity: local moves over tables, then communities become nodes, until nothing gains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .centrality import both_ways

#: Gains are compared to so many decimals, so that the order of sums doesn't decide.
DIGITS = 9


def modularity(links: DataFrame, nodes: DataFrame, state: DataFrame, two_m: float) -> float:
    """Of ``state(fqn, community)``: links inside less what the degrees lead one to expect."""
    held = nodes.join(state, "fqn")
    inside = (
        links.join(state.select(F.col("fqn").alias("a"), F.col("community").alias("ours")), "a")
        .join(state.select(F.col("fqn").alias("b"), F.col("community").alias("theirs")), "b")
        .agg(F.sum(F.when(F.col("ours") == F.col("theirs"), F.col("w"))).alias("x"))
    )
    totals = held.groupBy("community").agg(F.sum("k").alias("total"), F.sum("loop").alias("loop"))
    t = totals.agg(F.sum(F.col("total") ** 2).alias("squares"), F.sum("loop").alias("loops")).first()
    return ((inside.first()["x"] or 0.0) + (t["loops"] or 0.0)) / two_m - (t["squares"] or 0.0) / two_m**2


def moves(links: DataFrame, nodes: DataFrame, state: DataFrame, two_m: float) -> DataFrame:
    """(fqn, mine, best, gain): each node's neighbouring community of the largest gain over staying, if there is one."""
    own = nodes.join(state, "fqn").select("fqn", "k", F.col("community").alias("mine"))
    totals = own.groupBy(F.col("mine").alias("community")).agg(F.sum("k").alias("total"))
    to = links.join(state.select(F.col("fqn").alias("b"), "community"), "b").groupBy(F.col("a").alias("fqn"), "community").agg(F.sum("w").alias("w"))
    # A node's own community counts too, also without a link into it; its total is without the node.
    asked = to.unionByName(own.select("fqn", F.col("mine").alias("community"), F.lit(0.0).alias("w"))).groupBy("fqn", "community").agg(F.sum("w").alias("w"))
    stays = F.col("community") == F.col("mine")
    gain = F.col("w") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / two_m
    gains = asked.join(own, "fqn").join(totals, "community").withColumn("gain", F.round(gain, DIGITS)).withColumn("stays", stays)
    best = gains.groupBy("fqn").agg(
        F.first("mine").alias("mine"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"), F.min(F.when(~F.col("stays"), F.struct((-F.col("gain")).alias("cost"), "community"))).alias("top")
    )
    return best.filter(-F.col("top.cost") > F.col("stay")).select("fqn", "mine", F.col("top.community").alias("best"), (-F.col("top.cost") - F.col("stay")).alias("gain"))


def moved(state: DataFrame, chosen: DataFrame) -> DataFrame:
    return stored(state.join(chosen.select("fqn", "best"), "fqn", "left").select("fqn", F.coalesce("best", "community").alias("community")))


def together(found: DataFrame, nodes: DataFrame, two_m: float) -> DataFrame:
    """Those of the moves ``found`` that raise modularity when they are made at once, among them the best of all.

    A community is left or entered in a round, whichever its best move does, so nothing that a move counts on goes away; the
    others then only take away from its gain by their degrees. Moves are made in order of a hash's classes, each half as
    large as the one before: a move stays if it gains with all of its class and of the smaller ones made before it.
    """
    order = F.struct((-F.col("gain")).alias("cost"), "fqn")
    touched = found.select(F.col("mine").alias("c"), order.alias("m"), F.lit(False).alias("enters")).unionByName(found.select(F.col("best").alias("c"), order.alias("m"), F.lit(True).alias("enters")))
    first = stored(touched.groupBy("c").agg(F.min(F.struct("m", "enters")).alias("t")).select("c", F.col("t.m.fqn").alias("first"), F.col("t.enters").alias("enters")))
    source, target = first.filter("not enters").select(F.col("c").alias("mine"), F.col("first").alias("out")), first.filter("enters").select(F.col("c").alias("best"), F.col("first").alias("into"))
    half = F.length(F.regexp_extract(F.conv(F.hex(F.xxhash64("fqn", "best")), 16, 2), "(0*)$", 1))
    kept = found.join(source, "mine").join(target, "best").join(nodes.select("fqn", "k"), "fqn").withColumn("class", half)
    kept = stored(kept.withColumn("leads", (F.col("fqn") == F.col("out")) & (F.col("fqn") == F.col("into"))))
    for end, name in (("mine", "left"), ("best", "entered")):
        before = F.sum("k").over(Window.partitionBy(end).orderBy(F.desc("class")))
        sizes = kept.groupBy(end, "class").agg(F.sum("k").alias("k")).select(end, "class", before.alias(name))
        led = kept.filter("leads").select(end, F.col("k").alias(f"{name}_by"))
        kept = kept.join(sizes, [end, "class"]).join(led, end, "left")
    degrees = F.col("left") + F.col("entered") + F.coalesce("left_by", F.lit(0.0)) + F.coalesce("entered_by", F.lit(0.0))
    return kept.filter(F.col("leads") | (F.col("gain") > F.col("k") * degrees / two_m)).select("fqn", "best")


def local_optimum(links: DataFrame, nodes: DataFrame, two_m: float) -> tuple[DataFrame, bool]:
    """(state, whether anything moved): no node gains by moving alone. Each round's moves raise modularity together."""
    state, any_moved = stored(nodes.select("fqn", F.col("fqn").alias("community"))), False
    while True:
        found = stored(moves(links, nodes, state, two_m))
        if found.isEmpty():
            return state, any_moved
        state, any_moved = moved(state, together(found, nodes, two_m)), True


def communities(edges: DataFrame) -> DataFrame:
    """(fqn, community) of the nodes of ``edges(source, target)``, named by the least of their nodes.

    Nodes move to the neighbouring community of the largest gain until none gains; communities then become nodes,
    weighted by the links between and inside them, and move in turn, level by level, until a level moves nothing.
    Modularity rises with every step, so it ends without a limit of rounds. Ties go to the least name. Directions,
    loops and repeated edges do not count; an empty table gives no rows.
    """
    links = both_ways(edges).withColumn("w", F.lit(1.0))
    two_m = float(links.count())
    loops = None
    members = stored(links.select(F.col("a").alias("fqn")).distinct().select("fqn", F.col("fqn").alias("node")))
    while two_m:
        nodes = members.select(F.col("node").alias("fqn")).distinct()
        degree = links.groupBy(F.col("a").alias("fqn")).agg(F.sum("w").alias("out"))
        nodes = nodes.join(degree, "fqn", "left")
        nodes = nodes.withColumn("loop", F.lit(0.0)) if loops is None else nodes.join(loops, "fqn", "left")
        nodes = stored(nodes.select("fqn", F.coalesce("loop", F.lit(0.0)).alias("loop"), (F.coalesce("out", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0))).alias("k")))
        state, any_moved = local_optimum(links, nodes, two_m)
        if not any_moved:
            break
        members = stored(members.join(state.withColumnRenamed("fqn", "node"), "node").select("fqn", F.col("community").alias("node")))
        ours, theirs = state.select(F.col("fqn").alias("a"), F.col("community").alias("ours")), state.select(F.col("fqn").alias("b"), F.col("community").alias("theirs"))
        joined = stored(links.join(ours, "a").join(theirs, "b").groupBy("ours", "theirs").agg(F.sum("w").alias("w")))
        inner = joined.filter("ours = theirs").select(F.col("ours").alias("fqn"), F.col("w").alias("loop"))
        held = nodes.join(state, "fqn").groupBy(F.col("community").alias("fqn")).agg(F.sum("loop").alias("loop"))
        loops = stored(inner.unionByName(held).groupBy("fqn").agg(F.sum("loop").alias("loop")))
        links = stored(joined.filter("ours <> theirs").select(F.col("ours").alias("a"), F.col("theirs").alias("b"), "w"))
    least = members.groupBy("node").agg(F.min("fqn").alias("community"))
    return members.join(least, "node").select("fqn", "community")
