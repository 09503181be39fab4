"""Property-graph tables and traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .centrality import betweenness, hubs  # noqa: F401  named with the other graph measures


def tpch_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (fqn, type, name) and edges (edge_id, source, target, type) of regions, nations, customers and suppliers."""

    def nodes(t: str, kind: str, key: str, name: str) -> DataFrame:
        return tables[t].select(F.concat_ws(":", F.lit(kind), F.col(key)).alias("fqn"), F.lit(kind).alias("type"), F.col(name).alias("name"))

    def edges(t: str, kind: str, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
        s, e = F.concat_ws(":", F.lit(source[0]), F.col(source[1])), F.concat_ws(":", F.lit(target[0]), F.col(target[1]))
        return tables[t].select(F.concat_ws("|", s, F.lit(kind), e).alias("edge_id"), s.alias("source"), e.alias("target"), F.lit(kind).alias("type"))

    all_nodes = (
        nodes("region", "region", "r_regionkey", "r_name")
        .unionByName(nodes("nation", "nation", "n_nationkey", "n_name"))
        .unionByName(nodes("supplier", "supplier", "s_suppkey", "s_name"))
        .unionByName(nodes("customer", "customer", "c_custkey", "c_name"))
    )
    all_edges = (
        edges("nation", "CONTAINS", ("region", "n_regionkey"), ("nation", "n_nationkey"))
        .unionByName(edges("supplier", "CONTAINS", ("nation", "s_nationkey"), ("supplier", "s_suppkey")))
        .unionByName(edges("customer", "CONTAINS", ("nation", "c_nationkey"), ("customer", "c_custkey")))
    )
    return all_nodes, all_edges


def upsert_nodes(rows: DataFrame, order_col: str) -> DataFrame:
    """One row for each (type, fqn): the last wins."""
    by = Window.partitionBy("type", "fqn").orderBy(F.desc(order_col))
    return rows.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, one for each (source, type, target)."""
    ends = nodes.select("fqn").distinct()
    known = edges.join(ends.withColumnRenamed("fqn", "source"), "source", "left_semi").join(ends.withColumnRenamed("fqn", "target"), "target", "left_semi")
    return known.dropDuplicates(["source", "type", "target"])


def expand(edges: DataFrame, start: DataFrame, depth: int, directed: bool = True, backwards: bool = False, chain: bool = False, enough: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """Trails from ``start(fqn)`` up to ``depth`` edges: (start, fqn, hops, path); no edge repeats in a trail.

    With ``chain``, ``relationship_chain`` has the types of the edges in order.
    One join for each hop against the edge table. With ``enough``, a start that has so many different (fqn, hops) among the
    nodes ``among`` goes no further: rows with more hops stand behind those it has. A hub's trails are then not followed.
    """
    kind = F.col("type") if chain else F.lit("")
    forward = edges.select("edge_id", F.col("source").alias("here"), F.col("target").alias("there"), kind.alias("kind"))
    back = edges.select("edge_id", F.col("target").alias("here"), F.col("source").alias("there"), kind.alias("kind"))
    steps = back if backwards else forward if directed else forward.unionByName(back)
    front = start.select(F.col("fqn").alias("start"), "fqn", F.lit(0).alias("hops"), F.array("fqn").alias("path"), F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("relationship_chain"))
    found = None
    for _ in range(depth):
        front = front.join(steps, front.fqn == steps.here).filter(~F.array_contains("used", F.col("edge_id"))).select(
            "start",
            F.col("there").alias("fqn"),
            (F.col("hops") + 1).alias("hops"),
            F.concat("path", F.array("there")).alias("path"),
            F.concat("used", F.array("edge_id")).alias("used"),
            F.concat("relationship_chain", F.array("kind")).alias("relationship_chain"),
        )
        if enough is not None:
            front = stored(front)
        found = front if found is None else found.unionByName(front)
        if enough is not None:
            front = unfinished(front, found, enough, among)
            if front.isEmpty():
                break
    return found.drop("used") if chain else found.drop("used", "relationship_chain")


def unfinished(front: DataFrame, found: DataFrame, enough: int, among: DataFrame | None = None) -> DataFrame:
    """The rows of ``front`` whose start has fewer than ``enough`` different (fqn, hops) in ``found``."""
    known = found.select("start", "fqn", "hops").distinct()
    known = known if among is None else known.join(among.select("fqn").distinct(), "fqn", "left_semi")
    full = known.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select("start")
    return stored(front.join(full, "start", "left_anti").select(front.columns))


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """For each node reached from two or more sources: how many sources it is shared by."""
    return edges.groupBy("target").agg(F.countDistinct("source").alias("sources")).filter("sources > 1")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("fqn"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("target").alias("fqn"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    return ends.groupBy("fqn").agg(F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))


def cross_references(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Each node's neighbours with the direction of the edge."""
    out = edges.select(F.col("source").alias("fqn"), F.col("target").alias("other"), "type", F.lit("out").alias("direction"))
    back = edges.select(F.col("target").alias("fqn"), F.col("source").alias("other"), "type", F.lit("in").alias("direction"))
    return out.unionByName(back).join(names.select(F.col("fqn").alias("other"), F.col("name").alias("other_name")), "other")
