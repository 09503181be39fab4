"""Questions over a property graph: query templates with their limits, full-text search, paths, communities, extraction.

Nodes are (fqn, type, name, description), edges (edge_id, source, target, type). Templates take a table of starting
points and answer all of them at once; limits hold for each start, with a total order, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored
from . import bm25
from .communities import communities  # noqa: F401  asked for with the other graph questions
from .graph import expand, unfinished
from .provider import STUB, Provider

# The universal schema.
NODE_TYPES = ["Topic", "Component", "Process", "Config", "Constraint"]
REL_TYPES = ["DEPENDS_ON", "CONTAINS", "CONNECTS_TO", "TRIGGERS", "CONFIGURES", "ALTERNATIVE_TO", "EXTENDS"]
# Edge types of a dependency chain and of a hierarchy.
CHAIN_TYPES = ["DEPENDS_ON", "CONNECTS_TO", "TRIGGERS", "EXTENDS", "CONFIGURES"]
HIERARCHY_TYPES = ["EXTENDS", "CONTAINS"]
# Limits of the templates.
HOP_LIMIT, CHAIN_LIMIT, SEARCH_LIMIT, PATH_LIMIT, SAMPLE_LIMIT = 50, 100, 20, 100, 500


def first_rows(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each ``by``; Spark cuts each partition's group to ``n`` before the shuffle."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def named(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    return rows.join(nodes.select("fqn", *(columns or ("name", "type"))), "fqn")


def multi_hop(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3, types: list[str] | None = None, limit: int = HOP_LIMIT) -> DataFrame:
    """Undirected trails over edges of ``types``: (start, fqn, name, type, hops, relationship_chain), nearest first."""
    allowed = edges.filter(F.col("type").isin(types or REL_TYPES))
    found = named(expand(allowed, starts, depth, directed=False, chain=True, enough=limit, among=nodes), nodes)
    return first_rows(found, "start", ["hops", "name", "fqn", F.array_join("path", ">")], limit).select("start", "fqn", "name", "type", "hops", "relationship_chain")


def dependency_chains(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 4, limit: int = CHAIN_LIMIT) -> DataFrame:
    """Directed chains of dependencies: (start, fqn, name, type, depth, chain)."""
    found = named(expand(edges.filter(F.col("type").isin(CHAIN_TYPES)), starts, depth, enough=limit, among=nodes), nodes)
    kept = first_rows(found, "start", ["hops", "fqn", F.array_join("path", ">")], limit)
    return kept.select("start", "fqn", "name", "type", F.col("hops").alias("depth"), F.col("path").alias("chain"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(here, there, type, direction, edge_id): every edge from both ends."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "type", F.lit("outgoing").alias("direction"), "edge_id")
    return out.unionByName(edges.select(F.col("target").alias("here"), F.col("source").alias("there"), "type", F.lit("incoming").alias("direction"), "edge_id"))


def comparison(edges: DataFrame, pairs: DataFrame, unique_too: bool = False) -> DataFrame:
    """For ``pairs(a, b)``: the neighbours they share, (a, b, shared, rel_to_a, rel_to_b), distinct.

    With ``unique_too``, also the neighbours of ``a`` that ``b`` has not; their ``rel_to_b`` is null.
    """
    ends = both_ways(edges)
    of_a = pairs.join(ends.select(F.col("here").alias("a"), F.col("there").alias("shared"), F.col("type").alias("rel_to_a"), F.col("edge_id").alias("edge_a")), "a")
    of_b = ends.select(F.col("here").alias("b"), F.col("there").alias("shared"), F.col("type").alias("rel_to_b"), F.col("edge_id").alias("edge_b"))
    both = of_a.join(of_b, ["b", "shared"]).filter("edge_a <> edge_b").select("a", "b", "shared", "rel_to_a", "rel_to_b")
    if unique_too:
        alone = of_a.join(of_b.select("b", "shared"), ["b", "shared"], "left_anti").select("a", "b", "shared", "rel_to_a", F.lit(None).cast("string").alias("rel_to_b"))
        both = both.unionByName(alone)
    return both.distinct()


def entity_lookup(edges: DataFrame, nodes: DataFrame, asked: DataFrame, neighbours: int = HOP_LIMIT) -> DataFrame:
    """The node that ``asked(key)`` names by fqn or by name in any case, with its first ``neighbours`` neighbours.

    One node answers a key: a match by fqn before one by name, then the least fqn.
    """
    by_fqn = asked.join(nodes, F.col("key") == F.col("fqn")).withColumn("via", F.lit(0))
    by_name = asked.join(nodes, F.lower("key") == F.lower("name")).withColumn("via", F.lit(1))
    found = first_rows(by_fqn.unionByName(by_name), "key", ["via", "fqn"], 1).select("key", "fqn", "name", "type")
    ends = both_ways(edges).join(nodes.select(F.col("fqn").alias("there"), F.col("name").alias("neighbour")), "there")
    near = found.join(ends.withColumnsRenamed({"here": "fqn", "type": "rel"}), "fqn", "left")
    kept = first_rows(near, "key", ["neighbour", "rel", "direction", "there"], neighbours)
    pairs = F.array_sort(F.collect_list(F.when(F.col("neighbour").isNotNull(), F.struct("neighbour", "rel", "direction"))))
    return kept.groupBy("key", "fqn", "name", "type").agg(pairs.alias("neighbours"))


def cross_reference(edges: DataFrame, nodes: DataFrame, starts: DataFrame, limit: int = HOP_LIMIT) -> DataFrame:
    ends = both_ways(edges).join(starts.select(F.col("fqn").alias("here")), "here").join(nodes.select(F.col("fqn").alias("there"), "name"), "there")
    return first_rows(ends, "here", ["direction", "name", "there", "type"], limit).select(F.col("here").alias("start"), F.col("there").alias("fqn"), "name", "type", "direction")


def hierarchy(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 5, limit: int = HOP_LIMIT) -> DataFrame:
    """Ancestors (the node itself at depth 0) and descendants over hierarchy edges, nearest first, distinct."""
    allowed = edges.filter(F.col("type").isin(HIERARCHY_TYPES))
    itself = starts.select(F.col("fqn").alias("start"), "fqn", F.lit(0).alias("depth"))
    up = expand(allowed, starts, depth, backwards=True, enough=limit, among=nodes).select("start", "fqn", F.col("hops").alias("depth"))
    down = expand(allowed, starts, depth, enough=limit, among=nodes).select("start", "fqn", F.col("hops").alias("depth"))
    found = named(itself.unionByName(up).unionByName(down).distinct(), nodes, "name")
    return first_rows(found, "start", ["depth", "fqn"], limit).select("start", "fqn", "name", "depth")


def fulltext_index(nodes: DataFrame) -> bm25.Bm25Index:
    """An index over name, description and fqn; punctuation divides words."""
    text = F.regexp_replace(F.concat_ws(" ", "name", "description", "fqn"), "[^\\p{L}\\p{N}]+", " ")
    return bm25.build(nodes.select(F.col("fqn").alias("doc_id"), F.lit(0).alias("section_pos"), F.col("fqn").alias("chunk_id"), text.alias("content")))


def fulltext(index: bm25.Bm25Index, questions: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(question_id, fqn, score, rank) of nodes that share a word with the question."""
    asked = questions.select("question_id", F.regexp_replace("question", "[^\\p{L}\\p{N}]+", " ").alias("question"))
    scored = bm25.scores(index, asked).filter("score > 0")
    by = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= limit).select("question_id", F.col("doc_id").alias("fqn"), "score", "rank")


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = 4, limit: int = PATH_LIMIT) -> DataFrame:
    """Directed paths without a repeated node, shortest first, at most ``limit`` a start: (start, fqn, hops, path).

    A start that has ``limit`` different ends already goes no further, as longer paths stand behind.
    """
    steps = edges.select(F.col("source").alias("here"), F.col("target").alias("there")).distinct()
    front = starts.select(F.col("fqn").alias("start"), "fqn", F.array("fqn").alias("path"))
    found = None
    for hops in range(1, depth + 1):
        front = front.join(steps, F.col("fqn") == F.col("here")).filter(~F.array_contains("path", F.col("there")))
        front = front.select("start", F.col("there").alias("fqn"), F.concat("path", F.array("there")).alias("path"))
        one = stored(front.withColumn("hops", F.lit(hops)))
        found = one if found is None else found.unionByName(one)
        front = unfinished(one, found, limit).drop("hops")
        if front.isEmpty():
            break
    return first_rows(found, "start", ["hops", F.array_join("path", ">")], limit).select("start", "fqn", "hops", "path")


def sample(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """What a viewer shows: the first ``limit`` nodes (500 at most), and of the first twice as many edges those among them."""
    limit = min(limit, SAMPLE_LIMIT)
    some = nodes.orderBy("fqn").limit(limit)
    first = edges.orderBy("source", "type", "target").limit(2 * limit).select("source", "type", "target")
    ends = some.select("fqn")
    return some, first.join(ends.withColumnRenamed("fqn", "source"), "source", "left_semi").join(ends.withColumnRenamed("fqn", "target"), "target", "left_semi")


def merge_counts(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys of an upsert are created and how many updated: one row."""
    wanted = rows.select(*keys).distinct()
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    return wanted.join(known, keys, "left").agg(F.count_if(F.col("_known").isNull()).alias("created"), F.count_if(F.col("_known").isNotNull()).alias("updated"))


def json_properties(rows: DataFrame) -> DataFrame:
    """Maps, structs and arrays of them as JSON strings; an empty map is the empty string."""
    out = []
    for field in rows.schema:
        kind = field.dataType.typeName()
        inner = field.dataType.elementType.typeName() if kind == "array" else ""
        if kind == "map":
            out.append(F.when(F.size(field.name) > 0, F.to_json(field.name)).otherwise("").alias(field.name))
        elif kind == "struct" or inner in ("map", "struct"):
            out.append(F.to_json(field.name).alias(field.name))
        else:
            out.append(F.col(field.name))
    return rows.select(*out)


def duplicated_keys(nodes: DataFrame) -> DataFrame:
    """(type, fqn, n) that break the store's uniqueness: none in a table that upserts wrote."""
    return nodes.groupBy("type", "fqn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def graph_context(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a question out of ``records(question_id, rank, fqn, name, type, chain)``: its nodes, and path names.

    A node counts where it comes first; path names (ten at most) are those of records with a chain.
    """
    first = records.groupBy("question_id", "fqn").agg(F.min(F.struct("rank", "name", "type")).alias("r"))
    kept = first_rows(first, "question_id", ["r.rank", "fqn"], CHAIN_LIMIT)
    seen = F.transform(F.array_sort(F.collect_list(F.struct(F.col("r.rank"), "fqn", F.col("r.name"), F.col("r.type")))), lambda x: F.struct(x["fqn"].alias("id"), x["name"], x["type"]))
    per = kept.groupBy("question_id").agg(seen.alias("nodes"))
    chained = first_rows(records.filter(F.size("chain") > 0), "question_id", ["rank", "fqn"], 10)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return per.join(chained.groupBy("question_id").agg(names.alias("query_path")), "question_id", "left")


def mock_context(questions: DataFrame) -> DataFrame:
    """What every question gets where no graph is loaded: two nodes, one edge, flagged as a mock."""
    # The mock graph.
    nodes = [("example-topic", "Example Topic", "Topic"), ("example-component", "Example Component", "Component")]
    edge = ("example-component", "example-topic", "DEPENDS_ON")
    return questions.select(
        "question_id",
        F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(t).alias("type")) for i, n, t in nodes]).alias("nodes"),
        F.array(F.struct(*[F.lit(v).alias(k) for k, v in zip(("source", "target", "type"), edge)])).alias("edges"),
        F.array(*[F.lit(i) for i, _, _ in nodes]).alias("query_path"),
        F.lit(True).alias("mock"),
    )


def valid_extraction(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of known types, and relations of known types whose ends are both entities of the same section."""
    kept = entities.filter(F.col("type").isin(NODE_TYPES))
    ends = kept.select("section_id", "fqn").distinct()
    linked = relations.filter(F.col("type").isin(REL_TYPES))
    for end in ("source", "target"):
        linked = linked.join(ends.withColumnRenamed("fqn", end), ["section_id", end], "left_semi")
    return kept, linked


ENTITY = "id string, name string, fqn string, type string, description string"
RELATION = "source_fqn string, target_fqn string, type string"


def extraction_prompt(title: Column, content: Column) -> Column:
    return F.concat(F.lit(f"Entity types: {', '.join(NODE_TYPES)}\nRelationship types: {', '.join(REL_TYPES)}\n\n# "), title, F.lit("\n\n"), content)


def extract_graph(sections: DataFrame, provider: Provider = STUB) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that a provider reads out of ``sections(doc_id, section_id, title, content)``, valid ones only.

    An answer that is no JSON object gives none.
    """
    answer = F.from_json(tx.opened_fence(provider.generate(extraction_prompt(F.col("title"), F.col("content")))), f"entities array<struct<{_struct(ENTITY)}>>, relationships array<struct<{_struct(RELATION)}>>")
    read = sections.select("doc_id", "section_id", answer.alias("a"))
    entities = read.select("doc_id", "section_id", F.explode("a.entities").alias("e")).select("doc_id", "section_id", "e.*")
    relations = read.select("doc_id", "section_id", F.explode("a.relationships").alias("r")).select("doc_id", "section_id", F.col("r.source_fqn").alias("source"), F.col("r.target_fqn").alias("target"), "r.type")
    return valid_extraction(entities, relations)


def _struct(columns: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in columns.split(", "))


def without_absorbed(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities that no merge (absorbed, canonical) took into another, with the names they took as ``aliases``."""
    aliases = merges.groupBy(F.col("canonical").alias("name")).agg(F.array_sort(F.collect_set("absorbed")).alias("aliases"))
    return entities.join(merges.select(F.col("absorbed").alias("name")).distinct(), "name", "left_anti").join(aliases, "name", "left")


def ask(edges: DataFrame, nodes: DataFrame, questions: DataFrame, limit: int = HOP_LIMIT, provider: Provider = STUB) -> DataFrame:
    """(question_id, fqn, rank, via): each question by the template its words ask for, else, and if that finds nothing, by full text.

    The first mention of a question is where its template starts, the second what a comparison is with.
    """
    mentions = tx.entity_mentions(F.col("question"))
    asked = questions.select("question_id", "question", tx.graph_intent(F.col("question")).alias("intent"), F.get(mentions, F.lit(0)).alias("a"), F.get(mentions, F.lit(1)).alias("b"))
    found: list[DataFrame] = []

    def add(intent: str, run: Callable[[DataFrame], DataFrame], start: str, fqn: str, order: list[str]) -> None:
        mine = asked.filter((F.col("intent") == intent) & F.col("a").isNotNull())
        rows = mine.select("question_id", F.col("a").alias(start)).join(run(mine).withColumnRenamed(fqn, "_fqn"), start)
        by = Window.partitionBy("question_id").orderBy(*[F.col(c) for c in order], "_fqn")
        found.append(rows.groupBy("question_id", "_fqn").agg(*[F.min(c).alias(c) for c in order]).select("question_id", F.col("_fqn").alias("fqn"), F.row_number().over(by).cast("long").alias("rank"), F.lit(intent).alias("via")))

    starts = lambda mine: mine.select(F.col("a").alias("fqn")).distinct()
    add("multi_hop", lambda m: multi_hop(edges, nodes, starts(m), limit=limit), "start", "fqn", ["hops"])
    add("dependency", lambda m: dependency_chains(edges, nodes, starts(m)), "start", "fqn", ["depth"])
    add("entity_lookup", lambda m: entity_lookup(edges, nodes, m.select(F.col("a").alias("key")).distinct()).select("key", "fqn", "name"), "key", "fqn", ["name"])
    add("comparison", lambda m: comparison(edges, m.filter("b is not null").select("a", "b").distinct()).select("a", "shared", "rel_to_a"), "a", "shared", ["rel_to_a"])
    by_template = found[0]
    for more in found[1:]:
        by_template = by_template.unionByName(more)
    rest = questions.join(by_template.select("question_id").distinct(), "question_id", "left_anti")
    searched = fulltext(fulltext_index(nodes), rest).select("question_id", "fqn", "rank", F.lit("fulltext").alias("via"))
    return by_template.filter(F.col("rank") <= limit).unionByName(searched)
