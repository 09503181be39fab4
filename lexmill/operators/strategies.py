"""Retrieval strategies behind one contract: build tables once, answer a batch of questions."""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, substring_intent
from ..session import stored
from . import bm25, chunking, fusion, generation, hierarchy, ivf, knowledge, tree, vector
from .provider import STUB, Provider


class Strategy(ABC):
    """``retrieve`` returns question_id, chunk_id, score, rank."""

    name = ""

    def __init__(self, provider: Provider = STUB):
        self.provider = provider

    @abstractmethod
    def build(self, docs: DataFrame) -> None: ...

    @abstractmethod
    def retrieve(self, questions: DataFrame, k: int = 5) -> DataFrame: ...


class Bm25(Strategy):
    name = "bm25"

    def build(self, docs):
        self.load(chunking.sections(docs))

    def load(self, sections):
        """Use sections (doc_id, section_pos, chunk_id, content); blank ones are no passages."""
        held = sections.select("doc_id", "section_pos", "chunk_id", "content").filter(~is_blank(F.coalesce("content", F.lit(""))))
        self.names = held.select("doc_id", "section_pos", F.col("chunk_id").alias("name"))
        self.index = bm25.build(held)

    def retrieve(self, questions, k=5):
        found = bm25.top_k(self.index, questions, k).join(self.names, bm25.KEY)
        return found.select("question_id", F.col("name").alias("chunk_id"), "score", "rank")


class Vector(Strategy):
    """Embedded token windows; ``enrich`` puts the heading path before each.

    With ``lists`` set, windows are searched by inverted lists (0: as many as fit their number); else exactly.
    """

    name = "naive_vector"
    enrich = False
    lists: int | None = None

    def chunks(self, docs):
        windows = chunking.token_windows(docs)
        text = F.array_join("chunk", " ")
        if self.enrich:
            text = F.concat_ws("\n\n", F.concat(F.lit("## "), F.concat_ws(" > ", "lang", "source")), text)
        return windows.select(F.concat_ws("::", "doc_id", "chunk_no").alias("vec_id"), self.provider.embed(text).alias("embedding"), "doc_id")

    def build(self, docs):
        self.vectors = self.chunks(docs)
        self.index = None if self.lists is None else ivf.build(self.vectors, self.lists)

    def retrieve(self, questions, k=5, where=None):
        """``where`` is a condition on a window's ``vec_id`` or ``doc_id`` that holds before the search."""
        asked = questions.select(F.col("question_id").cast("string").alias("vec_id"), self.provider.embed(F.col("question")).alias("embedding"))
        if getattr(self, "index", None) is not None:
            found = ivf.search(self.index, asked, k, where=where, exclude_self=False)
        else:
            found = vector.cosine_top_k(self.vectors if where is None else self.vectors.filter(where), asked, k, exclude_self=False)
        names = questions.select("question_id", F.col("question_id").cast("string").alias("query_id"))
        return found.join(names, "query_id").select("question_id", F.col("vec_id").alias("chunk_id"), "score", "rank")


class ContextualVector(Vector):
    name = "contextual_vector"
    enrich = True


class QnaPairs(Vector):
    """Search over stored questions (``pairs``: pair_id, question, answer)."""

    name = "qna_pairs"

    def build(self, docs):
        self.pairs = docs
        self.vectors = docs.select(F.concat(F.lit("qna:"), F.col("pair_id")).alias("vec_id"), self.provider.embed(F.col("question")).alias("embedding"))

    def answers(self, questions):
        """question_id, answer, mode: the best match's stored answer as it is where the questions agree in any case, else rephrased."""
        best = self.retrieve(questions, 1).select("question_id", F.regexp_replace("chunk_id", "^qna:", "").alias("key"))
        stored_pairs = self.pairs.select(F.col("pair_id").cast("string").alias("key"), F.col("question").alias("stored"), F.col("answer").alias("held"))
        met = questions.select("question_id", "question").join(best, "question_id").join(stored_pairs, "key")
        same = F.lower(F.trim("question")) == F.lower(F.trim("stored"))
        prompt = F.concat_ws("\n", F.col("question"), F.col("held"))
        return met.select("question_id", F.when(same, F.col("held")).otherwise(self.provider.generate(prompt)).alias("answer"), F.when(same, "exact").otherwise("rephrase").alias("mode"))


class Raptor(Vector):
    """Windows, and above them one or two levels of summaries of clusters; every level is searched."""

    name = "raptor"

    def build(self, docs):
        windows = chunking.token_windows(docs)
        text = F.array_join("chunk", " ")
        chunks = windows.select(F.concat_ws("::", "doc_id", "chunk_no").alias("vec_id"), F.struct("doc_id", "chunk_no").alias("pos"), text.alias("text"), self.provider.embed(text).alias("embedding"))
        self.levels = hierarchy.levels(stored(chunks), self.provider)

    def retrieve(self, questions, k=5):
        traces = []
        for n, rows in enumerate(self.levels):
            self.vectors = rows.select(F.concat(F.lit(f"L{n}:"), "vec_id").alias("vec_id"), "embedding")
            traces.append(super().retrieve(questions, k))
        return generation.ranks_by_level(traces, k).select("question_id", "chunk_id", "score", "rank")


class PageIndex(Strategy):
    """A beam through the documents' section trees for each question, by the provider's choice at each level."""

    name = "pageindex"
    width, depth = 3, 4

    def build(self, docs):
        marks = F.regexp_extract("content", "^(#{1,6}) ", 1)
        lines = chunking.sections(docs).withColumn("level", F.when(marks != "", F.length(marks)).otherwise(1))
        sections = lines.select("doc_id", F.col("section_pos").alias("pos"), "level", F.left("content", F.lit(80)).alias("title"), "content", F.col("chunk_id").alias("node_id"))
        self.load(sections, levels=[1, 2, 3, 4, 5, 6])

    def load(self, sections, docs=None, levels=None):
        """Use parsed sections (doc_id, pos, level, title, content, node_id)."""
        self.tree = generation.summaries(tree.nested(sections, docs, levels), self.provider)

    def retrieve(self, questions, k=5):
        found = tree.asked(self.tree, questions, self.provider, self.depth, self.width).filter(F.col("rank") <= k)
        return found.select("question_id", F.concat(F.lit("pageindex:"), "node_id").alias("chunk_id"), F.lit(0.0).alias("score"), "rank")


class KnowledgeGraph(Strategy):
    """Templates over a graph, full text where they find nothing. Without a graph a question gets no chunks.

    ``load`` takes nodes(fqn, type, name, description) and edges(edge_id, source, target, type); ``build`` reads them
    out of documents with the provider.
    """

    name = "knowledge_graph"

    def load(self, nodes, edges):
        self.nodes, self.edges = nodes, edges

    def build(self, docs):
        sections = chunking.sections(docs).select("doc_id", F.col("chunk_id").alias("section_id"), F.lit("").alias("title"), "content")
        entities, relations = knowledge.extract_graph(sections, self.provider)
        nodes = entities.groupBy("type", "fqn").agg(F.min("name").alias("name"), F.min("description").alias("description"))
        edges = relations.select("source", "target", "type").distinct().withColumn("edge_id", F.concat_ws("|", "source", "type", "target"))
        self.load(nodes.select("fqn", "type", "name", "description"), edges)

    def retrieve(self, questions, k=5):
        found = knowledge.ask(self.edges, self.nodes, questions, provider=self.provider).filter(F.col("rank") <= k)
        return found.select("question_id", F.concat(F.lit("graph:"), "fqn").alias("chunk_id"), (1.0 / F.col("rank")).alias("score"), "rank")


class Hybrid(Strategy):
    """Factoid questions go to vectors, relational ones to the graph, others to both, merged by raw score.

    Without a graph the lexical leg stands in for it.
    """

    name = "hybrid"

    def build(self, docs):
        self.legs = [Vector(self.provider), Bm25(self.provider)]
        for leg in self.legs:
            leg.build(docs)

    def load(self, nodes, edges):
        """Use a graph instead of the lexical leg."""
        self.legs[1] = KnowledgeGraph(self.provider)
        self.legs[1].load(nodes, edges)

    def retrieve(self, questions, k=5):
        routed = questions.withColumn("intent", substring_intent(F.col("question")))
        vectors, other = self.legs
        with_graph = isinstance(other, KnowledgeGraph)
        dense = routed.filter("intent <> 'relational'") if with_graph else routed
        parts = [vectors.retrieve(dense, k), other.retrieve(routed.filter("intent <> 'factoid'"), k)]
        return fusion.merge_traces(parts, k).select("question_id", "chunk_id", "score", F.col("place").alias("rank"))


STRATEGIES: dict[str, type[Strategy]] = {s.name: s for s in (Bm25, Vector, ContextualVector, QnaPairs, Raptor, PageIndex, KnowledgeGraph, Hybrid)}


def strategy(name: str, provider: Provider = STUB) -> Strategy:
    """A strategy by name; of a plugin, ``module:Class``, or ``module:`` for the only strategy that the module defines."""
    if ":" in name:
        place, _, kind = name.partition(":")
        module = importlib.import_module(place)
        own = [c for c in vars(module).values() if isinstance(c, type) and issubclass(c, Strategy) and c.__module__ == module.__name__]
        if not kind and len(own) != 1:
            raise TypeError(f"{place} defines {len(own)} strategies; name one")
        found = getattr(module, kind) if kind else own[0]
        if not issubclass(found, Strategy):
            raise TypeError(f"{name} is not a Strategy")
        return found(provider)
    return STRATEGIES[name](provider)


def strategies(wanted: str = "all", provider: Provider = STUB) -> tuple[dict[str, Strategy], dict[str, str]]:
    """Strategies by name, all or one, and the errors of those that could not be made."""
    made, failed = {}, {}
    for name in STRATEGIES if wanted == "all" else [wanted]:
        try:
            made[name] = strategy(name, provider)
        except Exception as e:  # one that fails must not keep the others from running
            failed[name] = f"{type(e).__name__}: {e}"
    return made, failed


def parsed_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_pos, pos, chunk_id, node_id, level, title, content) of parsed documents (id, sections)."""
    rows = docs.select(F.col("id").alias("doc_id"), F.posexplode("sections").alias("section_pos", "s"))
    name = F.concat_ws("::", "doc_id", "s.id")
    return rows.select("doc_id", "section_pos", F.col("section_pos").alias("pos"), name.alias("chunk_id"), name.alias("node_id"), "s.level", "s.title", "s.content")


def lab_rows(built: dict[str, Strategy], questions: DataFrame, expected: DataFrame, k: int = 5, min_recall: float = 0.0) -> DataFrame:
    """Metric means of each built strategy over all questions, and whether its recall is ``below_floor``."""
    from . import ir

    rows = None
    for name, found in built.items():
        one = ir.summary(ir.metrics(found.retrieve(questions, k), expected, questions, k), digits=6).withColumn("strategy", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("below_floor", F.coalesce(F.col("recall"), F.lit(0.0)) < min_recall)


def retriever_lab(docs: DataFrame, questions: DataFrame, expected: DataFrame, names: list[str], k: int = 5, min_recall: float = 0.0) -> DataFrame:
    """``lab_rows`` of strategies by name, each built over the documents."""
    built = {name: strategy(name) for name in names}
    for found in built.values():
        found.build(docs)
    return lab_rows(built, questions, expected, k, min_recall)


def lab_report(rows: DataFrame, run_id: str, corpus: str, k: int = 5) -> DataFrame:
    """(pos, line): the Markdown report of a run, a row of three decimals for each strategy in order of name."""
    number = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)).cast("double"))
    cells = [F.col("strategy"), *(number(F.col(c)) for c in ("recall", "precision", "hit", "mrr", "ndcg")), F.col("questions").cast("string")]
    body = rows.select(F.lit(1).alias("part"), F.col("strategy").alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    top = [f"# Retriever Lab — run {run_id}", "", f"Top-k: {k}", "", f"## {corpus}", "", f"| Strategy | Recall@{k} | P@{k} | Hit@{k} | MRR | NDCG@{k} | n |", "|---|---|---|---|---|---|---|"]
    head = rows.sparkSession.createDataFrame([(0, f"{i:02}", line) for i, line in enumerate(top)], "part int, key string, line string")
    ordered = head.unionByName(body)
    return ordered.select((F.row_number().over(Window.orderBy("part", "key")) - 1).alias("pos"), "line")  # a line a strategy


def write_lab(rows: DataFrame, path: str, run_id: str, corpus: str, k: int = 5) -> bool:
    """Store a run as JSON lines and as a report in ``path/run_<id>``; whether no strategy is below the floor."""
    held = stored(rows)
    folder = f"{path.rstrip('/')}/run_{run_id}"
    held.withColumns({"corpus": F.lit(corpus), "top_k": F.lit(k)}).coalesce(1).write.mode("overwrite").json(f"{folder}/retriever_lab")
    lab_report(held, run_id, corpus, k).orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/retriever_lab_report")
    return held.filter("below_floor").isEmpty()
