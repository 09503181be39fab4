"""Stages that a language model fills: summaries, pairs, re-ranking, labels. Without one the provider's stub stands in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored
from .provider import STUB, Provider

# What is cut, and where.
SUMMARY_FROM, SUMMARY_CHARS, CLUSTER_TEXTS, RERANKED, DEFAULT_SCORE = 100, 4000, 20, 10, 0.5
PAIR_CODE, PAIR_CHARS, EXCERPT_FROM, EXCERPT_CHARS = 500, 2000, 50, 2000


def summaries(tree: DataFrame, provider: Provider = STUB) -> DataFrame:
    """``tree(node_id, parent_id, title, content[, pos])`` with ``summary``, from the leaves up.

    A leaf of more than 100 characters is summarised (its first 4000), a shorter one stands for itself, an empty one is
    named by its title. An inner node is summarised from the titles and summaries of its children that have a title, in
    order of ``pos`` (else of their ids), or named as a container. Each step does all nodes whose children are done, for
    as many levels as there are. Nodes in a cycle, which no step can reach, have no summary. Of a tree with the columns
    ``level`` (of a parent one less) and ``leaf``, as ``tree.nested`` makes it, each step does a level, and nothing else is read.
    """
    order = "pos" if "pos" in tree.columns else "node_id"
    content = F.coalesce("content", F.lit(""))
    leaf = F.when(F.length(content) > SUMMARY_FROM, provider.summarize(F.left(content, F.lit(SUMMARY_CHARS)))).when(content != "", content).otherwise(F.concat(F.lit("Section: "), F.col("title")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id", F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("summary")).alias("line")))), lambda x: x["line"])
    text = F.when(F.col("below").isNotNull(), provider.summarize(F.col("below"))).otherwise(F.concat(F.lit("Container section: "), F.col("title")))
    if {"level", "leaf"} <= set(tree.columns):
        return _levelled(tree, order, leaf, lines, text)
    tree = stored(tree)  # read at each level
    # What is carried from level to level is without contents.
    rest = tree.select("node_id", "parent_id", "title", F.col(order).alias("at"))
    made = rest.columns + ["summary"]
    done, children = None, None
    while True:
        parents = rest.select(F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct()
        if done is None:
            step = stored(tree.join(parents, "node_id", "left_anti").withColumn("at", F.col(order)).withColumn("summary", leaf).select(made))
        else:
            below = children.filter("title <> ''").groupBy(F.col("parent_id").alias("node_id")).agg(F.array_join(lines, "\n").alias("below"))
            step = stored(rest.join(parents, "node_id", "left_anti").join(below, "node_id", "left").withColumn("summary", text).select(made))  # a level's summaries are asked for once
        if step.isEmpty():
            break
        done = step if done is None else done.unionByName(step)
        rest = stored(rest.join(step.select("node_id"), "node_id", "left_anti"))
        open_ = rest.select(F.col("node_id").alias("parent_id"))
        children = (step if children is None else children.unionByName(step)).join(open_, "parent_id", "left_semi")
    if done is None:
        return tree.withColumn("summary", F.lit(None).cast("string"))
    return tree.join(done.select("node_id", "summary"), "node_id", "left")


def _levelled(tree: DataFrame, order: str, leaf, lines, text) -> DataFrame:
    """``summaries`` of a tree whose levels and leaves are known; its inner nodes have no content."""
    columns = tree.columns + ["summary"]
    nodes = stored(tree.withColumn("summary", F.when(F.col("leaf"), leaf)))
    deepest = nodes.agg(F.max("level").alias("level")).first()["level"]
    if deepest is None:
        return nodes
    light = [c for c in tree.columns if c != "content"]
    found, step = nodes.filter("leaf"), None
    for level in range(deepest - 1, -1, -1):
        named = ["parent_id", "node_id", "title", "summary", F.col(order).alias("at")]
        children = nodes.filter(F.col("leaf") & (F.col("level") == level + 1)).select(named)
        children = children if step is None else children.unionByName(step.select(named))
        below = children.filter("title <> ''").groupBy(F.col("parent_id").alias("node_id")).agg(F.array_join(lines, "\n").alias("below"))
        inner = nodes.filter(~F.col("leaf") & (F.col("level") == level)).select(light)
        step = stored(inner.join(below, "node_id", "left").withColumn("summary", text).select(*light, "summary"))  # a level's summaries are asked for once
        found = found.unionByName(step.withColumn("content", F.lit(None).cast("string")).select(columns))
    return found.select(columns)


def cluster_texts(rows: DataFrame, between: str = "\n\n") -> DataFrame:
    """(cluster, text) of ``rows(cluster, pos, text)``: the first 20 texts of each cluster in order, joined."""
    by = Window.partitionBy("cluster").orderBy("pos")
    first = rows.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= CLUSTER_TEXTS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), between)
    return first.groupBy("cluster").agg(joined.alias("text"), F.count(F.lit(1)).alias("n_texts"))


def ranks_by_level(traces: list[DataFrame], k: int = 5) -> DataFrame:
    """Traces of levels one after the other: each keeps its ``k`` best, ranks go on from level to level by no new sort."""
    rows = None
    for level, trace in enumerate(traces):
        one = trace.filter(F.col("rank") <= k).withColumn("level", F.lit(level))
        rows = one if rows is None else rows.unionByName(one)
    by = Window.partitionBy("question_id").orderBy("level", "rank", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(by).cast("long"))


def reranked(retrieved: DataFrame, questions: DataFrame, passages: DataFrame, provider: Provider = STUB, k: int = 5) -> DataFrame:
    """The first ten passages of each question by a model's score (0.5 where it gives none), best first, cut to ``k``."""
    held = retrieved.filter(F.col("rank") <= RERANKED).join(questions.select("question_id", "question"), "question_id").join(passages.select("chunk_id", "text"), "chunk_id")
    scored = held.withColumn("score", F.coalesce(provider.rerank(F.col("question"), F.col("text")).cast("double"), F.lit(DEFAULT_SCORE)))
    by = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank", "chunk_id")
    return scored.withColumn("place", F.row_number().over(by).cast("long")).filter(F.col("place") <= k).select("question_id", "chunk_id", "score", F.col("place").alias("rank"))


def pair_prompts(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, prompt): heading, content and the first code block (500 characters), 2000 characters in all."""
    code = F.get("code_blocks", F.lit(0))["code"]
    body = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("title")), F.col("content"), F.left(code, F.lit(PAIR_CODE)))
    return sections.select("doc_id", "section_id", F.left(body, F.lit(PAIR_CHARS)).alias("prompt"))


def generated_pairs(sections: DataFrame, provider: Provider = STUB) -> DataFrame:
    """(pair_id, doc_id, section_id, question, answer) that a provider's JSON arrays hold, in their order."""
    reply = F.from_json(tx.greedy_json_array(tx.opened_fence(provider.generate(F.col("prompt")))), "array<struct<question: string, answer: string>>")
    pairs = pair_prompts(sections).select("doc_id", "section_id", F.posexplode(reply).alias("pos", "p")).filter("p.question is not null and p.answer is not null")
    return pairs.select(F.concat_ws("::", "section_id", "pos").alias("pair_id"), "doc_id", "section_id", "p.question", "p.answer")


def judged_labels(candidates: DataFrame, provider: Provider = STUB, skip: DataFrame | None = None) -> DataFrame:
    """(question_id, expected_id): what a judge picks of ``candidates(question_id, question, rank, chunk_id, text)``.

    The judge sees a question's candidates (20 at most) in order and replies with a JSON array of ids; ids that are no
    candidates are dropped. Questions in ``skip`` have labels already.
    """
    asked = candidates if skip is None else candidates.join(skip.select("question_id").distinct(), "question_id", "left_anti")
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    per = asked.filter(F.col("rank") <= 20).groupBy("question_id", "question").agg(listed.alias("c"))
    passages = F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["chunk_id"], F.lit("] "), x["text"])), "\n")
    reply = F.from_json(tx.balanced_json_array(provider.judge(passages, F.col("question"))), "array<string>")
    valid = F.filter(reply, lambda x: F.array_contains(F.transform("c", lambda y: y["chunk_id"]), x))
    return per.select("question_id", F.explode(F.array_distinct(valid)).alias("expected_id"))


def excerpts(sections: DataFrame, max_chars: int = 50_000) -> list[str]:
    """Excerpts for question generation, within a budget of characters.

    ``sections(doc_pos, pos, doc_title, title, content)`` in order: those of 50 characters or more, cut to 2000. A
    document stops at the first that would exceed the budget; all stops when the budget is spent, or too small for
    any. The rows come to the driver one partition at a time and no more than the budget is kept.
    """
    body = F.concat(F.lit("["), F.col("doc_title"), F.lit(" / "), F.col("title"), F.lit("]\n"), F.left("content", F.lit(EXCERPT_CHARS)))
    rows = sections.filter(F.length("content") >= EXCERPT_FROM).select("doc_pos", "pos", body.alias("excerpt")).orderBy("doc_pos", "pos")
    taken: list[str] = []
    total, stopped = 0, None
    for row in rows.toLocalIterator():
        if total >= max_chars or max_chars - total < EXCERPT_FROM:
            break
        if row["doc_pos"] == stopped:
            continue
        if total + len(row["excerpt"]) > max_chars:
            stopped = row["doc_pos"]
            continue
        taken.append(row["excerpt"])
        total += len(row["excerpt"])
    return taken


def probed_slugs(sections: DataFrame) -> DataFrame:
    """(doc_id, pos, section_id) of ``sections(doc_id, pos, slug)``: a slug seen before gets -1, -2, ... until it is new.

    The fold is over a document's own array, as a literal title ``x-1`` may stand in the way.
    """
    ordered = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slug"))).alias("s"))

    def step(seen, x):
        free = F.filter(F.transform(F.sequence(F.lit(1), F.size(seen) + 1), lambda n: F.concat(x["slug"], F.lit("-"), n.cast("string"))), lambda c: ~F.array_contains(seen, c))
        return F.concat(seen, F.array(F.when(F.array_contains(seen, x["slug"]), F.get(free, F.lit(0))).otherwise(x["slug"])))

    named = F.aggregate("s", F.array().cast("array<string>"), step)
    return ordered.select("doc_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x["pos"]).alias("pos"), named.alias("section_id"))).alias("z")).select("doc_id", "z.pos", "z.section_id")
