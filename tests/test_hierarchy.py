"""Trees, their summaries, the beam for a question and the hierarchy of summaries, against recursion and plain loops."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import generation, hierarchy, strategies, tree
from lexmill.operators.provider import STUB, shared_words
from lexmill.plans.catalogue_more import QUERIES
from tests.test_operators import SF

SECTIONS = "doc_id string, pos long, level int, title string, content string"
MODEL = dataclasses.replace(STUB, choose=shared_words)


def made(seed, docs=6, most=30):
    rng = random.Random(seed)
    words = "lambda queue bucket role policy node cluster job table key".split()
    rows = []
    for d in range(docs):
        for pos in range(rng.randrange(1, most)):
            content = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40])))
            rows.append((f"d{d}", pos * 2, rng.choice([1, 1, 2, 2, 3, 5]), rng.choice(words + [""]), content))
    return rows


class Node:
    def __init__(self, id, doc, title, level, content, order):
        self.id, self.doc, self.title, self.level, self.content, self.order, self.children = id, doc, title, level, content, order, []


def stacked(rows, docs):
    """Each document's tree by a stack, node for node."""
    roots = []
    for doc, title in docs:
        mine = sorted(r for r in rows if r[0] == doc)
        root = Node(doc, doc, title, 0, None if mine else "", -1)
        stack = [root]
        for _, pos, level, name, content in mine:
            stack = stack[:level]
            while len(stack) < level:
                new = Node(None, doc, "", len(stack), None, pos)
                stack[-1].children.append(new)
                stack.append(new)
            node = Node(f"{doc}::{pos}", doc, name, level, content or "", pos)
            stack[-1].children.append(node)
            stack.append(node)
        roots.append(root)
    return roots


def flat(node, parent=None):
    """(title, level, content, order, path of orders) of every node below."""
    path = (parent or ()) + ((node.level, node.order),)
    yield path, node.title, None if node.children else node.content
    for c in node.children:
        yield from flat(c, path)


def test_nested_trees_equal_a_stack(spark):
    for seed in (1, 2):
        rows = made(seed)
        docs = [(f"d{d}", f"T{d}") for d in range(8)]
        got = tree.nested(spark.createDataFrame(rows, SECTIONS).repartition(3), spark.createDataFrame(docs, "doc_id string, title string")).collect()
        by_id = {r.node_id: r for r in got}
        assert len(by_id) == len(got)

        def path(r, by_id=by_id):
            return (path(by_id[r.parent_id]) if r.parent_id else ()) + ((r.level, r.pos),)

        found = sorted((r.doc_id, path(r), r.title, r.content) for r in got)
        want = sorted(((root.doc, *row) for root in stacked(rows, docs) for row in flat(root)), key=lambda r: r[:2])
        assert sorted(found, key=lambda r: r[:2]) == want
    assert any(r.synthetic for r in got) and tree.nested(spark.createDataFrame([], SECTIONS)).count() == 0


def test_long_documents_end(spark):
    rows = spark.range(200_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"), (F.col("id") % 4 + 1).cast("int").alias("level"))
    built = tree.build(rows)
    assert built.filter("parent_id is null").count() == 50_000 and built.filter("level = 3 and parent_id = concat('d::', pos - 1)").count() == 50_000


def summarised(node):
    for c in node.children:
        summarised(c)
    if not node.children:
        text = node.content or ""
        node.summary = text[:200] if len(text) > 100 else text or f"Section: {node.title}"
    else:
        lines = "\n".join(f"- {c.title}: {c.summary}" for c in sorted(node.children, key=lambda c: c.order) if c.title)
        node.summary = lines[:200] if lines else f"Container section: {node.title}"


def traversed(candidates, question, width, depth, level=0):
    if not candidates or level >= depth or all(not c.children for c in candidates):
        return candidates
    words = set(question.lower().split())
    best = sorted(candidates, key=lambda c: -len(words & set(f"{c.title} {c.summary}".lower().split())))[:width]
    ahead = [x for c in best if c.children for x in sorted(c.children, key=lambda x: x.order)]
    return [c for c in best if not c.children] + traversed(ahead, question, width, depth, level + 1)


@pytest.mark.parametrize("width,depth", [(3, 4), (2, 2), (5, 9)])
def test_beam_for_each_question_equals_recursion(spark, width, depth):
    rows = made(7)
    docs = [(f"d{d}", f"title of d{d}") for d in range(7)]
    roots = stacked(rows, docs)
    for r in roots:
        summarised(r)
    asked = [("q1", "which queue has a role"), ("q2", "table key"), ("q3", "nothing here"), ("q4", "lambda lambda policy")]
    nodes = generation.summaries(tree.nested(spark.createDataFrame(rows, SECTIONS), spark.createDataFrame(docs, "doc_id string, title string")), MODEL)
    found = tree.asked(nodes, spark.createDataFrame(asked, "question_id string, question string"), MODEL, depth, width).collect()
    answers = {}
    for q, question in asked:
        got = [(r.doc_id, r.title, r.content) for r in sorted((r for r in found if r.question_id == q), key=lambda r: r["rank"])]
        want = traversed(roots, question, width, depth)
        assert got == [(n.doc, n.title, None if n.children else n.content) for n in want]
        answers[q] = tuple(got)
    assert len(set(answers.values())) > 1


def test_leaves_and_summaries_of_deep_chains(spark):
    """More levels than any fixed depth."""
    rows = [(f"n{i:02}", f"n{i - 1:02}" if i else None, f"t{i}", "x" if i == 29 else "") for i in range(30)]
    frame = spark.createDataFrame(rows, "node_id string, parent_id string, title string, content string")
    assert {r.leaves for r in tree.leaves_below(frame.select("node_id", "parent_id")).collect()} == {1}
    got = {r.node_id: r.summary for r in generation.summaries(frame).collect()}
    assert len(got) == 30 and got["n29"] == "x" and got["n28"] == "- t29: x" and got["n00"].startswith("- t1: - t2: ")
    loop = spark.createDataFrame([("a", "b", "A", ""), ("b", "a", "B", ""), ("c", None, "C", "")], "node_id string, parent_id string, title string, content string")
    assert {r.node_id: r.summary for r in generation.summaries(loop).collect()} == {"a": None, "b": None, "c": "Section: C"}


def kmeans(vectors, k, rounds=15):
    x = np.array(vectors, float)
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    if len(x) <= k:
        return list(range(len(x)))
    centre = [x[int(i)] for i in np.linspace(0, len(x) - 1, k, dtype=int)]
    found = [0] * len(x)
    for _ in range(rounds):
        new = [max(range(k), key=lambda c: (float(v @ centre[c]), -c)) for v in x]
        if new == found:
            break
        found = new
        for c in range(k):
            members = [v for v, f in zip(x, found) if f == c]
            if members:
                mean = np.mean(members, axis=0)
                centre[c] = mean / (np.linalg.norm(mean) + 1e-8)
    return found


def test_hierarchy_equals_plain_loops(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words[i % 5 * 6 : i % 5 * 6 + 8]) for _ in range(30))) for i in range(140)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = strategies.strategy("raptor")
    found.build(frame)
    assert len(found.levels) == 3
    texts, ids = [t for _, t in docs], [f"{i}::0" for i, _ in docs]
    for n, rows in enumerate(found.levels):
        got = {r.vec_id: r for r in rows.collect()}
        assert {i: r.text for i, r in got.items()} == dict(zip(ids, texts))
        if n == len(found.levels) - 1:
            break
        cluster = kmeans([got[i].embedding for i in ids], max(1, len(ids) // 5))
        members = {}
        for i, c in enumerate(cluster):
            members.setdefault(c, []).append(texts[i])
        ids = [f"l{n + 1}_cluster_{c}" for c in members]
        texts = ["\n\n---\n\n".join(m[:20])[:200] for m in members.values()]
    questions = spark.createDataFrame([("q", docs[7][1])], "question_id string, question string")
    top = found.retrieve(questions, 4).orderBy("rank").collect()
    assert [r.chunk_id[:3] for r in top] == ["L0:"] * 4 + ["L1:"] * 4 + ["L2:"] * 4 and top[0].chunk_id == "L0:7::0"


def test_cells_are_small_and_whole(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=6).tolist() for _ in range(300)] + [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0]] * 200
    rows = [(i, (i,), v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, pos struct<i:long>, embedding array<double>")
    found = hierarchy.cells(frame, limit=40, fan=4).groupBy("cell").count().collect()
    assert sum(r["count"] for r in found) == 500 and max(r["count"] for r in found) <= 40
    rows = frame.withColumn("text", F.concat(F.lit("t"), "vec_id"))
    above = hierarchy.level(rows, "l1", limit=40).collect()
    assert sum(r.n_texts for r in above) == 500 and 70 <= len(above) <= 140
    assert len(hierarchy.levels(rows.limit(0), STUB)) == 2


@pytest.mark.parametrize("name", ["summary_hierarchy", "hierarchy_topk", "tree_beam_by_question", "tree_summaries"])
def test_registered_queries_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name == "summary_hierarchy":
        sizes = {n: sum(r.n_texts for r in rows if r.level == n) for n in (0, 1, 2)}
        assert sizes[0] == sizes[1] and sizes[2] == sum(r.level == 1 for r in rows)
    if name == "tree_beam_by_question":
        assert len({r.node_id for r in rows}) > 5


def test_beam_sorts_no_texts(spark, monkeypatch):
    """Questions are paired with all roots, so what is ranked and written there is without titles and summaries."""
    written = []
    monkeypatch.setattr(tree, "stored", lambda df: written.append(df.columns) or df.localCheckpoint())
    nodes = [(f"r{i}", None, f"d{i}", 0, "t", f"word{i}") for i in range(6)] + [(f"c{i}", f"r{i}", f"d{i}", 1, "t", f"word{i} more") for i in range(6)]
    rows = spark.createDataFrame([(*n, "text") for n in nodes], "node_id string, parent_id string, doc_id string, pos int, title string, summary string, content string")
    asked = spark.createDataFrame([("q1", "word4 word2"), ("q2", "word5")], "question_id string, question string")
    found = tree.asked(rows, asked, dataclasses.replace(STUB, choose=shared_words), width=1).collect()
    assert sorted((r.question_id, r.node_id, r["rank"]) for r in found) == [("q1", "c2", 1), ("q2", "c5", 1)]
    ranked = [c for c in written if "place" in c]
    assert ranked and not any("summary" in c or "question" in c for c in ranked)


def test_beam_pairs_no_roots_with_questions(spark, monkeypatch):
    """Choice by shared words: counted for batches of roots, in any order of rows, with the same places as pair by pair."""
    rng = random.Random(11)
    words = "Queue role node, İx job   key a\x1cb table\tqueue Role ñ".split(" ")
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    roots = [(f"r{i}", None, f"d{i % 90}", i % 3, rng.choice([None, text(3)]), rng.choice([None, "", text(7)])) for i in range(200)]
    below = [(f"c{i}", f"r{i}", f"d{i % 90}", 1, "t", "x") for i in range(0, 200, 2)]
    rng.shuffle(roots)
    rows = spark.createDataFrame([(*n, "text") for n in roots + below], "node_id string, parent_id string, doc_id string, pos int, title string, summary string, content string").repartition(3)
    asked = spark.createDataFrame([(i, rng.choice([None, text(9), text(9)])) for i in range(30)], "question_id int, question string")
    pairs = dataclasses.replace(STUB, choose=lambda *a: shared_words(*a))
    want = sorted(map(tuple, tree.asked(rows, asked, pairs, width=4).collect()), key=str)
    monkeypatch.setattr(tree, "COUNTS", 700)
    monkeypatch.setattr(type(rows), "crossJoin", lambda *_: pytest.fail("roots were paired with questions"))
    assert sorted(map(tuple, tree.asked(rows, asked, MODEL, width=4).collect()), key=str) == want and len(want) > 60


def test_known_levels_and_leaves_are_read_once(spark):
    """Sections are read once and no node is looked up to see whether it is a leaf."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows, docs = made(5), spark.createDataFrame([("d0", "T"), ("none", "N")], "doc_id string, title string")
    sections = spark.createDataFrame(rows, SECTIONS).mapInArrow(counted, SECTIONS)
    kept = ["node_id", "parent_id", "pos", "content", "summary"]
    want = sorted(map(tuple, generation.summaries(tree.nested(sections, docs).drop("leaf"), MODEL).select(kept).collect()), key=str)
    before = read.value
    nodes = generation.summaries(tree.nested(sections, docs, [1, 2, 3, 5]), MODEL)
    assert sorted(map(tuple, nodes.select(kept).collect()), key=str) == want
    tree.asked(nodes, spark.createDataFrame([("q", "queue role")], "question_id string, question string"), MODEL).collect()
    assert before > 0 and read.value - before == len(rows)
    with pytest.raises(Exception, match="another level"):
        tree.nested(sections, docs, [1, 2]).collect()
