"""Routers, graph templates, evaluation and generation against hand-made cases."""

import dataclasses

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.functions import text as tx
from lexmill.operators import bm25, evaluation, generation, ir, knowledge, strategies, tree
from lexmill.operators.provider import STUB

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_router(spark):
    asked = {
        "Compare Lambda and ECS": "comparison", "what is the difference between a and b": "comparison", "advantages of x over y": "comparison",
        "does it depend on IAM": "relational", "if I delete it what happens": "relational", "which logs to S3": "relational",
        "how do I deploy": "procedural", "steps to enable it": "procedural", "what is a subnet": "factoid", "tell me more": "exploratory",
        "both of them": "comparison", "then we go": "relational", "hello": "factoid", "dependence": "factoid",
    }
    frame = spark.createDataFrame([(q, i) for q, i in asked.items()], "q string, want string")
    got = frame.select("q", "want", tx.routed_intent(F.col("q")).alias("got"), tx.routed_intent(F.col("q"), F.lit("exploratory")).alias("told"), tx.routed_intent(F.col("q"), F.lit("nonsense")).alias("wrong")).collect()
    assert {r.q: r.got for r in got} == asked and {r.q: r.wrong for r in got} == asked
    assert all(r.told in ("exploratory", "comparison", "relational", "procedural") for r in got)
    assert one(spark, "what linked them", tx.graph_intent) == "multi_hop" and one(spark, "hm", tx.graph_intent) == "fulltext"
    assert one(spark, "which class extends it", tx.graph_template) == "TYPE_HIERARCHY" and one(spark, "hm", tx.graph_template) is None


def test_names_and_mentions(spark):
    assert one(spark, "Does Lambda call s3.put_object, 'My Queue' or api-gateway", tx.entity_mentions) == ["My Queue", "s3.put_object", "api-gateway"]
    assert one(spark, "Lambda needs DynamoDB", tx.entity_mentions) == ["Lambda", "DynamoDB"]
    for name, want in (("put_item()", "PUT_ITEM"), ("Queue class", "QUEUE"), ("class Queue", "CLASS QUEUE"), ("Queue Service", "QUEUE SERVICE"), (" type ", "")):
        assert one(spark, name, tx.normal_name) == want, name


def test_text_of_answers(spark):
    assert one(spark, 'so: ["a]", ["b", "\\"["]] and [1]', tx.balanced_json_array) == '["a]", ["b", "\\"["]]'
    assert one(spark, "```json\n[1, [2, [3]]]\n```", tx.balanced_json_array) == "[1, [2, [3]]]"
    assert one(spark, "none [", tx.balanced_json_array) is None
    assert one(spark, "```py\na\n```", tx.opened_fence) == "a" and one(spark, "a ```b```", tx.opened_fence) == "a ```b```"
    assert one(spark, "aws-compute", tx.prettified) == "Aws Compute"
    found = one(spark, "Acme Widgets Inc. paid $1,200.50 million. Chief Executive Officer Jane Doe spoke; Jane Doe is CEO Jane Doe.", tx.filing_entities)
    assert found.dollar_amounts == ["$1,200.50 million"] and found.companies == ["Acme Widgets Inc."] and found.executives == ["Jane Doe"]
    links = F.array(*map(F.lit, ("/a?x=1", "b#f", "https://h.io/a", "http://other/x", "//h.io/c", "mailto:x@y", "./d")))
    assert one(spark, "https://h.io/docs/p.html", lambda t: tx.site_links(t, links)) == ["https://h.io/a", "https://h.io/docs/b", "https://h.io/c", "https://h.io/docs/d"]
    assert one(spark, "x", lambda t: tx.utc_stamp(F.lit(0))) == "1970-01-01T00:00:00+00:00"


def graph(spark):
    names = {"a": "Alpha", "b": "Beta", "c": "Gamma", "d": "Delta", "e": "Epsilon"}
    nodes = spark.createDataFrame([(k, "Topic", v, f"the {v.lower()} node") for k, v in names.items()], "fqn string, type string, name string, description string")
    edges = [("a", "b", "DEPENDS_ON"), ("b", "c", "TRIGGERS"), ("c", "a", "EXTENDS"), ("c", "d", "CONTAINS"), ("d", "e", "LIKES"), ("a", "d", "CONTAINS")]
    return nodes, spark.createDataFrame([(f"{s}{t}", s, t, k) for s, t, k in edges], "edge_id string, source string, target string, type string")


def test_graph_templates(spark):
    nodes, edges = graph(spark)
    start = lambda *x: spark.createDataFrame([(i,) for i in x], "fqn string")
    hops = knowledge.multi_hop(edges, nodes, start("d"), 2).collect()
    assert {(r.fqn, r.hops) for r in hops} == {("a", 1), ("c", 1), ("b", 2), ("a", 2), ("c", 2)}  # e only over a type that is not allowed
    assert [r.relationship_chain for r in hops if r.fqn == "b"] == [["CONTAINS", "DEPENDS_ON"], ["CONTAINS", "TRIGGERS"]]
    assert len(knowledge.multi_hop(edges, nodes, start("d"), 3, limit=3).collect()) == 3
    assert [r.chain for r in knowledge.dependency_chains(edges, nodes, start("a")).orderBy("depth").collect()] == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "a"]]
    assert {tuple(r.path) for r in knowledge.simple_paths(edges, start("a")).collect()} == {("a", "b"), ("a", "d"), ("a", "b", "c"), ("a", "d", "e"), ("a", "b", "c", "d"), ("a", "b", "c", "d", "e")}
    pairs = spark.createDataFrame([("a", "c")], "a string, b string")
    both = {(r.shared, r.rel_to_a, r.rel_to_b) for r in knowledge.comparison(edges, pairs, unique_too=True).collect()}
    assert both == {("b", "DEPENDS_ON", "TRIGGERS"), ("d", "CONTAINS", "CONTAINS"), ("c", "EXTENDS", None)}
    looked = {r.key: r for r in knowledge.entity_lookup(edges, nodes, spark.createDataFrame([("BETA",), ("e",), ("zz",)], "key string")).collect()}
    assert set(looked) == {"BETA", "e"} and [(n.neighbour, n.rel, n.direction) for n in looked["BETA"].neighbours] == [("Alpha", "DEPENDS_ON", "incoming"), ("Gamma", "TRIGGERS", "outgoing")]
    assert {(r.fqn, r.depth) for r in knowledge.hierarchy(edges, nodes, start("c")).collect()} == {("c", 0), ("a", 1), ("d", 1), ("d", 2)}
    assert [r.fqn for r in knowledge.fulltext(knowledge.fulltext_index(nodes), spark.createDataFrame([(1, "the gamma?")], "question_id int, question string")).orderBy("rank").collect()][0] == "c"


def test_communities(spark):
    clique = lambda s: [(f"{a}{b}", a, b) for i, a in enumerate(s) for b in s[:i]]
    edges = spark.createDataFrame([(*e, "CONTAINS") for e in clique("abcd") + clique("wxyz") + [("dw", "d", "w")]], "edge_id string, source string, target string, type string")
    got = {r.fqn: r.community for r in knowledge.communities(edges).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}


def test_graph_strategy(spark):
    nodes, edges = graph(spark)
    asked = spark.createDataFrame([("q1", "what does Alpha depend on"), ("q2", "explain the Beta"), ("q3", "delta node"), ("q4", 'how are "d" and x related')], "question_id string, question string")
    found = knowledge.ask(edges, nodes, asked).collect()
    assert {r.via for r in found if r.question_id == "q2"} == {"entity_lookup"} and {r.via for r in found if r.question_id == "q3"} == {"fulltext"}
    assert {r.via for r in found if r.question_id == "q4"} == {"multi_hop"}
    kg = strategies.strategy("knowledge_graph")
    kg.load(nodes, edges)
    assert {r.question_id for r in kg.retrieve(asked, 2).collect()} == {"q1", "q2", "q3", "q4"}
    reply = '{"entities": [{"fqn": "x", "name": "X", "type": "Topic"}, {"fqn": "y", "name": "Y", "type": "Topic"}, {"fqn": "z", "type": "Gadget"}], "relationships": [{"source_fqn": "x", "target_fqn": "y", "type": "CONTAINS"}, {"source_fqn": "x", "target_fqn": "z", "type": "CONTAINS"}]}'
    model = dataclasses.replace(STUB, generate=lambda prompt: F.lit("```json\n" + reply + "\n```"))
    kg = strategies.strategy("knowledge_graph", model)
    kg.build(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    assert sorted(r.fqn for r in kg.nodes.collect()) == ["x", "y"] and [(r.source, r.target) for r in kg.edges.collect()] == [("x", "y")]
    merges = spark.createDataFrame([("Lambda fn", "Lambda function")], "absorbed string, canonical string")
    rows = spark.createDataFrame([("Lambda fn",), ("Lambda function",), ("S3",)], "name string")
    assert {r["name"]: r.aliases for r in knowledge.without_absorbed(rows, merges).collect()} == {"Lambda function": ["Lambda fn"], "S3": None}
    assert knowledge.mock_context(asked).filter("mock and size(nodes) = 2").count() == 4
    props = spark.createDataFrame([({"a": 1}, [1], [{"b": 2}])], "p map<string,int>, n array<int>, l array<map<string,int>>")
    assert list(knowledge.json_properties(props).first()) == ['{"a":1}', [1], '[{"b":2}]']


def test_judges(spark):
    rows = spark.createDataFrame([("a", "r", 0.1, 0.2, 0.3, True), ("b", "r", 0.1, 0.2, 0.3, False)], "answer string, reference string, accuracy double, completeness double, faithfulness double, structural_pass boolean")
    model = dataclasses.replace(STUB, judge=lambda a, r: F.lit('Sure {"accuracy": 0.9, "faithfulness": 1}'))
    got = {r.answer: (r.accuracy, r.completeness, r.faithfulness) for r in evaluation.judged(rows, model).collect()}
    assert got == {"a": (0.9, 0.2, 1.0), "b": (0.1, 0.2, 0.3)}
    assert {(r.accuracy, r.completeness) for r in evaluation.judged(rows).collect()} == {(0.1, 0.2)}
    asked = spark.createDataFrame([("q", "a", "ref", ["c"] * 12), ("q", " ", "", None), ("q", "a", "ref", [])], "question string, answer string, reference string, chunks array<string>")
    model = dataclasses.replace(STUB, judge=lambda a, r: F.concat(F.lit('{"faithfulness": 0.5, "context_precision": 0.4, "context_recall": 0.3, "relevancy": '), F.length(a), F.lit("}")))
    got = [(r.faithfulness, r.context_precision, r.context_recall, r.answer_relevancy > 0) for r in evaluation.ragas(asked, model).collect()]
    assert got == [(0.5, 0.4, 0.3, True), (0.0, 0.0, 0.0, False), (0.0, 0.0, 0.0, True)]


def test_generation(spark):
    rows = spark.createDataFrame([("r", None, "R", ""), ("a", "r", "A", "x" * 300), ("b", "r", "B", "short"), ("c", "b2", "C", "y"), ("b2", "r", "B2", "")], "node_id string, parent_id string, title string, content string")
    got = {r.node_id: r.summary for r in generation.summaries(rows).collect()}
    assert got["a"] == "x" * 200 and got["b"] == "short" and got["b2"] == "- C: y" and got["r"].startswith("- A: xxx") and set(got) == {"r", "a", "b", "c", "b2"}
    slugs = spark.createDataFrame([(1, i, s) for i, s in enumerate(["x", "x-1", "x", "x", "y"])], "doc_id long, pos int, slug string")
    assert [r.section_id for r in generation.probed_slugs(slugs).orderBy("pos").collect()] == ["x", "x-1", "x-2", "x-3", "y"]
    sections = spark.createDataFrame([(0, 0, "D", "s", "a" * 60), (0, 1, "D", "s", "b" * 3000), (0, 2, "D", "s", "c" * 60), (1, 0, "E", "t", "d" * 60), (1, 1, "E", "t", "short")], "doc_pos int, pos int, doc_title string, title string, content string")
    assert generation.excerpts(sections, 300) == ["[D / s]\n" + "a" * 60, "[E / t]\n" + "d" * 60]
    asked = spark.createDataFrame([("q", "what", i, f"c{i}", "t") for i in range(1, 4)], "question_id string, question string, rank int, chunk_id string, text string")
    model = dataclasses.replace(STUB, judge=lambda a, r: F.lit('ids: ["c3", "c9", "c1"]'))
    assert sorted(r.expected_id for r in generation.judged_labels(asked, model).collect()) == ["c1", "c3"] and generation.judged_labels(asked).count() == 0
    pairs = spark.createDataFrame([("p1", "What is it?", "It."), ("p2", "Who was there then?", "They.")], "pair_id string, question string, answer string")
    qna = strategies.strategy("qna_pairs", dataclasses.replace(STUB, generate=lambda p: F.lit("rephrased")))
    qna.build(pairs)
    answers = {r.question_id: (r.answer, r["mode"]) for r in qna.answers(spark.createDataFrame([(1, "what is IT?"), (2, "who was there then or now?")], "question_id int, question string")).collect()}
    assert answers == {1: ("It.", "exact"), 2: ("rephrased", "rephrase")}
    assert {r.node_id: r.leaves for r in tree.leaves_below(rows.select("node_id", "parent_id")).collect()} == {"r": 3, "a": 1, "b": 1, "c": 1, "b2": 1}


def test_bm25_bounds_lose_nothing(spark):
    """The pruned ranking against all scores, on words of very unlike frequency."""
    import random

    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    chunks = spark.createDataFrame([(i, 0, f"{i}::0", " ".join(word() for _ in range(rng.randint(3, 60)))) for i in range(1500)], "doc_id long, section_pos int, chunk_id string, content string")
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(40)] + [(90, "w1 w1 w1 w2"), (91, "unknown"), (92, "")], "question_id long, question string")
    index = bm25.build(chunks)
    got = {}
    for r in bm25.top_k(index, asked, 7).collect():
        got.setdefault(r.question_id, []).append((-r.score, r.doc_id))
    every = {q: [] for q in got}
    for r in bm25.scores(index, asked).collect():
        every[r.question_id].append((-r.score, r.doc_id))
    for q, found in got.items():
        met = {d for _, d in every[q]}
        want = sorted(every[q] + [(0.0, d) for d in range(1500) if d not in met][:10])[:7]
        assert sorted(found) == want, q


def test_containing_equals_all_pairs(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "a quick brown fox", "overthe quick brown fox jumps", "the  quick brown fox jumps over", ""]
    asked = ["quick brown fox jumps over the", "he quick brown fox jumps over the lazy do", "fox", "quick brown fox", "the quick brown fox jumps over"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    got = {(r.question_id, r.doc_id) for r in ir.containing(docs, questions).collect()}
    assert got == {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if q in t}


@pytest.mark.parametrize("name", ["router_intent", "model_cost", "graph_multi_hop_undirected", "graph_comparison", "graph_type_hierarchy", "audit_rollup", "ir_document_fallback", "reranked_passages"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    own, other = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(other.columns)
    shown = lambda f: sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in f[columns].itertuples(index=False))
    assert shown(own) == shown(other)
