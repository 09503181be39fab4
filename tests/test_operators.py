import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import bm25, chunking, graph, ir, resolve, scoring, sessions, tree, vector
from lexmill.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def trace(spark, ids):
    return spark.createDataFrame([("q", i + 1, c) for i, c in enumerate(ids)], "question_id string, rank int, chunk_id string")


def measured(spark, ids, expected, k):
    wanted = spark.createDataFrame([("q", e) for e in expected], "question_id string, expected_id string")
    questions = spark.createDataFrame([("q",)], "question_id string")
    return ir.metrics(trace(spark, ids), wanted, questions, k).first()


def test_metric_anchors(spark):
    assert measured(spark, ["a", "x", "y"], ["a", "b"], 3).recall == 0.5
    assert measured(spark, ["a", "b"], ["a", "b"], 10).precision == 1.0
    assert measured(spark, ["x", "y", "z", "w", "a"], ["a"], 3).hit == 0
    assert measured(spark, ["x", "y", "a"], ["a"], 3).mrr == round(1 / 3, 6)
    assert measured(spark, ["x", "a"], ["a"], 2).ndcg == round(1 / math.log2(3), 6)
    assert measured(spark, ["documentation::0"], ["doc"], 5).recall == 0
    assert measured(spark, ["L0:lambda-overview::aws-lambda::0"], ["lambda-overview::aws-lambda"], 5).recall == 1.0
    assert measured(spark, ["foo:lambda-overview::aws-lambda::0"], ["lambda-overview::aws-lambda"], 5).recall == 0
    assert measured(spark, ["doc::sec::0", "doc::sec::1", "doc::sec::2"], ["doc::sec"], 3).ndcg == 1.0


def test_windows(spark):
    text = " ".join(map(str, range(1000)))
    rows = chunking.token_windows(spark.createDataFrame([(1, text), (2, ""), (3, "a b")], "doc_id long, text string")).orderBy("doc_id", "chunk_no").collect()
    first, second = rows[0].chunk, rows[1].chunk
    assert len(first) == 512 and first[-50:] == second[:50]
    assert [r.doc_id for r in rows].count(2) == 0 and rows[-1].chunk == ["a", "b"]


def test_bm25_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "alpha beta\ngamma delta"), (2, "alpha gamma"), (3, "zeta")], "doc_id long, text string")
    questions = spark.createDataFrame([("q", "zeta")], "question_id string, question string")
    rows = bm25.top_k(bm25.build(chunking.sections(docs)), questions, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["3::0", "1::0", "1::1"] and rows[1].score == 0


def test_percentiles(spark):
    frame = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 10.0 * i) for i in range(1, 6)], "k string, v double")
    rows = {r.k: r for r in scoring.index_percentiles(frame, ["k"], "v").collect()}
    assert (rows["a"].avg_ms, rows["a"].p50_ms, rows["a"].p95_ms, rows["a"].p99_ms) == (50.5, 51, 96, 100)
    assert rows["b"].p95_ms == 50


def test_ranges_sum_as_one_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(900)]), rng.randint(0, 5)) for _ in range(3000)]
    rows = [(k, None if o is None else o * 3000 + i, a) for i, (k, o, a) in enumerate(rows)]
    want, total = set(), {}
    for k, o, a in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if o is not None:
            want.add((k, o, a, total.get(k, 0)))
        total[k] = total.get(k, 0) + a
    frame = spark.createDataFrame(rows, "k string, o long, a long")
    got = scoring.summed_before(frame, ["k"], "o", "a")
    assert got.columns == ["k", "o", "a", "before"] and got.count() == len(rows)
    assert {tuple(r) for r in got.filter("o is not null").collect()} == want
    assert scoring.summed_before(frame.limit(0), ["k"], "o", "a").count() == 0


def test_percentiles_with_ties_and_nulls(spark):
    values = [1.0] * 70 + [2.0] * 40 + [3.0] * 10
    frame = spark.createDataFrame([(None, v) for v in values] + [("n", None)], "k string, v double").repartition(3)
    rows = {r.k: r for r in scoring.index_percentiles(frame, ["k"], "v").collect()}
    assert (rows[None].n, rows[None].p50_ms, rows[None].p95_ms, rows[None].p99_ms) == (120, 1.0, 3.0, 3.0)
    assert (rows["n"].n, rows["n"].p50_ms) == (1, None)


def test_attribution_and_checks(spark):
    frame = spark.createDataFrame([("Lambda runs on a server", ["lambda", "bucket"], ["provisions"]), ("it provisions", [], ["provisions"])], "a string, m array<string>, f array<string>")
    rows = scoring.structural_check(frame, "a", "m", "f").collect()
    assert (rows[0].completeness, rows[0].accuracy, rows[0].structural_pass) == (0.5, 0.5, True)
    assert (rows[1].completeness, rows[1].accuracy, rows[1].faithfulness) == (1.0, 0.0, 0.0)


def test_trails_do_not_repeat_edges(spark):
    edges = spark.createDataFrame([("1", "a", "b", "R"), ("2", "b", "a", "R")], "edge_id string, source string, target string, type string")
    start = spark.createDataFrame([("a",)], "fqn string")
    assert [(r.fqn, r.hops) for r in graph.expand(edges, start, 4).orderBy("hops").collect()] == [("b", 1), ("a", 2)]


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    got = {r.fqn: r.betweenness for r in graph.betweenness(edges).collect()}
    assert got["b"] == 1.0


def brute_betweenness(pairs):
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    dist, paths = {}, {}
    for s in links:
        d, n, front = {s: 0}, {s: 1}, [s]
        while front:
            ahead = []
            for v in front:
                for w in links[v]:
                    if w not in d:
                        d[w], n[w] = d[v] + 1, 0
                        ahead.append(w)
                    if d[w] == d[v] + 1:
                        n[w] += n[v]
            front = ahead
        dist[s], paths[s] = d, n
    total = dict.fromkeys(links, 0.0)
    for s in links:
        for t in dist[s]:
            for v in dist[s]:
                if s != t and v not in (s, t) and dist[s][v] + dist[v][t] == dist[s][t]:
                    total[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return {v: x / ((len(links) - 1) * (len(links) - 2)) for v, x in total.items()}


def test_betweenness_of_trees_on_a_core(spark):
    rng = random.Random(4)
    pairs = [(f"c{rng.randrange(12)}", f"c{rng.randrange(12)}") for _ in range(22)] + [(f"t{i}", f"t{rng.randrange(i)}" if rng.random() < 0.5 and i else f"c{i % 12}") for i in range(25)]
    pairs = [(a, b) for a, b in pairs if a != b] + [("x", "y"), ("y", "z"), ("y", "w"), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "o")]
    got = {r.fqn: r.betweenness for r in graph.betweenness(spark.createDataFrame(pairs, "source string, target string")).collect()}
    want = brute_betweenness(pairs)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want)


def test_hubs_are_of_the_whole_graph(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("region", "nation", "supplier", "customer")}
    want = brute_betweenness([(e.source, e.target) for e in graph.tpch_graph(tables)[1].collect()])
    got = {r.fqn: r.betweenness for r in QUERIES["graph_hubs_betweenness"](spark, SF).collect()}
    assert any(v.startswith("customer:") for v in got)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want)


def test_candidate_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    names = ["cold anvil", "old anvil", "red ring", "deep red ring", "ÄRGER 😀", "ärger 😀😀", "abc", "ab"] + ["".join(rng.choice("abc d") for _ in range(rng.randint(3, 14))).strip() for _ in range(150)]
    names += [n[1:] for n in names[:40]] + [n + "xyzzy" for n in names[40:80]]
    rows = [(("t", "u")[i % 3 == 0], n) for i, n in enumerate(names)] * 2
    normal = sorted({(t, n.strip().upper()) for t, n in rows if len(n.strip()) >= 3})
    scores = {(t, a, b): resolve.jaro_winkler(a, b) for t, a in normal for u, b in normal if t == u and a < b}
    want = {k: "merge" if s >= 0.92 else "review" for k, s in scores.items() if s >= 0.85}
    found = resolve.candidate_pairs(spark.createDataFrame(rows, "type string, name string")).collect()
    assert len(found) == len(want) and {(r.type, r.left, r.right): r.action for r in found} == want
    assert any(a[:2] != b[:2] for _, a, b in want) and any(abs(len(a) - len(b)) > 3 for _, a, b in want)


def test_kmeans_and_search(spark):
    rows = [(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r.vec_id: r.cluster for r in vector.spherical_kmeans(frame, 2).collect()}
    assert len({found[i] for i in range(0, 10, 2)}) == 1 and found[0] != found[1]
    top = vector.cosine_top_k(frame, frame.filter("vec_id = 0"), 2).orderBy("rank").collect()
    assert [r.vec_id for r in top] == [2, 4]


def test_tree(spark):
    frame = spark.createDataFrame([("d", 0, 1), ("d", 1, 2), ("d", 2, 4), ("d", 3, 2)], "doc_id string, pos int, level int")
    built = tree.build(frame)
    assert {r.node_id: r.parent_id for r in built.collect()} == {"d::0": None, "d::1": "d::0", "d::2": "d::1", "d::3": "d::0"}
    assert tree.leaf_counts(built).first().leaves == 2


def test_rate_limit_is_exact(spark):
    frame = spark.range(5).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id") * 20).alias("ts"))
    got = {r.event_id: r.allowed for r in sessions.admitted(frame, limit=2, seconds=60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("name", ["section_stats", "agg_by_tier", "latency_index_percentiles", "graph_degree", "vector_topk", "bm25_ir_summary", "tree_build", "csv_row_sections"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    own, other = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(other.columns)
    shown = lambda f: sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in f[columns].itertuples(index=False))
    assert shown(own) == shown(other)


def test_strategies_share_one_contract(spark):
    from lexmill.operators.strategies import strategy

    docs = spark.createDataFrame([(1, "alpha beta gamma\ndelta", "en", "s"), (2, "zeta eta theta", "en", "s")], "doc_id long, text string, lang string, source string")
    asked = spark.createDataFrame([("q1", "what is zeta eta theta"), ("q2", "compare alpha beta gamma")], "question_id string, question string")
    for name in ("bm25", "naive_vector", "contextual_vector", "pageindex", "hybrid", "raptor"):
        found = strategy(name)
        found.build(docs)
        rows = found.retrieve(asked, 2).collect()
        most = 3 if name == "raptor" else 2  # two of each level: two chunks and their one summary
        assert {r.question_id for r in rows} == {"q1", "q2"} and {r["rank"] for r in rows} <= set(range(1, most + 1))
    best = [r.chunk_id for r in rows if r.question_id == "q1" and r["rank"] == 1]
    assert best == ["L0:2::0"]


def test_lifecycle(spark, tmp_path):
    from lexmill.plans import lifecycle

    answers = spark.createDataFrame([("t1", "bm25", "a lambda", ["doc"], 100.0, 0.01, "")], "question_id string, strategy string, answer string, sources array<string>, latency_ms double, cost_usd double, error string")
    questions = spark.createDataFrame([("t1", ["lambda"], ["never"], ["doc"], ["lambda"])], "question_id string, must_mention array<string>, must_not_claim array<string>, source_refs array<string>, required_entities array<string>")
    ranked = lifecycle.benchmark(answers, questions, str(tmp_path / "runs"), "r1")
    assert ranked.first().composite == 0.998 and "bm25" in lifecycle.report(ranked, "Run")
    assert [r.event for r in lifecycle.chat_events(answers).orderBy("seq").collect()] == ["message_id", "token", "token", "done", "meta"]
