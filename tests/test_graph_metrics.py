"""Betweenness, communities and entity resolution as tables, against loops over small inputs."""

import random

import pytest

from lexmill.operators import centrality, communities, graph, knowledge, resolve
from lexmill.plans.catalogue import QUERIES
from tests.test_operators import SF, brute_betweenness

EDGES = "source string, target string"


def random_pairs(seed, nodes=10, edges=18, tail=4):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)]
    pairs = [(a, b) for a, b in pairs if a != b]
    pairs += [(f"t{i}", f"t{i - 1}" if i else pairs[0][0]) for i in range(tail)] + [("x", "y"), ("y", "z"), ("p", "q")]
    return pairs + pairs[:3] + [(b, a) for a, b in pairs[:3]]


@pytest.mark.parametrize("seed,rows,folds", [(1, 10**6, 0), (2, 60, 1)])
def test_betweenness_equals_brute_force(spark, seed, rows, folds):
    pairs = random_pairs(seed)
    edges = spark.createDataFrame([*pairs, ("n1", "n1")], EDGES)
    got = {r.fqn: r.betweenness for r in centrality.betweenness(edges, rows, folds).collect()}
    want = brute_betweenness(pairs)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-6 for v in want)


def test_hubs_and_empty_graph(spark):
    edges = spark.createDataFrame(random_pairs(5), EDGES)
    want = sorted(brute_betweenness(random_pairs(5)).items(), key=lambda x: (-round(x[1], 6), x[0]))[:10]
    assert [r.fqn for r in graph.hubs(edges).collect()] == [v for v, _ in want]
    assert centrality.betweenness(edges.limit(0)).count() == 0 and communities.communities(edges.limit(0)).count() == 0
    top = QUERIES["graph_top_hubs"](spark, SF).collect()
    assert len(top) == 10 and [r.betweenness for r in top] == sorted((r.betweenness for r in top), reverse=True)


@pytest.mark.parametrize("folds", [0, 16])
def test_node_tables_stay_off_the_driver(spark, monkeypatch, folds):
    """Broadcast tables are collected by the driver first: no join of betweenness has one, however small its files."""
    plans, stored = [], centrality.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(centrality, "stored", noted)
    result = centrality.betweenness(spark.createDataFrame(random_pairs(7), EDGES), folds=folds)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("folds", [0, 1, 16])
def test_component_sizes(spark, folds):
    """A path longer than the rounds of folding, a ring with a tail, a pair: sizes come back to all folded nodes."""
    pairs = [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r2", "t1"), ("t1", "t2"), ("x", "y")]
    rest, nodes, rounds = centrality.folded(centrality.both_ways(spark.createDataFrame(pairs, EDGES)), folds)
    got = sorted(map(tuple, centrality.component_sizes(rest, nodes, rounds).collect()))
    assert got == sorted((v, 41 if v[0] == "p" else 2 if v in "xy" else 5) for v in {v for p in pairs for v in p})


def quality(pairs, of):
    pairs = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    degree = {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    m = len(pairs)
    total = {}
    for v, k in degree.items():
        total[of[v]] = total.get(of[v], 0) + k
    return sum(of[a] == of[b] for a, b in pairs) / m - sum((t / (2 * m)) ** 2 for t in total.values())


def greedy(pairs):
    """One node at a time to where modularity is highest, until none gains."""
    nodes = sorted({v for p in pairs for v in p})
    of = {v: v for v in nodes}
    while True:
        before = dict(of)
        for v in nodes:
            of[v] = max(sorted(set(of.values())), key=lambda c: (round(quality(pairs, {**of, v: c}), 9), c == before[v]))
        if of == before:
            return of


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_are_a_local_optimum(spark, seed):
    pairs = random_pairs(seed, nodes=16, edges=34, tail=4)
    got = {r.fqn: r.community for r in knowledge.communities(spark.createDataFrame(pairs, EDGES)).collect()}
    assert got.keys() == {v for p in pairs for v in p} and all(got[c] == c for c in got.values())
    assert quality(pairs, got) >= quality(pairs, greedy(pairs)) - 0.02
    named = sorted(set(got.values()))
    for a in named:  # no two communities gain by merging
        for b in named:
            assert quality(pairs, {v: b if c == a else c for v, c in got.items()}) <= quality(pairs, got) + 1e-9


def test_leaves_of_hubs_move_together(spark, monkeypatch):
    """Hubs on a root, 200 leaves each: rounds don't grow with the leaves, and every leaf ends with its hub."""
    pairs = [(f"h{h}", f"l{h}.{i}") for h in range(4) for i in range(200)] + [("root", f"h{h}") for h in range(4)]
    rounds, moves = [], communities.moves

    def counted(*args):
        rounds.append(1)
        assert len(rounds) <= 12
        return moves(*args)

    monkeypatch.setattr(communities, "moves", counted)
    got = {r.fqn: r.community for r in communities.communities(spark.createDataFrame(pairs, EDGES)).collect()}
    assert all(got[a] == got[b] for a, b in pairs[:800]) and len(set(got.values())) == 4


@pytest.mark.parametrize("seed", [3, 4])
def test_moves_together_raise_modularity(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}
    links = centrality.both_ways(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], EDGES)).selectExpr("a", "b", "1.0D w")
    nodes = links.groupBy("a").count().selectExpr("a fqn", "0.0D loop", "double(count) k").cache()
    two_m, state = float(links.count()), nodes.selectExpr("fqn", "fqn community")
    before = communities.modularity(links, nodes, state, two_m)
    for _ in range(4):
        chosen = communities.together(communities.moves(links, nodes, state, two_m), nodes, two_m)
        if chosen.isEmpty():
            break
        state = communities.moved(state, chosen)
        after = communities.modularity(links, nodes, state, two_m)
        assert after > before
        before = after


def test_communities_contract(spark):
    """A ring of small cliques: neighbouring cliques merge as whole nodes only in a second level."""
    pairs = []
    for i in range(24):
        pairs += [(f"c{i:02}a", f"c{i:02}b"), (f"c{i:02}b", f"c{i:02}c"), (f"c{i:02}a", f"c{i:02}c"), (f"c{i:02}c", f"c{(i + 1) % 24:02}a")]
    got = {r.fqn: r.community for r in knowledge.communities(spark.createDataFrame(pairs, EDGES)).collect()}
    cliques = {v: v[:3] for v in got}
    assert quality(pairs, got) > quality(pairs, cliques) and len(set(got.values())) < 24


def sequential(rows):
    gone, out = set(), []
    rows = sorted(r for r in rows if r[2] is not None and r[3] is not None)
    for i, (_, a_id, kind, a) in enumerate(rows):
        if a_id in gone or len(normal(a)) < 3:
            continue
        for _, b_id, other, b in rows[i + 1 :]:
            if b_id in gone or other != kind or len(normal(b)) < 3:
                continue
            score = resolve.jaro_winkler(normal(a), normal(b))
            if score >= 0.92:
                keep, drop = (a_id, b_id) if len(a) >= len(b) else (b_id, a_id)
                out.append((a_id, b_id, keep, "merge"))
                gone.add(drop)
            elif score >= 0.85:
                out.append((a_id, b_id, None, "review"))
    return sorted(out, key=str)


def normal(name):
    import re

    return re.sub(r"\s*\(\)\s*$|\s+(class|function|method|module|type)\s*$", "", name, flags=re.I).strip().upper()


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_equals_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    stems = ["payment gateway", "payment gatewey", "pay gateway", "user session", "user sessions", "abc", "abcd", "abcde", "ab"]
    rows = []
    for i in range(90):
        name = rng.choice(stems)
        if rng.random() < 0.5:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("xyzab") + name[at + rng.randrange(2) :]
        name += rng.choice(["", "", " class", "()", "s", "s"])
        rows.append((i, f"e{i:03}", rng.choice(["Topic", "Topic", "Process"]), name))
    rows += [(200, "n1", None, "abcdef"), (201, "n2", "Topic", None), (202, "n3", "Topic", "")]
    frame = spark.createDataFrame(rows, "pos long, id string, type string, name string").repartition(3)
    got = sorted(((r.left_id, r.right_id, r.canonical_id, r.action) for r in resolve.resolved(frame).collect()), key=str)
    assert got == sequential(rows)
    assert resolve.resolved(frame.limit(0)).count() == 0


def test_entity_merges_on_whole_table(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    want = sequential([(r.p_partkey, str(r.p_partkey), r.p_brand, r.p_name) for r in part])
    got = sorted(((r.left_id, r.right_id, r.canonical_id, r.action) for r in QUERIES["entity_merges"](spark, SF).collect()), key=str)
    assert got == want


def test_hubs_are_not_followed_further_than_needed(spark):
    """A hub of 3000 neighbours, each with 40 more: the limits hold at its own neighbours, and no trail beyond is made."""
    edges = spark.range(3000).selectExpr("concat('h|', id) edge_id", "'hub' source", "concat('n', id) target", "'DEPENDS_ON' type")
    more = spark.range(3000 * 40).selectExpr("concat('m|', id) edge_id", "concat('n', id % 3000) source", "concat('x', id) target", "'DEPENDS_ON' type")
    every = edges.unionByName(more)
    nodes = every.selectExpr("target fqn").distinct().selectExpr("fqn", "'Component' type", "fqn name").unionByName(spark.createDataFrame([("hub", "Component", "hub")], "fqn string, type string, name string"))
    start = spark.createDataFrame([("hub",), ("n7",)], "fqn string")
    followed = graph.expand(every, start, 3, enough=50, among=nodes)
    assert followed.filter("start = 'hub'").agg({"hops": "max"}).first()[0] == 1 and followed.filter("start = 'n7'").count() == 40
    for rows in (knowledge.multi_hop(every, nodes, start), knowledge.dependency_chains(every, nodes, start).withColumnRenamed("depth", "hops"), knowledge.simple_paths(every, start)):
        got = rows.filter("start = 'hub'").collect()
        assert len(got) in (50, 100) and {r.hops for r in got} == {1}
