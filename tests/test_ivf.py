"""Inverted lists against exact search: recall, filters, whole probes, parts of a hot list, rows without direction."""

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import ivf, strategies, vector
from lexmill.plans.catalogue import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, list string"


def made(n=1500, size=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, size))
    rows = [(i, v.tolist(), i % 7, "own") for i, v in enumerate(x)]
    return rows + [(n + i, rows[3][1], 0, "own") for i in range(500)] + [(9000, None, 1, ""), (9001, [], 1, ""), (9002, [0.0] * size, 1, "")]


def pairs(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


def test_recall_and_filters(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 150)
    monkeypatch.setattr(ivf, "QUERY_PART", 10)
    frame = spark.createDataFrame(made(), VECTORS).repartition(4)
    asked = frame.filter("vec_id % 20 = 0 and vec_id < 1500")
    index = ivf.build(frame.drop("list"), lists=24, sample=600)
    assert index.vectors.count() == frame.count() and index.sizes.count() <= 24
    exact = vector.cosine_top_k(frame, asked)
    assert ivf.recall(ivf.search(index, asked), exact) >= 0.9
    assert pairs(ivf.search(index, asked, probes=24)) == pairs(exact)
    some = vector.cosine_top_k(frame.filter("label = 2"), asked)
    assert pairs(ivf.search(index, asked, probes=24, where=F.col("label") == 2)) == pairs(some)
    assert ivf.search(index, asked.limit(0)).count() == 0 and ivf.search(ivf.build(frame.limit(0)), asked).count() == 0


def test_registered_queries_reach_their_recall(spark):
    sf = "/root/testdata/sf0.01"
    for name, exact in (("vector_topk_indexed", "vector_topk"), ("vector_topk_indexed_filtered", "vector_topk_filtered")):
        assert ivf.recall(QUERIES[name](spark, sf), QUERIES[exact](spark, sf)) >= 0.9


def test_strategy_filters_before_the_search(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma word{i} " * 5) for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "alpha word7")], "question_id string, question string")
    for lists in (None, 4):
        found = strategies.strategy("naive_vector")
        found.lists = lists
        found.build(docs)
        assert {int(r.chunk_id.split("::")[0]) for r in found.retrieve(asked, 3, where=F.col("doc_id") > 20).collect()} <= set(range(21, 40))
