"""Hierarchical ids: a question's expected ids as an array, and by a join where they are many, against a loop."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import ws_tokens
from lexmill.operators import bm25, ir


@pytest.mark.parametrize("limit", [1000, 3])
def test_matched_equals_a_loop(spark, monkeypatch, limit):
    monkeypatch.setattr(ir, "HELD_IDS", limit)
    rng = random.Random(1)
    ids = ["a", "a::b", "a::b::c", "a:", "L0:a", "b", "a:::b", "qna:a::b", "", "ab"]
    expected = {(q, rng.choice(ids)) for q in range(8) for _ in range(q)}
    retrieved = [(q, i + 1, rng.choice(["", "L0:", "foo:"]) + c) for q in range(9) for i, c in enumerate(["a::b::c", "a:::b", "a", "ab::c", "b::", "a::::c"])]

    def hit(q, chunk):
        for c in (chunk, chunk.removeprefix("L0:")):
            held = [x for p, x in expected if p == q and (c == x or c.startswith(x + "::"))]
            if held:
                return max(held, key=len)
        return None

    frames = spark.createDataFrame(retrieved, "question_id int, rank int, chunk_id string"), spark.createDataFrame(list(expected), "question_id int, expected_id string")
    got = sorted(map(tuple, ir.matched(*frames).select("question_id", "rank", "chunk_id", "hit").collect()))
    assert got == sorted((q, r, c, hit(q, c)) for q, r, c in retrieved)


def test_words_are_those_of_the_sections(spark):
    """Arrow's splitting, with the separators that it takes for white space, is that of ``ws_tokens``."""
    texts = [f"A{chr(c)}b {chr(c)}" for c in range(1, 0x3100) if c not in range(0x1C, 0x20)]
    for some in (texts, [f"A{chr(c)}b {chr(c)}" for c in range(0x1C, 0x20)] + texts[::50], ["", " ", "x"]):
        rows = spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", F.lower("t").alias("t"), ws_tokens(F.col("t")).alias("w")).orderBy("i").collect()
        words, row = bm25._tokens(pa.array([r.t for r in rows], pa.string()))
        assert list(zip(row.tolist(), words.to_pylist())) == [(r.i, w) for r in rows for w in r.w]


def test_texts_are_searched_in_batches(spark, monkeypatch):
    """All texts that hold a question are found, in parts of a batch too, without a call a word and without shuffling texts."""
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice(["a", "b", "ab", "é"]) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(rng.randrange(60)))) for i in range(120)] + [(900, None)]
    asked = [(i, docs[i][1][2 * (i % 3) : 30 + i % 9]) for i in range(0, 60)] + [(70, "a a a a a a a"), (71, "b"), (72, None)]
    plans, stored = [], ir.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(ir, "stored", noted)
    monkeypatch.setattr(bm25, "stored", noted)
    monkeypatch.setattr(ir, "RUN_BYTES", 50)
    frame = spark.createDataFrame(docs, "doc_id int, text string").coalesce(1)
    found = ir.containing(frame, spark.createDataFrame(asked, "question_id int, question string")).collect()
    assert sorted(map(tuple, found)) == sorted((q, d) for q, x in asked if x is not None for d, t in docs if t is not None and x in t)
    bm25.build(frame.selectExpr("doc_id", "0L section_pos", "text content"))
    assert len(plans) > 4 and not [p for p in plans if "lambda" in p or "hashpartitioning(doc_id#" in p]
