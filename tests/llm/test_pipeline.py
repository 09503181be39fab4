"""The pipeline's stages on a small table: whole results, clean documents kept, decisions in effect."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[5], "en", "s1", 1), (101, clean[6].rsplit(" ", 1)[0], "en", "s2", 1)]
    rows += [(200, "too short", "en", "s0", 9), (201, "again and again and " * 30, "en", "s0", 9), (202, None, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:3]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
        ids = {r.doc_id for r in docs.collect()}
        assert ids == set(range(40)) | ({100, 101} if k < 2 else set())
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert final and all(r.round_trip for r in final) and {r.doc_id for r in final} <= set(range(40))


def test_one_row_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(reversed(words))
    rows = [(None, text), (None, text), (None, near), (None, other), (None, other), (4, near), (4, near), (9, text)]
    rows += [(5, " ".join(f"v{i}" for i in range(60)))] * 3 + [(7, ""), (7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text, r.source) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    want = [(4, near, "s5"), (None, other, "s3"), (5, rows[8][1], "s10"), (7, "", "s11"), (7, "", "s12"), (None, None, "s13")]
    assert got == sorted(want, key=str)
