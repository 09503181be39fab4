"""Repository and site scans, question and result files, stored trees and arena state, event rows."""

import json

from lexmill.operators import arena, strategies, tree
from lexmill.plans import lifecycle
from lexmill.sources import files
from lexmill.streaming import stateful


def test_repository(spark, tmp_path):
    for name, text in {"docs/b.md": "# B\nbody", "a.rst": "# A\nbody", "node_modules/c.md": "# C\nbody", "x/build/d.txt": "no", "e.py": "no", "f.md": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.read_repository(spark, str(tmp_path), "demo", "remote:x/y").select("id", "source").collect()
    assert [tuple(r) for r in got] == [("arst", "remote:x/y/a.rst"), ("docs/bmd", "remote:x/y/docs/b.md")]


def test_sites(spark, tmp_path):
    (tmp_path / "url.txt").write_text(" https://a.org/x\n")
    assert files.entry_url(spark, str(tmp_path / "url.txt")) == "https://a.org/x" == files.entry_url(spark, "https://a.org/x")
    assert files.entry_url(spark, str(tmp_path / "none.txt")) is None
    pages = spark.createDataFrame([("https://a.org/x", "<h1>P</h1>"), ("https://b.org/", "<h1>Q</h1>"), ("https://b.org/r", "<h1>R</h1>")], "url string, html string")
    links = spark.createDataFrame([("https://b.org/", "https://b.org/r#top")], "source string, target string")
    guides = spark.createDataFrame([("a.org", "# Guide\n" + "word " * 20), ("b.org", "# short")], "host string, text string")
    seeds = spark.createDataFrame([("https://a.org/x",), ("https://b.org/",)], "url string")
    got = {(r.title, r.metadata["source_type"]) for r in files.site_documents(pages, links, seeds, guides, "demo").collect()}
    assert got == {("Guide", "llms.txt"), ("Q", "web"), ("R", "web")}


def test_question_and_label_files(spark, tmp_path):
    rows = [("t1-1", 1, "f", 1, "whät", "a", ["s"], [], ["m"], []), ("t2-1", 2, "p", 2, "how", "b", [], ["e"], [], ["n"])]
    questions = spark.createDataFrame(rows, files.QUESTION)
    assert files.corpora_with_questions(spark, str(tmp_path)) == [] and files.read_all_questions(spark, str(tmp_path)).count() == 0
    files.write_questions(questions, str(tmp_path / "one/questions"))
    files.write_questions(questions.filter("tier = 1"), str(tmp_path / "two/questions"))
    assert files.corpora_with_questions(spark, str(tmp_path)) == ["one", "two"]
    assert sorted(map(tuple, files.read_questions(spark, str(tmp_path / "one/questions")).collect())) == rows
    assert {(r.corpus, r.question_id) for r in files.read_all_questions(spark, str(tmp_path), tier=1).collect()} == {("one", "t1-1"), ("two", "t1-1")}
    files.write_labels(spark.createDataFrame([("q2", "b"), ("q1", "d"), ("q1", "c")], "question_id string, expected_id string"), str(tmp_path / "labels.yaml"))
    assert (tmp_path / "labels.yaml").read_text() == "q1:\n- c\n- d\nq2:\n- b\n"
    assert {tuple(r) for r in files.read_labels(spark, str(tmp_path / "labels.yaml")).collect()} == {("q1", "c"), ("q1", "d"), ("q2", "b")}


def test_result_files(spark, tmp_path):
    for name, value in {"my_corpus_bm25": 1, "other_hybrid": 2, "notes": 3}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"accuracy": value}, indent=1))
    got = files.read_result_files(spark, str(tmp_path), ["bm25", "hybrid"])
    assert {(r.corpus, r.strategy, r.accuracy) for r in got.collect()} == {("my_corpus", "bm25", 1), ("other", "hybrid", 2)}
    assert files.read_result_files(spark, str(tmp_path), ["bm25", "hybrid"], "other").count() == 1


def test_stored_state(spark, tmp_path):
    nodes = spark.createDataFrame([("c", "d", "d::0", None), ("e", "f", "f::0", None)], "corpus string, doc_id string, node_id string, parent_id string")
    tree.save(nodes, str(tmp_path / "tree"))
    assert [r.node_id for r in tree.load(spark, str(tmp_path / "tree"), "e").collect()] == ["f::0"]
    made, failed = strategies.strategies("no such")
    assert made == {} and "KeyError" in failed["no such"] and set(strategies.strategies()[0]) == set(strategies.STRATEGIES)
    assert arena.load_state(spark, str(tmp_path / "arena")) is None
    matches = spark.createDataFrame([(i, "q" * 300, "x", "y", "a" * 600, "b", "a" if i else None, i) for i in range(250)], "match_id long, question string, strategy_a string, strategy_b string, answer_a string, answer_b string, winner string, ts long")
    ratings = spark.createDataFrame([("x", 1216.04), ("y", 1183.96)], "strategy string, rating double")
    arena.save_state(matches, ratings, str(tmp_path / "arena"))
    kept, held = arena.load_state(spark, str(tmp_path / "arena"))
    assert {r.match_id for r in kept.collect()} == set(range(50, 250)) and kept.first().answer_a == "a" * 500 and held.count() == 2
    for _ in range(2):
        arena.append_votes(matches.filter("match_id < 2"), ratings, str(tmp_path / "votes"))
    logged = spark.read.json(str(tmp_path / "votes")).collect()
    assert [(r.match_id, len(r.question), r.elo_snapshot.x) for r in logged] == [(1, 200, 1216.0)] * 2


def test_event_rows(spark):
    entities = spark.createDataFrame([("b", "B", "t"), ("a", "A", "t")], "fqn string, name string, type string")
    relations = spark.createDataFrame([("a", "b", "uses")], "source string, target string, type string")
    assert [(r.event, json.loads(r.data).get("id")) for r in lifecycle.graph_events(entities, relations).collect()] == [("entity", "a"), ("entity", "b"), ("relationship", None), ("done", None)]
    sections = spark.createDataFrame([("d", i, f"s{i}", "T", c) for i, c in enumerate(["x", " ", "y"])], "doc_id string, pos int, section_id string, title string, content string")
    pairs = spark.createDataFrame([("s0::0", "d", "s0", "q", "a"), ("s2::0", "d", "s2", "q", "a")], "pair_id string, doc_id string, section_id string, question string, answer string")
    events = lifecycle.generation_events(sections, pairs).collect()
    assert [r.event for r in events] == ["started", "progress", "pair", "progress", "pair", "complete"] and json.loads(events[-1].data) == {"total_pairs": 2}
    assert [r.event for r in lifecycle.generation_events(sections.limit(0), pairs).collect()] == ["error"]
    scored = spark.createDataFrame([("s0", 0.9, "q1", 0), ("s1", 0.1, "q2", 1)], "section_id string, accuracy double, question_id string, pos int")
    audited = lifecycle.audit(scored)
    events = lifecycle.audit_events(audited).collect()
    assert [r.event for r in events] == ["started", "section_result", "section_result", "complete"]
    assert json.loads(events[-1].data) == {"strong": 1, "weak": 0, "gaps": 1, "total_questions": 2}
    told = [r.event for r in lifecycle.fix_events(audited, lifecycle.fixes(audited, sections)).collect()]
    assert told == ["phase", "audit_progress", "audit_progress", "audit_complete", "phase", "fix_result", "complete"]


def test_session_history(spark, tmp_path):
    rows = [(1, t, "assistant" if t % 2 else "user", "x" * 600 if t == 13 else f"m{t}") for t in range(14)] + [(2, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn int, role string, text string").parquet(str(tmp_path / "in"))
    got = {r.conv_id: r.history for r in stateful.drained(stateful.session_history(stream), str(tmp_path / "history"), "update").collect()}
    assert len(got[1]) == 12 and got[1][0] == "user: m2" and got[1][-1] == "assistant: " + "x" * 500 + "..." and got[2] == [": "]
