from lexmill.sources import files
from lexmill.sources.parsers import headings_by_size, parse_csv, parse_filing, parse_html, parse_markdown, parse_plaintext, parse_rst


def test_markdown():
    found = parse_markdown("lost\n# One\ntext [a](b)\n```py\nx = 1\n```\n### Deep\n| h |\n|---|\n| 1 |\n# One\n")
    assert [(s.id, s.level, s.heading_path) for s in found] == [("one", 1, ["One"]), ("deep", 3, ["One", "Deep"]), ("one-1", 1, ["One"])]
    assert found[0].content == "text [a](b)" and found[0].code_blocks == [{"language": "py", "code": "x = 1"}]
    assert found[0].links[0]["target"] == "b" and found[1].tables[0]["rows"] == [["1"]] and found[1].parent_id == "one"


def test_rst():
    found = parse_rst("Title\n=====\nSee :func:`os.path`.\n\nSub\n---\nCode::\n\n    x = 1\n")
    assert [(s.title, s.level) for s in found] == [("Title", 1), ("Sub", 2)]
    assert found[0].links[0]["ref_type"] == "func" and found[1].code_blocks[0]["code"] == "x = 1"


def test_html():
    found = parse_html("<title>T</title><nav>menu</nav><h1>A</h1><p>one <a href='/x'>link</a></p><h2>B</h2><table><tr><th>h</th></tr><tr><td>1</td></tr></table>")
    assert [s.title for s in found][-2:] == ["A", "B"] and "menu" not in "".join(s.content for s in found)
    assert found[-2].links[0] == {"target": "/x", "label": "link", "ref_type": "link"} and found[-1].tables[0]["rows"] == [["1"]]


def test_others():
    assert [s.title for s in parse_filing("<p>Item 1. Business</p><p>text</p><p>Item 1. Business</p>")] == ["Item 1. Business"]
    assert [s.title for s in parse_plaintext("INTRODUCTION\n\nbody")] == ["INTRODUCTION"]
    sections = parse_csv("a,b\n" + "\n".join(f"{i},x" for i in range(25)))
    assert len(sections) == 2 and sections[0].content.startswith("a: 0; b: x")
    assert [(s.title, s.level) for s in headings_by_size([(20, "Big"), (10, "x"), (10, "y"), (14, "Mid"), (10, "z")])] == [("Big", 1), ("Mid", 2)]


def test_scan_and_jsonl(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\nhello world")
    (tmp_path / "in/b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "in/c.bin").write_bytes(b"no")
    docs = files.read_documents(spark, str(tmp_path / "in"), "demo")
    got = {r.id: r for r in docs.collect()}
    assert set(got) == {"a", "b"} and got["a"].sections[0].content == "hello world" and got["b"].sections[0].content == "café"
    files.write_jsonl(docs, str(tmp_path / "out"))
    (tmp_path / "out/part-bad.json").write_text("{broken\n")
    assert {r.id for r in files.read_jsonl(spark, str(tmp_path / "out")).collect()} == {"a", "b"}


def test_streaming(spark, tmp_path):
    from lexmill.streaming import stateful

    events = stateful.event_stream(spark, "/root/testdata/sf0.001/events.parquet")
    limited = stateful.drained(stateful.rate_limited(events, 1, 3600), str(tmp_path / "limited"))
    assert limited.count() == 1000 and limited.filter("not allowed").count() > 0
    ratings = stateful.drained(stateful.elo_stream(events), str(tmp_path / "elo"), "update")
    assert ratings.count() == 5
