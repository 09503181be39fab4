"""Parsers as column functions: every format's query against its SQL, and rows that are null, empty or cannot be parsed."""

import duckdb
import pytest

from lexmill.plans import catalogue_sources  # noqa: F401  registers its queries
from lexmill.plans.catalogue import ORACLE_SQL, QUERIES
from lexmill.sources import files
from lexmill.sources.parsers import parse_csv, parse_markdown
from tests.test_operators import SF

NAMES = ["markdown_sections", "markdown_code", "csv_sections", "plaintext_sections", "rst_sections", "filing_sections", "html_sections"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    for t in ("documents", "pages", "supplier"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    want = duckdb.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and got


def test_references_without_a_semicolon(spark, tmp_path):
    pages = [(1, "u", "<p>t</p><h1>A &lt;b&gt; and&amp</h1><p>x &amp;amp y&lt z &copy; &#39;q&quot;</p>"), (2, "u", "<p>t</p><h1>&amp;lt; &</h1>&ampamp&quot")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(ORACLE_SQL["html_sections"])
    got = QUERIES["html_sections"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and "A <b> and&amp" in [r.title for r in got]


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "# A\nx"), (4, "no heading"), (5, 'h\n"unclosed')]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.section.title) for r in files.sections_of(frame, "markdown").collect()] == [(3, "A")]
    assert {r.doc_id for r in files.sections_of(frame, "csv").collect()} <= {3, 4, 5}
    assert files.sections_of(frame.limit(0), "html").count() == 0


def test_fences_tables_and_blank_cells():
    found = parse_markdown("# A #\n```py\na\n```\n|h|k|\n|-|-|\n|1||\n|lone|\ntext\n```\nopen to the end\n## B\n| x |\n")
    assert [s.title for s in found] == ["A #", "B"] and found[0].content == "text"
    assert found[0].code_blocks == [{"language": "py", "code": "a"}, {"language": "", "code": "open to the end"}]
    assert found[0].tables == [{"headers": ["h", "k"], "rows": [["1"], ["lone"]], "caption": ""}] and found[1].content == ""
    assert parse_csv("a , b\n1, \n , \n2,x\n")[0].content == "a: 1\na: 2; b: x" and parse_csv("a,b\n") == []


def test_sections_are_packed_part_by_part(spark, monkeypatch):
    """A batch of more text than is held as objects at a time gives the sections of all its texts."""
    assert files.HELD_CHARS <= 1_000_000
    rows = spark.range(30).selectExpr("id doc_id", "if(id % 7 = 3, null, concat('# A', id, repeat('\nx y', 25000))) text").coalesce(1)
    found = files.sections_of(rows, "markdown").selectExpr("doc_id", "section.title", "length(section.content) n").collect()
    assert sorted((r.doc_id, r.title, r.n) for r in found) == [(i, f"A{i}", 99_999) for i in range(30) if i % 7 != 3]
