"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier prefixes of the retrieval strategies, tried in this order.
NAMESPACES = ["L0:", "L1:", "L2:", "qna:", "graph:", "pageindex:"]
# Patterns of the intent scan, in order, first match wins.
SCAN_PATTERNS = {
    "comparison": [
        "\\bcompare\\b", "\\bvs\\.?\\b", "\\bdifference(?:s)? between\\b", "\\bwhich is better\\b", "\\badvantage(?:s)? of .+ over\\b",
        "\\bversus\\b",
    ],
    "relational": [
        "\\bdepend(?:s|encies)?\\b", "\\brequire(?:s|ments)?\\b", "\\baffect(?:s)?\\b", "\\bdownstream\\b", "\\bif I .+ what happens\\b",
        "\\bcause(?:s)?\\b", "\\bimplication(?:s)?\\b", "\\btrigger(?:s)?\\b", "\\binvoke(?:s)?\\b", "\\bconnect(?:s|ed)? to\\b",
        "\\broute(?:s)? to\\b", "\\blogs? to\\b", "\\bdeployed in\\b",
    ],
    "procedural": [
        "\\bhow (?:do|can|should|to)\\b", "\\bsteps? to\\b", "\\bsetup\\b", "\\bconfigure\\b", "\\bimplement\\b", "\\binstall\\b",
        "\\bcreate\\b", "\\bbuild\\b", "\\bdeploy\\b", "\\blaunch\\b", "\\benable\\b", "\\battach\\b",
    ],
}
# Words of the regex fallback of the router, in order.
FALLBACK_PATTERNS = [
    ("factoid", "\\b(what|who|when|where|which|define|definition|meaning)\\b"),
    ("exploratory", "\\b(explain|overview|tell me|describe|about)\\b"),
    ("comparison", "\\b(and|or|both|either|neither)\\b"),
    ("relational", "\\b(if|when|after|before|then)\\b"),
]
# Substrings of the hybrid strategy's own routing, in order.
HYBRID_WORDS = [
    ("comparison", ["compare", "vs", "difference", "versus"]),
    ("relational", ["depend", "require", "affect", "downstream"]),
    ("procedural", ["how do", "how can", "how to", "steps", "setup", "configure", "implement"]),
]
# Substrings of the graph strategy's routing, in order.
GRAPH_WORDS = [
    ("comparison", ["compare", "vs", "difference", "vs.", "versus"]),
    ("dependency", ["depend", "require", "affect", "downstream", "cause"]),
    ("entity_lookup", ["what is", "define", "explain", "describe"]),
    ("multi_hop", ["related", "connected", "linked", "path"]),
]
# Trigger words of the graph query templates, most specific first.
TEMPLATE_WORDS = [
    ("TYPE_HIERARCHY", ["inherit", "hierarchy", "subclass", "superclass", "extends"]),
    ("DEPENDENCY_CHAIN", ["depend", "import", "require"]),
    ("CROSS_REFERENCE", ["cross-ref", "references", "links to", "connected to"]),
    ("COMPARISON_QUERY", ["compare", "difference", "vs", "versus"]),
    ("MULTI_HOP_QUERY", ["connected", "related", "hop", "neighbor"]),
    ("SINGLE_ENTITY_LOOKUP", ["find", "lookup", "get", "show", "what is"]),
]
# US dollars for a million tokens in and out, tried by exact name, then as a substring, in this order.
PRICES = [
    ("haiku", 0.80, 4.00), ("sonnet", 3.00, 15.00), ("opus", 15.00, 75.00), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00),
    ("gpt-4-turbo", 10.00, 30.00), ("llama", 0.0, 0.0), ("mistral", 0.0, 0.0), ("qwen", 0.0, 0.0), ("phi", 0.0, 0.0), ("gemma", 0.0, 0.0),
]
DEFAULT_PRICE = "sonnet"
# What a cache write and a cache read cost, as shares of an input token.
CACHE_WRITE, CACHE_READ = 1.25, 0.1


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, "^(?U)\\s+|(?U)\\s+$", "")


def ws_tokens(text: Column) -> Column:
    """Lower-cased runs of non-space characters (Unicode white space)."""
    return F.filter(F.split(F.lower(text), "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(ws_tokens(text)).cast("long")


def approx_tokens(words: Column) -> Column:
    return F.floor(words * F.lit(1.3)).cast("long")


def is_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit("^(?U)\\s*$"))


def slugify(title: Column) -> Column:
    kept = F.regexp_replace(stripped(F.lower(title)), "(?U)[^\\w\\s/-]", "")
    slug = F.regexp_replace(kept, "(?U)\\s+", "-")
    return F.when(slug == "", "section").otherwise(slug)


def strip_namespace(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, "^(" + "|".join(NAMESPACES) + ")", "")


def tier_of(question_id: Column) -> Column:
    """The number after the first ``-t`` of an id like corpus-t3-001; 0 if there is none."""
    tail = F.split_part(question_id, F.lit("-t"), F.lit(2))
    return F.coalesce(F.try_to_number(F.nullif(F.split_part(tail, F.lit("-"), F.lit(1)), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))


def holds(text: Column, term: Column) -> Column:
    """Case-insensitive literal containment."""
    return F.contains(F.lower(text), F.lower(term))


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def first_json_object(text: Column) -> Column:
    return F.regexp_extract(text, "(?s)\\{[^}]+\\}", 0)


def greedy_json_array(text: Column) -> Column:
    return F.regexp_extract(text, "(?s)\\[.*\\]", 0)


def strip_code_fences(text: Column) -> Column:
    return stripped(F.regexp_replace(text, "(?m)^```[A-Za-z]*[ \\t]*$", ""))


def dedup_key(text: Column, words: int = 50) -> Column:
    return F.array_join(F.slice(ws_tokens(text), 1, words), " ")


def keyword_intent(text: Column) -> Column:
    """Pattern scan; null where no group matches."""
    found = F.lit(None).cast("string")
    for intent, patterns in reversed(SCAN_PATTERNS.items()):
        found = F.when(F.regexp_like(text, F.lit("(?i)" + "|".join(patterns))), intent).otherwise(found)
    return found


def fallback_intent(text: Column) -> Column:
    """Broader word scan for what the pattern scan leaves; factoid where nothing matches."""
    found = F.lit("factoid")
    for intent, pattern in reversed(FALLBACK_PATTERNS):
        found = F.when(F.regexp_like(F.lower(text), F.lit(pattern)), intent).otherwise(found)
    return found


def routed_intent(text: Column, classified: Column | None = None) -> Column:
    """Scan, then a classifier's answer (null where it failed or gave no known intent), then the fallback; never null."""
    known = [*SCAN_PATTERNS, "factoid", "exploratory"]
    stages = [] if classified is None else [F.when(classified.isin(known), classified)]
    return F.coalesce(keyword_intent(text), *stages, fallback_intent(text))


def first_of(text: Column, groups: list[tuple[str, list[str]]], default: str | None) -> Column:
    """The first group one of whose words the lower-cased text contains."""
    found = F.lit(default).cast("string")
    for name, words in reversed(groups):
        held = F.lit(False)
        for w in words:
            held = held | F.contains(F.lower(text), F.lit(w))
        found = F.when(held, name).otherwise(found)
    return found


def substring_intent(text: Column) -> Column:
    """Routing of the hybrid strategy."""
    return first_of(text, HYBRID_WORDS, "factoid")


def graph_intent(text: Column) -> Column:
    """Routing of the graph strategy."""
    return first_of(text, GRAPH_WORDS, "fulltext")


def graph_template(text: Column) -> Column:
    """Name of the query template whose trigger words the text has; null without any."""
    return first_of(text, TEMPLATE_WORDS, None)


def entity_mentions(text: Column, limit: int = 3) -> Column:
    """Quoted, dotted, hyphenated and capitalised names, in that priority, distinct."""
    patterns = [
        "[\"']([^\"']+)[\"']",
        "\\b([a-z][a-z0-9_]*(?:\\.[a-z][a-z0-9_]*)+)\\b",
        "\\b([a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)+)\\b",
        "\\b([A-Z][a-zA-Z0-9]+)\\b",
    ]
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    return F.slice(F.array_distinct(found), 1, limit)


def normal_name(name: Column) -> Column:
    """Upper-case name without call brackets or a type word at its end, for entity resolution."""
    return F.upper(stripped(F.regexp_replace(name, "(?i)\\s*\\(\\)\\s*$|\\s+(class|function|method|module|type)\\s*$", "")))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, cache_writes: Column | None = None, cache_reads: Column | None = None) -> Column:
    """US dollars of a call: the price of the exact model name, else of the first listed name it contains, else the default."""
    rate_in = rate_out = None
    for test in (lambda n: F.contains(model, F.lit(n)), lambda n: model == n):
        if rate_in is None:
            rate_in, rate_out = (F.lit(next(p[i] for p in PRICES if p[0] == DEFAULT_PRICE)) for i in (1, 2))
        for name, price_in, price_out in reversed(PRICES):
            rate_in, rate_out = F.when(test(name), price_in).otherwise(rate_in), F.when(test(name), price_out).otherwise(rate_out)
    zero = F.lit(0)
    cached = F.coalesce(cache_writes, zero) * CACHE_WRITE + F.coalesce(cache_reads, zero) * CACHE_READ if cache_writes is not None or cache_reads is not None else zero
    return ((tokens_in + cached) * rate_in + tokens_out * rate_out) / 1_000_000


def opened_fence(text: Column) -> Column:
    """Without a fence that opens the text and one that ends it; what is between is kept as it is."""
    t = stripped(text)
    inner = F.regexp_replace(F.regexp_replace(t, "^```[^\n]*\n", ""), "```$", "")
    return F.when(F.startswith(t, F.lit("```")) & (F.instr(t, "\n") > 0), stripped(inner)).otherwise(t)


def fenced_query(text: Column) -> Column:
    """The first fenced block of an answer, or the whole answer."""
    block = F.regexp_extract(text, "(?is)```(?:cypher)?\\s*(.+?)```", 1)
    return F.when(block != "", stripped(block)).otherwise(stripped(text))


def reads_only(query: Column, needs_read_clause: bool = True) -> Column:
    """Whether a graph query has no write clause and, unless told otherwise, some read clause."""
    if needs_read_clause:
        writes = F.regexp_like(query, F.lit("(?i)\\b(CREATE|DELETE|DETACH|SET|REMOVE|MERGE|DROP)\\b"))
        return ~writes & F.regexp_like(query, F.lit("(?i)\\b(MATCH|CALL|RETURN|WITH|UNWIND)\\b"))
    return ~F.regexp_like(query, F.lit("(?i)\\b(CREATE|MERGE|SET|DELETE|REMOVE|DROP|DETACH|CALL\\s+apoc\\.schema)\\b"))


def balanced_json_array(text: Column) -> Column:
    """The first balanced ``[...]`` of a text, aware of strings and escapes; null without one.

    The regular expression takes strings, other characters and nested arrays to a depth of five.
    """
    string, plain = '"(?:[^"\\\\]|\\\\.)*+"', '[^\\[\\]"]'
    pattern = f"\\[(?:{string}|{plain})*+\\]"
    for _ in range(5):
        pattern = f"\\[(?:{string}|{plain}|{pattern})*+\\]"
    return F.nullif(F.regexp_extract(opened_fence(text), "(?s)" + pattern, 0), F.lit(""))


def prettified(slug: Column) -> Column:
    """``aws-compute`` as ``Aws Compute``."""
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def section_text(title: Column, content: Column, code_blocks: Column, tables: Column) -> Column:
    """A section as one text: title, content, fenced code (language, code) and tables (headers, rows)."""
    code = F.transform(code_blocks, lambda c: F.concat(F.lit("```"), c["language"], F.lit("\n"), c["code"], F.lit("\n```")))
    row = lambda cells: F.array_join(cells, " | ")
    lines = F.flatten(F.transform(tables, lambda t: F.concat(F.when(F.size(t["headers"]) > 0, F.array(row(t["headers"]))).otherwise(F.array().cast("array<string>")), F.transform(t["rows"], row))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), title), content), F.coalesce(code, F.array()), F.coalesce(lines, F.array())), "\n\n")


def filing_entities(text: Column) -> Column:
    """Dollar amounts (first 20), companies and executives (distinct, first 10) of a filing."""
    amounts = F.regexp_extract_all(text, F.lit("(?i)\\$[\\d,]+(?:\\.\\d+)?(?:\\s*(?:million|billion|trillion))?"), F.lit(0))
    companies = F.regexp_extract_all(text, F.lit("\\b[A-Z][A-Za-z0-9&,.\\s]{2,40}(?:Inc\\.|Corp\\.|LLC|Ltd\\.|L\\.P\\.|Co\\.)"), F.lit(0))
    titles = "(?:Chief\\s+\\w+\\s+Officer|President|Chairman|CEO|CFO|COO|CTO|Director)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3})"
    executives = F.regexp_extract_all(text, F.lit(titles), F.lit(1))
    return F.struct(
        F.slice(amounts, 1, 20).alias("dollar_amounts"),
        F.slice(F.array_distinct(F.transform(companies, stripped)), 1, 10).alias("companies"),
        F.slice(F.array_distinct(executives), 1, 10).alias("executives"),
    )


def site_links(base: Column, links: Column) -> Column:
    """Links of a page made absolute, those of its host only, without query and fragment, distinct."""
    scheme, host = F.regexp_extract(base, "^(https?)://", 1), F.regexp_extract(base, "^https?://([^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^(https?://[^/]*(?:/.*/|/|))", 1)
    root = F.concat(scheme, F.lit("://"), host)

    def absolute(link: Column) -> Column:
        return (
            F.when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(root, link))
            .when(F.regexp_like(link, F.lit("^([?#].*)?$")), F.concat(clean_url(base), link))
            .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), F.regexp_replace(link, "^(\\./)+", "")))
        )

    whole = F.transform(F.transform(links, absolute), clean_url)
    return F.array_distinct(F.filter(whole, lambda x: F.regexp_extract(x, "^https?://([^/?#]*)", 1) == host))


def utc_stamp(epoch_seconds: Column) -> Column:
    """ISO 8601 in UTC of seconds since 1970."""
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def record_text(names: list[str]) -> Column:
    """``k: v | k: v`` of the columns that are not null."""
    return F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in names])


def selection(text: Column, n: Column, beam: int) -> Column:
    """Zero-based picks of an answer like ``1,3,5``; out-of-range ones drop, none means the first ``beam``."""
    picks = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int") - 1), lambda i: i.isNotNull() & (i >= 0) & (i < n))
    first = F.sequence(F.lit(0), F.least(F.lit(beam), n) - 1)
    return F.when(F.size(picks) > 0, F.slice(picks, 1, beam)).when(n > 0, first).otherwise(F.array().cast("array<int>"))


def clean_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, "[?#].*$", "")


def strip_boilerplate(html: Column) -> Column:
    """Visible text of a page: script, style, nav, footer, header and aside dropped, tags removed."""
    kept = F.regexp_replace(html, "(?is)<(script|style|nav|footer|header|aside)\\b.*?</\\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, "(?s)<[^>]*>", " "), "\\s+", " "))
