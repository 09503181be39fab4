"""Registered queries of the graph templates, the routers, the evaluation passes and the report columns."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, generation, knowledge, strategies, tree
from ..operators.provider import STUB, shared_words
from ..session import table
from .catalogue import _ASK, BM25, GRAPH, QUERIES, REC, SECTIONS, _asks, _expected, _graph, _questions, _records, _top, query

# Routing -------------------------------------------------------------------------------------------------


def _case(column: str, groups, default: str) -> str:
    tests = " ".join(f"when {' or '.join(f'contains({column}, {_quoted(w)})' for w in words)} then '{name}'" for name, words in groups)
    return f"case {tests} else {default} end"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SCAN = "case " + " ".join(f"when regexp_matches(question, {_quoted('|'.join(p))}, 'i') then '{i}'" for i, p in tx.SCAN_PATTERNS.items()) + " end"
_FALLBACK = "case " + " ".join(f"when regexp_matches(lower(question), {_quoted(p)}) then '{i}'" for i, p in tx.FALLBACK_PATTERNS) + " else 'factoid' end"


@query(f"with q as (select p_partkey, {_ASK} as question from part) select p_partkey, {_SCAN} as scan, {_FALLBACK} as fallback, coalesce({_SCAN}, {_FALLBACK}) as intent from q")
def router_intent(spark, sf):
    q = F.col("question")
    return _asks(spark, sf).select("p_partkey", tx.keyword_intent(q).alias("scan"), tx.fallback_intent(q).alias("fallback"), tx.routed_intent(q).alias("intent"))


@query(f"with q as (select p_partkey, lower({_ASK}) as q from part) select p_partkey, {_case('q', tx.GRAPH_WORDS, _quoted('fulltext'))} as intent, {_case('q', tx.TEMPLATE_WORDS, 'null')} as template from q")
def graph_routing(spark, sf):
    q = F.col("question")
    return _asks(spark, sf).select("p_partkey", tx.graph_intent(q).alias("intent"), tx.graph_template(q).alias("template"))


_NAMES = "select p_partkey, p_name || case p_partkey % 6 when 0 then '()' when 1 then ' class' when 2 then ' Function ' when 3 then ' type' when 4 then ' service' else '' end as n from part"


@query(f"with q as ({_NAMES}) select p_partkey, upper(trim(regexp_replace(n, '\\s*\\(\\)\\s*$|\\s+(class|function|method|module|type)\\s*$', '', 'i'))) as name from q")
def normal_names(spark, sf):
    kind = F.col("p_partkey") % 6
    tail = F.when(kind == 0, "()").when(kind == 1, " class").when(kind == 2, " Function ").when(kind == 3, " type").when(kind == 4, " service").otherwise("")
    return table(spark, sf, "part").select("p_partkey", tx.normal_name(F.concat("p_name", tail)).alias("name"))


_MODELS = ["haiku", "gpt-4o-mini", "my-gpt-4o-mini-tuned", "gpt-4o", "claims-opus-1", "local-phi", "unknown"]
_PRICE = lambda i: "case " + " ".join(f"when model = '{p[0]}' then {p[i]}" for p in tx.PRICES) + " " + " ".join(f"when contains(model, '{p[0]}') then {p[i]}" for p in tx.PRICES) + f" else {next(p[i] for p in tx.PRICES if p[0] == tx.DEFAULT_PRICE)} end"


@query(f"with c as (select o_orderkey, ({_MODELS})[o_orderkey % 7 + 1] as model, o_custkey as i, o_orderkey % 1000 as o, o_orderkey % 50 as w, o_orderkey % 30 as r from orders) select o_orderkey, model, round(((i + w * 1.25::double + r * 0.1::double) * {_PRICE(1)}::double + o * {_PRICE(2)}::double) / 1000000.0, 12) as cost from c")
def model_cost(spark, sf):
    model = F.get(F.array(*map(F.lit, _MODELS)), (F.col("o_orderkey") % 7).cast("int"))
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", model.alias("model"), F.round(tx.token_cost(model, F.col("o_custkey"), key % 1000, key % 50, key % 30), 12).alias("cost"))


_ANSWERS = "select p_partkey, case p_partkey % 5 when 0 then '```cypher' || chr(10) || 'MATCH (n) RETURN n' || chr(10) || '```' when 1 then 'MATCH (n) SET n.x = 1' when 2 then 'select 1' when 3 then 'Sure: ```' || chr(10) || 'CALL db.x()' || chr(10) || '``` done' else 'RETURN ' || p_name end as a from part"


@query(f"with x as ({_ANSWERS}), f as (select p_partkey, trim(case when regexp_extract(a, '(?is)```(?:cypher)?\\s*(.+?)```', 1) <> '' then regexp_extract(a, '(?is)```(?:cypher)?\\s*(.+?)```', 1) else a end, ' ' || chr(10)) as q from x) select p_partkey, q, not regexp_matches(q, '\\b(CREATE|DELETE|DETACH|SET|REMOVE|MERGE|DROP)\\b', 'i') and regexp_matches(q, '\\b(MATCH|CALL|RETURN|WITH|UNWIND)\\b', 'i') as reads_only from f")
def query_guard(spark, sf):
    kind = F.col("p_partkey") % 5
    answer = F.when(kind == 0, "```cypher\nMATCH (n) RETURN n\n```").when(kind == 1, "MATCH (n) SET n.x = 1").when(kind == 2, "select 1").when(kind == 3, "Sure: ```\nCALL db.x()\n``` done").otherwise(F.concat(F.lit("RETURN "), "p_name"))
    fenced = table(spark, sf, "part").select("p_partkey", tx.fenced_query(answer).alias("q"))
    return fenced.withColumn("reads_only", tx.reads_only(F.col("q")))


@query("with t as (select doc_id, regexp_extract_all(text, '\\$[\\d,]+(?:\\.\\d+)?(?:\\s*(?:million|billion|trillion))?', 0, 'i')[1:20] as a from documents) select doc_id, len(a) as n_amounts, coalesce(a[1], '') as first_amount from t")
def filing_amounts(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", tx.filing_entities(F.col("text"))["dollar_amounts"].alias("a"))
    return found.select("doc_id", F.size("a").cast("long").alias("n_amounts"), F.coalesce(F.get("a", F.lit(0)), F.lit("")).alias("first_amount"))


# Graph templates -----------------------------------------------------------------------------------------

# The same graph the other way round, as chains of dependencies.
_CHAINS = GRAPH + ", d as (select target as source, source as target, case when target like 'nation:%' then 'CONNECTS_TO' else 'DEPENDS_ON' end as type from e)"


def _chains(spark, sf):
    nodes, edges = _graph(spark, sf)
    kind = F.when(F.startswith("target", F.lit("nation:")), "CONNECTS_TO").otherwise("DEPENDS_ON")
    return nodes, edges.select("edge_id", F.col("target").alias("source"), F.col("source").alias("target"), kind.alias("type"))


_UNDIRECTED = "u as (select source as here, target as there, type, source || '|' || target as id from e union all select target, source, type, source || '|' || target from e)"


@query(
    f"with {GRAPH}, {_UNDIRECTED}, s as (select fqn as start from nodes where type = 'nation'), "
    "h1 as (select start, there as fqn, 1 as hops, [id] as used, start || '>' || there as path from s join u on here = start), "
    "h2 as (select start, there as fqn, 2 as hops, list_append(used, id) as used, path || '>' || there as path from h1 join u on here = fqn where not list_contains(used, id)), "
    "h3 as (select start, there as fqn, 3 as hops, list_append(used, id) as used, path || '>' || there as path from h2 join u on here = fqn where not list_contains(used, id)), "
    "a as (select * from h1 union all select * from h2 union all select * from h3), "
    "r as (select start, a.fqn, name, type, hops, row_number() over (partition by start order by hops, name, a.fqn, path) as nth from a join nodes using (fqn)) "
    "select start, fqn, name, type, hops from r where nth <= 50"
)
def graph_multi_hop_undirected(spark, sf):
    nodes, edges = _graph(spark, sf)
    return knowledge.multi_hop(edges, nodes, nodes.filter("type = 'nation'").select("fqn")).select("start", "fqn", "name", "type", "hops")


@query(f"with recursive {_CHAINS}, t as (select fqn as start, fqn, 0 as depth, fqn as chain from nodes where type in ('supplier', 'customer') union all select t.start, d.target, depth + 1, chain || '>' || d.target from t join d on d.source = t.fqn where depth < 4), r as (select t.*, row_number() over (partition by start order by depth, fqn, chain) as nth from t where depth > 0) select start, fqn, depth, chain from r where nth <= 100")
def graph_dependency_limited(spark, sf):
    nodes, edges = _chains(spark, sf)
    found = knowledge.dependency_chains(edges, nodes, nodes.filter("type in ('supplier', 'customer')").select("fqn"))
    return found.select("start", "fqn", "depth", F.array_join("chain", ">").alias("chain"))


_PAIRS = "p as (select x.fqn as a, y.fqn as b from nodes x join nodes y on x.type = 'nation' and y.type = 'region')"
_NEAR = "n as (select source as here, target as there, type from e union all select target, source, type from e)"


@query(f"with {GRAPH}, {_NEAR}, {_PAIRS} select distinct p.a, p.b, n.there as shared, n.type as rel_to_a, m.type as rel_to_b from p join n on n.here = a left join n m on m.here = b and m.there = n.there")
def graph_comparison(spark, sf):
    nodes, edges = _graph(spark, sf)
    pairs = nodes.filter("type = 'nation'").select(F.col("fqn").alias("a")).crossJoin(F.broadcast(nodes.filter("type = 'region'").select(F.col("fqn").alias("b"))))  # five regions
    return knowledge.comparison(edges, pairs, unique_too=True)


@query(
    f"with {GRAPH}, k as (select upper(n_name) as key from nation union all select 'region:1'), "
    "m as (select key, fqn, name, type, row_number() over (partition by key order by via, fqn) as nth from (select key, fqn, name, type, 0 as via from k join nodes on key = fqn union all select key, fqn, name, type, 1 from k join nodes on lower(key) = lower(name))), "
    "u as (select source as here, target as there, type as rel, 'outgoing' as direction from e union all select target, source, type, 'incoming' from e), "
    "j as (select m.key, m.fqn, o.name as neighbour, rel, direction, row_number() over (partition by m.key order by o.name, rel, direction, there) as nth from m join u on here = m.fqn join nodes o on o.fqn = there where m.nth = 1) "
    "select key, fqn, count(*) as n_neighbours, min(neighbour) as first, max(neighbour) as last from j where nth <= 50 group by key, fqn"
)
def graph_entity_neighbours(spark, sf):
    nodes, edges = _graph(spark, sf)
    keys = table(spark, sf, "nation").select(F.upper("n_name").alias("key")).unionByName(spark.createDataFrame([("region:1",)], "key string"))
    names = lambda x: x["neighbour"]
    found = knowledge.entity_lookup(edges, nodes, keys)
    return found.select("key", "fqn", F.size("neighbours").cast("long").alias("n_neighbours"), F.array_min(F.transform("neighbours", names)).alias("first"), F.array_max(F.transform("neighbours", names)).alias("last"))


@query(f"with {GRAPH}, x as (select source as start, target as fqn, type, 'outgoing' as direction from e union all select target, source, type, 'incoming' from e), r as (select start, x.fqn, name, x.type, direction, row_number() over (partition by start order by direction, name, x.fqn, x.type) as nth from x join nodes n on n.fqn = x.fqn) select start, fqn, name, type, direction from r where nth <= 50")
def graph_cross_refs_limited(spark, sf):
    nodes, edges = _graph(spark, sf)
    return knowledge.cross_reference(edges, nodes, nodes.select("fqn"))


@query(
    f"with recursive {GRAPH}, s as (select fqn as start from nodes where type in ('region', 'nation', 'supplier')), "
    "up as (select start, start as fqn, 0 as depth from s union all select up.start, e.source, depth + 1 from up join e on e.target = up.fqn where depth < 5), "
    "down as (select start, start as fqn, 0 as depth from s union all select down.start, e.target, depth + 1 from down join e on e.source = down.fqn where depth < 5), "
    "a as (select * from up union select * from down where depth > 0), r as (select start, a.fqn, name, depth, row_number() over (partition by start order by depth, a.fqn) as nth from a join nodes using (fqn)) "
    "select start, fqn, name, depth from r where nth <= 50"
)
def graph_type_hierarchy(spark, sf):
    nodes, edges = _graph(spark, sf)
    return knowledge.hierarchy(edges, nodes, nodes.filter("type in ('region', 'nation', 'supplier')").select("fqn"))


@query(f"with recursive {GRAPH}, t as (select fqn as start, fqn, 0 as hops, [fqn] as path from nodes where type = 'region' union all select t.start, e.target, hops + 1, list_append(path, e.target) from t join e on e.source = t.fqn where hops < 4 and not list_contains(path, e.target)), r as (select *, row_number() over (partition by start order by hops, array_to_string(path, '>')) as nth from t where hops > 0) select start, fqn, hops, array_to_string(path, '>') as path from r where nth <= 100")
def graph_simple_paths(spark, sf):
    nodes, edges = _graph(spark, sf)
    return knowledge.simple_paths(edges, nodes.filter("type = 'region'").select("fqn")).withColumn("path", F.array_join("path", ">"))


@query(f"with {GRAPH}, s as (select fqn from nodes order by fqn limit 500), f as (select * from e order by source, type, target limit 1000) select source, type, target from f where source in (select fqn from s) and target in (select fqn from s)")
def graph_sample_edges(spark, sf):
    return knowledge.sample(*_graph(spark, sf), limit=900)[1]


@query()
def graph_communities(spark, sf):
    return knowledge.communities(_graph(spark, sf)[1])


@query("with old as (select distinct p_brand, p_type from part where p_partkey % 2 = 0), new as (select distinct p_brand, p_type from part where p_partkey % 3 = 0) select count(*) filter (o.p_brand is null) as created, count(*) filter (o.p_brand is not null) as updated from new n left join old o using (p_brand, p_type)")
def graph_merge_counts(spark, sf):
    part = table(spark, sf, "part")
    return knowledge.merge_counts(part.filter("p_partkey % 3 = 0"), part.filter("p_partkey % 2 = 0"), ["p_brand", "p_type"])


_EXTRACTED = (
    "ents as (select l_orderkey as section_id, 'p' || l_partkey as fqn, (['Topic', 'Component', 'Gadget', 'Process'])[l_partkey % 4 + 1] as type from lineitem), "
    "rels as (select l_orderkey as section_id, 'p' || l_partkey as source, 'p' || (l_partkey + l_linenumber % 3) as target, (['DEPENDS_ON', 'CONTAINS', 'LIKES'])[l_suppkey % 3 + 1] as type from lineitem), "
    "kept as (select distinct section_id, fqn from ents where type <> 'Gadget')"
)


@query(f"with {_EXTRACTED} select section_id, source, target, type from rels r where type <> 'LIKES' and exists (select 1 from kept k where k.section_id = r.section_id and k.fqn = r.source) and exists (select 1 from kept k where k.section_id = r.section_id and k.fqn = r.target)")
def graph_extraction_valid(spark, sf):
    rows = table(spark, sf, "lineitem")
    pick = lambda names, key: F.get(F.array(*map(F.lit, names)), (F.col(key) % len(names)).cast("int"))
    part = lambda c: F.concat(F.lit("p"), c)
    entities = rows.select(F.col("l_orderkey").alias("section_id"), part(F.col("l_partkey")).alias("fqn"), pick(["Topic", "Component", "Gadget", "Process"], "l_partkey").alias("type"))
    relations = rows.select(
        F.col("l_orderkey").alias("section_id"), part(F.col("l_partkey")).alias("source"), part(F.col("l_partkey") + F.col("l_linenumber") % 3).alias("target"), pick(["DEPENDS_ON", "CONTAINS", "LIKES"], "l_suppkey").alias("type")
    )
    return knowledge.valid_extraction(entities, relations)[1].select("section_id", "source", "target", "type")


# Evaluation ----------------------------------------------------------------------------------------------

def _judge(key: str):
    """A stand-in for a model: replies with JSON that depends on the first argument's length."""
    share = lambda text: F.format_string("%.2f", (F.length(text) % 100) / 100.0)
    return dataclasses.replace(STUB, judge=lambda text, _: F.concat(F.lit(f'{{"{key}": '), share(text), F.lit("}")))


@query("select doc_id, case when contains(lower(text), 'idiot') then 0.25 else (length(text) % 100) / 100.0 end::double as accuracy, 0.5::double as completeness from documents")
def judge_override(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("answer"), F.lit("r").alias("reference"), F.lit(0.25).alias("accuracy"), F.lit(0.5).alias("completeness"), F.lit(0.75).alias("faithfulness"),
        (~F.contains(F.lower("text"), F.lit("idiot"))).alias("structural_pass"),
    )
    return evaluation.judged(rows, _judge("accuracy")).select("doc_id", "accuracy", "completeness")


@query("with r as (select conv_id, max(case when turn = 0 then text end) as q, max(case when turn = 1 then text end) as a from conversations group by conv_id) select conv_id, case when a is null or trim(a) = '' then 0.0 else ((length('Question: ' || coalesce(q, '') || chr(10) || chr(10) || 'Answer:' || chr(10) || a)) % 100) / 100.0 end::double as answer_relevancy, case when q is null then 0.0 else ((length('Question: ' || q || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || 'Chunk 1: ' || q)) % 100) / 100.0 end::double as with_context from r where q is not null")
def ragas_scores(spark, sf):
    said = lambda t: F.max(F.when(F.col("turn") == t, F.col("text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(said(0).alias("question"), said(1).alias("answer")).filter("question is not null")
    rows = rows.withColumns({"chunks": F.array("question"), "reference": F.lit("")})
    relevant = evaluation.ragas(rows, _judge("relevancy")).select("conv_id", "answer_relevancy")
    precise = evaluation.ragas(rows, _judge("context_precision")).select("conv_id", F.col("context_precision").alias("with_context"))
    return relevant.join(precise, "conv_id")


@query(
    f"with {BM25}, expected as (select item_id as question_id, doc_id::varchar as expected_id from benchmark b join documents d on contains(d.text, b.text)), "
    "h as (select t.question_id, t.rank, e.expected_id as hit from top t join expected e on e.question_id = t.question_id and e.expected_id = t.doc_id::varchar), "
    "w as (select question_id, count(*) as expected_count from expected group by all) "
    "select b.item_id as question_id, w.question_id is not null as fallback_doc_level, coalesce(expected_count, 0) as expected_count, coalesce((select string_agg(distinct hit, ',' order by hit) from h where h.question_id = b.item_id), '') as hits, "
    "round(coalesce((select count(distinct hit) from h where h.question_id = b.item_id)::double / expected_count, 0), 6) as recall from benchmark b left join w on w.question_id = b.item_id"
)
def ir_document_fallback(spark, sf):
    found = _top(spark, sf).select("question_id", "chunk_id", "doc_id", "rank")
    none = _questions(spark, sf).select("question_id", F.lit("").alias("expected_id")).filter("false")
    wanted = _expected(spark, sf).withColumnRenamed("expected_id", "doc_id")
    measured = evaluation.metrics_or_documents(found, none, wanted, _questions(spark, sf))
    return measured.select("question_id", "fallback_doc_level", "expected_count", F.array_join("hits", ",").alias("hits"), "recall")


# Report columns ------------------------------------------------------------------------------------------

_OUT = "o as (select event_type as strategy, least(value / 100.0, 1.0) as accuracy, case event_id % 7 when 0 then 'Timeout after 120 s' when 1 then 'refused' else '' end as error, case when event_id % 11 = 0 then '  ' else 'a' end as answer from events)"


@query(f"with {_OUT} select strategy, count(*) as total, count(*) filter (accuracy >= 0.7) as correct, count(*) filter (error <> '') as errors, count(*) filter (error = '' and trim(answer) = '') as empty, count(*) filter (contains(lower(error), 'timeout')) as timeouts from o group by strategy")
def outcome_counts(spark, sf):
    error = F.when(F.col("event_id") % 7 == 0, "Timeout after 120 s").when(F.col("event_id") % 7 == 1, "refused").otherwise("")
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("strategy"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("accuracy"), error.alias("error"), F.when(F.col("event_id") % 11 == 0, "  ").otherwise("a").alias("answer")
    )
    return evaluation.outcome_counts(rows, ["strategy"])


@query(f"with {REC}, m as (select strategy, case when seq % 4 > 0 then accuracy end as recall, case when seq % 4 > 0 then latency_ms end as mrr from rec) select strategy, count(recall) as measured, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr from m group by strategy")
def measured_means(spark, sf):
    some = F.col("seq") % 4 > 0
    rows = _records(spark, sf).select("strategy", F.when(some, F.col("accuracy")).alias("recall"), F.when(some, F.col("latency_ms")).alias("mrr"))
    return evaluation.measured_means(rows, ["strategy"], ["recall", "mrr"])


@query(f"with {REC}, p as (select 'c' || (user_id % 3) as corpus, strategy, 0.5 * avg(accuracy) + 0.3 * (1 - avg(is_error::int)) + 0.2 * greatest(0.0, 1 - (case when max(case when user_id % 3 = 0 then 0.0 else 25.0 end) > 0 then max(case when user_id % 3 = 0 then 0.0 else 25.0 end) else avg(latency_ms) end) / 10000) as c from rec group by all), s as (select strategy, round(avg(c), 6) as composite, count(*) as corpora from p group by strategy) select *, row_number() over (order by composite desc, strategy) as place from s")
def corpus_composite(spark, sf):
    rows = _records(spark, sf).withColumns({"corpus": F.concat(F.lit("c"), F.col("user_id") % 3), "p50_ms": F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(25.0)})
    return evaluation.corpus_composite(rows)


_AUDITED = "s as (select source as section_id, doc_id::varchar as question_id, doc_id as pos, quality::double as accuracy, substr(text, 1, 200) as question from documents join labels using (doc_id))"


def _scored(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select(F.col("source").alias("section_id"), F.col("doc_id").cast("string").alias("question_id"), F.col("doc_id").alias("pos"), F.col("quality").cast("double").alias("accuracy"), F.left("text", F.lit(200)).alias("question"))


@query(f"with {_AUDITED}, r as (select section_id, avg(accuracy) as m, count(*) as tested, arg_min(question_id, (accuracy, pos)) as worst from s group by section_id) select section_id, round(m, 6) as mean, tested, worst, case when m >= 0.7 then 'strong' when m >= 0.3 then 'weak' else 'gap' end as bucket from r")
def audit_rollup(spark, sf):
    return evaluation.audit_rollup(_scored(spark, sf)).withColumn("mean", F.round("mean", 6))


@query(f"with {_AUDITED}, r as (select section_id, avg(accuracy) as m, count(*) as tested from s group by section_id) select round(sum(m * tested) / greatest(sum(tested), 1), 6) as overall, count(*) filter (m >= 0.7) as strong, count(*) filter (m >= 0.3 and m < 0.7) as weak, count(*) filter (m < 0.3) as gap from r")
def audit_overall(spark, sf):
    return evaluation.audit_overall(evaluation.audit_rollup(_scored(spark, sf)))


@query(f"with {_AUDITED}, f as (select section_id, substr(question, 1, 100) as q, row_number() over (partition by section_id order by accuracy, pos) as nth from s where accuracy < 0.7) select section_id, count(*) as n_failing, md5(string_agg(q, '|' order by nth)) as failing_md5 from f where nth <= 3 group by section_id")
def failing_questions(spark, sf):
    found = evaluation.failing_questions(_scored(spark, sf))
    return found.select("section_id", F.size("failing").cast("long").alias("n_failing"), F.md5(F.array_join("failing", "|").cast("binary")).alias("failing_md5"))


@query("with f as (select '/data/' || p_brand || '/' || p_name || case p_partkey % 4 when 0 then '.md' when 1 then '.HTML' when 2 then '' else '.tar.gz' end as path, p_partkey from part) select case p_partkey % 4 when 0 then '.md' when 1 then '.html' when 2 then '' else '.gz' end as extension, count(*) as files from f group by all")
def extension_counts(spark, sf):
    kind = F.col("p_partkey") % 4
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_name", F.when(kind == 0, ".md").when(kind == 1, ".HTML").when(kind == 2, "").otherwise(".tar.gz"))
    return evaluation.extension_counts(table(spark, sf, "part").select(path.alias("path")))


@query("with p as (select conv_id, count(*) as n from conversations where role = 'user' group by conv_id) select count(*) as documents, sum(n)::bigint as pairs, round(avg(n), 6) as pairs_per_document from p")
def pair_stats(spark, sf):
    return evaluation.pair_stats(table(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("doc_id")))


@query("with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id, turn, role, md5(substr(text, 1, 500)) as content_md5 from r where back <= 6")
def recent_turns(spark, sf):
    return evaluation.recent_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("select event_id, user_id from events order by event_id desc limit 200")
def latest_matches(spark, sf):
    return evaluation.retained(table(spark, sf, "events").select("event_id", "user_id"), "event_id")


@query("with m as (select distinct user_id as match_id from events where user_id % 3 > 0), v as (select user_id as match_id, event_type as winner, event_id as seq from events) select match_id, arg_min(winner, seq) as winner, min(seq) as seq from v where match_id in (select match_id from m) group by match_id")
def first_votes(spark, sf):
    events = table(spark, sf, "events")
    matches = events.select(F.col("user_id").alias("match_id"), F.when(F.col("user_id") % 3 == 0, "x").alias("winner")).distinct()
    return evaluation.votable(matches, events.select(F.col("user_id").alias("match_id"), F.col("event_type").alias("winner"), F.col("event_id").alias("seq")))


# Generation ----------------------------------------------------------------------------------------------


@query(f"with {BM25}, ten as (select * from ranked where rank <= 20), r as (select question_id, doc_id || '::' || section_pos as chunk_id, rank, (len(tokens) % 10) / 10.0 as s from ten join sections using (doc_id, section_pos) where rank <= 10), p as (select question_id, chunk_id, s::double as score, row_number() over (partition by question_id order by s desc, rank, chunk_id) as rank from r) select * from p where rank <= 5")
def reranked_passages(spark, sf):
    from ..operators import bm25
    from .catalogue import _sections

    sections = _sections(spark, sf)
    found = bm25.top_k(bm25.build(sections), _questions(spark, sf), 20).select("question_id", "chunk_id", "rank", "score").drop("score")
    model = dataclasses.replace(STUB, rerank=lambda question, text: (tx.word_count(text) % 10) / 10.0)
    return generation.reranked(found, _questions(spark, sf), sections.select("chunk_id", F.col("content").alias("text")), model)


@query("with r as (select label as cluster, vec_id as pos, 'text ' || vec_id as text, row_number() over (partition by label order by vec_id) as nth from embeddings) select cluster, md5(string_agg(text, chr(10) || chr(10) order by nth)) as text_md5, count(*) as n_texts from r where nth <= 20 group by cluster")
def cluster_texts(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("pos"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"))
    return generation.cluster_texts(rows).select("cluster", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_texts")


_LEVEL = "select vec_id % {0} as level, row_number() over (partition by label, vec_id % {0} order by vec_id) as rank, label as question_id, vec_id as chunk_id from embeddings"


@query(f"with a as ({_LEVEL.format(3)}) select question_id, level::int as level, chunk_id, row_number() over (partition by question_id order by level, rank, chunk_id) as rank from a where rank <= 5")
def ranks_by_level(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "embeddings")
    by = Window.partitionBy("question_id").orderBy("chunk_id")
    one = lambda level: rows.filter(F.col("vec_id") % 3 == level).select(F.col("label").alias("question_id"), F.col("vec_id").alias("chunk_id")).withColumn("rank", F.row_number().over(by))
    return generation.ranks_by_level([one(0), one(1), one(2)]).select("question_id", "level", "chunk_id", "rank")


@query(
    f"with recursive {GRAPH}, t as (select n.fqn, e.source as parent, n.name as title from nodes n left join e on e.target = n.fqn), "
    "l as (select t.*, not exists (select 1 from t c where c.parent = t.fqn) as leaf from t), "
    "up as (select fqn as leaf, fqn as here from l where leaf union all select leaf, t.parent from up join t on t.fqn = up.here where t.parent is not null) "
    "select here as node_id, count(distinct leaf) as leaves from up group by here"
)
def tree_leaf_counts(spark, sf):
    nodes, edges = _graph(spark, sf)
    rows = nodes.select(F.col("fqn").alias("node_id")).join(edges.select(F.col("target").alias("node_id"), F.col("source").alias("parent_id")), "node_id", "left")
    return tree.leaves_below(rows)


@query()
def tree_summaries(spark, sf):
    nodes, edges = _graph(spark, sf)
    rows = nodes.select(F.col("fqn").alias("node_id"), F.col("name").alias("title"), F.col("name").alias("content")).join(edges.select(F.col("target").alias("node_id"), F.col("source").alias("parent_id")), "node_id", "left")
    return generation.summaries(rows).select("node_id", "summary")


def _nested(spark, sf):
    from .catalogue import _sections

    level = (F.length("content") % 4 + 1).cast("int")
    lines = _sections(spark, sf).select("doc_id", F.col("section_pos").alias("pos"), level.alias("level"), F.left("content", F.lit(40)).alias("title"), "content", F.col("chunk_id").alias("node_id"))
    return tree.nested(lines, table(spark, sf, "documents").select("doc_id", F.col("source").alias("title")), [1, 2, 3, 4])


_NESTED = f"""with {SECTIONS},
s as (select doc_id, section_pos as pos, (length(content) % 4 + 1)::int as level, chunk_id as node_id, content from sections),
p as (select *, lag(pos) over w as last, lead(level) over w as next,
      (select max(struct_pack(pos := t.pos, level := t.level, id := t.node_id)) from s t where t.doc_id = s.doc_id and t.pos < s.pos and t.level < s.level) as above
      from s window w as (partition by doc_id order by pos)),
q as (select *, coalesce(above.level, 0) as top, coalesce(above.pos::varchar, 'root') as mark, coalesce(above.id, doc_id::varchar) as under from p),
made as (select doc_id, pos, top, mark, under, unnest(range(top + 1, level)) as depth from q where level - 1 > top and last is not distinct from above.pos)
select node_id, case when top = level - 1 then under else doc_id || '::synthetic_l' || (level - 1) || '::' || mark end as parent_id, level,
       pos, case when next is null or next <= level then length(content) end as chars, false as synthetic from q
union all select doc_id || '::synthetic_l' || depth || '::' || mark, case when depth = top + 1 then under else doc_id || '::synthetic_l' || (depth - 1) || '::' || mark end,
       depth::int, pos, null, true from made
union all select doc_id::varchar, null, 0, -1, case when doc_id not in (select doc_id from s) then 0 end, false from documents"""


@query(_NESTED)
def tree_nested(spark, sf):
    return _nested(spark, sf).select("node_id", "parent_id", "level", "pos", F.length("content").cast("long").alias("chars"), "synthetic")


@query()
def tree_beam_by_question(spark, sf):
    model = dataclasses.replace(STUB, choose=shared_words)
    summed = generation.summaries(_nested(spark, sf), model)
    return tree.asked(summed, _questions(spark, sf), model).select("question_id", "node_id", "rank")


def _hierarchy(spark, sf):
    found = strategies.strategy("raptor")
    found.build(table(spark, sf, "documents").select("doc_id", "text"))
    return found


@query()
def summary_hierarchy(spark, sf):
    rows = None
    for n, level in enumerate(_hierarchy(spark, sf).levels):
        size = F.col("n_texts") if n else F.lit(1).cast("long")
        one = level.select(F.lit(n).alias("level"), "vec_id", size.alias("n_texts"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query()
def hierarchy_topk(spark, sf):
    return _hierarchy(spark, sf).retrieve(_questions(spark, sf)).withColumn("score", F.round("score", 5))


@query()
def graph_answers(spark, sf):
    nodes, edges = _graph(spark, sf)
    names = table(spark, sf, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey")).alias("question_id"), F.concat(F.lit("what is "), F.initcap(F.lower("n_name"))).alias("question"))
    return knowledge.ask(edges, nodes.withColumn("description", F.col("type")), names)

