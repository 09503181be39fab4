"""Registered queries over the test tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import arena, bm25, chunking, fusion, graph, ir, ivf, resolve, scoring, sessions, tree, vector
from ..session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Shared SQL pieces ---------------------------------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> '')"
SECTIONS = """
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as content,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as section_pos from documents),
sections as (
  select doc_id, section_pos, content, doc_id || '::' || section_pos as chunk_id,
         list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') as tokens
  from lines where not regexp_full_match(content, '\\s*'))"""
BM25 = (
    SECTIONS
    + """,
stats as (select count(*) as n, avg(len(tokens)) as mean_length from sections),
tokens as (select doc_id, section_pos, len(tokens) as length, unnest(tokens) as term from sections),
postings as (select term, doc_id, section_pos, length, count(*) as tf from tokens group by all),
raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from postings, stats group by term),
terms as (select term, df, case when raw < 0 then 0.25 * avg(raw) over () else raw end as idf from raw),
qt as (select item_id as question_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as term from benchmark),
q as (select question_id, term, count(*) as qtf from qt group by all),
scores as (
  select question_id, doc_id, section_pos,
         round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 9) as score
  from postings join q using (term) join terms using (term), stats group by all),
ranked as (select *, row_number() over (partition by question_id order by score desc, doc_id, section_pos) as rank from scores),
top as (select question_id, rank, doc_id || '::' || section_pos as chunk_id, doc_id, score from ranked where rank <= 5)"""
)
IR = (
    BM25
    + """,
expected as (select item_id as question_id, doc_id::varchar as expected_id from benchmark b join documents d on contains(d.text, b.text)),
hits as (
  select t.question_id, rank, case when e.expected_id is not null then e.expected_id end as hit
  from top t left join expected e on e.question_id = t.question_id and e.expected_id = t.doc_id::varchar),
firsts as (select *, hit is not null and row_number() over (partition by question_id, hit order by rank) = 1 as first from hits),
per as (
  select question_id, count(distinct hit) as found, count(hit) as good, count(*) as retrieved,
         min(case when hit is not null then rank end) as first_rank,
         sum(case when first then 1 / log2(rank + 1) else 0 end) as dcg from firsts group by question_id),
wanted as (select question_id, count(distinct expected_id) as expected from expected group by question_id),
metrics as (
  select b.item_id as question_id,
    round(coalesce(found::double / expected, 0), 6) as recall,
    round(coalesce(case when expected > 0 then good::double / least(5, retrieved) end, 0), 6) as precision,
    case when expected > 0 and good > 0 then 1 else 0 end as hit,
    round(coalesce(case when expected > 0 then 1.0 / first_rank end, 0), 6) as mrr,
    round(coalesce(dcg / list_sum(list_transform(range(1, least(expected, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 6) as ndcg
  from benchmark b left join per on per.question_id = b.item_id left join wanted w on w.question_id = b.item_id)"""
)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sections(spread(table(spark, sf, "documents").select("doc_id", "text")))


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a whole benchmark passage: four of a passage's inner words find candidates, containment decides."""
    return ir.containing(spread(table(spark, sf, "documents").select("doc_id", "text")), _questions(spark, sf)).select("question_id", F.col("doc_id").cast("string").alias("expected_id"))


# Sections and chunks -------------------------------------------------------------------------------------


@query(f"with {SECTIONS} select doc_id, section_pos, chunk_id, len(tokens) as n_words from sections")
def section_explode(spark, sf):
    return _sections(spark, sf).select("doc_id", "section_pos", "chunk_id", tx.word_count(F.col("content")).alias("n_words"))


@query(f"with {SECTIONS} select doc_id, count(*) as n_sections, sum(len(tokens))::bigint as n_words, floor(sum(len(tokens)) * 1.3::double)::bigint as approx_tokens from sections group by doc_id")
def section_stats(spark, sf):
    per = _sections(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(tx.word_count(F.col("content"))).alias("n_words"))
    return per.withColumn("approx_tokens", tx.approx_tokens(F.col("n_words")))


_WINDOWS = f"""
with t as (select doc_id, {TOKENS.format('text')} as tokens from documents),
c as (select doc_id, tokens, case when len(tokens) = 0 then 0 when len(tokens) <= 512 then 1 else 1 + ceil((len(tokens) - 512) / 462.0)::int end as k from t),
w as (select doc_id, tokens, unnest(range(k)) as chunk_no from c)
"""


@query(_WINDOWS + "select doc_id, chunk_no::int as chunk_no, len(tokens[chunk_no * 462 + 1 : chunk_no * 462 + 512]) as n_tokens, tokens[chunk_no * 462 + 1] as first_token, md5(array_to_string(tokens[chunk_no * 462 + 1 : chunk_no * 462 + 512], ' ')) as chunk_md5 from w")
def chunk_windows(spark, sf):
    windows = chunking.token_windows(table(spark, sf, "documents").select("doc_id", "text"))
    return windows.select(
        "doc_id", "chunk_no", F.size("chunk").cast("long").alias("n_tokens"), F.get("chunk", F.lit(0)).alias("first_token"), F.md5(F.array_join("chunk", " ").cast("binary")).alias("chunk_md5")
    )


@query(_WINDOWS + "select doc_id, count(*) as n_chunks from w group by doc_id")
def chunk_counts(spark, sf):
    return chunking.token_windows(table(spark, sf, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("select doc_id, lang as module, lang || ' > ' || source as section_path, contains(text, '|') as has_table, contains(text, '```') as has_code, md5('## ' || lang || ' > ' || source || chr(10) || chr(10) || text) as enriched_md5 from documents")
def contextual_enrich(spark, sf):
    path = F.array("lang", "source")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("module"),
        F.array_join(path, " > ").alias("section_path"),
        F.contains("text", F.lit("|")).alias("has_table"),
        F.contains("text", F.lit("```")).alias("has_code"),
        F.md5(chunking.heading_enriched(path, F.lit(""), F.col("text")).cast("binary")).alias("enriched_md5"),
    )


_SLUG = "regexp_replace(regexp_replace(lower(trim(p_name)), '[^\\w\\s/-]', '', 'g'), '\\s+', '-', 'g')"


@query(f"select p_partkey, case when {_SLUG} = '' then 'section' else {_SLUG} end as slug from part")
def slugify_titles(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.slugify(F.col("p_name")).alias("slug"))


@query(f"with s as (select p_partkey, p_brand, p_size, 'size ' || p_size as t from part), g as (select p_partkey, p_brand, replace(t, ' ', '-') as slug, row_number() over (partition by p_brand, t order by p_partkey) - 1 as seen from s) select p_partkey, case when seen = 0 then slug else slug || '-' || seen end as section_id from g")
def unique_section_ids(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", tx.slugify(F.concat(F.lit("size "), F.col("p_size"))).alias("slug"))
    return chunking.unique_slugs(part, "p_brand", "slug", "p_partkey").select("p_partkey", "section_id")


@query("with q as (select o_orderkey, 'corpus-t' || (o_orderkey % 7) || '-' || o_custkey as id from orders) select o_orderkey, coalesce(try_cast(split_part(split_part(id, '-t', 2), '-', 1) as int), 0) as tier from q")
def tier_parse(spark, sf):
    name = F.concat(F.lit("corpus-t"), F.col("o_orderkey") % 7, F.lit("-"), F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", tx.tier_of(name).alias("tier"))


# Lexical retrieval ---------------------------------------------------------------------------------------


@query(f"with {SECTIONS}, t as (select doc_id, section_pos, unnest(tokens) as term from sections), u as (select distinct * from t) select term, count(*) as df from u group by term")
def token_df(spark, sf):
    return bm25.build(_sections(spark, sf)).terms.select("term", "df")


@query(f"with {BM25} select term, df, round(idf, 6) as idf from terms")
def bm25_term_stats(spark, sf):
    return bm25.build(_sections(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _top(spark, sf):
    return bm25.top_k(bm25.build(_sections(spark, sf)), _questions(spark, sf))


@query(f"with {BM25} select question_id, rank, chunk_id, round(score, 5) as score from top")
def bm25_topk(spark, sf):
    return _top(spark, sf).select("question_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


@query(f"with {IR} select * from metrics")
def bm25_ir_metrics(spark, sf):
    return ir.metrics(_top(spark, sf), _expected(spark, sf), _questions(spark, sf))


@query(f"with {IR} select count(*) as questions, round(avg(recall), 4) as recall, round(avg(precision), 4) as precision, round(avg(hit), 4) as hit, round(avg(mrr), 4) as mrr, round(avg(ndcg), 4) as ndcg from metrics")
def bm25_ir_summary(spark, sf):
    return ir.summary(bm25_ir_metrics(spark, sf))


@query("with r as (select l_orderkey as question_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rank, (['', 'L0:', 'qna:', 'foo:'])[l_partkey % 4 + 1] || 'd' || (l_partkey % 50) || '::s' || (l_suppkey % 5) || '::' || l_linenumber as chunk_id from lineitem), e as (select distinct l_orderkey as question_id, unnest(['d' || (l_partkey % 50), 'd' || (l_partkey % 50) || '::s' || (l_suppkey % 3)]) as x from lineitem where l_linenumber < 3), c as (select *, regexp_replace(chunk_id, '^(L0:|L1:|L2:|qna:|graph:|pageindex:)', '') as bare from r) select c.question_id, c.rank, c.chunk_id, max_by(e.x, length(e.x)) as hit from c left join e on e.question_id = c.question_id and (bare = x or starts_with(bare, x || '::')) group by all")
def hierarchical_match(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "lineitem")
    head = F.get(F.array(*map(F.lit, ("", "L0:", "qna:", "foo:"))), (F.col("l_partkey") % 4).cast("int"))
    doc = F.concat(F.lit("d"), F.col("l_partkey") % 50)
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    chunk = F.concat_ws("::", F.concat(head, doc), F.concat(F.lit("s"), F.col("l_suppkey") % 5), F.col("l_linenumber"))
    retrieved = rows.select(F.col("l_orderkey").alias("question_id"), F.row_number().over(by).cast("long").alias("rank"), chunk.alias("chunk_id"))
    wanted = rows.filter("l_linenumber < 3").select(F.col("l_orderkey").alias("question_id"), F.explode(F.array(doc, F.concat(doc, F.lit("::s"), F.col("l_suppkey") % 3))).alias("expected_id"))
    return ir.matched(retrieved, wanted).select("question_id", "rank", "chunk_id", "hit")


# Vectors -------------------------------------------------------------------------------------------------

_COSINE = """
q as (select vec_id as query_id, embedding as e, label as query_label from embeddings where vec_id % 20 = 0),
s as (select query_id, query_label, v.vec_id, v.label, round(list_cosine_similarity(e::double[], v.embedding::double[]), 6) as score from q, embeddings v where v.vec_id <> query_id {0}),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query(f"with {_COSINE.format('')} select query_id, vec_id, score, rank from r where rank <= 5")
def vector_topk(spark, sf):
    v = _vectors(spark, sf)
    return vector.cosine_top_k(v, v.filter("vec_id % 20 = 0"))


@query(f"with {_COSINE.format('and v.label < 5')} select query_id, vec_id, score, rank from r where rank <= 5")
def vector_topk_filtered(spark, sf):
    v = _vectors(spark, sf)
    return vector.cosine_top_k(v.filter("label < 5"), v.filter("vec_id % 20 = 0"))


@query(f"with {_COSINE.format('')} select query_label as label, count(*) as retrieved, round(avg(case when label = query_label then 1.0 else 0.0 end), 6) as precision from r where rank <= 5 group by query_label")
def vector_ir_by_label(spark, sf):
    v = _vectors(spark, sf)
    labels = v.select("vec_id", "label")
    found = vector.cosine_top_k(v, v.filter("vec_id % 20 = 0"))
    joined = found.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "query_label"}), "query_id").join(labels, "vec_id")
    return joined.groupBy(F.col("query_label").alias("label")).agg(
        F.count(F.lit(1)).alias("retrieved"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("precision")
    )


@query()
def vector_topk_indexed(spark, sf):
    v = _vectors(spark, sf)
    return ivf.search(ivf.build(v), v.filter("vec_id % 20 = 0"))


@query()
def vector_topk_indexed_filtered(spark, sf):
    v = _vectors(spark, sf)
    return ivf.search(ivf.build(v), v.filter("vec_id % 20 = 0"), where=F.col("label") < 5)


@query()
def spherical_kmeans(spark, sf):
    return vector.spherical_kmeans(_vectors(spark, sf), 10)


# Fusion and routing --------------------------------------------------------------------------------------

_TRACES = """
a as (select label as question_id, vec_id as chunk_id, (vec_id % 97) / 97.0::double as score, row_number() over (partition by label order by vec_id % 97 desc, vec_id) as rank from embeddings),
b as (select label as question_id, vec_id as chunk_id, (vec_id % 89) / 89.0::double as score, row_number() over (partition by label order by vec_id % 89 desc, vec_id) as rank from embeddings),
t as (select *, 0 as trace from a where rank <= 20 union all select *, 1 as trace from b where rank <= 20)
"""


def _traces(spark, sf):
    from pyspark.sql import Window

    def one(mod: int) -> DataFrame:
        by = Window.partitionBy("question_id").orderBy(F.desc(F.col("chunk_id") % mod), "chunk_id")
        rows = _vectors(spark, sf).select(F.col("label").alias("question_id"), F.col("vec_id").alias("chunk_id"))
        return rows.withColumns({"score": (F.col("chunk_id") % mod) / F.lit(float(mod)), "rank": F.row_number().over(by).cast("long")}).filter("rank <= 20")

    return [one(97), one(89)]


@query(f"with {_TRACES}, s as (select *, row_number() over (partition by question_id, chunk_id order by trace, rank) as sight from t), p as (select *, row_number() over (partition by question_id order by score desc, trace, rank) as place from s where sight = 1) select question_id, chunk_id, round(score, 6) as score, trace, place from p where place <= 5")
def hybrid_merge(spark, sf):
    return fusion.merge_traces(_traces(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"with {_TRACES}, s as (select question_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as rrf from t group by all), p as (select *, row_number() over (partition by question_id order by rrf desc, chunk_id) as place from s) select * from p where place <= 5")
def rrf_fusion(spark, sf):
    return fusion.reciprocal_rank_fusion(_traces(spark, sf))


@query(f"with k as (select doc_id, md5(array_to_string(({TOKENS.format('text')})[1:50], ' ')) as prefix_md5 from documents) select prefix_md5, min(doc_id) as first_doc, count(*) as documents from k group by prefix_md5")
def near_dup_prefix(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", F.md5(tx.dedup_key(F.col("text")).cast("binary")).alias("prefix_md5"))
    return keyed.groupBy("prefix_md5").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("documents"))


_ASK = "case p_size % 5 when 0 then 'compare ' when 1 then 'how to setup ' when 2 then 'what does it require of ' when 3 then 'advs ' else 'what is ' end || p_name"


def _asks(spark, sf):
    kind = F.col("p_size") % 5
    head = F.when(kind == 0, "compare ").when(kind == 1, "how to setup ").when(kind == 2, "what does it require of ").when(kind == 3, "advs ").otherwise("what is ")
    return table(spark, sf, "part").select("p_partkey", F.concat(head, F.col("p_name")).alias("question"))


def _scan_sql(column: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{'|'.join(p)}', 'i') then '{i}'" for i, p in tx.SCAN_PATTERNS.items()) + " end"


def _words_sql(column: str, groups: list, default: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({column}, '{w}')" for w in words) + f" then '{i}'" for i, words in groups) + f" else '{default}' end"


@query(f"with q as (select p_partkey, {_ASK} as question from part) select p_partkey, {_scan_sql('question')} as intent from q")
def intent_keyword_scan(spark, sf):
    return _asks(spark, sf).select("p_partkey", tx.keyword_intent(F.col("question")).alias("intent"))


@query(f"with q as (select p_partkey, lower({_ASK}) as q from part) select p_partkey, {_words_sql('q', tx.HYBRID_WORDS, 'factoid')} as intent from q")
def intent_fallback(spark, sf):
    return _asks(spark, sf).select("p_partkey", tx.substring_intent(F.col("question")).alias("intent"))


_MENTION = "c_name || ' of \"' || c_mktsegment || '\" asks about api-gateway, s3.put_object, Lambda and ' || 'DynamoDB' || c_nationkey"


@query(f"with e as (select c_custkey, {_MENTION} as t from customer), m as (select c_custkey, list_concat(list_concat(regexp_extract_all(t, '[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(t, '\\b([a-z][a-z0-9_]*(?:\\.[a-z][a-z0-9_]*)+)\\b', 1)), list_concat(regexp_extract_all(t, '\\b([a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)+)\\b', 1), regexp_extract_all(t, '\\b([A-Z][a-zA-Z0-9]+)\\b', 1))) as m from e) select c_custkey, array_to_string(m[1:3], ',') as mentions from m")
def entity_mentions(spark, sf):
    text = F.concat(F.col("c_name"), F.lit(' of "'), F.col("c_mktsegment"), F.lit('" asks about api-gateway, s3.put_object, Lambda and DynamoDB'), F.col("c_nationkey"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(tx.entity_mentions(text), ",").alias("mentions"))


# Answer checks -------------------------------------------------------------------------------------------


@query("with a as (select doc_id, lower(text) as t from documents), s as (select doc_id, (contains(t, 'the')::int + contains(t, 'license')::int + contains(t, 'and')::int) / 3.0 as share, contains(t, 'trash') or contains(t, 'idiot') as bad from a) select doc_id, round(share, 6)::double as completeness, round(case when bad then 0 else share end, 6)::double as accuracy, case when bad then 0.0 else 1.0 end::double as faithfulness, not bad as structural_pass from s")
def structural_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.array(*map(F.lit, ("the", "license", "and"))).alias("mention"), F.array(*map(F.lit, ("trash", "idiot"))).alias("forbid"))
    return scoring.structural_check(docs, "text", "mention", "forbid").select("doc_id", "completeness", "accuracy", "faithfulness", "structural_pass")


@query("with a as (select doc_id, lower(text) as t, lang from documents) select lang, round(avg((contains(t, 'apache')::int + contains(t, 'error')::int) / 2.0), 6) as coverage from a group by lang")
def entity_coverage(spark, sf):
    terms = F.array(F.lit("Apache"), F.lit("Error"))
    covered = table(spark, sf, "documents").select("lang", scoring.ratio(scoring.held_terms(F.col("text"), terms), terms).alias("c"))
    return covered.groupBy("lang").agg(F.round(F.avg("c"), 6).alias("coverage"))


@query("with r as (select page_id, lower(url) as u from pages) select page_id, round((contains(u, 'example')::int + contains(u, 'https')::int + (contains(u, 'page') or contains('page', u))::int) / 3.0, 6)::double as attribution from r")
def source_attribution(spark, sf):
    refs = F.array(F.lit("Example"), F.lit("HTTPS"), F.lit("page"))
    return table(spark, sf, "pages").select("page_id", F.round(scoring.source_attribution(refs, F.array("url")), 6).alias("attribution"))


@query("select substr(sha256(text), 1, 16) as answer_key, substr(sha256(lang), 1, 16) as reference_key, count(*) as answers, max(length(text)) as verdict from documents group by all")
def eval_memo(spark, sf):
    judged = scoring.evaluate_once(table(spark, sf, "documents").select("text", "lang"), "text", "lang", lambda a, r: F.length(a).cast("long"))
    return judged.groupBy("answer_key", "reference_key").agg(F.count(F.lit(1)).alias("answers"), F.max("verdict").alias("verdict"))


# Aggregates of a run -------------------------------------------------------------------------------------

REC = "rec as (select event_id as seq, event_type as strategy, (event_id % 5 + 1)::int as tier, least(value / 100.0, 1.0)::double as accuracy, value as latency_ms, event_type = 'error' as is_error, round(value / 1000.0, 6) as cost_usd, user_id, ts from events)"


def _records(spark, sf):
    return scoring.records(table(spark, sf, "events"))


@query(f"with {REC} select strategy, tier, count(*) as n, round(avg(accuracy), 6) as accuracy from rec group by all")
def agg_by_tier(spark, sf):
    return _records(spark, sf).groupBy("strategy", "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


@query("select d.lang as type, count(*) as n, round(avg(coalesce(l.quality, 0)), 6) as accuracy, round(avg(coalesce(l.toxic, 0)), 6) as toxic from documents d left join labels l using (doc_id) group by d.lang")
def agg_by_type(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return joined.groupBy(F.col("lang").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(zero("quality")), 6).alias("accuracy"), F.round(F.avg(zero("toxic")), 6).alias("toxic"))


@query(f"with {REC} select strategy, count(*) as total, count(*) filter (accuracy >= 0.7) as correct, count(*) filter (is_error) as errors, round(avg(is_error::int), 6) as error_rate, round(avg(latency_ms), 4) as avg_latency_ms from rec group by strategy")
def reliability(spark, sf):
    return _records(spark, sf).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("accuracy") >= 0.7).alias("correct"),
        F.count_if("is_error").alias("errors"),
        F.round(F.avg(F.col("is_error").cast("double")), 6).alias("error_rate"),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
    )


@query(f"with {REC}, t as (select strategy, tier, avg(accuracy) as a from rec group by all) select strategy, round(avg(a), 6) as macro_accuracy from t group by strategy")
def macro_accuracy(spark, sf):
    per = _records(spark, sf).groupBy("strategy", "tier").agg(F.avg("accuracy").alias("a"))
    return per.groupBy("strategy").agg(F.round(F.avg("a"), 6).alias("macro_accuracy"))


@query(f"with {REC}, r as (select strategy, latency_ms, row_number() over (partition by strategy order by latency_ms) - 1 as spot, count(*) over (partition by strategy) as n from rec) select strategy, max(n) as n, round(avg(latency_ms), 4) as avg_ms, max(case when spot = floor(n * 0.5) then latency_ms end) as p50_ms, max(case when spot = case when n >= 20 then floor(n * 0.95) else n - 1 end then latency_ms end) as p95_ms, max(case when spot = case when n >= 100 then floor(n * 0.99) else n - 1 end then latency_ms end) as p99_ms, min(latency_ms) as min_ms, max(latency_ms) as max_ms from r group by strategy")
def latency_index_percentiles(spark, sf):
    return scoring.index_percentiles(_records(spark, sf), ["strategy"], "latency_ms")


@query(f"with {REC} select strategy, round(sum(cost_usd), 3) as total_cost, round(coalesce(sum(cost_usd) / nullif(count(*) filter (accuracy >= 0.7), 0), 0), 5) as cost_per_correct from rec group by strategy")
def cost_per_correct(spark, sf):
    correct = F.count_if(F.col("accuracy") >= 0.7)
    return _records(spark, sf).groupBy("strategy").agg(
        F.round(F.sum("cost_usd"), 3).alias("total_cost"), F.round(F.coalesce(F.try_divide(F.sum("cost_usd"), correct), F.lit(0.0)), 5).alias("cost_per_correct")
    )


@query("with p(rule, pattern, price) as (values (1, 'RAIL', 3.0), (2, 'AIR', 15.0), (3, '', 1.0)), m as (select p_partkey, min(rule) as rule from part, p where contains(upper(p_type), pattern) group by p_partkey) select p_partkey, round(price * p_size / 1000000.0, 9)::double as cost from m join p using (rule) join part using (p_partkey)")
def token_cost(spark, sf):
    prices = spark.createDataFrame([(1, "RAIL", 3.0), (2, "AIR", 15.0), (3, "", 1.0)], "rule int, pattern string, price double")  # three rules
    matched = table(spark, sf, "part").join(F.broadcast(prices), F.contains(F.upper("p_type"), F.col("pattern")))
    best = matched.groupBy("p_partkey", "p_size").agg(F.min_by("price", "rule").alias("price"))
    return best.select("p_partkey", F.round(F.col("price") * F.col("p_size") / 1000000.0, 9).alias("cost"))


@query(f"with {REC}, s as (select strategy, round(0.5 * avg(accuracy) + 0.3 * (1 - avg(is_error::int)) + 0.2 * greatest(0.0, 1 - avg(latency_ms) / 10000), 6) as composite from rec group by strategy) select *, row_number() over (order by composite desc, strategy) as place from s")
def composite_ranking(spark, sf):
    return scoring.composite(_records(spark, sf))


@query(f"with {REC} select strategy, " + ", ".join(f"coalesce(round_even(avg(accuracy) filter (tier = {t}) * 100, 0), 0)::int as tier_{t}" for t in range(1, 6)) + ", round(avg(latency_ms), 3) as latency_ms from rec group by strategy")
def dashboard_pivot(spark, sf):
    rec = _records(spark, sf)
    tiers = [F.coalesce(F.bround(F.avg(F.when(F.col("tier") == t, F.col("accuracy"))) * 100, 0), F.lit(0)).cast("int").alias(f"tier_{t}") for t in range(1, 6)]
    return rec.groupBy("strategy").agg(*tiers, F.round(F.avg("latency_ms"), 3).alias("latency_ms"))


@query(f"with {REC} select coalesce(strategy, 'all') as strategy, coalesce(tier, 0) as tier, count(*) as n, round(avg(accuracy), 6) as accuracy from rec group by grouping sets ((strategy, tier), (strategy), (tier), ())")
def report_grouping_sets(spark, sf):
    cube = _records(spark, sf).cube("strategy", "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))
    return cube.select(F.coalesce("strategy", F.lit("all")).alias("strategy"), F.coalesce("tier", F.lit(0)).alias("tier"), "n", "accuracy")


@query(f"with {REC}, t as (select strategy, tier, avg(accuracy) as a from rec group by all) select x.tier, round(x.a, 6) as click, round(y.a, 6) as purchase, round(x.a - y.a, 6) as delta from t x join t y on x.tier = y.tier where x.strategy = 'click' and y.strategy = 'purchase'")
def strategy_compare(spark, sf):
    wide = _records(spark, sf).groupBy("tier").pivot("strategy", ["click", "purchase"]).agg(F.avg("accuracy"))
    return wide.filter("click is not null and purchase is not null").select("tier", F.round("click", 6).alias("click"), F.round("purchase", 6).alias("purchase"), F.round(F.col("click") - F.col("purchase"), 6).alias("delta"))


@query(f"with {REC}, s as (select strategy, avg(accuracy) as a from rec group by strategy) select strategy, a < 0.45 as below from s")
def threshold_gate(spark, sf):
    return _records(spark, sf).groupBy("strategy").agg((F.avg("accuracy") < 0.45).alias("below"))


@query(f"with {REC}, b as (select strategy, seq, round(coalesce(sum(cost_usd) over (partition by strategy order by seq rows between unbounded preceding and 1 preceding), 0), 6) as spent_before from rec) select strategy, seq, spent_before from b where spent_before < 5.0")
def cost_cap_prefix(spark, sf):
    return scoring.spend_until(_records(spark, sf), ["strategy"], 5.0).select("strategy", "seq", "spent_before")


# Arena ---------------------------------------------------------------------------------------------------


@query()
def elo_ratings(spark, sf):
    return arena.elo(arena.votes(table(spark, sf, "events")))


@query("with v as (select 's' || (user_id % 5) as a, 's' || (event_id % 5) as b, case when value < 20 then 'a' when value < 40 then 'b' else 'tie' end as w from events where user_id % 5 <> event_id % 5), s as (select a as strategy, case w when 'a' then 'win' when 'b' then 'loss' else 'tie' end as o from v union all select b, case w when 'b' then 'win' when 'a' then 'loss' else 'tie' end from v) select strategy, count(*) filter (o = 'win') as wins, count(*) filter (o = 'loss') as losses, count(*) filter (o = 'tie') as ties from s group by strategy")
def arena_leaderboard(spark, sf):
    return arena.leaderboard(arena.votes(table(spark, sf, "events")))


# Audit ---------------------------------------------------------------------------------------------------

_AUDIT = "a as (select source, lang, count(*) as tested, avg(quality) as accuracy from documents join labels using (doc_id) group by all), b as (select *, case when accuracy >= 0.7 then 'strong' when accuracy >= 0.3 then 'weak' else 'gap' end as bucket from a)"


def _audit(spark, sf):
    per = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").groupBy("source", "lang")
    stats = per.agg(F.count(F.lit(1)).alias("tested"), F.avg(F.col("quality").cast("double")).alias("accuracy"))
    return stats.withColumn("bucket", F.when(F.col("accuracy") >= 0.7, "strong").when(F.col("accuracy") >= 0.3, "weak").otherwise("gap"))


@query(f"with {_AUDIT} select source, lang, tested, round(accuracy, 6) as accuracy, bucket from b")
def audit_buckets(spark, sf):
    return _audit(spark, sf).withColumn("accuracy", F.round("accuracy", 6))


@query(f"with {_AUDIT}, r as (select source, lang, tested, bucket, row_number() over (order by tested desc, bucket, source, lang) as priority from b where bucket <> 'strong') select *, case when priority <= 2 then 'HIGH' when priority = 3 then 'MEDIUM' else 'LOW' end as label from r where priority <= 10")
def fix_priority(spark, sf):
    top = _audit(spark, sf).filter("bucket <> 'strong'").orderBy(F.desc("tested"), "bucket", "source", "lang").limit(10)
    from pyspark.sql import Window

    ranked = top.select("source", "lang", "tested", "bucket").withColumn("priority", F.row_number().over(Window.orderBy(F.desc("tested"), "bucket", "source", "lang")).cast("long"))  # ten rows
    return ranked.withColumn("label", F.when(F.col("priority") <= 2, "HIGH").when(F.col("priority") == 3, "MEDIUM").otherwise("LOW"))


# Sessions and limits -------------------------------------------------------------------------------------


@query("with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id, turn, role, md5(case when role = 'assistant' and length(text) > 500 then substr(text, 1, 500) || '...' else text end) as content_md5 from r where back <= 12")
def session_memory(spark, sf):
    return sessions.memory(table(spark, sf, "conversations")).select("conv_id", "turn", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from s group by user_id, k")
def session_ttl(spark, sf):
    return sessions.idle_sessions(table(spark, sf, "events"))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as in_window from events")
def rate_limit_sliding(spark, sf):
    return sessions.requests_in_window(table(spark, sf, "events"), seconds=3600).select("event_id", "in_window")


@query()
def rate_limit_exact(spark, sf):
    return sessions.admitted(table(spark, sf, "events"), limit=3, seconds=3600)


# Graph ---------------------------------------------------------------------------------------------------

GRAPH = """
nodes as (
  select 'region:' || r_regionkey as fqn, 'region' as type, r_name as name from region union all
  select 'nation:' || n_nationkey, 'nation', n_name from nation union all
  select 'supplier:' || s_suppkey, 'supplier', s_name from supplier union all
  select 'customer:' || c_custkey, 'customer', c_name from customer),
e as (
  select 'region:' || n_regionkey as source, 'nation:' || n_nationkey as target, 'CONTAINS' as type from nation union all
  select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' from supplier union all
  select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' from customer)"""


def _graph(spark, sf):
    return graph.tpch_graph({t: table(spark, sf, t) for t in ("region", "nation", "supplier", "customer")})


@query("with p as (select p_brand as fqn, 'brand' as type, p_name as name, row_number() over (partition by p_brand order by p_partkey desc) as nth from part) select fqn, type, name from p where nth = 1")
def graph_upsert_nodes(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("fqn"), F.lit("brand").alias("type"), F.col("p_name").alias("name"), "p_partkey")
    return graph.upsert_nodes(rows, "p_partkey").select("fqn", "type", "name")


@query("with n as (select s_suppkey as fqn from supplier union select p_partkey from part) select distinct l_suppkey as source, 'SUPPLIES' as type, l_partkey as target from lineitem where l_suppkey in (select fqn from n) and l_partkey in (select fqn from n)")
def graph_upsert_edges(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.lit("SUPPLIES").alias("type"), F.col("l_partkey").alias("target"))
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fqn")).unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("fqn")))
    return graph.upsert_edges(edges, nodes).select("source", "type", "target")


@query(f"with {GRAPH}, s as (select fqn as start from nodes where type = 'region'), h1 as (select start, target as fqn, 1 as hops from s join e on source = start), h2 as (select start, target as fqn, 2 as hops from h1 join e on source = fqn) select * from h1 union all select * from h2")
def graph_multi_hop(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.expand(edges, nodes.filter("type = 'region'"), 2).select("start", "fqn", "hops")


@query(f"with recursive {GRAPH}, t as (select fqn as start, fqn, 0 as depth, fqn as chain from nodes where type = 'region' union all select t.start, e.target, depth + 1, chain || ' > ' || e.target from t join e on e.source = t.fqn where depth < 4) select start, fqn, depth, chain from t where depth > 0")
def graph_dependency_chain(spark, sf):
    nodes, edges = _graph(spark, sf)
    found = graph.expand(edges, nodes.filter("type = 'region'"), 4)
    return found.select("start", "fqn", F.col("hops").alias("depth"), F.array_join("path", " > ").alias("chain"))


@query(f"with recursive {GRAPH}, t as (select fqn as start, fqn, 0 as depth from nodes where type = 'supplier' union all select t.start, e.source, depth + 1 from t join e on e.target = t.fqn where depth < 5) select start, fqn, depth from t where depth > 0")
def graph_hierarchy(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.expand(edges, nodes.filter("type = 'supplier'"), 5, backwards=True).select("start", "fqn", F.col("hops").alias("depth"))


@query("with e as (select distinct l_suppkey as source, l_partkey as target from lineitem) select target, count(distinct source) as sources from e group by target having count(distinct source) > 1")
def graph_shared_neighbours(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return graph.shared_neighbours(edges)


@query(f"with {GRAPH} select n.fqn, n.name, count(e.target) as neighbours from nodes n left join e on e.source = n.fqn where n.type in ('region', 'nation') group by n.fqn, n.name")
def graph_entity_lookup(spark, sf):
    nodes, edges = _graph(spark, sf)
    wanted = nodes.filter("type in ('region', 'nation')")
    return wanted.join(edges.select(F.col("source").alias("fqn"), "target"), "fqn", "left").groupBy("fqn", "name").agg(F.count("target").alias("neighbours"))


@query(f"with {GRAPH}, x as (select source as fqn, target as other, type, 'out' as direction from e union all select target, source, type, 'in' from e) select x.fqn, other, x.type, direction, n.name as other_name from x join nodes n on n.fqn = other")
def graph_cross_refs(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.cross_references(edges, nodes).select("fqn", "other", "type", "direction", "other_name")


@query(f"with {GRAPH}, x as (select source as fqn, 1 as o, 0 as i from e union all select target, 0, 1 from e) select fqn, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from x group by fqn")
def graph_degree(spark, sf):
    return graph.degrees(_graph(spark, sf)[1])


@query()
def graph_hubs_betweenness(spark, sf):
    return graph.betweenness(_graph(spark, sf)[1])


@query()
def graph_top_hubs(spark, sf):
    return graph.hubs(_graph(spark, sf)[1])


@query()
def entity_merges(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"))
    return resolve.resolved(names)


@query()
def entity_resolution_pairs(spark, sf):
    return resolve.candidate_pairs(table(spark, sf, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("name")))


# Trees ---------------------------------------------------------------------------------------------------


def _levels(spark, sf):
    return _sections(spark, sf).select("doc_id", F.col("section_pos").alias("pos"), (F.length("content") % 3 + 1).alias("level"))


@query(f"with {SECTIONS}, l as (select doc_id, section_pos as pos, length(content) % 3 + 1 as level from sections) select doc_id || '::' || pos as node_id, doc_id || '::' || (select max(p.pos) from l p where p.doc_id = l.doc_id and p.pos < l.pos and p.level < l.level) as parent_id, level::int as level from l")
def tree_build(spark, sf):
    return tree.build(_levels(spark, sf)).select("node_id", "parent_id", "level")


@query()
def tree_beam_stub(spark, sf):
    return tree.beam(tree.build(_levels(spark, sf))).select("doc_id", "node_id", "level")


# Pages, tables and JSON ----------------------------------------------------------------------------------


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a\\s')) as n_links, regexp_replace(url, '[?#].*$', '') as clean_url from pages")
def html_title_links(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit("<a\\s"), F.lit(0))).cast("long").alias("n_links"),
        tx.clean_url(F.col("url")).alias("clean_url"),
    )


_STRIP = "html"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _STRIP = f"regexp_replace({_STRIP}, '<{_tag}\\b.*?</{_tag}>', ' ', 'gis')"


@query(f"select page_id, md5(trim(regexp_replace(regexp_replace({_STRIP}, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g'))) as text_md5 from pages")
def html_clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.strip_boilerplate(F.col("html")).cast("binary")).alias("text_md5"))


@query("with r as (select s_suppkey, floor((s_suppkey - 1) / 20.0)::bigint as section, 's_suppkey: ' || s_suppkey || '; s_name: ' || s_name as line from supplier) select section, count(*) as n_rows, md5(string_agg(line, chr(10) order by s_suppkey)) as content_md5 from r group by section")
def csv_row_sections(spark, sf):
    line = F.concat_ws("; ", F.concat(F.lit("s_suppkey: "), F.col("s_suppkey")), F.concat(F.lit("s_name: "), F.col("s_name")))
    rows = table(spark, sf, "supplier").select(F.floor((F.col("s_suppkey") - 1) / 20).alias("section"), F.struct("s_suppkey", line.alias("line")).alias("r"))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"), F.md5(F.array_join(F.array_sort(F.collect_list("r"))["line"], "\n").cast("binary")).alias("content_md5"))


@query("select event_id, (regexp_extract('note ' || props || ' end', '\\{[^}]+\\}')::json ->> 'k')::int as k from events")
def json_extract_first(spark, sf):
    found = tx.first_json_object(F.concat(F.lit("note "), F.col("props"), F.lit(" end")))
    return table(spark, sf, "events").select("event_id", F.from_json(found, "k int")["k"].alias("k"))


@query("select p_partkey, case when lower(p_name) = lower(case when p_partkey % 2 = 0 then upper(p_name) else p_name || '?' end) then 'exact' else 'rephrase' end as mode from part")
def qna_exact_or_rephrase(spark, sf):
    stored = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("?")))
    return table(spark, sf, "part").select("p_partkey", F.when(F.lower("p_name") == F.lower(stored), "exact").otherwise("rephrase").alias("mode"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def idempotent_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
