"""Ingest, index, benchmark, audit and chat as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bm25, chunking, generation, scoring
from ..operators.provider import STUB, Provider
from ..operators.strategies import retriever_lab
from ..sources import files, reports


def ingest(spark: SparkSession, path: str, corpus: str, out: str, kind: str = "auto") -> DataFrame:
    """Parse a folder to JSON lines and read them back."""
    files.write_jsonl(files.read_documents(spark, path, corpus, kind), out)
    return files.read_jsonl(spark, out)


def section_rows(docs: DataFrame) -> DataFrame:
    """Parsed documents as doc_id, pos, section_id, title, level, heading_path, content."""
    return docs.select(F.col("id").alias("doc_id"), F.posexplode("sections").alias("pos", "s")).select(
        "doc_id", "pos", F.col("s.id").alias("section_id"), "s.title", "s.level", "s.heading_path", "s.content"
    )


def label_expected(questions: DataFrame, docs: DataFrame, known: DataFrame | None = None, k: int = 20, provider: Provider = STUB) -> DataFrame:
    """(question_id, expected_id): of BM25's first ``k`` chunks those that the provider's judge picks; questions that have labels are skipped.

    The stub judge picks none.
    """
    asked = questions if known is None else questions.join(known.select("question_id").distinct(), "question_id", "left_anti")
    sections = chunking.sections(docs)
    found = bm25.top_k(bm25.build(sections), asked, k).select("question_id", "chunk_id", "rank")
    shown = found.join(asked.select("question_id", "question"), "question_id").join(sections.select("chunk_id", F.col("content").alias("text")), "chunk_id")
    return generation.judged_labels(shown, provider)


def generate_questions(docs: DataFrame, count: int, provider: Provider = STUB) -> DataFrame:
    """Prompts for each tier over excerpts of ``docs(doc_id, text)``; the count is split over five tiers, the remainder to the low ones."""
    spark = docs.sparkSession
    split = spark.createDataFrame([(t, count // 5 + (t <= count % 5), 300 if t <= 2 else 500) for t in range(1, 6)], "tier int, wanted int, max_tokens int")
    sections = docs.select(F.col("doc_id").alias("doc_pos"), F.lit(0).alias("pos"), F.col("doc_id").cast("string").alias("doc_title"), F.lit("").alias("title"), F.col("text").alias("content"))
    excerpt = "\n\n---\n\n".join(generation.excerpts(sections))  # 50,000 characters at most
    return split.withColumn("excerpt", F.lit(excerpt)).withColumn("questions", provider.generate(F.col("excerpt")))


def benchmark(answers: DataFrame, questions: DataFrame, path: str, run_id: str) -> DataFrame:
    """Score answers (question_id, strategy, answer, sources, latency_ms, cost_usd, error), write and rank them."""
    joined = answers.join(questions, "question_id")
    checked = scoring.structural_check(joined, "answer", "must_mention", "must_not_claim").withColumns(
        {
            "entity_coverage": scoring.ratio(scoring.held_terms(F.col("answer"), F.col("required_entities")), F.col("required_entities")),
            "source_attribution": scoring.source_attribution(F.col("source_refs"), F.col("sources")),
            "is_error": F.col("error") != "",
        }
    )
    files.write_results(checked, path, run_id)
    return scoring.composite(answers.sparkSession.read.parquet(f"{path}/latest"))


def audit(scored: DataFrame) -> DataFrame:
    """Per section: mean accuracy, the worst question and the bucket."""
    return (
        scored.groupBy("section_id")
        .agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("tested"), F.min_by("question_id", F.struct("accuracy", "pos")).alias("worst"))
        .withColumn("bucket", F.when(F.col("accuracy") >= 0.7, "strong").when(F.col("accuracy") >= 0.3, "weak").otherwise("gap"))
    )


def fixes(audited: DataFrame, sections: DataFrame, limit: int = 10) -> DataFrame:
    """The first weak and gap sections by questions tested, with their content to mend."""
    top = audited.filter("bucket <> 'strong'").orderBy(F.desc("tested"), "bucket", "section_id").limit(limit)
    ranked = top.withColumn("priority", F.row_number().over(Window.orderBy(F.desc("tested"), "bucket", "section_id")))  # ``limit`` rows
    content = sections.select("section_id", tx.clip(F.col("content"), 1500).alias("content"))
    return ranked.join(content, "section_id", "left").fillna({"content": "(no content)"})


def arena_match(questions: DataFrame, names: list[str], seed: int = 7) -> DataFrame:
    """Two distinct strategies for each question, drawn by a seeded hash."""
    ordered = F.array_sort(F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(F.xxhash64(n, F.col("question_id"), F.lit(seed)).alias("h"), n.alias("n"))))
    return questions.withColumn("_o", ordered).select("question_id", F.col("_o")[0]["n"].alias("strategy_a"), F.col("_o")[1]["n"].alias("strategy_b"))


def chat_events(answers: DataFrame) -> DataFrame:
    """A reply as ordered stream rows: message id, tokens, done, meta."""
    tokens = F.transform(F.split("answer", " "), lambda t: F.struct(F.lit("token").alias("event"), t.alias("data")))
    one = lambda e, d: F.array(F.struct(F.lit(e).alias("event"), d.alias("data")))
    events = F.concat(one("message_id", F.col("question_id").cast("string")), tokens, one("done", F.lit("")), one("meta", F.col("strategy")))
    return answers.select("question_id", F.posexplode(events).alias("seq", "e")).select("question_id", "seq", "e.event", "e.data")


def _event(name: str, *fields: Column) -> list[Column]:
    return [F.lit(name).alias("event"), F.to_json(F.struct(*fields)).alias("data")]


def graph_events(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """What a graph build tells its listeners, in order of (part, key): entities, relations, the end."""
    found = entities.select(F.lit(0).alias("part"), F.col("fqn").alias("key"), *_event("entity", F.col("fqn").alias("id"), F.col("name"), F.col("type")))
    links = relations.select(F.lit(1).alias("part"), F.concat_ws(">", "source", "type", "target").alias("key"), *_event("relationship", F.col("source"), F.col("target"), F.col("type")))
    end = entities.sparkSession.range(1).select(F.lit(2).alias("part"), F.lit("").alias("key"), F.lit("done").alias("event"), F.lit("{}").alias("data"))
    return found.unionByName(links).unionByName(end).orderBy("part", "key")


def generation_events(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Progress of pair generation in order of (part, key, nth): started, each section and its pairs, complete.

    ``sections(doc_id, pos, section_id, title, content)`` without content are left out; without any there is one error.
    """
    told = sections.filter(~tx.is_blank(F.col("content")))
    key = F.concat_ws("::", "doc_id", F.lpad(F.col("pos").cast("string"), 9, "0"))
    n = told.agg(F.count(F.lit(1)).alias("total_sections"))
    place = lambda part, k, nth: [F.lit(part).alias("part"), k.alias("key"), nth.alias("nth")]
    blank, first = F.lit(""), F.lit("")
    started = n.filter("total_sections > 0").select(*place(0, blank, first), *_event("started", F.col("total_sections")))
    error = n.filter("total_sections = 0").select(*place(0, blank, first), *_event("error", F.lit("No documents found").alias("message")))
    progress = told.select(*place(1, key, first), *_event("progress", F.col("doc_id"), F.col("title").alias("section_title")))
    made = pairs.join(told.select("doc_id", "section_id", key.alias("key")), ["doc_id", "section_id"])
    shown = made.select(*place(1, F.col("key"), F.col("pair_id")), *_event("pair", F.col("pair_id"), F.col("question"), F.col("answer")))
    complete = made.agg(F.count(F.lit(1)).alias("total_pairs")).join(n.filter("total_sections > 0"))  # one row each
    complete = complete.select(*place(2, blank, first), *_event("complete", F.col("total_pairs")))
    return started.unionByName(error).unionByName(progress).unionByName(shown).unionByName(complete).orderBy("part", "key", "nth")


def audit_events(audited: DataFrame) -> DataFrame:
    """Progress of an audit in order of (part, key): started, a result for each section, complete with the buckets' counts."""
    place = lambda part, k: [F.lit(part).alias("part"), k.alias("key")]
    counts = {name: F.count_if(F.col("bucket") == b).alias(name) for name, b in (("strong", "strong"), ("weak", "weak"), ("gaps", "gap"))}
    n = audited.agg(F.count(F.lit(1)).alias("total_sections"), F.coalesce(F.sum("tested"), F.lit(0)).alias("total_questions"), *counts.values())
    started = n.select(*place(0, F.lit("")), *_event("started", F.col("total_sections")))
    each = audited.select(
        *place(1, F.col("section_id").cast("string")),
        *_event("section_result", F.col("section_id"), F.col("tested").alias("questions_tested"), F.round("accuracy", 4).alias("avg_accuracy"), F.col("worst").alias("worst_question"), F.col("bucket").alias("classification")),
    )
    complete = n.select(*place(2, F.lit("")), *_event("complete", *[F.col(c) for c in ("strong", "weak", "gaps", "total_questions")]))
    return started.unionByName(each).unionByName(complete).orderBy("part", "key")


def fix_events(audited: DataFrame, fixed: DataFrame) -> DataFrame:
    """Both phases of a repair: the audit's events, then a result for each section of ``fixes`` by priority, then complete."""
    phase = lambda part, name: audited.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), *_event("phase", F.lit(name).alias("phase")))
    told = F.when(F.col("event") == "section_result", "audit_progress").when(F.col("event") == "complete", "audit_complete")
    first = audit_events(audited).filter("event <> 'started'").withColumn("event", told)
    results = fixed.select(F.lit(4).alias("part"), F.lpad(F.col("priority").cast("string"), 9, "0").alias("key"), *_event("fix_result", F.col("priority"), F.col("section_id"), F.col("bucket").alias("classification")))
    end = audited.sparkSession.range(1).select(F.lit(5).alias("part"), F.lit("").alias("key"), *_event("complete", F.lit("done").alias("status")))
    return phase(0, "audit").unionByName(first).unionByName(phase(3, "fix")).unionByName(results).unionByName(end).orderBy("part", "key")


@contextmanager
def cancellable(spark: SparkSession, request_id: str) -> Iterator[None]:
    """Jobs that the block starts carry the request's tag, so that ``cancel`` can end them when the client has gone."""
    tag = f"lexmill-{request_id}"
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, request_id: str) -> None:
    """End the running jobs of a request; those of others go on."""
    spark.sparkContext.cancelJobsWithTag(f"lexmill-{request_id}")


def explain_routing(questions: DataFrame) -> DataFrame:
    """What the routers make of each question."""
    q = F.col("question")
    stages = {"scan": tx.keyword_intent(q), "fallback": tx.fallback_intent(q), "intent": tx.routed_intent(q), "hybrid": tx.substring_intent(q), "graph": tx.graph_intent(q), "template": tx.graph_template(q)}
    return questions.select("question_id", *[c.alias(n) for n, c in stages.items()], tx.entity_mentions(q).alias("mentions"))


def corpora(docs: DataFrame) -> DataFrame:
    """Documents and tokens of each corpus."""
    return docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("sections")).alias("sections"), F.sum("raw_token_count").alias("tokens"))


def dry_run(questions: DataFrame, strategies: int, concurrency: int = 5) -> DataFrame:
    """Planned queries, cost (0.008 a query) and seconds (4.5 a query)."""
    n = F.count(F.lit(1)) * strategies
    return questions.agg(n.alias("queries"), F.round(n * 0.008, 3).alias("cost_usd"), F.round(n * 4.5 / concurrency, 1).alias("seconds"))


def report(table: DataFrame, title: str, kind: str = "markdown") -> str:
    return {"markdown": lambda: reports.markdown(title, table), "csv": lambda: reports.as_csv(table), "html": lambda: reports.as_html(title, table), "json": lambda: reports.as_json(table)}[kind]()


__all__ = ["arena_match", "audit", "audit_events", "benchmark", "cancel", "cancellable", "chat_events", "corpora", "dry_run", "explain_routing", "fix_events", "fixes", "generate_questions", "generation_events", "graph_events", "ingest", "label_expected", "report", "retriever_lab", "section_rows"]
