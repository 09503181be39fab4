"""What a benchmark run adds to the answer checks: judges, retrieval fallback, report columns and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stored
from . import ir
from .provider import STUB, Provider

# How many chunks a judge sees, and how many names, questions and characters reports show.
JUDGED_CHUNKS, SHOWN_QUESTIONS, SHOWN_CHARS = 10, 3, 100
# Keys of the four judge replies.
RAGAS_KEYS = {"faithfulness": "faithfulness", "context_precision": "context_precision", "context_recall": "context_recall", "answer_relevancy": "relevancy"}


def judged(scored: DataFrame, provider: Provider = STUB, reference_free: bool = False) -> DataFrame:
    """``scored(answer, reference, accuracy, completeness, faithfulness, structural_pass)`` with a judge's scores.

    Rows that fail the structural checks are not judged; what a reply lacks, or a failed reply, keeps the score.
    """
    if reference_free:
        return scored
    asks = F.col("structural_pass") & F.col("reference").isNotNull()
    reply = F.from_json(tx.first_json_object(F.when(asks, provider.judge(F.col("answer"), F.col("reference")))), "accuracy double, completeness double, faithfulness double")
    return scored.withColumn("_reply", reply).withColumns({c: F.coalesce(F.col(f"_reply.{c}"), F.col(c)) for c in ("accuracy", "completeness", "faithfulness")}).drop("_reply")


def ragas(rows: DataFrame, provider: Provider = STUB) -> DataFrame:
    """The four judge metrics of ``rows(question, answer, reference, chunks)``; empty inputs and failed replies are 0."""
    first = F.slice("chunks", 1, JUDGED_CHUNKS)
    context = F.array_join(first, "\n---\n")
    numbered = F.array_join(F.transform(first, lambda c, i: F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(": "), c)), "\n---\n")
    some = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    has = lambda c: ~tx.is_blank(F.coalesce(F.col(c), F.lit("")))
    asks = {
        "faithfulness": (some & has("answer"), F.concat(F.lit("Context:\n"), context, F.lit("\n\nAnswer:\n"), F.col("answer"))),
        "context_precision": (some, F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nRetrieved context:\n"), numbered)),
        "context_recall": (some & has("reference"), F.concat(F.lit("Reference answer:\n"), F.col("reference"), F.lit("\n\nRetrieved context:\n"), context)),
        "answer_relevancy": (has("answer"), F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nAnswer:\n"), F.col("answer"))),
    }
    out = {}
    for name, (able, prompt) in asks.items():
        reply = F.from_json(tx.first_json_object(provider.judge(prompt, F.lit(""))), f"{RAGAS_KEYS[name]} double")
        out[name] = F.when(able, F.coalesce(reply[RAGAS_KEYS[name]], F.lit(0.0))).otherwise(0.0)
    return rows.withColumns(out)


def metrics_or_documents(retrieved: DataFrame, expected: DataFrame, expected_docs: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """``ir.metrics``; questions without labelled chunks but with ``expected_docs(question_id, doc_id)`` are measured by document.

    ``retrieved`` has ``doc_id`` too. Adds ``fallback_doc_level``, ``expected_count`` and ``hits``, the distinct
    expected ids found in the first ``k``, in order.
    """
    labelled = expected.select("question_id").distinct()
    by_doc = expected_docs.join(labelled, "question_id", "left_anti").select("question_id", F.col("doc_id").cast("string").alias("expected_id")).distinct()
    falls = by_doc.select("question_id").distinct().withColumn("fallback_doc_level", F.lit(True))
    wanted = expected.select("question_id", "expected_id").distinct().unionByName(by_doc)
    flagged = retrieved.join(falls, "question_id", "left").withColumn("chunk_id", F.when(F.col("fallback_doc_level"), F.col("doc_id").cast("string")).otherwise(F.col("chunk_id")))
    flagged = stored(flagged.drop("fallback_doc_level", "doc_id"))
    hits = ir.matched(flagged, wanted).filter((F.col("rank") <= k) & F.col("hit").isNotNull()).groupBy("question_id").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    counts = wanted.groupBy("question_id").agg(F.count(F.lit(1)).alias("expected_count"))
    found = ir.metrics(flagged, wanted, questions, k).join(falls, "question_id", "left").join(hits, "question_id", "left").join(counts, "question_id", "left")
    return found.withColumns(
        {"fallback_doc_level": F.coalesce("fallback_doc_level", F.lit(False)), "hits": F.coalesce("hits", F.array().cast("array<string>")), "expected_count": F.coalesce("expected_count", F.lit(0))}
    )


def outcome_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``records(accuracy, answer, error)``: all, correct, failed, empty and timed out."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("accuracy") >= 0.7).alias("correct"),
        F.count_if(F.col("error") != "").alias("errors"),
        F.count_if((F.col("error") == "") & tx.is_blank(F.col("answer"))).alias("empty"),
        F.count_if(F.contains(F.lower("error"), F.lit("timeout"))).alias("timeouts"),
    )


def measured_means(records: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Means over the records that have metrics: those without are null, not 0."""
    return records.groupBy(*keys).agg(F.count(names[0]).alias("measured"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def corpus_composite(rows: DataFrame) -> DataFrame:
    """Composite of each strategy, as the mean over corpora, ranked.

    In a corpus: 0.5 accuracy + 0.3 success + 0.2 max(0, 1 - latency / 10 s), where latency is the median if that is
    above 0, else the mean. ``rows`` has corpus, strategy, accuracy, is_error, latency_ms and p50_ms.
    """
    latency = F.when(F.max("p50_ms") > 0, F.max("p50_ms")).otherwise(F.avg("latency_ms"))
    per = rows.groupBy("corpus", "strategy").agg(
        (0.5 * F.avg("accuracy") + 0.3 * (1 - F.avg(F.col("is_error").cast("double"))) + 0.2 * F.greatest(F.lit(0.0), 1 - latency / 10000)).alias("c")
    )
    over = per.groupBy("strategy").agg(F.round(F.avg("c"), 6).alias("composite"), F.count(F.lit(1)).alias("corpora"))
    return over.withColumn("place", F.row_number().over(Window.orderBy(F.desc("composite"), "strategy")).cast("long"))  # a row a strategy


def audit_rollup(scored: DataFrame) -> DataFrame:
    """Sections of ``scored(section_id, question_id, pos, accuracy)``: mean, tested, worst (the first least) and bucket."""
    per = scored.groupBy("section_id").agg(F.avg("accuracy").alias("mean"), F.count(F.lit(1)).alias("tested"), F.min_by("question_id", F.struct("accuracy", "pos")).alias("worst"))
    return per.withColumn("bucket", F.when(F.col("mean") >= 0.7, "strong").when(F.col("mean") >= 0.3, "weak").otherwise("gap"))


def audit_overall(rollup: DataFrame) -> DataFrame:
    """The mean over sections, weighted by questions tested, and how many sections each bucket has: one row."""
    buckets = [F.count_if(F.col("bucket") == b).alias(b) for b in ("strong", "weak", "gap")]
    return rollup.agg(F.round(F.sum(F.col("mean") * F.col("tested")) / F.greatest(F.sum("tested"), F.lit(1)), 6).alias("overall"), *buckets)


def failing_questions(scored: DataFrame, below: float = 0.7) -> DataFrame:
    """(section_id, failing): the first three questions below the limit, worst first, cut to 100 characters."""
    by = Window.partitionBy("section_id").orderBy("accuracy", "pos")
    first = scored.filter(F.col("accuracy") < below).withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= SHOWN_QUESTIONS)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.left("question", F.lit(SHOWN_CHARS)).alias("q")))), lambda x: x["q"])
    return first.groupBy("section_id").agg(shown.alias("failing"))


def display_order(rollup: DataFrame, bucket: str) -> DataFrame:
    """Strong sections by falling mean, weak ones and gaps by rising mean."""
    order = F.desc("mean") if bucket == "strong" else F.asc("mean")
    return rollup.filter(F.col("bucket") == bucket).orderBy(order, "section_id")


def sorted_table(table: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A report table by one of its columns; nulls come last either way, ties by the first column."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return table.orderBy(key, table.columns[0])


def distinct_sources(sources: Column, keep_order: bool = True) -> Column:
    """Each source once: as they came, or sorted."""
    once = F.array_distinct(F.filter(sources, lambda s: s.isNotNull()))
    return once if keep_order else F.array_sort(once)


def available(loaded: Column, graph_based: Column) -> Column:
    """Strategies that are loaded and need a graph."""
    return F.array_intersect(loaded, graph_based)


def extension_counts(files: DataFrame) -> DataFrame:
    """Files of each extension, of ``files(path)``; a name without one counts as empty."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.groupBy(F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """One row: documents, pairs and pairs a document."""
    per = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("pairs_per_document"))


def recent_turns(messages: DataFrame, turns: int = 6, chars: int = 500) -> DataFrame:
    """(conv_id, turn, role, content): what a classifier sees of each conversation, its last turns, cut."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(by)).filter(F.col("_back") <= turns).select("conv_id", "turn", "role", F.left("text", F.lit(chars)).alias("content"))


def retained(matches: DataFrame, order: str, n: int = 200) -> DataFrame:
    """The latest ``n`` rows, latest first."""
    return matches.orderBy(F.desc(order)).limit(n)


def votable(matches: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes for matches that have no winner yet; the first vote on a match counts."""
    open_ = matches.filter(F.col("winner").isNull()).select("match_id")
    first = votes.join(open_, "match_id", "left_semi").groupBy("match_id").agg(F.min_by("winner", "seq").alias("winner"), F.min("seq").alias("seq"))
    return first
