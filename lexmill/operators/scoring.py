"""Answer checks and the aggregates of a benchmark run."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key, holds


def held_terms(text: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: holds(text, t))


def ratio(part: Column, whole: Column) -> Column:
    """Share of an expected list that was found; an empty list counts as all found."""
    return F.when(F.size(whole) == 0, 1.0).otherwise(F.size(part) / F.size(whole))


def structural_check(answers: DataFrame, answer: str, mention: str, forbid: str) -> DataFrame:
    """accuracy, completeness, faithfulness and structural_pass from required and forbidden terms."""
    found, false = held_terms(F.col(answer), F.col(mention)), held_terms(F.col(answer), F.col(forbid))
    bad = F.size(false) > 0
    share = ratio(found, F.col(mention))
    return answers.withColumns(
        {
            "completeness": F.round(share, 6),
            "accuracy": F.round(F.when(bad, 0.0).otherwise(share), 6),
            "faithfulness": F.when(bad, 0.0).otherwise(1.0),
            "structural_pass": ~bad,
        }
    )


def source_attribution(refs: Column, sources: Column) -> Column:
    """Share of references that contain, or are contained in, some source, ignoring case."""

    def cited(r: Column) -> Column:
        return F.exists(sources, lambda s: F.contains(F.lower(s), F.lower(r)) | F.contains(F.lower(r), F.lower(s)))

    return (
        F.when(F.size(refs) == 0, 1.0).when(F.size(sources) == 0, 0.0).otherwise(F.size(F.filter(refs, cited)) / F.size(refs))
    )


def evaluate_once(answers: DataFrame, answer: str, reference: str, judge) -> DataFrame:
    """Judge each distinct (answer, reference) once and join the verdict back."""
    keyed = answers.withColumns({"answer_key": cache_key(F.col(answer)), "reference_key": cache_key(F.col(reference))})
    distinct = keyed.dropDuplicates(["answer_key", "reference_key"])
    verdicts = distinct.select("answer_key", "reference_key", judge(F.col(answer), F.col(reference)).alias("verdict"))
    return keyed.join(verdicts, ["answer_key", "reference_key"], "left")


def records(events: DataFrame) -> DataFrame:
    """Events read as answer records: strategy, tier, accuracy, latency, error flag, cost, sequence."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("strategy"),
        (F.col("event_id") % 5 + 1).cast("int").alias("tier"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("accuracy"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("is_error"),
        F.round(F.col("value") / 1000.0, 6).alias("cost_usd"),
        "user_id",
        "ts",
    )


def summed_before(frame: DataFrame, keys: list[str], order: str, amount: str) -> DataFrame:
    """``frame`` with ``before``: the sum of ``amount`` over the rows of the same keys that come earlier by ``order``.

    A key's rows are cut into 256 ranges at approximate quantiles. Windows run over a range, and only the ranges'
    totals are summed over a key, so a key that holds a third of all rows is no single task. Nulls in ``order`` come
    first; rows that tie in it are in any order.
    """
    edges = frame.groupBy(*keys).agg(F.percentile_approx(order, [k / 256 for k in range(1, 256)]).alias("_edges"))
    here = F.col(order)
    # Every 16th edge first, then the 15 that follow the last one passed.
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(16), F.lit(240), F.lit(16)), lambda k: F.element_at("_edges", k)), lambda e: e < here))
    fine = F.size(F.filter(F.slice("_edges", 16 * F.col("_coarse") + 1, F.lit(15)), lambda e: e < here))
    cut = _same(frame, edges, keys).withColumn("_coarse", coarse)
    cut = cut.withColumn("_range", F.when(here.isNull(), -1).otherwise(16 * F.col("_coarse") + fine)).drop("_edges", "_coarse")
    totals = cut.groupBy(*keys, "_range").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = _same(cut.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0))), totals, [*keys, "_range"])
    return placed.withColumn("before", F.col("_offset") + F.col("_within")).drop("_offset", "_within", "_range")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join on equal keys, null equal to null, with the left's keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on).drop(*[f"_right_{k}" for k in keys])


def index_percentiles(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """avg, p50 = s[n//2], p95 = s[int(.95 n)] from n = 20 on, p99 = s[int(.99 n)] from n = 100 on, else the maximum.

    Equal values are counted before they are ranked, and ranked in ranges, so no group is one task.
    """
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    ranked = _same(summed_before(counts, keys, value, "copies"), sizes, keys)

    def pick(share: float, least: int) -> Column:
        spot = F.when(F.col("n") >= least, F.floor(F.col("n") * F.lit(share)).cast("int")).otherwise(F.col("n") - 1)
        return F.max(F.when((F.col("before") <= spot) & (spot < F.col("before") + F.col("copies")), F.col(value)))

    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.round(F.max("mean"), 4).alias("avg_ms"),
        pick(0.5, 1).alias("p50_ms"),
        pick(0.95, 20).alias("p95_ms"),
        pick(0.99, 100).alias("p99_ms"),
        F.max("least").alias("min_ms"),
        F.max("most").alias("max_ms"),
    )


def composite(rows: DataFrame) -> DataFrame:
    """0.5 accuracy + 0.3 success + 0.2 max(0, 1 - latency / 10 s), ranked."""
    per = rows.groupBy("strategy").agg(
        F.avg("accuracy").alias("accuracy"), (1 - F.avg(F.col("is_error").cast("double"))).alias("success"), F.avg("latency_ms").alias("latency_ms")
    )
    score = F.round(0.5 * F.col("accuracy") + 0.3 * F.col("success") + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("latency_ms") / 10000), 6)
    # One row for each strategy: the global rank is over a handful of rows.
    return per.select("strategy", score.alias("composite")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("composite"), "strategy")).cast("long"))


def spend_until(rows: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Records that still ran under a cost cap: those whose earlier records of the same keys cost less than it."""
    spent = summed_before(rows, keys, "seq", "cost_usd")
    return spent.withColumn("spent_before", F.round("before", 6)).drop("before").filter(F.col("spent_before") < cap)
