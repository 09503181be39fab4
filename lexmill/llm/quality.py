"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects a document whose feature lies above a cutoff. Cutoffs are chosen for each stratum from a fixed
ladder: a step is a level, which sets the cutoffs of all rules, and at most one rule that is left out. A step
qualifies if, among the stratum's labelled clean documents, an exact binomial test refutes "the rules of this step
together reject more than ``risk`` of clean documents" after a Bonferroni correction over all steps and strata.
The lowest qualifying level is used, with no rule left out if that qualifies; without one the rules are off there.
With the stated confidence the union of the rules thus keeps to the risk in every stratum at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, own_columns, row_id, whole_text, words_of, written

SYMBOLS = "#*$%&|<>"
#: Feature name -> cutoffs in percent, one for each level, lowest first.
GRIDS: dict[str, list[int]] = {
    "symbol_pct": [2, 5, 10, 20, 40],
    "shout_pct": [10, 20, 35, 50, 75],
    "upper_pct": [20, 35, 50, 75, 90],
    "dup_line_pct": [10, 25, 40, 60, 80],
    "repeat_pct": [5, 10, 15, 18, 20],
    "digit_pct": [5, 10, 20, 40, 60],
}


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more in the array."""

    def windows(h: Column) -> Column:
        last = F.size(h) - width
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def starts(pairs: Column) -> Column:
        twin = F.transform(
            pairs,
            lambda p, j: F.when(
                p["h"].eqNullSafe(F.get(pairs, j - 1)["h"]) | p["h"].eqNullSafe(F.get(pairs, j + 1)["h"]), p["i"]
            ),
        )
        return F.array_sort(F.filter(twin, lambda i: i.isNotNull()))

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(pairs, starts),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
        )["n"]

    def counted(found: Column) -> Column:  # the sort only where two windows are equal
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(let(hashed, windows), counted))


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the features the rules compare (prefixed ``_lm_``)."""
    text = whole_text(text_col)
    words = F.col("_lm_words")
    upper = F.length(F.regexp_replace(text, "[^\\p{Lu}]", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    counted = (
        docs.withColumn("_lm_words", words_of(text))
        .withColumns(
            {
                "_lm_n_words": F.size(words).cast("long"),
                "_lm_word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
                "_lm_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "_lm_lines": lines,
                "_lm_n_repeat_words": repeated_window_words(words).cast("long"),
                "_lm_shouts": F.size(F.filter(words, lambda w: w.endswith("!!"))),
                "_lm_upper": upper,
                "_lm_digits": F.length(text) - F.length(F.translate(text, "0123456789", "")),
            }
        )
        .withColumns(
            {
                "_lm_n_lines": F.size("_lm_lines"),
                "_lm_n_dup_lines": (F.size("_lm_lines") - F.size(F.array_distinct("_lm_lines"))).cast("long"),
            }
        )
    )

    def percent(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0))

    return counted.withColumns(
        {
            "_lm_symbol_pct": percent("_lm_n_symbols", "_lm_word_chars"),
            "_lm_shout_pct": percent("_lm_shouts", "_lm_n_words"),
            "_lm_upper_pct": percent("_lm_upper", "_lm_word_chars"),
            "_lm_dup_line_pct": percent("_lm_n_dup_lines", "_lm_n_lines"),
            "_lm_repeat_pct": percent("_lm_n_repeat_words", "_lm_n_words"),
            "_lm_digit_pct": percent("_lm_digits", "_lm_word_chars"),
        }
    ).drop("_lm_words", "_lm_lines")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    first = n.cast("double") * F.lit(math.log1p(-p))
    step = F.lit(math.log(p / (1.0 - p)))
    return F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct(first.alias("log_term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["log_term"] + F.log((n - i).cast("double") / (i + 1)) + step).alias("log_term"),
            (acc["sum"] + F.exp(acc["log_term"])).alias("sum"),
        ),
    )["sum"]


#: The ladder: (level from 0, number of the rule that is left out, or -1), best first.
STEPS = [(level, left_out) for level in range(5) for left_out in range(-1, len(GRIDS))]


def rejects(level: int, left_out: int) -> Column:
    """Whether any rule of a step rejects."""
    found = F.lit(False)
    for i, (rule, grid) in enumerate(GRIDS.items()):
        if i != left_out:
            found = found | (F.col(f"_lm_{rule}") > grid[level])
    return found


def risk_steps(labelled: DataFrame, risk: float, confidence: float) -> DataFrame:
    """(stratum, step): the first step of ``STEPS`` that qualifies, for each stratum that has one.

    ``labelled`` has ``stratum``, ``clean`` and the feature columns. Only counts leave the executors.
    """
    totals = labelled.filter("clean").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rejects(*s)).alias(f"wrong{i}") for i, s in enumerate(STEPS)])
    counts = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"wrong{i}").alias("wrong")) for i in range(len(STEPS))])
    long = written(totals.select("stratum", "n", F.explode(counts).alias("cell")).select("stratum", "n", "cell.*"))  # a row for each stratum and step
    tests = long.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("tests"))
    tested = long.crossJoin(F.broadcast(tests)).filter(
        # The tail is only summed below the mean: above it the test cannot pass.
        F.when(F.col("wrong") <= F.col("n") * risk, binomial_tail(F.col("wrong"), F.col("n"), risk)).otherwise(1.0)
        <= (1.0 - confidence) / F.col("tests")
    )
    return tested.groupBy("stratum").agg(F.min("step").alias("step"))


@own_columns
def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum_col: str = "lang",
    risk: float = 0.01,
    confidence: float = 0.95,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, kept.

    ``labels(doc_id, quality)``: rows with quality 1 are the clean holdout; null or repeated labels count
    once each as they come, and labels of unknown ids do nothing. A null text has no words and fails the
    base rules; a null stratum is a stratum of its own; a stratum without enough labels (about 800 with no false
    rejection, at 1 percent and 95 percent confidence in four strata) has no learned rules. Empty tables give empty results; columns of ``docs`` named like the results are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]
    docs = docs.drop(*added)
    clean_ids = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("_lm_rid")).distinct()
    # Features without the text are written once, for the cutoffs and the verdicts both.
    scored = base_features(
        docs.select(row_id(id_col).alias("_lm_rid"), F.xxhash64(whole_text(text_col)).alias("_lm_hash"), F.col(stratum_col).alias("_lm_stratum"), F.col(text_col).alias("_lm_text")),
        "_lm_text",
    ).drop("_lm_text")
    # A null stratum is told from every text by a flag of its own.
    scored = written(scored.withColumns({"_lm_no_stratum": F.col("_lm_stratum").isNull(), "_lm_stratum": F.coalesce(F.col("_lm_stratum").cast("string"), F.lit(""))}))
    stratum = ["_lm_stratum", "_lm_no_stratum"]
    base_failed = (F.col("_lm_n_words") < 10) | (100 * F.col("_lm_n_repeat_words") > 20 * F.col("_lm_n_words"))
    labelled = scored.join(clean_ids, "_lm_rid", "left_semi").withColumns({"clean": ~base_failed, "stratum": F.struct(*stratum)})
    steps = written(risk_steps(labelled, risk, confidence).select("stratum.*", F.col("step").alias("_lm_step")))
    step_level, step_left_out = F.col("_lm_step").cast("int"), F.array(*[F.lit(left_out) for _, left_out in STEPS])
    level = F.get(F.array(*[F.lit(level) for level, _ in STEPS]), step_level)
    fails = [
        F.when((F.get(step_left_out, step_level) != i) & (F.col(f"_lm_{r}") > F.get(F.array(*[F.lit(c) for c in grid]), level)), F.lit(r))
        for i, (r, grid) in enumerate(GRIDS.items())
    ]
    failed = F.filter(F.array(*fails), lambda r: r.isNotNull())  # no step, no failures
    judged = scored.dropDuplicates(["_lm_rid", "_lm_hash", *stratum]).join(steps, stratum, "left").select(
        "_lm_rid",
        "_lm_hash",
        *stratum,
        F.col("_lm_n_words").alias("n_words"),
        F.col("_lm_word_chars").alias("word_chars"),
        F.col("_lm_n_symbols").alias("n_symbols"),
        F.col("_lm_n_dup_lines").alias("n_dup_lines"),
        F.col("_lm_n_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        failed.alias("failed_rules"),
    )
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    keyed = docs.withColumns(
        {
            "_lm_rid": row_id(id_col),
            "_lm_hash": F.xxhash64(whole_text(text_col)),
            "_lm_stratum": F.coalesce(F.col(stratum_col).cast("string"), F.lit("")),
            "_lm_no_stratum": F.col(stratum_col).isNull(),
        }
    )
    return keyed.join(judged, ["_lm_rid", "_lm_hash", *stratum]).select(*docs.columns, *added)
