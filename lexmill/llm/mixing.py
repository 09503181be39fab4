"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_columns, whole_text, written

#: Above this rate, where exp(-rate) comes near to underflow, sums start below the mode; below it, at 0.
LOG_RATE = 700


def unit_hash(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the seed and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_steps(rate: Column) -> Column:
    """(skip, cdf): P(X <= skip), P(X <= skip + 1), ... until the rest is below 2**-53.

    ``skip`` is 0 up to ``LOG_RATE``; above it starts where all before is below 2**-53 too, at a probability taken
    from Stirling's series, which is exact there to the last bits. The list grows with the root of the rate.
    """
    reach = 12 * F.sqrt(rate) + 30
    skip = F.when(rate > LOG_RATE, F.floor(rate - reach)).otherwise(0).cast("long")
    last = F.ceil(rate + reach).cast("long")
    k = F.greatest(skip, F.lit(1)).cast("double")
    log_factorial = k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k)
    first = F.when(skip > 0, F.exp(k * F.log(rate) - rate - log_factorial)).otherwise(F.exp(-rate))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))
    return F.struct(skip.alias("skip"), F.aggregate(F.sequence(skip + 1, last), start, step)["all"].alias("cdf"))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, scale: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per source: characters, target share and mean repetition rate.

    ``weights(source, weight)`` gives the targets; sources it lacks get weight 0. Rows that repeat a source add up;
    null, negative and NaN weights count as 0. Without ``weights`` the target is the square root of a source's share,
    normalised. A null source is a source of its own.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("_lm_source"), F.col(source_col).isNull().alias("_lm_null")).agg(
        F.sum(F.length(whole_text(text_col))).cast("long").alias("chars")
    )
    if weights is None:
        sized = sizes.withColumn("weight", F.sqrt(F.col("chars").cast("double")))
    else:
        weight = F.col("weight").cast("double")
        wanted = (
            weights.select(F.coalesce(F.col("source"), F.lit("")).alias("_lm_source"), F.col("source").isNull().alias("_lm_null"), F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(0.0).alias("weight"))
            .groupBy("_lm_source", "_lm_null")
            .agg(F.sum("weight").alias("weight"))
        )
        sized = sizes.join(wanted, ["_lm_source", "_lm_null"], "left").fillna({"weight": 0.0})
    sized = written(sized)
    total = sized.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    share = F.try_divide(F.col("weight"), F.col("all_weight"))
    rate = F.coalesce(F.try_divide(share * F.col("all_chars") * F.lit(float(scale)), F.col("chars")), F.lit(0.0))
    rated = sized.crossJoin(F.broadcast(total)).select("_lm_source", "_lm_null", "chars", share.alias("target_share"), rate.alias("rate"))
    return written(rated.withColumn("steps", poisson_steps(F.col("rate"))))


@own_columns
def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    scale: float = 1.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Replicate each document Poisson(rate of its source) times and shuffle globally.

    Adds ``copy_no`` (from 1), ``n_copies``, ``rate`` and ``mix_key``, the sort key of the global shuffle:
    rows are range-partitioned and sorted by it. The count inverts the Poisson distribution at a hash of
    seed and id, so reruns agree; repeated ids get equal counts, a null id hashes as the empty string.
    Sources with no characters have rate 0. Empty tables give empty results; columns of ``docs`` named like
    the results are replaced.
    """
    docs = docs.drop("copy_no", "n_copies", "rate", "mix_key")
    rates = source_rates(docs, weights, scale, source_col, text_col).select("_lm_source", "_lm_null", "rate", F.col("steps").alias("_lm_steps"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # The rates are a written table: the planner broadcasts them only if their measured size is below its threshold.
    counted = (
        docs.withColumns({"_lm_source": F.coalesce(F.col(source_col), F.lit("")), "_lm_null": F.col(source_col).isNull(), "_lm_unit": unit_hash(seed, key)})
        .join(rates, ["_lm_source", "_lm_null"])
        .withColumn("n_copies", F.col("_lm_steps.skip") + F.size(F.filter("_lm_steps.cdf", lambda c: c <= F.col("_lm_unit"))))
        .filter("n_copies > 0")
    )
    copies = counted.select(
        *[F.col(c) for c in docs.columns],
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy_no"),
        "n_copies",
        "rate",
    ).withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key, F.col("copy_no")).cast("binary")))
    return copies.repartitionByRange("mix_key").sortWithinPartitions("mix_key")
