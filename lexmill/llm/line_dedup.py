"""Removal of lines that spread over many distinct sites, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import own_columns, row_id, whole_text, written

#: HyperLogLog sketches have 2**12 registers: relative standard error about 1.6 %.
SKETCH_BITS = 12
#: Estimates within this share of a limit are replaced by exact counts (over six standard errors).
NEAR = 0.10


def line_rows(docs: DataFrame, id_col: str, site_col: str, text_col: str, around: int | None) -> DataFrame:
    """A row for each non-blank line: document key, position, and hashes of the line and its site.

    With ``around``, also what surrounds it: ``nth`` counts the non-blank lines, ``before`` and ``after`` are the text of
    the next of them (null at an end), ``body`` is a hash of them all.
    """
    lines = F.split(whole_text(text_col), "\n")
    full = docs.select(
        row_id(id_col).alias("rid"), F.xxhash64(whole_text(text_col)).alias("hash"), F.xxhash64(F.col(site_col).cast("string")).alias("site"), lines.alias("lines")
    ).withColumn("full", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line"))), lambda x: x["line"] != ""))
    if around is None:
        return full.select("rid", "hash", "site", F.explode("full").alias("at")).select("rid", "hash", "at.pos", F.xxhash64("at.line").alias("line"), "site")
    return (
        full.select("rid", "hash", "site", "full", F.xxhash64(F.col("full.line")).alias("body"), F.posexplode("full").alias("nth", "at"))
        .select("*", F.col("at.pos").alias("pos"), F.get("full", F.col("nth") - 1)["line"].alias("last"), F.get("full", F.col("nth") + 1)["line"].alias("next"))
        .select(
            "rid",
            "hash",
            "pos",
            "nth",
            F.xxhash64("at.line").alias("line"),
            "site",
            F.when(F.col("last").isNotNull(), F.xxhash64(F.right("last", F.lit(around)))).alias("before"),
            F.when(F.col("next").isNotNull(), F.xxhash64(F.left("next", F.lit(around)))).alias("after"),
            "body",
        )
    )


def spread_lines(rows: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of lines on ``min_sites`` or more distinct sites.

    Sketches merge by one aggregation, combined before the shuffle. Only lines whose estimate is near the limit are
    counted exactly, from the distinct (line, site) pairs: the rows of a line are never brought together.
    """
    sites = F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).cast("double")
    guessed = written(rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"), sites.alias("sites")).filter(F.col("n") >= min_sites))  # a spread is at most n
    near = F.abs(F.col("sites") - min_sites) <= min_sites * NEAR + 1
    sure = guessed.filter((F.col("sites") > min_sites) & ~near).select("line")
    pairs = rows.groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.join(guessed.filter(near).select("line"), "line").groupBy("line").agg(F.count("one").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("line"))


def block_rows(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """A row for each occurrence of a spread line, whose ``context`` is what surrounds its block.

    A block is a run of spread lines with nothing but blank lines between; its surroundings are the ends of the
    lines around it that are not spread. If it is the whole text, all its lines are the context.
    """
    # A place has one line; it is no grouping key, so that a frequent line's rows are dealt out again after the join.
    held = rows.join(spread, "line").groupBy("rid", "hash", "pos").agg(*(F.min(c).alias(c) for c in ("nth", "line", "before", "after", "body", "site")))
    held = held.withColumn("block", F.col("nth") - F.row_number().over(Window.partitionBy("rid", "hash").orderBy("nth")))
    whole = Window.partitionBy("rid", "hash", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = held.select("rid", "hash", "pos", "line", "site", "body", F.first("before").over(whole).alias("before"), F.last("after").over(whole).alias("after"))
    everything = F.when(F.col("before").isNull() & F.col("after").isNull(), F.col("body"))
    context = F.xxhash64(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0)), everything)
    return around.select("rid", "hash", "pos", "line", "site", context.alias("context"))


def independent_lines(blocks: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of lines on ``min_sites`` or more sites if each context counts once, at the site of its least id."""
    first = blocks.groupBy("line", "context").agg(F.min(F.struct("rid", "site")).alias("first"))
    sites = first.select("line", F.col("first.site").alias("site")).distinct()
    return sites.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("line")


@own_columns
def line_dedup(
    docs: DataFrame,
    min_sites: int = 8,
    around: int | None = None,
    site_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and ``n_lines``, ``n_removed_lines`` added.

    A line (trimmed; blank ones never count) is boilerplate if it occurs on ``min_sites`` distinct sites.

    With ``around``, the places also have to be independent: the block of such lines a line stands in is judged by so
    many characters before and after the block. Places with the same surroundings are copies and count once, at the
    site of the least id, however many there are. Lines that only travel with copies of one document are thus left
    for a document dedup that follows.

    No row is dropped. A null text stays null, a null site counts as one site; rows repeated with id and text are one
    place. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    rows = written(line_rows(docs, id_col, site_col, text_col, around))
    spread = written(spread_lines(rows, min_sites))
    if around is None:
        places = rows.join(spread, "line")
    else:
        blocks = written(block_rows(rows, spread))
        places = blocks.join(written(independent_lines(blocks, min_sites)), "line")
    removed = (
        places.groupBy(F.col("rid").alias("_lm_rid"), F.col("hash").alias("_lm_hash"))
        .agg(F.collect_set("pos").alias("_lm_removed"))  # at most the lines of one document
    )
    keyed = docs.withColumns({"_lm_rid": row_id(id_col), "_lm_hash": F.xxhash64(whole_text(text_col))})
    found = keyed.join(removed, ["_lm_rid", "_lm_hash"], "left")
    lines = F.split(F.col(text_col), "\n")
    gone = F.col("_lm_removed")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(kept)
    return found.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed_lines"),
    )
