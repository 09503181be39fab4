"""Exact dedup by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes. Each round splits every open group by its next digit; a group
that holds one document, or whose texts have ended, is closed. Digits widen from round to round, so
the rounds grow with the logarithm of the longest repeated text. Bytes are compared themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NO_ID, own_columns, row_id, whole_text, written


def _split(rows: DataFrame, group: list[str]) -> DataFrame:
    """One radix pass: the rows of groups that still hold two or more, with the new group's keys.

    The aggregate combines on the map side, so a hot group sends one row from each task; joining its
    one row back leaves the large side free for skew splitting.
    """
    key = [*group, "digit", "ended"]
    groups = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("size"), F.max("rid").alias("top"), F.max("hash").alias("top_hash"))
        .filter("size > 1")
    )
    return rows.join(groups, key).drop("digit", *group)


@own_columns
def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_digit: int = 256,
    widen: int = 16,
) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept``; every input column and row is returned.

    Of equal texts (null counts as empty) the row with the largest id stays. A null id orders below all
    others and stays only if its whole group has none. Rows that repeat with the same id and text count
    as members each, and are all marked as kept when theirs is the largest id. An empty table gives an
    empty result. Columns of ``docs`` named like the three results are replaced.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    text = F.encode(whole_text(text_col), "UTF-8")
    rows = docs.select(row_id(id_col).alias("rid"), F.xxhash64(whole_text(text_col)).alias("hash"), text.alias("bytes"))
    digit = rows.select(
        "rid",
        "hash",
        F.substring("bytes", 1, first_digit).alias("digit"),
        (F.length("bytes") <= first_digit).alias("ended"),
    )
    open_rows = written(_split(digit, []))
    closed = [open_rows.filter("ended")]
    open_rows = open_rows.filter("not ended")
    # The texts of open groups, once; later rounds take only their next digits from it.
    # One strategy at every size; the ids are the build side, so texts are not sorted.
    texts = written(rows.join(open_rows.select("rid", "hash").distinct().hint("shuffle_hash"), ["rid", "hash"]))
    longest = texts.agg(F.max(F.length("bytes"))).first()[0] or 0
    at, width = first_digit, first_digit * widen
    while at < longest:
        digits = texts.filter(F.length("bytes") > at).select(
            "rid",
            "hash",
            F.substring("bytes", at + 1, width).alias("digit"),
            (F.length("bytes") <= at + width).alias("ended"),
        )
        group = open_rows.select("rid", "hash", F.col("top").alias("in"), F.col("top_hash").alias("in_hash")).distinct()
        split = written(_split(digits.join(group, ["rid", "hash"]), ["in", "in_hash"]))
        closed.append(split.filter("ended"))
        open_rows = split.filter("not ended")
        at, width = at + width, width * widen
    groups = closed[0]
    for more in closed[1:]:
        groups = groups.unionByName(more)
    groups = groups.select("rid", "hash", F.col("top").alias("_lm_top"), F.col("size").alias("_lm_size")).distinct()
    keyed = docs.withColumns({"_lm_rid": row_id(id_col), "_lm_hash": F.xxhash64(whole_text(text_col))})
    found = keyed.join(groups.withColumnsRenamed({"rid": "_lm_rid", "hash": "_lm_hash"}), ["_lm_rid", "_lm_hash"], "left")
    in_group = F.col("_lm_top").isNotNull()
    return found.select(
        *docs.columns,
        F.when(in_group, F.nullif("_lm_top", F.lit(NO_ID))).otherwise(F.col(id_col).cast("long")).alias("keep_id"),
        F.coalesce("_lm_size", F.lit(1)).cast("long").alias("group_size"),
        (~in_group | (F.col("_lm_top") == F.col("_lm_rid"))).alias("kept"),
    )
