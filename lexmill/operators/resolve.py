"""Entity resolution by Jaro-Winkler similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import normal_name
from ..session import ship, stored

# Thresholds of a merge and of a review.
MERGE, REVIEW = 0.92, 0.85
#: Tasks over which the pairs of one type are dealt.
PARTS = 16


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    ours = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                ours.append(c)
                break
    if not ours:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(ours, theirs)) / 2
    m = len(ours)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def letters(name: Column) -> Column:
    """The characters of a name, each with its count so far, so that common ones can be counted as a set."""
    ordered = F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))
    return F.transform(ordered, lambda c, i: F.concat(c, (i + 1 - F.array_position(ordered, c)).cast("string")))


def reachable(matches: Column) -> Column:
    """Whether so many matching characters of names a and b can reach ``REVIEW``.

    Jaro is at most (m/|a| + m/|b| + 1) / 3 for m matches, and l equal first characters (4 at most) raise j to
    j + l/10 (1 - j).
    """
    same = sum((F.expr(f"int(left(a.name, {n}) = left(b.name, {n}) and least(length(a.name), length(b.name)) >= {n})") for n in (1, 2, 3, 4)), F.lit(0))
    jaro = (F.lit(REVIEW) - same * 0.1) / (F.lit(1.0) - same * 0.1)
    return matches / F.length("a.name") + matches / F.length("b.name") + 1 >= jaro * 3 - 1e-9


def candidate_pairs(entities: DataFrame) -> DataFrame:
    """Distinct normal names of one type whose similarity is ``REVIEW`` or more, with it and the action.

    All pairs of a type are compared, as no key is shared by every similar pair; those whose lengths and common
    characters cannot reach ``REVIEW`` are not scored. A type's pairs are dealt over ``PARTS`` tasks. Names are
    distinct before the join, so that repeats cannot multiply.
    """
    ship(entities.sparkSession)
    similarity = pandas_udf(similarities, "double")
    names = (
        entities.select("type", normal_name(F.col("name")).alias("name"))
        .filter(F.length("name") >= 3)
        .distinct()
        .withColumn("letters", letters(F.col("name")))
    )
    ours = names.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int")).alias("a")
    theirs = names.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).alias("b")
    pairs = (
        ours.join(theirs, ["type", "part"])
        .filter("a.name < b.name")
        .filter(reachable(F.least(F.length("a.name"), F.length("b.name"))))
        .filter(reachable(F.size(F.array_intersect("a.letters", "b.letters"))))
    )
    scored = pairs.select("type", F.col("a.name").alias("left"), F.col("b.name").alias("right"), similarity("a.name", "b.name").alias("score"))
    return scored.filter(F.col("score") >= REVIEW).select("type", "left", "right", F.round("score", 4).alias("score"), F.when(F.col("score") >= MERGE, "merge").otherwise("review").alias("action"))


def resolved(entities: DataFrame) -> DataFrame:
    """(left_id, right_id, canonical_id, score, action) of ``entities(pos, id, type, name)``, as a pass in order finds them.

    In order of ``pos``, an entity that none before has absorbed is compared with those behind it that are not absorbed
    either. At ``MERGE`` or more the one with the shorter name is absorbed (of equals the later; the longer name is
    canonical), at ``REVIEW`` or more the pair is for review. Types are not mixed; names of fewer than three characters
    after normalisation are left out. Equal positions are told apart by id; nulls in type or name are left out.

    Entities of one type, normal name and length behave alike: whether the first of them is absorbed decides for all, so
    it stands for its class, and repeats make no pairs. A class settles when all earlier classes that could absorb it
    have; each round settles at least the first open one, and mostly all whose rivals are settled.
    """
    size = F.length("name")
    rows = stored(
        entities.filter("type is not null and name is not null")
        .select(F.struct("pos", F.col("id").cast("string").alias("id")).alias("at"), "type", size.alias("size"), normal_name(F.col("name")).alias("normal"))
        .filter(F.length("normal") >= 3)
    )
    classes = stored(rows.groupBy("type", "normal", "size").agg(F.min("at").alias("at")).withColumn("class", F.xxhash64("type", "normal", "size", "at.id")))
    similar = candidate_pairs(rows.select("type", F.col("normal").alias("name")))
    one_way = similar.select("type", "left", "right", "score", "action")
    same = classes.select("type", F.col("normal").alias("left"), F.col("normal").alias("right"), F.lit(1.0).alias("score"), F.lit("merge").alias("action")).distinct()
    linked = stored(one_way.unionByName(one_way.select("type", F.col("right").alias("left"), F.col("left").alias("right"), "score", "action")).unionByName(same))
    named = lambda side, *more: classes.select("type", F.col("normal").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("class", "at", "size")), *more)
    pairs = stored(linked.join(named("left"), ["type", "left"]).join(named("right"), ["type", "right"]).filter("left_class <> right_class"))
    absorbs = stored(pairs.filter("action = 'merge' and left_at < right_at and left_size >= right_size").select(F.col("left_class").alias("rival"), F.col("right_class").alias("class")))
    state = stored(classes.select("class", F.when(F.lit(False), True).alias("acts")))  # null while open
    while True:
        rivals = absorbs.join(state.select(F.col("class").alias("rival"), "acts"), "rival").groupBy("class")
        seen = rivals.agg(F.bool_or("acts").alias("absorbed"), F.count_if(F.col("acts").isNull()).alias("open"))
        settled = F.when(F.col("absorbed"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        after = stored(state.join(seen, "class", "left").select("class", F.coalesce("acts", settled).alias("acts"), (F.col("acts").isNull() & settled.isNull()).alias("left_open")))
        state = after.select("class", "acts")
        if after.filter("left_open").isEmpty():
            break
    acting = stored(state.filter("acts").select("class"))
    # Where the first acting entity that absorbs a class stands; what comes before sees all of the class.
    actors = classes.join(acting, "class")
    takers = (
        linked.filter("action = 'merge'")
        .join(actors.select("type", F.col("normal").alias("left"), F.col("at").alias("taker"), F.col("size").alias("taker_size"), F.col("class").alias("taker_class")), ["type", "left"])
        .join(classes.select("type", F.col("normal").alias("right"), "size", "class", "at"), ["type", "right"])
        .filter("taker_size >= size and (taker < at or taker_class = class)")
        .groupBy("class")
        .agg(F.min("taker").alias("taker"))
    )
    taken = rows.join(classes.drop("at"), ["type", "normal", "size"]).join(takers, "class", "left")
    met = (
        linked.join(actors.select("type", F.col("normal").alias("left"), F.col("at").alias("left_at"), F.col("size").alias("left_size")), ["type", "left"])
        .join(taken.select("type", F.col("normal").alias("right"), F.col("at").alias("right_at"), F.col("size").alias("right_size"), "taker"), ["type", "right"])
        # An absorbed entity is still met by those that come before what absorbs it, and by that itself.
        .filter("left_at < right_at and (taker is null or taker >= left_at or taker >= right_at)")
    )
    keeps_left = F.col("left_size") >= F.col("right_size")
    return met.select(
        F.col("left_at.id").alias("left_id"),
        F.col("right_at.id").alias("right_id"),
        F.when(F.col("action") == "merge", F.when(keeps_left, F.col("left_at.id")).otherwise(F.col("right_at.id"))).alias("canonical_id"),
        "score",
        "action",
    )
