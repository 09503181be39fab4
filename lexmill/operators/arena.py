"""Pairwise votes: leaderboard and ELO ratings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Rating step and start.
K_FACTOR, START = 32.0, 1200.0


def votes(events: DataFrame) -> DataFrame:
    """Events read as votes: two strategies of five by user and event, the winner by value."""
    names = F.array(*[F.lit(f"s{i}") for i in range(5)])
    return events.select(
        F.col("event_id").alias("match_id"),
        "ts",
        F.get(names, (F.col("user_id") % 5).cast("int")).alias("strategy_a"),
        F.get(names, (F.col("event_id") % 5).cast("int")).alias("strategy_b"),
        F.when(F.col("value") < 20, "a").when(F.col("value") < 40, "b").otherwise("tie").alias("winner"),
    ).filter("strategy_a <> strategy_b")


def leaderboard(matches: DataFrame) -> DataFrame:
    sides = matches.select(
        F.explode(
            F.array(
                F.struct(F.col("strategy_a").alias("strategy"), F.when(F.col("winner") == "a", "win").when(F.col("winner") == "b", "loss").otherwise("tie").alias("outcome")),
                F.struct(F.col("strategy_b").alias("strategy"), F.when(F.col("winner") == "b", "win").when(F.col("winner") == "a", "loss").otherwise("tie").alias("outcome")),
            )
        ).alias("side")
    ).select("side.*")
    return sides.groupBy("strategy").agg(
        F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"), F.count_if(F.col("outcome") == "tie").alias("ties")
    )


def rate(rating: dict[str, float], a: str, b: str, winner: str) -> None:
    """One vote, in place."""
    ra, rb = rating.get(a, START), rating.get(b, START)
    expected = 1 / (1 + 10 ** ((rb - ra) / 400))
    score = {"a": 1.0, "b": 0.0}.get(winner, 0.5)
    rating[a], rating[b] = ra + K_FACTOR * (score - expected), rb - K_FACTOR * (score - expected)


def elo(matches: DataFrame) -> DataFrame:
    """Ratings after all votes in order of (ts, match_id).

    Every vote depends on all before it, so the fold is one task by nature; votes stream through it in order
    and only the ratings are held.
    """
    import pyarrow as pa

    ship(matches.sparkSession)

    def fold(batches):
        rating: dict[str, float] = {}
        for batch in batches:
            for a, b, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rate(rating, a, b, w)
        yield pa.RecordBatch.from_arrays([pa.array(list(rating), pa.string()), pa.array([round(x, 6) for x in rating.values()], pa.float64())], ["strategy", "rating"])

    ordered = matches.repartition(1).sortWithinPartitions("ts", "match_id").select("strategy_a", "strategy_b", "winner")
    return ordered.mapInArrow(fold, "strategy string, rating double")


# Characters of a stored answer and of a logged question, matches that a state keeps.
STATE_ANSWER, LOG_QUESTION, STATE_MATCHES = 500, 200, 200


def save_state(matches: DataFrame, ratings: DataFrame, path: str) -> None:
    """Ratings and the latest 200 matches (match_id, question, strategies, answers, winner, ts), answers cut."""
    cut = matches.withColumns({c: F.left(c, F.lit(STATE_ANSWER)) for c in ("answer_a", "answer_b")})
    cut.orderBy(F.desc("ts"), F.desc("match_id")).limit(STATE_MATCHES).write.mode("overwrite").parquet(f"{path}/matches")
    ratings.write.mode("overwrite").parquet(f"{path}/ratings")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Matches and ratings as stored; None, which means to start anew, where there is no whole state."""
    try:
        return spark.read.parquet(f"{path}/matches"), spark.read.parquet(f"{path}/ratings")
    except AnalysisException:
        return None


def append_votes(matches: DataFrame, ratings: DataFrame, path: str) -> None:
    """Log voted matches as JSON lines with the ratings of the time; the log outlives the state."""
    shown = ratings.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", F.round("rating", 1).alias("rating"))))).alias("elo_snapshot"))  # a row for each strategy
    voted = matches.filter(F.col("winner").isin("a", "b", "tie"))
    logged = voted.select("match_id", F.left("question", F.lit(LOG_QUESTION)).alias("question"), "strategy_a", "strategy_b", "winner", "ts")
    logged.crossJoin(F.broadcast(shown)).write.mode("append").json(path)
