"""Statistics of guessing games from a table of rounds.

Rounds have game_id, map, mode, finished_at, at (the place in the game, which tells its rounds apart), score, truth and
guessed (places to be told apart, null where not known) and streak_mode ('off': no streaks). Other columns are ignored. A game
without rounds isn't there; a null map or mode is one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import streaks

PERFECT = 5000.0


def games(rounds: DataFrame) -> DataFrame:
    """(game_id, map, mode, finished_at, rounds, score): one row a game."""
    return rounds.groupBy("game_id", "map", "mode", "finished_at").agg(F.count(F.lit(1)).alias("rounds"), F.sum("score").alias("score"))


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("games"),
        F.sum("rounds").alias("rounds"),
        (F.sum("score") / F.sum("rounds")).alias("average_score"),
        F.max("score").alias("best_game"),
    ]


def by(played: DataFrame, key: str) -> DataFrame:
    """(key, games, rounds, average_score, best_game), by map or mode, most played first."""
    return played.groupBy(key).agg(*_sums()).orderBy(F.desc("games"), key)


def overall(rounds: DataFrame) -> DataFrame:
    """One row: the sums over all games, the rounds of full score, and the longest run of hits inside one game (null if no game counts).

    A game counts for the run if its streak mode is on and the true place of all its rounds is known.
    """
    sums = games(rounds).agg(*_sums())
    perfect = rounds.agg(F.count_if(F.col("score") == PERFECT).alias("perfect_rounds"))
    counted = rounds.groupBy("game_id").agg((F.bool_and(F.col("truth").isNotNull()) & F.bool_and(F.col("streak_mode") != "off")).alias("counts")).filter("counts")
    runs = streaks(rounds.join(counted, "game_id", "left_semi"), "game_id", "at", F.col("truth") == F.col("guessed")).agg(F.max("best").alias("run"))
    some = counted.agg((F.count(F.lit(1)) > 0).alias("some"))
    one = sums.join(F.broadcast(perfect), F.lit(True)).join(F.broadcast(runs), F.lit(True)).join(F.broadcast(some), F.lit(True))
    return one.select(*sums.columns, "perfect_rounds", F.when(F.col("some"), F.coalesce("run", F.lit(0))).alias("best_streak"))


def countries(rounds: DataFrame) -> DataFrame:
    """(country, rounds, hits, average_score) of rounds whose true place is known."""
    known = rounds.filter(F.col("truth").isNotNull())
    hits = F.count_if(F.col("truth") == F.col("guessed"))
    return known.groupBy(F.col("truth").alias("country")).agg(F.count(F.lit(1)).alias("rounds"), hits.alias("hits"), F.avg("score").alias("average_score"))


def trend(played: DataFrame) -> DataFrame:
    """(game_id, finished_at, map, average_score) in the order of play."""
    return played.select("game_id", "finished_at", "map", (F.col("score") / F.col("rounds")).alias("average_score")).orderBy("finished_at", "game_id")
