"""Home and away sides of a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def home_away_pairs(team_match: DataFrame) -> DataFrame:
    """(matchId, homeTeamId, homeScore, awayTeamId, awayScore), one row per match."""
    home, away = F.col("atHome"), ~F.col("atHome")
    return team_match.groupBy("matchId").agg(
        F.max(F.when(home, F.col("teamId"))).alias("homeTeamId"),
        F.max(F.when(home, F.col("score"))).alias("homeScore"),
        F.max(F.when(away, F.col("teamId"))).alias("awayTeamId"),
        F.max(F.when(away, F.col("score"))).alias("awayScore"),
    )
