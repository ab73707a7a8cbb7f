"""Each match's tip, with the margin and the probability models combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundledger.operators.scoring import model_roles

_PICK = ("predictedWinnerId", "isCorrect", "predictedMargin", "predictedWinProbability")


def _first(column: str, among: Column) -> Column:
    """The column's value in the eligible row with the lowest prediction key.

    Keys and values are of fixed width, so this stays a hash aggregate.
    """
    return F.min_by(F.col(column), F.when(among, F.col("id")))


def combine_picks(picks: DataFrame) -> DataFrame:
    """One row per match from predictions flagged ``isPrincipal`` or not.

    The principal model names the winner. What it lacks, the margin or the
    probability, comes from another model and is told from the principal's
    pick: an opposite pick gives a negative margin, or one minus the
    probability. Matches without a principal prediction have no tip.
    """
    principal = F.col("isPrincipal")
    has_margin = ~principal & F.col("predictedMargin").isNotNull()
    has_probability = ~principal & F.col("predictedWinProbability").isNotNull()
    margin, probability = F.col("otherMargin"), F.col("otherProbability")
    combined = picks.groupBy("year", "roundNumber", "matchId").agg(
        *(_first(column, principal).alias(column) for column in _PICK),
        _first("predictedMargin", has_margin).alias("otherMargin"),
        _first("predictedWinnerId", has_margin).alias("marginWinnerId"),
        _first("predictedWinProbability", has_probability).alias("otherProbability"),
        _first("predictedWinnerId", has_probability).alias("probabilityWinnerId"),
    )
    winner = F.col("predictedWinnerId")
    return combined.filter(winner.isNotNull()).select(
        "year",
        "roundNumber",
        "matchId",
        "predictedWinnerId",
        F.coalesce(
            "predictedMargin", F.when(F.col("marginWinnerId") == winner, margin).otherwise(-margin)
        ).alias("predictedMargin"),
        F.coalesce(
            "predictedWinProbability",
            F.when(F.col("probabilityWinnerId") == winner, probability).otherwise(1 - probability),
        ).alias("predictedWinProbability"),
        "isCorrect",
    )


def round_predictions(scored: DataFrame, ml_model_season: DataFrame, team: DataFrame) -> DataFrame:
    """(year, roundNumber, matchId, predictedWinnerName, predictedMargin,
    predictedWinProbability, isCorrect), one row per match with a tip.

    ``scored`` may hold all seasons or one round (``of_round``). A winner
    without a team row keeps a NULL name.
    """
    picks = scored.join(model_roles(ml_model_season), ["seasonId", "mlModelId"])
    teams = team.select(
        F.col("id").alias("predictedWinnerId"), F.col("name").alias("predictedWinnerName")
    )
    return combine_picks(picks).join(teams, "predictedWinnerId", "left").select(
        "year",
        "roundNumber",
        "matchId",
        "predictedWinnerName",
        "predictedMargin",
        "predictedWinProbability",
        "isCorrect",
    )
