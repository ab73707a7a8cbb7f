"""Joining predictions to results, and scoring each one once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundledger.functions.scores import (
    absolute_error,
    information_bits,
    recomputed_correctness,
    tip,
)
from roundledger.schemas import Tables


def matches_of_seasons(match: DataFrame, season: DataFrame, year: int | None = None) -> DataFrame:
    """Matches that belong to a season (optionally of one year), with its year.

    Stored matches are partitioned by season, so a filter on the small season
    side prunes files through the join.
    """
    seasons = season.select(F.col("id").alias("seasonId"), "year")
    if year is not None:
        seasons = seasons.filter(F.col("year") == year)
    return match.withColumnRenamed("id", "matchId").join(seasons, "seasonId")


def score_predictions(tables: Tables, year: int | None = None) -> DataFrame:
    """One row per prediction of a season's match, with its three scores.

    This holds the only join between the two large tables. Every metric and
    report is an aggregate of this result, so it pays to store it
    (``save_scored``) when several are needed. Predictions stored by season
    (``sources.league``) are read from the folders of the seasons wanted only.
    """
    matches = matches_of_seasons(tables.match, tables.season, year).select(
        "matchId", "year", "seasonId", "roundNumber", "margin", "winnerId"
    )
    prediction, keys = tables.prediction, ["matchId"]
    if "seasonId" in prediction.columns:
        wanted = tables.season if year is None else tables.season.filter(F.col("year") == year)
        seasons = wanted.select(F.col("id").alias("seasonId"))
        prediction, keys = prediction.join(seasons, "seasonId", "left_semi"), ["matchId", "seasonId"]
    return prediction.join(matches, keys).select(
        "year",
        "seasonId",
        "roundNumber",
        "matchId",
        "id",
        "mlModelId",
        "predictedWinnerId",
        "predictedMargin",
        "predictedWinProbability",
        "isCorrect",
        tip().alias("tip"),
        absolute_error().alias("absError"),
        information_bits().alias("bits"),
    )


def of_round(scored: DataFrame, year: int | None = None, round_number: int | None = None) -> DataFrame:
    """Scored predictions of one year, or of one of its rounds.

    The conditions move down to the files: year and round are plain columns.
    """
    if year is not None:
        scored = scored.filter(F.col("year") == year)
    if round_number is not None:
        scored = scored.filter(F.col("roundNumber") == round_number)
    return scored


def recompute_correctness(tables: Tables, draws_count: bool = False) -> DataFrame:
    """Predictions with ``isCorrect`` worked out from the results, NULL without a match."""
    results = tables.match.select(F.col("id").alias("matchId"), "margin", "winnerId")
    return (
        tables.prediction.join(results, "matchId", "left")
        .withColumn("isCorrect", recomputed_correctness(draws_count))
        .select(*tables.prediction.columns)
    )


def model_roles(ml_model_season: DataFrame) -> DataFrame:
    """Models in use per season: (seasonId, mlModelId, isPrincipal, isUsedInCompetitions).

    Should a season name several principals, the one with the lowest key counts.
    """
    flags = ml_model_season.groupBy("seasonId", "mlModelId").agg(
        F.bool_or("isPrincipal").alias("named"),
        F.bool_or("isUsedInCompetitions").alias("isUsedInCompetitions"),
    )
    first = F.min(F.when(F.col("named"), F.col("mlModelId"))).over(Window.partitionBy("seasonId"))
    return flags.select(
        "seasonId",
        "mlModelId",
        F.coalesce(F.col("mlModelId") == first, F.lit(False)).alias("isPrincipal"),
        "isUsedInCompetitions",
    ).filter(F.col("isPrincipal") | F.col("isUsedInCompetitions"))
