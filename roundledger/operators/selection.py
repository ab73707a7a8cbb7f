"""Which seasons and rounds there are, and which one to show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundledger.operators.backfill import predicted_matches
from roundledger.operators.scoring import matches_of_seasons
from roundledger.schemas import Tables


# Fixed value: the message when there is no season or round to show.
NOTHING_TO_SHOW = "Required data not found"


def seasons(season: DataFrame) -> DataFrame:
    """Season years, ascending."""
    return season.select("year").orderBy("year")


def predicted_rounds(tables: Tables, year: int | None = None) -> DataFrame:
    """(year, roundNumber) of the rounds with predictions, ascending."""
    matches = matches_of_seasons(tables.match, tables.season, year).select(
        F.col("matchId").alias("id"), "year", "roundNumber"
    )
    return (
        predicted_matches(matches, tables.prediction)
        .select("year", "roundNumber")
        .distinct()
        .orderBy("year", "roundNumber")
    )


def latest_rounds(rounds: DataFrame) -> DataFrame:
    """(year, roundNumber) of each season's last round, the one shown first."""
    return rounds.groupBy("year").agg(F.max("roundNumber").alias("roundNumber"))


def current_value(values: DataFrame, column: str, requested: int | None = None) -> DataFrame:
    """One row: the requested value where it exists, else the largest.

    Fails when there are no values at all.
    """
    value = F.col(column)
    wanted = F.max(F.when(value == requested, value)) if requested is not None else F.lit(None)
    return values.agg(
        F.coalesce(
            wanted, F.max(value), F.raise_error(F.lit(NOTHING_TO_SHOW))
        ).alias(column)
    )
