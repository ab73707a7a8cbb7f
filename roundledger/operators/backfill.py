"""Seasons and per-season model flags derived from what was predicted."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundledger.operators.keys import pair_keys
from roundledger.schemas import Tables


# Tasks the pairs of seasons and models are spread over.
PAIR_SALTS = 64


class Backfill(NamedTuple):
    season: DataFrame
    match: DataFrame
    ml_model_season: DataFrame


def predicted_matches(match: DataFrame, prediction: DataFrame) -> DataFrame:
    """Matches with at least one prediction.

    The predicted keys are made distinct first: that collapses a match with
    very many predictions before the shuffle, and the join reuses the layout.
    """
    keys = prediction.select(F.col("matchId").alias("id")).distinct()
    return match.join(keys, "id", "left_semi")


def predicted_years(match: DataFrame, prediction: DataFrame) -> DataFrame:
    """Years (UTC) of the matches with predictions, ascending."""
    return (
        predicted_matches(match, prediction)
        .select(F.year("startDateTime").alias("year"))
        .distinct()
        .orderBy("year")
    )


def add_seasons(season: DataFrame, years: DataFrame) -> DataFrame:
    """Existing seasons plus one for every further year, keyed after the last."""
    new = years.select("year").distinct().join(season, "year", "left_anti")
    last = season.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    # A timestamp's type has fewer than 600,000 years, so one task can number them.
    numbered = new.select(
        (F.row_number().over(Window.orderBy("year")) + last).cast("int").alias("id"), "year"
    )
    return season.select("id", "year").unionByName(numbered)


def assign_seasons(match: DataFrame, season: DataFrame) -> DataFrame:
    """Give each match the season of its UTC year; others keep what they have.

    Equal years stand for "season start <= start time < next season start",
    which turns an interval join into a hash join.
    """
    by_year = season.groupBy("year").agg(F.min("id").alias("newSeasonId"))
    columns = [F.col(c) for c in match.columns if c != "seasonId"]
    return (
        match.withColumn("year", F.year("startDateTime"))
        .join(by_year, "year", "left")
        .select(*columns, F.coalesce("newSeasonId", "seasonId").alias("seasonId"))
        .select(*match.columns)
    )


def seasons_by_models(season: DataFrame, ml_model: DataFrame) -> DataFrame:
    """Every season with every model: the pairs the flags table must hold.

    Models are dealt over salts and seasons repeated for each, so that the
    pairs come out of an equal-key join over many tasks, whatever the numbers
    of seasons and models.
    """
    seasons = (
        season.groupBy("year")
        .agg(F.min("id").alias("seasonId"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))))
    )
    models = ml_model.select(
        F.col("id").alias("mlModelId"), "name", F.pmod("id", F.lit(PAIR_SALTS)).alias("salt")
    )
    return models.join(seasons, "salt").select("seasonId", "year", "mlModelId", "name")


def add_model_seasons(
    ml_model_season: DataFrame, season: DataFrame, ml_model: DataFrame, usage: DataFrame
) -> DataFrame:
    """Existing flag rows plus one for every missing pair of season and model.

    ``usage`` (name, year, isPrincipal, isUsedInCompetitions) lists the models
    in use; pairs it does not name get false for both flags.
    """
    flags = usage.groupBy("name", "year").agg(
        F.bool_or("isPrincipal").alias("isPrincipal"),
        F.bool_or("isUsedInCompetitions").alias("isUsedInCompetitions"),
    )
    missing = seasons_by_models(season, ml_model).join(
        ml_model_season, ["seasonId", "mlModelId"], "left_anti"
    )
    rows = missing.join(flags, ["name", "year"], "left").select(
        pair_keys("seasonId", "mlModelId", ml_model_season, ml_model).cast("int").alias("id"),
        F.coalesce("isPrincipal", F.lit(False)).alias("isPrincipal"),
        F.coalesce("isUsedInCompetitions", F.lit(False)).alias("isUsedInCompetitions"),
        "seasonId",
        "mlModelId",
    )
    return ml_model_season.select(*rows.columns).unionByName(rows)


def backfill_seasons(tables: Tables, usage: DataFrame) -> Backfill:
    """The three tables after a backfill; a second run changes nothing.

    ``plans.jobs.backfill_job`` stores the seasons first, so that the join of
    the two facts is not repeated for each of the three results.
    """
    season = add_seasons(tables.season, predicted_years(tables.match, tables.prediction))
    return backfill_from(tables, season, usage)


def backfill_from(tables: Tables, season: DataFrame, usage: DataFrame) -> Backfill:
    """The three tables once the seasons are known."""
    return Backfill(
        season=season,
        match=assign_seasons(tables.match, season),
        ml_model_season=add_model_seasons(
            tables.ml_model_season, season, tables.ml_model, usage
        ),
    )
