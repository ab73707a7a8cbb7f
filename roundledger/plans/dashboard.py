"""The three requests a reader makes, each as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundledger.functions.text import METRICS, finite, parse_integer_prefix
from roundledger.operators.metrics import (
    map_models,
    pivot_models,
    round_metrics,
    round_totals,
    season_summaries,
    season_summary,
)
from roundledger.operators.predictions import round_predictions
from roundledger.operators.scoring import of_round, score_predictions
from roundledger.operators.selection import current_value
from roundledger.schemas import Tables


def dashboard_document(
    tables: Tables, season_text: str | None = None, scored: DataFrame | None = None
) -> DataFrame:
    """One row, one JSON ``document``: round numbers and metrics of the current
    season, its year, and all season years.

    The year asked for is used where it exists, else the latest one. Rounds and
    metrics come out of the same pass over the season's predictions, which are
    read from ``scored`` where that is stored.
    """
    current = current_value(tables.season, "year", parse_integer_prefix(season_text))
    # A global aggregate has one row, so both broadcasts have a fixed bound.
    if scored is None:
        chosen = tables.season.join(F.broadcast(current), "year").select("id", "year")
        predictions = score_predictions(tables.swap(season=chosen))
    else:
        predictions = scored.join(F.broadcast(current), "year")
    summary = season_summary(round_totals(predictions), tables.ml_model_season)
    years = tables.season.agg(F.sort_array(F.collect_set("year")).alias("seasonYears"))
    metrics = F.struct(
        *(finite(F.col(f"metrics.{metric}")).alias(metric) for metric in METRICS)
    )
    document = F.struct(
        "roundNumbers",
        metrics.alias("metrics"),
        current.scalar().alias("currentSeasonYear"),
        years.scalar().alias("seasonYears"),
    )
    return summary.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def season_documents(
    totals: DataFrame,
    season: DataFrame,
    ml_model_season: DataFrame,
    all_seasons: DataFrame | None = None,
) -> DataFrame:
    """(year, document): the ``dashboard_document`` of every row of ``season``.

    ``totals`` are ``round_totals``; one aggregate of them gives all documents.
    ``all_seasons`` is what the documents list, ``season`` if not given.
    """
    listed = season if all_seasons is None else all_seasons
    years = listed.agg(F.sort_array(F.collect_set("year")).alias("seasonYears"))
    metrics = F.struct(
        *(finite(F.col(f"metrics.{metric}")).alias(metric) for metric in METRICS)
    )
    document = F.struct(
        "roundNumbers",
        metrics.alias("metrics"),
        F.col("year").alias("currentSeasonYear"),
        years.scalar().alias("seasonYears"),
    )
    return season_summaries(totals, season, ml_model_season).select(
        "year", F.to_json(document, {"ignoreNullFields": "false"}).alias("document")
    )


def metric_series(
    tables: Tables,
    season_text: str | None,
    metric: str | None,
    cumulative: bool = True,
    scored: DataFrame | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """A season's rounds, ascending, each with the values of all models.

    They come as ``series``, a map by model name; with ``names`` given as one
    column for each of those. A missing season or an unknown metric gives no
    rows; so does a season text without a number.
    """
    year = parse_integer_prefix(season_text)
    wanted = year is not None and metric in METRICS
    if scored is not None:
        predictions = of_round(scored, year)
    else:
        predictions = score_predictions(tables, year)
    long = round_metrics(
        round_totals(predictions), tables.ml_model, metric if wanted else METRICS[0], cumulative
    )
    index = ("roundNumber",)
    rounds = map_models(long, index) if names is None else pivot_models(long, names, index)
    return rounds.orderBy("roundNumber") if wanted else rounds.limit(0)


def prediction_list(
    tables: Tables,
    season_text: str | None,
    round_text: str | None,
    scored: DataFrame | None = None,
) -> DataFrame:
    """A round's tips in match order; no rows for a missing or unreadable parameter."""
    year, round_number = parse_integer_prefix(season_text), parse_integer_prefix(round_text)
    predictions = scored if scored is not None else score_predictions(tables, year)
    in_round = of_round(predictions, year, round_number)
    tips = round_predictions(in_round, tables.ml_model_season, tables.team).orderBy("matchId").select(
        "predictedWinnerName", "predictedMargin", "predictedWinProbability", "isCorrect"
    )
    return tips.limit(0) if year is None or round_number is None else tips
