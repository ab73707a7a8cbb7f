"""Metrics and predictions as the rows a reader sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundledger.functions.text import (
    METRICS,
    correctness,
    metric_label,
    present_metric,
    present_number,
    present_percentage,
)

# Line colours, in series order.
PALETTE = (
    "#E69F00",
    "#56B4E9",
    "#CC79A7",
    "#009E73",
    "#0072B2",
    "#D55E00",
    "#F0E442",
)

# Title formats.
SEASON_TITLE = "Model performance for %d"
ROUND_TITLE = "Predictions for Round %d, %d"


def season_report(metrics: DataFrame) -> DataFrame:
    """(year, position, label, text): four rows per season."""
    long = metrics.select(
        "year", *(F.col(metric).cast("double").alias(metric) for metric in METRICS)
    ).unpivot(["year"], list(METRICS), "metric", "value")
    position = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    return long.select(
        "year",
        position.cast("int").alias("position"),
        metric_label(F.col("metric")).alias("label"),
        present_metric(F.col("metric"), F.col("value"), 2).alias("text"),
    )


def round_report(predictions: DataFrame) -> DataFrame:
    """(year, roundNumber, matchId, winner, margin, probability, correct) as text."""
    return predictions.select(
        "year",
        "roundNumber",
        "matchId",
        F.col("predictedWinnerName").alias("winner"),
        present_number(F.col("predictedMargin"), 2).alias("margin"),
        present_percentage(F.col("predictedWinProbability")).alias("probability"),
        correctness(F.col("isCorrect")).alias("correct"),
    )


def report_titles(latest: DataFrame) -> DataFrame:
    """(year, seasonTitle, roundTitle) for each season and its latest round."""
    return latest.select(
        "year",
        F.format_string(SEASON_TITLE, "year").alias("seasonTitle"),
        F.format_string(ROUND_TITLE, "roundNumber", "year").alias("roundTitle"),
    )


def series_colours(long: DataFrame) -> DataFrame:
    """(year, series, name, colour): a season's models in binary name order.

    Series beyond the palette have no colour.
    """
    models = long.select("year", "name").distinct()
    series = F.row_number().over(Window.partitionBy("year").orderBy("name"))
    colours = F.array(*map(F.lit, PALETTE))
    return models.withColumn("series", series).select(
        "year", "series", "name", F.try_element_at(colours, F.col("series")).alias("colour")
    )


def ranked_models(long: DataFrame, metric: str) -> DataFrame:
    """(year, roundNumber, position, name, value, text), best value first.

    A missing value ranks as zero; equal values follow the name.
    """
    best_first = Window.partitionBy("year", "roundNumber").orderBy(
        F.coalesce("value", F.lit(0.0)).desc(), "name"
    )
    return long.select(
        "year",
        "roundNumber",
        F.row_number().over(best_first).alias("position"),
        "name",
        "value",
        present_metric(F.lit(metric), F.col("value"), 2).alias("text"),
    )
