"""The four metrics by season, and by round and model.

Each scored prediction is folded once into totals per model and season or
round; flags, names and running values are worked out on those few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundledger.functions.text import METRICS
from roundledger.operators.scoring import model_roles

_SCORES = {"tip": "Tip", "absError": "AbsError", "bits": "Bits"}


def round_totals(scored: DataFrame) -> DataFrame:
    """Sums and counts of the scores per season, round and model.

    This is the one pass over scored predictions; all metrics start from it.
    """
    return _totals(scored, "year", "seasonId", "roundNumber", "mlModelId")


def _totals(scored: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(score).alias(f"sum{name}") for score, name in _SCORES.items()]
    counts = [F.count(score).alias(f"n{name}") for score, name in _SCORES.items()]
    return scored.groupBy(*keys).agg(*sums, *counts)


def _metrics_from(total: Callable[[str], Column]) -> list[Column]:
    """Metrics from totals; ``total`` gives the column of a named total."""

    def mean(name: str) -> Column:
        return F.try_divide(total(f"sum{name}").cast("double"), total(f"n{name}"))

    return [
        total("sumTip").alias("totalTips"),
        mean("Tip").alias("accuracy"),
        mean("AbsError").alias("mae"),
        total("sumBits").alias("bits"),
    ]


def _total_in_use(name: str) -> Column:
    """Tips count for the principal model, error and bits for models in competitions."""
    role = "isPrincipal" if name.endswith("Tip") else "isUsedInCompetitions"
    return F.sum(F.when(F.col(role), F.col(name)))


def season_metrics(scored: DataFrame, season: DataFrame, ml_model_season: DataFrame) -> DataFrame:
    """(year, totalTips, accuracy, mae, bits), one row per season.

    Tips and accuracy are those of the season's principal model; error and
    bits cover the models used in competitions. A metric without any scored
    prediction is NULL.
    """
    by_model = _totals(scored, "seasonId", "mlModelId")
    in_use = by_model.join(model_roles(ml_model_season), ["seasonId", "mlModelId"])
    by_season = in_use.groupBy("seasonId").agg(*_metrics_from(_total_in_use))
    seasons = season.select(F.col("id").alias("seasonId"), "year")
    return seasons.join(by_season, "seasonId", "left").select("year", *METRICS)


def season_summary(totals: DataFrame, ml_model_season: DataFrame) -> DataFrame:
    """One row for the ``round_totals`` of one season: ``roundNumbers``, ``metrics``."""
    roles = model_roles(ml_model_season)
    return (
        totals.join(roles, ["seasonId", "mlModelId"], "left")
        .agg(
            F.sort_array(F.collect_set("roundNumber")).alias("roundNumbers"),
            *_metrics_from(_total_in_use),
        )
        .select("roundNumbers", F.struct(*METRICS).alias("metrics"))
    )


def season_summaries(totals: DataFrame, season: DataFrame, ml_model_season: DataFrame) -> DataFrame:
    """(year, roundNumbers, metrics) of every season, from one pass over ``round_totals``.

    A season without predictions has an empty list and NULL metrics.
    """
    by_season = (
        totals.join(model_roles(ml_model_season), ["seasonId", "mlModelId"], "left")
        .groupBy("seasonId")
        .agg(
            F.sort_array(F.collect_set("roundNumber")).alias("roundNumbers"),
            *_metrics_from(_total_in_use),
        )
    )
    return (
        season.select(F.col("id").alias("seasonId"), "year")
        .join(by_season, "seasonId", "left")
        .select(
            "year",
            F.coalesce("roundNumbers", F.array().cast("array<int>")).alias("roundNumbers"),
            F.struct(*METRICS).alias("metrics"),
        )
    )


def round_scores(totals: DataFrame, ml_model: DataFrame, cumulative: bool = True) -> DataFrame:
    """(year, roundNumber, name, totalTips, accuracy, mae, bits) per round and model.

    Cumulative values run from the first round of the season; averages divide
    running sums by running counts. Scores of a model without a row keep a NULL
    name; the broken reference is a check's to report.
    """
    total = F.col
    if cumulative:
        to_date = (
            Window.partitionBy("year", "mlModelId")
            .orderBy("roundNumber")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

        def total(name: str) -> Column:
            return F.sum(name).over(to_date)

    names = ml_model.select(F.col("id").alias("mlModelId"), "name")
    return (
        totals.select("year", "roundNumber", "mlModelId", *_metrics_from(total))
        .join(names, "mlModelId", "left")
        .select("year", "roundNumber", "name", *METRICS)
    )


def round_metrics(
    totals: DataFrame, ml_model: DataFrame, metric: str, cumulative: bool = True
) -> DataFrame:
    """(year, roundNumber, name, value) of one metric, from ``round_totals``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return round_scores(totals, ml_model, cumulative).select(
        "year", "roundNumber", "name", F.col(metric).cast("double").alias("value")
    )


def model_names(ml_model: DataFrame) -> list[str]:
    """Names in binary order, to become columns: a job that reads the models.

    ``map_models`` needs no names and suits any number of models.
    """
    return [row.name for row in ml_model.select("name").distinct().orderBy("name").collect()]


def map_models(long: DataFrame, index: Sequence[str] = ("year", "roundNumber")) -> DataFrame:
    """One row per round with ``series``, a map from each model's name to its value.

    A row gathers one value per model of its round.
    """
    pairs = F.sort_array(F.collect_list(F.struct("name", "value")))
    named = long.filter(F.col("name").isNotNull()).groupBy(*index, "name").agg(
        F.max("value").alias("value")
    )
    return named.groupBy(*index).agg(F.map_from_entries(pairs).alias("series"))


def pivot_models(
    long: DataFrame, names: Sequence[str], index: Sequence[str] = ("year", "roundNumber")
) -> DataFrame:
    """One row per round, one column per name; NULL where a model has no row."""
    return long.groupBy(*index).pivot("name", list(names)).agg(F.max("value"))


def unpivot_models(
    wide: DataFrame, names: Sequence[str], index: Sequence[str] = ("year", "roundNumber")
) -> DataFrame:
    """Back to one row per round and model."""
    return wide.unpivot(list(index), [f"`{name}`" for name in names], "name", "value")
