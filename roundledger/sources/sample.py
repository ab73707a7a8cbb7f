"""The seven tables derived from order-shaped test data.

Orders stand in for matches, their line items for predictions, nations for
teams and line numbers for models. The mapping gives the shape of the domain
(unplayed matches, draws, missing venues, paired models), not real matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundledger.operators.backfill import seasons_by_models
from roundledger.schemas import Tables
from roundledger.session import configure
from roundledger.sources.tables import conform


def sample_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Derive all seven tables from the parquet files in ``sf_dir``."""
    configure(spark)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders, lineitem = read("orders"), read("lineitem")
    season, ml_model = _season(orders), _ml_model(lineitem)
    match = _match(orders, read("customer"), season)
    return Tables(
        match=conform(match, "match"),
        prediction=conform(_prediction(lineitem, match), "prediction"),
        team_match=conform(_team_match(match), "team_match"),
        season=season,
        team=read("nation").select(
            F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")
        ),
        ml_model=ml_model,
        ml_model_season=_ml_model_season(season, ml_model),
    )


def _season(orders: DataFrame) -> DataFrame:
    # A date's type bounds its distinct years, so one task can number them.
    years = orders.select(F.year("o_orderdate").alias("year")).distinct()
    return years.select(
        F.row_number().over(Window.orderBy("year")).cast("int").alias("id"), "year"
    )


def _ml_model(lineitem: DataFrame) -> DataFrame:
    model_id = F.col("l_linenumber")
    return lineitem.select("l_linenumber").distinct().select(
        model_id.cast("int").alias("id"),
        F.concat(F.lit("model_"), model_id.cast("string")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(False).alias("isPrincipal"),
        F.when(model_id % 2 == 1, "margin").otherwise("win_probability").alias("predictionType"),
        F.lit(False).alias("usedInCompetitions"),
    )


def _ml_model_season(season: DataFrame, ml_model: DataFrame) -> DataFrame:
    principal = F.col("mlModelId") == 1 + 2 * (F.col("year") % 4)
    secondary = F.col("mlModelId") == 2 + 2 * (F.col("year") % 3)
    return seasons_by_models(season, ml_model).select(
        (F.col("seasonId") * 10 + F.col("mlModelId")).cast("int").alias("id"),
        principal.alias("isPrincipal"),
        (principal | secondary).alias("isUsedInCompetitions"),
        "seasonId",
        "mlModelId",
    )


def _match(orders: DataFrame, customer: DataFrame, season: DataFrame) -> DataFrame:
    """Matches, with the two team keys that team rows and predictions need."""
    home = F.col("c_nationkey").cast("int")
    away = ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int")
    unplayed = F.col("o_orderstatus") == "P"
    margin = F.floor(F.col("o_totalprice") / 10000).cast("int")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .withColumn("year", F.year("o_orderdate"))
        .join(season.select(F.col("id").alias("seasonId"), "year"), "year")
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").cast("timestamp").alias("startDateTime"),
            (F.floor((F.dayofyear("o_orderdate") - 1) / 14) + 1).cast("int").alias("roundNumber"),
            F.when(
                F.col("o_orderkey") % 50 != 0,
                F.concat(F.lit("venue_"), (F.col("o_custkey") % 20).cast("string")),
            ).alias("venue"),
            F.when(~unplayed, margin).alias("margin"),
            F.when(~unplayed & (margin != 0), F.when(F.col("o_orderstatus") == "F", home).otherwise(away))
            .alias("winnerId"),
            "seasonId",
            home.alias("homeId"),
            away.alias("awayId"),
        )
    )


def _team_match(match: DataFrame) -> DataFrame:
    """The home and the away row of every played match."""

    def side(at_home: bool, offset: int, team: str):
        won_by = F.when(F.col("winnerId") == F.col(team), F.col("margin")).otherwise(0)
        return F.struct(
            (F.col("id") * 2 + offset).alias("id"),
            F.lit(at_home).alias("atHome"),
            (60 + F.col("id") % 40 + won_by).alias("score"),
            F.col("id").alias("matchId"),
            F.col(team).alias("teamId"),
        )

    played = match.filter(F.col("margin").isNotNull())
    return played.select(F.inline(F.array(side(True, 0, "homeId"), side(False, 1, "awayId"))))


def _prediction(lineitem: DataFrame, match: DataFrame) -> DataFrame:
    # Grouping first leaves at most one row per match and model, so a match
    # with very many line items cannot make the join lopsided.
    picks = lineitem.groupBy(
        F.col("l_orderkey").alias("matchId"), F.col("l_linenumber").alias("mlModelId")
    ).agg(
        F.min("l_quantity").alias("quantity"),
        F.min("l_partkey").alias("part"),
        F.max("l_discount").alias("discount"),
    )
    matches = match.select(
        F.col("id").alias("matchId"), "startDateTime", "margin", "winnerId", "homeId", "awayId"
    )
    winner = F.when(F.col("part") % 3 < 2, F.col("homeId")).otherwise(F.col("awayId"))
    is_margin_model = F.col("mlModelId") % 2 == 1
    return picks.join(matches, "matchId").select(
        (F.col("matchId") * 10 + F.col("mlModelId")).alias("id"),
        F.when(is_margin_model, F.col("quantity")).alias("predictedMargin"),
        "matchId",
        "mlModelId",
        winner.alias("predictedWinnerId"),
        F.when(F.col("margin").isNotNull(), F.coalesce(winner == F.col("winnerId"), F.lit(False)))
        .alias("isCorrect"),
        F.when(~is_margin_model, 0.5 + 4.0 * F.col("discount")).alias("predictedWinProbability"),
        F.col("startDateTime").alias("createdAt"),
        F.col("startDateTime").alias("updatedAt"),
    )
