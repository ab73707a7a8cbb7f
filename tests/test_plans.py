"""The physical plans: what is read, shuffled and broadcast, and how skew is met."""

import re

import pytest
from pyspark.sql import functions as F

from roundledger.functions.text import within_year
from roundledger.operators import backfill, metrics, predictions, quality, scoring
from roundledger.sources import store
from roundledger.sources.sample import sample_tables
from roundledger.sources.tables import load_tables
from tests.tiny import NOW, at, tiny_tables

SAMPLE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sample"))
    store.save_tables(sample_tables(spark, SAMPLE), root)
    tables = load_tables(spark, root)
    store.save_scored(scoring.score_predictions(tables), f"{root}/Scored")
    return tables, root


@pytest.fixture
def no_broadcast(spark):
    """Tables far beyond the broadcast threshold, in miniature."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def test_one_join_of_facts(spark, stored, no_broadcast):
    tables, _ = stored
    scored = scoring.score_predictions(tables)
    text = plan(metrics.round_scores(metrics.round_totals(scored), tables.ml_model))
    by_match = re.findall(r"Exchange hashpartitioning\((?:matchId|id)#\d+L, 8\)", text)
    assert len(by_match) == 2


def test_season_filter_prunes_stored_matches(spark, stored):
    tables, _ = stored
    text = plan(scoring.score_predictions(tables, 1999))
    assert "dynamicpruning" in text


def test_round_filter_reaches_the_files(spark, stored):
    tables, root = stored
    scored = store.load_scored(spark, f"{root}/Scored")
    one_round = scoring.of_round(scored, 1999, 5)
    text = plan(predictions.round_predictions(one_round, tables.ml_model_season, tables.team))
    assert re.search(r"PartitionFilters: \[[^]]*year#\d+ = 1999", text)
    assert "EqualTo(roundNumber,5)" in text
    assert "absError" not in text
    text = plan(scoring.of_round(scoring.score_predictions(tables), 1999, 5))
    assert "EqualTo(roundNumber,5)" in text


def test_year_range_reaches_the_files(stored):
    tables, _ = stored
    text = plan(tables.match.filter(within_year(F.col("startDateTime"), 1999)).select("id"))
    assert "GreaterThanOrEqual(startDateTime" in text and "LessThan(startDateTime" in text


def test_only_needed_columns_are_read(stored):
    tables, _ = stored
    text = plan(backfill.predicted_years(tables.match, tables.prediction))
    assert "ReadSchema: struct<matchId:bigint>" in text
    assert "ReadSchema: struct<id:bigint,startDateTime:timestamp>" in text


def test_nothing_else_is_forced_to_broadcast(stored, no_broadcast):
    tables, _ = stored
    scored = scoring.score_predictions(tables)
    for result in (
        metrics.season_metrics(scored, tables.season, tables.ml_model_season),
        predictions.round_predictions(scored, tables.ml_model_season, tables.team),
        quality.orphan_references(tables),
    ):
        assert "Broadcast" not in plan(result)


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all predictions belong to one match."""
    t = tiny_tables(
        spark,
        match=[(n, at(2020, 3, 1), 1 + n % 20, None, n % 50, 1 + n % 2 if n % 50 else None, 1)
               for n in range(2000)],
    )
    n = F.col("n")
    rows = spark.range(200_000, numPartitions=16).select(F.col("id").alias("n")).select(
        n.alias("id"),
        F.when(n % 4 == 0, (n % 40).cast("double")).alias("predictedMargin"),
        F.when(n % 2 == 0, 7).otherwise((n * 7) % 2000).cast("bigint").alias("matchId"),
        F.when(n % 4 == 0, 1).otherwise(2).alias("mlModelId"),
        (1 + n % 3).cast("int").alias("predictedWinnerId"),
        (n % 3 == 0).alias("isCorrect"),
        F.when(n % 4 != 0, 0.25 + (n % 3) / 8).alias("predictedWinProbability"),
        F.lit(NOW).alias("createdAt"),
        F.lit(NOW).alias("updatedAt"),
    )
    return t.swap(prediction=rows)


@pytest.fixture
def eager_skew(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def reports(tables):
    scored = scoring.score_predictions(tables)
    return {
        "season": metrics.season_metrics(scored, tables.season, tables.ml_model_season),
        "rounds": metrics.round_scores(metrics.round_totals(scored), tables.ml_model),
        "tips": predictions.round_predictions(scored, tables.ml_model_season, tables.team),
    }


def approximately(rows):
    return sorted(
        [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows], key=repr
    )


@pytest.fixture(scope="module")
def plain_reports(skewed):
    return {name: approximately(df.collect()) for name, df in reports(skewed).items()}


@pytest.mark.parametrize("name", ["season", "rounds", "tips"])
def test_a_hot_match_is_split(skewed, plain_reports, eager_skew, name):
    result = reports(skewed)[name]
    assert approximately(result.collect()) == plain_reports[name]
    assert "skew=true" in plan(result)
