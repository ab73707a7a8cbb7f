import math

import pytest
from pyspark.sql import functions as F

from roundledger.operators import metrics, predictions, scoring
from tests.tiny import NOW, ROWS, at, tiny_tables, tuples


@pytest.fixture(scope="module")
def tables(spark):
    return tiny_tables(spark)


@pytest.fixture(scope="module")
def scored(tables):
    return scoring.score_predictions(tables)


def by_id(scored):
    return {r.id: (r.tip, r.absError, r.bits) for r in scored.collect()}


def test_each_prediction_scored(scored):
    assert by_id(scored) == {
        11: (1, 6.0, None),
        12: (0, None, 1 + math.log2(0.25)),
        13: (1, 9.0, None),
        21: (0, 6.0, None),
        22: (0, None, 0.0),
        31: (0, 42.0, None),
        32: (1, None, 0.0),
        41: (None, None, None),
    }


def test_matches_outside_seasons_do_not_count(scored):
    assert scored.filter("matchId = 9").count() == 0


@pytest.mark.parametrize(
    "probability, winner, margin, bits",
    [
        (1.0, 1, 9, 1.0),
        (1.0, 2, 9, -math.inf),
        (0.0, 1, 9, -math.inf),
        (0.0, 2, 9, 1.0),
        (1.0, None, 0, -math.inf),
        (0.5, None, 0, 0.0),
        (0.5, None, None, None),
        (None, 1, 9, None),
        # A played match whose winner was deleted has no known result.
        (0.5, None, 9, None),
    ],
)
def test_bits(spark, probability, winner, margin, bits):
    t = tiny_tables(
        spark,
        match=[(1, at(2020, 3, 1), 1, None, margin, winner, 1)],
        prediction=[(1, None, 1, 2, 1, None, probability, NOW, NOW)],
    )
    assert scoring.score_predictions(t).first().bits == bits


def test_certain_and_wrong_makes_the_season_minus_infinity(spark):
    certain = (33, None, 3, 2, 1, False, 1.0, NOW, NOW)
    t = tiny_tables(spark, prediction=ROWS["prediction"] + [certain])
    row = metrics.season_metrics(
        scoring.score_predictions(t), t.season, t.ml_model_season
    ).filter("year = 2020").first()
    assert row.bits == -math.inf


def test_season_metrics(tables, scored):
    result = metrics.season_metrics(scored, tables.season, tables.ml_model_season)
    assert sorted(tuples(result)) == [
        (2020, 1, 1 / 3, 18.0, -1.0),
        (2021, None, None, None, None),
    ]


def test_one_year(tables):
    assert scoring.score_predictions(tables, 2021).count() == 0
    assert scoring.score_predictions(tables, 2020).count() == 8


def test_two_principals_lowest_key_counts(spark):
    flags = [(1, False, False, 1, 1), (2, True, True, 1, 3), (3, True, True, 1, 2)]
    t = tiny_tables(spark, ml_model_season=flags)
    roles = {(r.mlModelId, r.isPrincipal) for r in scoring.model_roles(t.ml_model_season).collect()}
    assert roles == {(2, True), (3, False)}


def test_running_averages_divide_running_sums(tables, scored):
    scores = metrics.round_scores(metrics.round_totals(scored), tables.ml_model)
    rows = {(r.roundNumber, r.name): r for r in scores.collect()}
    assert rows[1, "m"].mae == 6.0
    assert rows[2, "m"].mae == 18.0
    assert rows[2, "m"].accuracy == 1 / 3
    assert rows[2, "m"].totalTips == 1
    assert rows[2, "p"].bits == -1.0
    assert (2, "X") not in rows


def test_last_cumulative_point_and_sum_of_rounds_equal_the_season(tables, scored):
    totals = metrics.round_totals(scored)
    season = metrics.season_metrics(scored, tables.season, tables.ml_model_season)
    tips = season.filter("year = 2020").first().totalTips
    cumulative = metrics.round_metrics(totals, tables.ml_model, "totalTips").filter("name = 'm'")
    single = metrics.round_metrics(totals, tables.ml_model, "totalTips", cumulative=False)
    assert cumulative.orderBy(F.desc("roundNumber")).first().value == tips
    assert single.filter("name = 'm'").agg(F.sum("value")).first()[0] == tips


def test_pivot_and_back(tables, scored):
    names = metrics.model_names(tables.ml_model)
    assert names == ["X", "m", "p"]
    long = metrics.round_metrics(metrics.round_totals(scored), tables.ml_model, "totalTips")
    wide = metrics.pivot_models(long, names)
    assert wide.columns == ["year", "roundNumber", "X", "m", "p"]
    assert tuples(wide.orderBy("roundNumber")) == [(2020, 1, 1.0, 1.0, 0.0), (2020, 2, None, 1.0, 1.0)]
    back = metrics.unpivot_models(wide, names).filter("value IS NOT NULL")
    assert sorted(tuples(back)) == sorted(tuples(long))


def test_unknown_metric(tables, scored):
    with pytest.raises(ValueError):
        metrics.round_metrics(metrics.round_totals(scored), tables.ml_model, "Accuracy")


def test_combined_predictions(tables, scored):
    tips = predictions.round_predictions(scored, tables.ml_model_season, tables.team)
    assert sorted(tuples(tips), key=lambda row: row[2]) == [
        # The probability model tipped the other team: 1 - 0.75.
        (2020, 1, 1, "Ants", 4.0, 0.25, True),
        (2020, 1, 2, "Ants", 6.0, 0.5, False),
        (2020, 2, 3, "Ants", 12.0, 0.5, False),
        (2020, 2, 4, "Bees", 3.0, None, None),
    ]


def test_opposite_margin_turns_negative(spark):
    flags = [(1, True, True, 1, 2), (2, False, True, 1, 1)]
    t = tiny_tables(spark, ml_model_season=flags)
    tips = predictions.round_predictions(
        scoring.score_predictions(t), t.ml_model_season, t.team
    ).filter("matchId = 1")
    assert tuples(tips) == [(2020, 1, 1, "Bees", -4.0, 0.75, False)]


def test_repeated_prediction_takes_the_first(spark):
    later = (99, 50.0, 1, 1, 2, False, None, NOW, NOW)
    t = tiny_tables(spark, prediction=[later] + ROWS["prediction"])
    tips = predictions.round_predictions(
        scoring.score_predictions(t), t.ml_model_season, t.team
    ).filter("matchId = 1")
    assert tuples(tips) == [(2020, 1, 1, "Ants", 4.0, 0.25, True)]


def test_recomputed_correctness(tables):
    for draws_count in (False, True):
        again = scoring.recompute_correctness(tables, draws_count)
        assert again.columns == tables.prediction.columns
        correct = {r.id: r.isCorrect for r in again.collect()}
        assert correct == {
            11: True, 12: False, 13: True, 21: draws_count, 22: draws_count,
            31: False, 32: True, 41: None, 91: True,
        }
