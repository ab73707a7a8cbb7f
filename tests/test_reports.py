from roundledger.operators import reports
from tests.tiny import tuples

METRICS = "year int, totalTips bigint, accuracy double, mae double, bits double"
PREDICTIONS = (
    "year int, roundNumber int, matchId bigint, predictedWinnerName string, "
    "predictedMargin double, predictedWinProbability double, isCorrect boolean"
)
LONG = "year int, roundNumber int, name string, value double"


def test_season_report(spark):
    metrics = spark.createDataFrame(
        [(2020, 120, 0.61236, 27.5049, 30.0), (2021, None, None, None, None)], METRICS
    )
    rows = reports.season_report(metrics).orderBy("year", "position")
    assert tuples(rows) == [
        (2020, 1, "Total Tips", "120"),
        (2020, 2, "Accuracy", "61.24%"),
        (2020, 3, "MAE", "27.50"),
        (2020, 4, "Bits", "30.00"),
        (2021, 1, "Total Tips", "NA"),
        (2021, 2, "Accuracy", "NA"),
        (2021, 3, "MAE", "NA"),
        (2021, 4, "Bits", "NA"),
    ]


def test_round_report(spark):
    tips = spark.createDataFrame(
        [
            (2020, 1, 1, "Ants", 4.0, 0.25, True),
            (2020, 1, 2, "Bees", -4.126, 0.755, False),
            (2020, 1, 3, "Cats", None, None, None),
        ],
        PREDICTIONS,
    )
    assert tuples(reports.round_report(tips).orderBy("matchId").drop("year", "roundNumber")) == [
        (1, "Ants", "4.00", "25.00%", "yeah"),
        (2, "Bees", "-4.13", "75.50%", "nah"),
        (3, "Cats", "NA", "NA", "dunno"),
    ]


def test_titles(spark):
    latest = spark.createDataFrame([(2020, 12)], "year int, roundNumber int")
    assert tuples(reports.report_titles(latest)) == [
        (2020, "Model performance for 2020", "Predictions for Round 12, 2020")
    ]


def test_series_colours_in_binary_name_order(spark):
    names = ["b", "B", "a_", "aA", "é", "c", "d", "e"]
    long = spark.createDataFrame([(2020, r, n, 1.0) for n in names for r in (1, 2)], LONG)
    rows = reports.series_colours(long).orderBy("series").collect()
    assert [r.name for r in rows] == ["B", "aA", "a_", "b", "c", "d", "e", "é"]
    assert [r.colour for r in rows] == list(reports.PALETTE) + [None]


def test_missing_values_rank_as_zero(spark):
    long = spark.createDataFrame(
        [(2020, 1, "low", -1.0), (2020, 1, "none", None), (2020, 1, "high", 2.0), (2020, 1, "a", 0.0)],
        LONG,
    )
    rows = reports.ranked_models(long, "bits").orderBy("position")
    assert [(r.position, r.name, r.text) for r in rows.collect()] == [
        (1, "high", "2.00"), (2, "a", "0.00"), (3, "none", "NA"), (4, "low", "-1.00"),
    ]
