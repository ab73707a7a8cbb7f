import pytest
from pyspark.sql import functions as F

from roundledger.operators import backfill, selection
from tests.tiny import ROWS, at, tiny_tables, tuples

USAGE = [("m", 2020, True, True), ("p", 2020, False, True), ("gone", 2020, True, True)]
USAGE_SCHEMA = "name string, year int, isPrincipal boolean, isUsedInCompetitions boolean"


@pytest.fixture(scope="module")
def usage(spark):
    return spark.createDataFrame(USAGE, USAGE_SCHEMA)


@pytest.fixture(scope="module")
def bare(spark):
    """No seasons yet; year ends, a predicted year and an unpredicted one."""
    match = [row[:-1] + (None,) for row in ROWS["match"]] + [
        (10, at(2020, 1, 1), 1, None, None, None, None),
        (11, at(2020, 12, 31, 23), 1, None, None, None, None),
    ]
    return tiny_tables(spark, match=match, season=[], ml_model_season=[])


def test_predicted_years(bare):
    assert tuples(backfill.predicted_years(bare.match, bare.prediction)) == [(2019,), (2020,)]


def test_backfill(bare, usage):
    filled = backfill.backfill_seasons(bare, usage)
    assert sorted(tuples(filled.season)) == [(1, 2019), (2, 2020)]
    seasons = {r.id: r.seasonId for r in filled.match.collect()}
    # Every match of a covered year is assigned; 2021 has no predictions.
    assert seasons == {1: 2, 2: 2, 3: 2, 4: 2, 5: None, 9: 1, 10: 2, 11: 2}
    flags = {
        (r.seasonId, r.mlModelId): (r.isPrincipal, r.isUsedInCompetitions)
        for r in filled.ml_model_season.collect()
    }
    none = (False, False)
    assert flags == {
        (1, 1): none, (1, 2): none, (1, 3): none,
        (2, 1): (True, True), (2, 2): (False, True), (2, 3): none,
    }


def test_second_run_changes_nothing(bare, usage):
    once = backfill.backfill_seasons(bare, usage)
    twice = backfill.backfill_seasons(bare.swap(**once._asdict()), usage)
    for name in once._fields:
        assert sorted(tuples(getattr(once, name)), key=repr) == sorted(
            tuples(getattr(twice, name)), key=repr
        )


def test_new_rows_are_keyed_after_existing_ones(spark, usage):
    t = tiny_tables(spark, season=[(7, 2019)], ml_model_season=[(5, True, False, 7, 1)])
    filled = backfill.backfill_seasons(t, usage)
    assert sorted(tuples(filled.season)) == [(7, 2019), (8, 2020)]
    rows = filled.ml_model_season.collect()
    ids = [r.id for r in rows]
    assert len(ids) == len(set(ids)) == 6
    assert min(i for i in ids if i != 5) > 5
    assert (5, True, False, 7, 1) in [tuple(r) for r in rows]


def test_any_number_of_seasons(spark):
    t = tiny_tables(spark)
    season = spark.range(1, 12_001).selectExpr("int(id) AS id", "int(id) AS year")
    pairs = backfill.seasons_by_models(season, t.ml_model)
    assert pairs.select("seasonId", "mlModelId").distinct().count() == 12_000 * 3
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_years_beyond_four_digits(spark):
    t = tiny_tables(spark)
    match = t.match.limit(1).withColumn("startDateTime", F.expr("timestamp'+10000-06-01 00:00:00'"))
    season = spark.createDataFrame([(5, 10_000)], "id int, year int")
    assigned = backfill.assign_seasons(match, season)
    assert assigned.select("seasonId").first().seasonId == 5


def test_selection(spark):
    t = tiny_tables(spark)
    assert tuples(selection.seasons(t.season)) == [(2020,), (2021,)]
    assert tuples(selection.predicted_rounds(t)) == [(2020, 1), (2020, 2)]
    assert tuples(selection.predicted_rounds(t, 2021)) == []
    assert tuples(selection.latest_rounds(selection.predicted_rounds(t))) == [(2020, 2)]
    for requested, shown in ((None, 2021), (2020, 2020), (1999, 2021)):
        assert selection.current_value(t.season, "year", requested).first().year == shown


def test_no_seasons_is_an_error(spark):
    t = tiny_tables(spark, season=[])
    with pytest.raises(Exception, match="Required data not found"):
        selection.current_value(t.season, "year", 2020).collect()


def test_year_zero_is_an_ordinary_value(spark):
    values = spark.createDataFrame([(0,), (3,)], "year int")
    assert selection.current_value(values, "year", 0).first().year == 0
