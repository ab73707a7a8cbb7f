import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roundledger.operators import backfill, metrics, scoring
from roundledger.plans import dashboard
from roundledger.schemas import SCHEMAS
from roundledger.sources import evolve, store
from roundledger.sources.tables import database_tables, jdbc_options, load_tables
from tests.tiny import ROWS, tiny_tables, tuples


@pytest.fixture(scope="module")
def tables(spark):
    return tiny_tables(spark)


@pytest.fixture(scope="module")
def root(tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "tables")
    store.save_tables(tables, root)
    return root


def same_rows(left, right):
    assert left.columns == right.columns
    assert sorted(tuples(left), key=repr) == sorted(tuples(right), key=repr)


def test_round_trip(spark, tables, root):
    loaded = load_tables(spark, root)
    for name, df in tables.items():
        same_rows(loaded[name], df)
        assert [f.dataType for f in loaded[name].schema] == [f.dataType for f in SCHEMAS[name]]


def test_narrow_keys_are_widened_on_read(spark, tables, tmp_path):
    old = tables.swap(match=tables.match.withColumn("id", F.col("id").cast("int")))
    store.save_tables(old, str(tmp_path))
    same_rows(load_tables(spark, str(tmp_path)).match, tables.match)


def test_stored_scores_give_the_same_reports(spark, tables, tmp_path):
    path = str(tmp_path / "scored")
    scored = scoring.score_predictions(tables)
    store.save_scored(scored, path)
    assert (tmp_path / "scored" / "year=2020").is_dir()
    stored = store.load_scored(spark, path)
    same_rows(
        metrics.season_metrics(stored, tables.season, tables.ml_model_season),
        metrics.season_metrics(scored, tables.season, tables.ml_model_season),
    )
    assert store.load_scored(spark, path, 2021).count() == 0
    for request in (None, "2020", "2021", "1999"):
        assert tuples(dashboard.dashboard_document(tables, request, stored)) == tuples(
            dashboard.dashboard_document(tables, request)
        )
    same_rows(
        dashboard.metric_series(tables, "2020", "mae", scored=stored),
        dashboard.metric_series(tables, "2020", "mae"),
    )
    same_rows(
        dashboard.prediction_list(tables, "2020", "1", stored),
        dashboard.prediction_list(tables, "2020", "1"),
    )


def test_append_fills_defaults(spark, tmp_path):
    t = tiny_tables(spark)
    store.save_tables(t, str(tmp_path))
    rows = spark.createDataFrame([(9, 2, 2)], "id int, seasonId int, mlModelId int")
    store.append_rows(rows, "ml_model_season", str(tmp_path))
    picks = spark.createDataFrame(
        [(99, 5, 1, 3)], "id int, matchId int, mlModelId int, predictedWinnerId int"
    )
    with pytest.raises(ValueError, match="Prediction rows repeat|without a row"):
        store.append_rows(picks.withColumn("matchId", F.lit(77)), "prediction", str(tmp_path))
    store.append_rows(picks, "prediction", str(tmp_path))
    loaded = load_tables(spark, str(tmp_path))
    assert (9, False, False, 2, 2) in tuples(loaded.ml_model_season)
    added = loaded.prediction.filter("id = 99").first()
    assert added.createdAt is not None and added.isCorrect is None


def test_append_refuses_missing_values(spark, tmp_path):
    store.save_tables(tiny_tables(spark), str(tmp_path))
    rows = spark.createDataFrame([(9,)], "id int")
    with pytest.raises(Exception, match="Season.year is required"):
        store.append_rows(rows, "season", str(tmp_path))


def test_load_database(spark, tables, root):
    for _ in range(2):
        store.load_database(spark, root, "league")
    same_rows(database_tables(spark, "league").match, tables.match)
    assert spark.table("league.Prediction").count() == len(ROWS["prediction"])


def test_publish_switches_after_all_are_written(spark, tables, tmp_path):
    usage = spark.createDataFrame(
        [("m", 2020, True, True)],
        "name string, year int, isPrincipal boolean, isUsedInCompetitions boolean",
    )
    root = str(tmp_path)
    store.publish(spark, "live", dict(tables.items()), root, "run1")
    current = database_tables(spark, "live")
    filled = backfill.backfill_seasons(current, usage)._asdict()
    broken = filled | {"season": filled["season"].withColumn("year", F.raise_error(F.lit("stop")))}
    with pytest.raises(Exception, match="stop"):
        store.publish(spark, "live", broken, root, "run2")
    same_rows(database_tables(spark, "live").match, tables.match)
    store.publish(spark, "live", filled, root, "run3")
    after = database_tables(spark, "live")
    assert sorted(r.year for r in after.season.collect()) == [2019, 2020, 2021]
    assert after.match.filter("seasonId IS NULL").count() == 0


def test_evolve_old_tables(spark, tables):
    old = spark.createDataFrame(
        [(1, ROWS["match"][0][1], 3, "Oval", 10, 1)],
        "id int, start_date_time timestamp, round_number short, venue string, margin int, winner_id int",
    )
    new = evolve.evolve_table(old, "match")
    assert new.dtypes == tables.match.dtypes
    assert tuples(new) == [(1, ROWS["match"][0][1].replace(tzinfo=None), 3, "Oval", 10, 1, None)]
    assert evolve.old_name("predictedWinProbability") == "predicted_win_probability"
    assert evolve.old_name("id") == "id"


def test_load_old_tables(spark, tables, tmp_path):
    for table, name in evolve.OLD_TABLE_NAMES.items():
        old = tables[table].drop("seasonId")
        if table != "ml_model":
            old = old.withColumn("id", F.col("id").cast("int"))
        old.toDF(*(evolve.old_name(c) for c in old.columns)).write.parquet(f"{tmp_path}/{name}")
    new = evolve.load_old_tables(spark, str(tmp_path))
    for table in evolve.OLD_TABLE_NAMES:
        assert new[table].dtypes == tables[table].dtypes
    same_rows(new.prediction, tables.prediction)
    same_rows(new.match, tables.match.withColumn("seasonId", F.lit(None).cast("int")))
    assert new.season.count() == new.ml_model_season.count() == 0
    usage = spark.createDataFrame(
        [("m", 2020, True, True), ("p", 2020, False, True)],
        "name string, year int, isPrincipal boolean, isUsedInCompetitions boolean",
    )
    filled = new.swap(**backfill.backfill_seasons(new, usage)._asdict())
    report = metrics.season_metrics(
        scoring.score_predictions(filled), filled.season, filled.ml_model_season
    )
    assert (2020, 1, 1 / 3, 18.0, -1.0) in tuples(report)


def test_json_lines(spark, tables, tmp_path):
    path = str(tmp_path / "json")
    rows = spark.createDataFrame(
        [(2, None), (1, float("-inf")), (3, 0.5)], "roundNumber int, value double"
    )
    store.save_json(rows.orderBy("roundNumber"), path)
    files = sorted(Path(path).glob("part-*"))
    lines = [json.loads(line) for file in files for line in file.read_text().splitlines()]
    assert lines == [
        {"roundNumber": 1, "value": None},
        {"roundNumber": 2, "value": None},
        {"roundNumber": 3, "value": 0.5},
    ]


def test_jdbc_options():
    assert jdbc_options("match", 1, 10, 4) == {
        "dbtable": '"Match"',
        "partitionColumn": "id",
        "lowerBound": "1",
        "upperBound": "11",
        "numPartitions": "4",
    }
    assert jdbc_options("match", None, None, 4) == {"dbtable": '"Match"'}


def test_dashboard_document(tables):
    document = json.loads(dashboard.dashboard_document(tables, "2020x").first().document)
    assert document == {
        "roundNumbers": [1, 2],
        "metrics": {"totalTips": 1, "accuracy": 1 / 3, "mae": 18.0, "bits": -1.0},
        "currentSeasonYear": 2020,
        "seasonYears": [2020, 2021],
    }
    document = json.loads(dashboard.dashboard_document(tables).first().document)
    assert document == {
        "roundNumbers": [],
        "metrics": {"totalTips": None, "accuracy": None, "mae": None, "bits": None},
        "currentSeasonYear": 2021,
        "seasonYears": [2020, 2021],
    }


def test_metric_series(tables):
    names = metrics.model_names(tables.ml_model)
    series = dashboard.metric_series(tables, "2020", "totalTips", names=names)
    assert series.columns == ["roundNumber", "X", "m", "p"]
    assert tuples(series) == [(1, 1.0, 1.0, 0.0), (2, None, 1.0, 1.0)]
    single = dashboard.metric_series(tables, "2020", "totalTips", cumulative=False, names=names)
    assert tuples(single) == [(1, 1.0, 1.0, 0.0), (2, None, 0.0, 1.0)]


@pytest.mark.parametrize(
    "season, metric", [(None, "mae"), ("", "mae"), ("soon", "mae"), ("2020", "MAE"), ("2020", None)]
)
def test_bad_metric_requests_are_empty(tables, season, metric):
    assert tuples(dashboard.metric_series(tables, season, metric)) == []


def test_prediction_list(tables):
    columns = ["predictedWinnerName", "predictedMargin", "predictedWinProbability", "isCorrect"]
    tips = dashboard.prediction_list(tables, "2020", "1")
    assert tips.columns == columns
    assert tuples(tips) == [("Ants", 4.0, 0.25, True), ("Ants", 6.0, 0.5, False)]
    for season, round_text in ((None, "1"), ("2020", ""), ("2020", "x"), ("2030", "1")):
        empty = dashboard.prediction_list(tables, season, round_text)
        assert empty.columns == columns and tuples(empty) == []
