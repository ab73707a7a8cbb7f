import pytest

from roundledger.operators import integrity, keys, pairs, quality
from tests.tiny import NOW, ROWS, at, tiny_tables, tuples


@pytest.fixture(scope="module")
def tables(spark):
    return tiny_tables(spark)


def test_repeated_keys_ignore_nulls(spark):
    start = at(2020, 3, 1)
    match = [
        (1, start, 1, "Oval", 1, 1, 1),
        (2, start, 1, "Oval", 1, 1, 1),
        (3, start, 1, None, 1, 1, 1),
        (4, start, 1, None, 1, 1, 1),
    ]
    t = tiny_tables(spark, match=match)
    found = {r.tableName: (r.repeatedKeys, r.rows) for r in quality.unique_violations(t).collect()}
    assert found == {
        "Match": (1, 2), "MlModel": (0, 0), "MlModelSeason": (0, 0), "Team": (0, 0), "Season": (0, 0),
    }


def nullable(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_primary_keys(spark, tables):
    team = nullable(spark, [(1, "a"), (1, "b"), (None, "c"), (None, "d")], "id int, name string")
    found = quality.primary_key_violations(tables.swap(team=team)).filter("tableName = 'Team'")
    assert tuples(found) == [("Team", 1, 2, 2)]


def test_missing_required(spark, tables):
    team = nullable(spark, [(1, None), (None, None)], "id int, name string")
    found = quality.missing_required(tables.swap(team=team)).filter("nulls > 0")
    assert sorted(tuples(found)) == [("Team", "id", 1), ("Team", "name", 2)]


def test_orphans(spark):
    lost = [
        (98, 1.0, 77, 8, 9, None, None, NOW, NOW),
        (99, 1.0, 77, 1, 1, None, None, NOW, NOW),
    ]
    t = tiny_tables(spark, prediction=ROWS["prediction"] + lost)
    assert sorted(tuples(quality.orphan_references(t))) == [
        ("Prediction.matchId", 77, 2),
        ("Prediction.mlModelId", 8, 1),
        ("Prediction.predictedWinnerId", 9, 1),
    ]
    assert ("Match.winnerId", 1, 2) in tuples(quality.references_held(t))


def test_no_orphans(tables):
    assert tuples(quality.orphan_references(tables)) == []


def test_principals_per_season(spark):
    flags = [(1, True, True, 1, 1), (2, True, True, 1, 2)]
    t = tiny_tables(spark, ml_model_season=flags)
    found = quality.principals_per_season(t.season, t.ml_model_season)
    assert sorted(tuples(found)) == [(2020, 2, False), (2021, 0, True)]


def test_other_checks(spark, tables):
    team = spark.createDataFrame([(1, "x" * 100), (2, "x" * 101)], "id int, name string")
    assert [r.id for r in quality.overlong_text(team, "name").collect()] == [2]
    match = tables.match.withColumn("margin", tables.match.margin - 8)
    assert sorted(r.id for r in quality.negative_margins(match).collect()) == [2, 5, 9]
    doubled = tables.prediction.unionByName(tables.prediction.filter("id = 11"))
    assert tuples(quality.repeated_predictions(doubled)) == [(1, 1, 2)]
    with pytest.raises(ValueError, match="margins"):
        quality.require_empty(quality.negative_margins(match), "margins")
    quality.require_empty(quality.negative_margins(tables.match), "margins")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_delete_cascade(tables):
    left = integrity.delete_cascade(tables, "match", tables.match.filter("id IN (1, 2)"))
    assert ids(left.match) == [3, 4, 5, 9]
    assert ids(left.prediction) == [31, 32, 41, 91]
    assert ids(left.team_match) == [5, 6]
    assert left.prediction.columns == tables.prediction.columns


def test_delete_set_null(tables):
    left = integrity.delete_set_null(tables, "team", tables.team.filter("id = 1"))
    winners = {r.id: r.winnerId for r in left.match.collect()}
    assert winners == {1: None, 2: None, 3: 2, 4: None, 5: 3, 9: None}
    assert ids(left.team) == [2, 3]
    left = integrity.delete_set_null(tables, "season", tables.season.filter("year = 2020"))
    assert {r.seasonId for r in left.match.collect()} == {None, 2}
    assert left.match.columns == tables.match.columns


def test_delete_restricted(tables):
    deleted = tables.ml_model.filter("id = 3")
    assert sorted(tuples(integrity.restricting_references(tables, "ml_model", deleted))) == [
        ("MlModelSeason.mlModelId", 3, 1),
        ("Prediction.mlModelId", 3, 1),
    ]
    with pytest.raises(ValueError, match="still in use"):
        integrity.delete_rows(tables, "ml_model", deleted)


def test_delete_unused(spark):
    t = tiny_tables(spark, team=ROWS["team"] + [(4, "Dogs")])
    assert ids(integrity.delete_rows(t, "team", t.team.filter("id = 4")).team) == [1, 2, 3]


def test_delete_match_by_all_rules(tables):
    left = integrity.delete_rows(tables, "match", tables.match.filter("id = 1"))
    assert ids(left.prediction) == [21, 22, 31, 32, 41, 91]


def test_remap_keys(spark, tables):
    key_map = spark.createDataFrame([(1, 101), (2, 1)], "oldId int, newId int")
    moved = integrity.remap_keys(tables, "team", key_map)
    assert sorted(tuples(moved.team)) == [(1, "Bees"), (3, "Cats"), (101, "Ants")]
    assert {r.id: r.winnerId for r in moved.match.collect()} == {
        1: 101, 2: None, 3: 1, 4: None, 5: 3, 9: 101,
    }
    assert {r.id: r.predictedWinnerId for r in moved.prediction.collect()}[12] == 1
    assert moved.team_match.schema == tables.team_match.schema or (
        moved.team_match.dtypes == tables.team_match.dtypes
    )
    assert tuples(quality.orphan_references(moved)) == []


def test_remap_to_two_places_fails(spark, tables):
    key_map = spark.createDataFrame([(1, 101), (1, 102)], "oldId int, newId int")
    with pytest.raises(Exception, match="key mapped twice"):
        integrity.remap_keys(tables, "team", key_map).match.collect()


def test_pairs(tables):
    assert sorted(tuples(pairs.home_away_pairs(tables.team_match))) == [
        (1, 1, 70, 2, 60), (2, 1, 50, 3, 50), (3, 1, 40, 2, 70),
    ]


def test_append_keys(spark, tables):
    rows = spark.range(1000).repartition(4).select("id").withColumnRenamed("id", "n")
    keyed = keys.append_keys(rows, tables.prediction)
    assert keyed.select("id").distinct().count() == 1000
    assert keyed.selectExpr("min(id)").first()[0] == 92
