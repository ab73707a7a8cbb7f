"""Stored tables after whole jobs, and what stops a job."""

import pytest
from pyspark.sql import functions as F

from roundledger import configure
from roundledger.operators import quality, scoring
from roundledger.plans import dashboard, jobs
from roundledger.schemas import REFERENCES, SCHEMAS
from roundledger.session import working_folder
from roundledger.sources import evolve, store
from roundledger.sources.tables import database_tables, load_tables
from tests.tiny import NOW, ROWS, at, tiny_tables, tuples


def rows_of(df):
    return sorted(tuples(df), key=repr)


def save(tables, root):
    store.save_tables(tables, root)
    store.save_scored(scoring.score_predictions(tables), f"{root}/Scored")


def test_backfill_job(spark, tmp_path):
    usage = spark.createDataFrame(
        [("m", 2019, True, True)],
        "name string, year int, isPrincipal boolean, isUsedInCompetitions boolean",
    )
    root = str(tmp_path)
    store.publish(spark, "jobs", dict(tiny_tables(spark).items()), root, "first")
    jobs.backfill_job(spark, "jobs", usage, root, "second")
    after = database_tables(spark, "jobs")
    assert [r.year for r in after.season.orderBy("year").collect()] == [2019, 2020, 2021]
    once = {table: rows_of(df) for table, df in after.items()}
    jobs.backfill_job(spark, "jobs", usage, root, "third")
    assert {t: rows_of(df) for t, df in database_tables(spark, "jobs").items()} == once


def dependents(table):
    """A table and all that may refer to it, directly or not."""
    children = {r.child for r in REFERENCES if r.parent == table}
    return {table}.union(*map(dependents, children))


def test_empty_tables_round_trip_and_publish(spark, tmp_path):
    full = tiny_tables(spark)
    for table in SCHEMAS:
        one = full.swap(**{t: full[t].limit(0) for t in dependents(table)})
        root = str(tmp_path / table)
        save(one, root)
        loaded = load_tables(spark, root)
        assert loaded[table].count() == 0
        assert store.load_scored(spark, f"{root}/Scored").count() >= 0
        store.publish(spark, f"empty_{table}", dict(one.items()), root, "run")
        published = database_tables(spark, f"empty_{table}")
        for name, df in one.items():
            assert rows_of(published[name]) == rows_of(df)


def broken_tables(spark):
    """One table each that breaks a rule, and what the refusal says."""
    t = tiny_tables(spark)
    lost = t.team.withColumn("name", F.when(F.col("id") > 1, F.col("name")))
    return {
        "Team repeats id": {"team": tiny_tables(spark, team=[*ROWS["team"], (1, "Dogs")]).team},
        "Team repeats name": {"team": tiny_tables(spark, team=[*ROWS["team"], (4, "Ants")]).team},
        "Team: name is required": {"team": lost},
        "references without a row": {"team": t.team.filter("id = 1")},
        "Match: margin is negative": {"match": t.match.withColumn("margin", -F.col("margin"))},
    }


def test_broken_tables_are_refused_with_nothing_changed(spark, tmp_path):
    good, root = tiny_tables(spark), str(tmp_path)
    store.save_tables(good, f"{root}/good")
    store.load_database(spark, f"{root}/good", "guarded", f"{root}/db")
    before = {t: rows_of(df) for t, df in database_tables(spark, "guarded").items()}
    for i, (message, broken) in enumerate(broken_tables(spark).items()):
        with pytest.raises(ValueError, match=message):
            store.publish(spark, "guarded", broken, f"{root}/db", f"run{i}")
        store.save_tables(good.swap(**broken), f"{root}/bad{i}")
        with pytest.raises(ValueError, match=message):
            store.load_database(spark, f"{root}/bad{i}", "guarded")
        assert {t: rows_of(df) for t, df in database_tables(spark, "guarded").items()} == before


def test_row_rules_ride_on_the_write(spark, tmp_path):
    """The rows are counted, and checked, in the one job that writes them."""
    t = tiny_tables(spark)
    store.save_tables(t, str(tmp_path / "in"))
    match = load_tables(spark, str(tmp_path / "in")).match
    tracker, group = spark.sparkContext.statusTracker(), "rules"
    spark.sparkContext.setJobGroup(group, group)
    try:
        store.save_checked(match, "match", str(tmp_path / "out"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    scans = 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            scans += info is not None and info.numCompletedTasks > 0
    # The scan and the write after its shuffle; nothing else ran.
    assert scans == 2
    watched, observation = quality.watched(match, "match")
    assert "CollectMetrics" in watched._jdf.queryExecution().executedPlan().toString()
    watched.write.format("noop").mode("overwrite").save()
    assert quality.require_watched(observation, "match") == len(ROWS["match"])


def test_saving_one_year_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "Scored")
    t = tiny_tables(spark, prediction=[*ROWS["prediction"], (51, 1.0, 5, 1, 3, True, None, NOW, NOW)])
    scored = scoring.score_predictions(t)
    store.save_scored(scored, path)
    store.save_scored(scored.filter("year = 2021"), path)
    store.save_scored(scored.limit(0), path)
    assert store.load_scored(spark, path).count() == scored.count()
    store.save_scored(scored.filter("year = 2021"), path, replace=True)
    assert store.load_scored(spark, path).count() == 1


def test_sound_tables_pass_and_each_fault_stops(spark):
    t = tiny_tables(spark)
    quality.require_sound(t)
    faults = {
        "primary keys": {"team": [*ROWS["team"], (1, "Dogs")]},
        "unique keys": {"team": [*ROWS["team"], (4, "Ants")]},
        "references": {"team": ROWS["team"][:1]},
        "margins": {"match": [*ROWS["match"], (10, at(2020, 5, 1), 9, "Park", -3, 1, 1)]},
    }
    for message, rows in faults.items():
        with pytest.raises(ValueError, match=message):
            quality.require_sound(tiny_tables(spark, **rows))
    lost = t.swap(team=t.team.withColumn("name", F.when(F.col("id") > 1, F.col("name"))))
    with pytest.raises(ValueError, match="required values"):
        quality.require_sound(lost)


def test_old_tables_must_be_complete(spark):
    old = spark.createDataFrame([(1, 3)], "id int, round_number short")
    with pytest.raises(ValueError, match="server_match lacks"):
        evolve.evolve_table(old, "match")


def test_no_prediction_is_lost(spark):
    t = tiny_tables(spark)
    fewer = t.swap(match=t.match.filter("id <> 1"))
    assert scoring.recompute_correctness(fewer).count() == len(ROWS["prediction"])
    no_teams = t.swap(team=t.team.limit(0))
    tips = dashboard.prediction_list(no_teams, "2020", "1")
    assert [r.predictedWinnerName for r in tips.collect()] == [None, None]


def test_series_as_a_map_and_no_job_when_built(spark):
    t = tiny_tables(spark)
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    series = dashboard.metric_series(t, "2020", "totalTips")
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert [(r.roundNumber, r.series) for r in series.collect()] == [
        (1, {"X": 1.0, "m": 1.0, "p": 0.0}), (2, {"m": 1.0, "p": 1.0})
    ]


def test_partitions_follow_the_expected_shuffle(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for size, partitions in ((1, "1"), (10 * 2**40, "40960"), (100 * 2**40, "409600")):
        configure(spark, shuffle_bytes=size)
        assert spark.conf.get(key) == partitions
    spark.conf.unset(key)


def test_working_folders_differ(spark):
    assert working_folder(spark, "x") != working_folder(spark, "x")
