"""A stored league: whole changes, read by season, equal to a full recomputation."""

import re
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roundledger.operators import keys, metrics, scoring, totals
from roundledger.plans import dashboard, jobs
from roundledger.sources import league
from roundledger.sources.fingerprint import table_fingerprint
from roundledger.sources.league import Change, read_result, read_tables
from tests.tiny import NOW, ROWS, at, tiny_tables, tuples

PICKS = "matchId bigint, mlModelId int, predictedWinnerId int, predictedMargin double"
RESULTS = "id bigint, margin int, winnerId int"


def rows_of(df):
    return sorted(tuples(df), key=repr)


@pytest.fixture
def root(spark, tmp_path):
    extra = [(51, 2.0, 5, 1, 3, True, None, NOW, NOW), (33, None, 3, 2, 1, False, 1.0, NOW, NOW)]
    jobs.start_league(tiny_tables(spark, prediction=ROWS["prediction"] + extra), str(tmp_path))
    return str(tmp_path)


def everything(spark, root):
    found = {t: rows_of(df) for t, df in read_tables(spark, root).items()}
    return found | {r: rows_of(read_result(spark, root, r)) for r in league.RESULTS}


def assert_results_follow(spark, root):
    """Every stored result equals what the tables give anew."""
    t = read_tables(spark, root)
    bare = t.swap(prediction=t.prediction.drop("seasonId"))
    scored = scoring.score_predictions(bare)
    assert rows_of(read_result(spark, root, "scored").select(*scored.columns)) == rows_of(scored)
    assert rows_of(read_result(spark, root, "totals")) == rows_of(totals.mergeable_totals(scored))
    assert rows_of(read_result(spark, root, "running")) == rows_of(
        totals.running_totals(totals.mergeable_totals(scored))
    )
    for row in read_result(spark, root, "documents").collect():
        wanted = dashboard.dashboard_document(bare, str(row.year)).first().document
        assert row.document == wanted
    years = {r.year for r in t.season.collect()}
    assert {r.year for r in read_result(spark, root, "documents").collect()} == years
    # Each fact lies in the season of its match.
    seasons = {r.id: r.seasonId for r in t.match.collect()}
    for table in league.BY_MATCH:
        assert all(r.seasonId == seasons.get(r.matchId) for r in t[table].collect())


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*.parquet") if "Staging" not in p.parts}


def test_start(spark, root):
    assert_results_follow(spark, root)
    loaded = read_tables(spark, root)
    assert rows_of(loaded.match) == rows_of(tiny_tables(spark).match)
    assert loaded.prediction.filter("seasonId IS NULL").count() == 1
    scored = read_result(spark, root, "scored")
    plain = metrics.round_totals(scored)
    kept = totals.as_round_totals(read_result(spark, root, "totals"))
    assert rows_of(kept.select(*plain.columns)) == rows_of(plain)


def test_one_season_reads_its_own_predictions(spark, root):
    tables = read_tables(spark, root)
    series = dashboard.metric_series(tables, "2020", "mae")
    text = series._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in text.split("FileScan")[1:] if "predictedMargin" in x)
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", scan)
    assert series.count() > 0
    bare = tables.swap(prediction=tables.prediction.drop("seasonId"))
    one = scoring.score_predictions(tables, 2020)
    assert rows_of(one) == rows_of(scoring.score_predictions(bare, 2020).select(*one.columns))


def test_append(spark, root):
    picks = spark.createDataFrame([(5, 2, 3, 2.5), (4, 2, 1, None), (1, 1, 2, 9.0), (9, 2, 1, 1.0)], PICKS)
    last = max(r.id for r in read_tables(spark, root).prediction.collect())
    old = files(root)
    # Match 1 was predicted by model 1 before: that row is left out.
    assert jobs.append_predictions(spark, picks, root) == 3
    ids = {r.id for r in read_tables(spark, root).prediction.collect()}
    assert {last + 1, last + 2, last + 3} <= ids and max(ids) == last + 3
    assert_results_follow(spark, root)
    assert old <= files(root)
    before = everything(spark, root)
    assert jobs.append_predictions(spark, picks, root) == 0
    assert everything(spark, root) == before
    with pytest.raises(ValueError, match="without a row"):
        jobs.append_predictions(spark, picks.withColumn("matchId", F.lit(77)), root)
    assert everything(spark, root) == before


def test_an_append_reads_no_old_scores(spark, root, monkeypatch):
    read = []
    plain = league.read_table
    monkeypatch.setattr(league, "read_table", lambda s, r, t, v: read.append(t) or plain(s, r, t, v))
    jobs.append_predictions(spark, spark.createDataFrame([(5, 2, 3, 2.5)], PICKS), root)
    assert "scored" not in read and "totals" in read


def test_late_results(spark, root):
    results = spark.createDataFrame([(4, 12, 2), (3, 6, 1)], RESULTS)
    jobs.late_results(spark, results, root)
    after = read_tables(spark, root)
    assert {r.id: r.isCorrect for r in after.prediction.collect()}[41] is True
    assert {r.id: r.margin for r in after.match.collect()}[4] == 12
    assert_results_follow(spark, root)
    before = everything(spark, root)
    jobs.late_results(spark, results, root)
    assert everything(spark, root) == before
    for bad, message in (((77, 1, 1), "without a match"), ((4, -1, 1), "margins")):
        with pytest.raises(ValueError, match=message):
            jobs.late_results(spark, spark.createDataFrame([bad], RESULTS), root)
    assert everything(spark, root) == before


def test_untouched_seasons_keep_their_files(spark, root):
    def named(part):
        version = league.current_version(spark, root)
        return {r for r in version.runs if r[0] in league.PART and r[1] in part}

    before = named({2, 2021, None})
    jobs.late_results(spark, spark.createDataFrame([(4, 12, 2)], RESULTS), root)
    jobs.delete_from_league(spark, root, "match", spark.createDataFrame([(3,)], "id bigint"))
    after = named({2, 2021, None})
    assert {r for r in before if r[0] != "documents"} == {r for r in after if r[0] != "documents"}


@pytest.mark.parametrize("job, stops", [("append", [3]), ("results", [4])])
def test_stopped_between_steps(spark, root, monkeypatch, job, stops):
    """A reader sees the old league until the switch; a rerun ends as if never stopped."""
    run = {
        "append": lambda: jobs.append_predictions(spark, spark.createDataFrame([(5, 2, 3, 2.5), (4, 2, 1, None)], PICKS), root),
        "results": lambda: jobs.late_results(spark, spark.createDataFrame([(4, 12, 2)], RESULTS), root),
        "delete": lambda: jobs.delete_from_league(spark, root, "match", spark.createDataFrame([(1,)], "id bigint")),
    }[job]
    before, runs = everything(spark, root), league.current_version(spark, root).runs
    write, steps = Change.write, [0]

    class Stopped(Exception):
        pass

    def stopping(limit):
        def step(self, *args, **kwargs):
            steps[0] += 1
            done = write(self, *args, **kwargs)
            if steps[0] == limit:
                raise Stopped
            return done

        return step

    for limit in stops:
        steps[0] = 0
        monkeypatch.setattr(Change, "write", stopping(limit))
        with pytest.raises(Stopped):
            run()
        # Files are never changed, so the same runs are the same rows.
        assert league.current_version(spark, root).runs == runs
    assert everything(spark, root) == before
    monkeypatch.undo()
    run()
    assert league.current_version(spark, root).runs != runs
    assert_results_follow(spark, root)


def test_deletes_and_key_changes(spark, root):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    jobs.delete_from_league(spark, root, "match", rows(1))
    after = read_tables(spark, root)
    assert all(r.matchId != 1 for t in league.BY_MATCH for r in after[t].collect())
    assert_results_follow(spark, root)
    before = everything(spark, root)
    with pytest.raises(ValueError, match="still in use"):
        jobs.delete_from_league(spark, root, "ml_model", rows(1))
    assert everything(spark, root) == before
    moved = spark.createDataFrame([(3, 30), (2, 20)], "oldId int, newId int")
    jobs.remap_in_league(spark, root, "team", moved)
    assert {r.winnerId for r in read_tables(spark, root).match.collect()} == {None, 1, 20, 30}
    assert_results_follow(spark, root)
    jobs.remap_in_league(spark, root, "match", spark.createDataFrame([(3, 300)], "oldId bigint, newId bigint"))
    assert_results_follow(spark, root)
    jobs.remap_in_league(spark, root, "season", spark.createDataFrame([(1, 7)], "oldId int, newId int"))
    assert {r.seasonId for r in read_tables(spark, root).match.collect()} == {7, 2, None}
    assert_results_follow(spark, root)


def test_a_deleted_season_takes_its_scores_along(spark, tmp_path):
    root = str(tmp_path)
    season = [*ROWS["season"], (3, 2019)]
    extra = [(8, at(2019, 5, 1), 1, "Dome", 3, 1, 3)]
    pick = (81, 3.0, 8, 1, 1, True, None, NOW, NOW)
    jobs.start_league(tiny_tables(spark, season=season, match=ROWS["match"] + extra, prediction=[*ROWS["prediction"], pick]), root)
    jobs.delete_from_league(spark, root, "season", spark.createDataFrame([(3,)], "id int"))
    assert_results_follow(spark, root)
    assert read_tables(spark, root).match.filter("seasonId IS NULL").count() == 2


def test_broken_tables_start_no_league(spark, tmp_path):
    t = tiny_tables(spark)
    negative = t.swap(match=t.match.withColumn("margin", -F.col("margin")))
    with pytest.raises(ValueError, match="negative"):
        jobs.start_league(negative, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="references"):
        jobs.start_league(t.swap(team=t.team.filter("id = 1")), str(tmp_path / "b"))


def test_totals_merge_and_part_exactly(spark):
    days = [(i, at(2020, 3, 1) + timedelta(days=i), 1 + i % 4, f"v{i}", i % 3 * 7, 1 + i % 2, 1) for i in range(40)]
    days = [d if d[4] else (*d[:5], None, d[6]) for d in days]
    picks = [
        (i, None if i % 3 else 0.1 * i, i % 40, 1 + i % 3, 1 + i % 2, i % 2 == 0, (None, 1.0, 0.3, 0.7)[i % 4], NOW, NOW)
        for i in range(300)
    ]
    scored = scoring.score_predictions(tiny_tables(spark, match=days, prediction=picks))
    whole = totals.mergeable_totals(scored)
    parts = [totals.mergeable_totals(scored.filter(f"id % 3 = {i}")) for i in range(3)]
    assert rows_of(totals.merge_totals(*parts)) == rows_of(whole)
    less = totals.merge_totals(whole, totals.taken_off(parts[0]))
    assert rows_of(less) == rows_of(totals.merge_totals(*parts[1:]))
    assert any(r.lostBits for r in whole.collect())
    running = totals.running_totals(less)
    changed = parts[0].filter("roundNumber > 2")
    after = totals.merge_totals(less, changed)
    got = totals.refresh_running(running, after, changed.select("year", "roundNumber").distinct())
    assert rows_of(got) == rows_of(totals.running_totals(after))


def test_dense_keys_follow_the_last(spark, tmp_path):
    existing = spark.createDataFrame([(7,), (41,)], "id bigint")
    rows = spark.range(1000).select((F.col("id") * 3).alias("matchId")).repartition(7)
    numbered = keys.numbered_by_task(rows)
    numbered.write.parquet(str(tmp_path / "staged"))
    staged = spark.read.schema(numbered.schema).parquet(str(tmp_path / "staged"))
    once = rows_of(keys.dense_keys(staged, existing))
    assert sorted(key for key, _ in once) == list(range(42, 1042))
    assert rows_of(keys.dense_keys(staged, existing)) == once
    assert rows_of(keys.dense_keys(staged.limit(0), existing)) == []


def test_fingerprints_tell_any_change(spark):
    t = tiny_tables(spark)
    plain = table_fingerprint(t.match, "match").first()
    assert plain.rows == len(ROWS["match"])
    dealt = t.match.orderBy(F.desc("id")).repartition(3)
    assert table_fingerprint(dealt, "match").first() == plain
    last = F.col("id") == max(row[0] for row in ROWS["match"])
    changes = {
        "startDateTime": "startDateTime + INTERVAL 1 MICROSECOND", "roundNumber": "roundNumber + 1",
        "venue": "NULL", "margin": "margin + 1", "winnerId": "NULL", "seasonId": "0",
    }
    for column, changed in changes.items():
        value = F.when(last, F.expr(changed)).otherwise(F.col(column))
        other = t.match.withColumn(column, value.cast(t.match.schema[column].dataType))
        assert table_fingerprint(other, "match").first().checksum != plain.checksum
    assert table_fingerprint(t.team.limit(0), "team").first().checksum == "0"


def test_deletes_and_key_changes_score_nothing_anew(spark, root, monkeypatch):
    """Stored scores follow a rule that leaves them as they are; facts are not gathered again."""
    scored, placed = [], []
    write = Change.write
    plain = jobs.score_predictions
    monkeypatch.setattr(jobs, "score_predictions", lambda *a: scored.append(1) or plain(*a))
    monkeypatch.setattr(
        Change, "write",
        lambda self, table, *a, **k: placed.append((table, k.get("placed"))) or write(self, table, *a, **k),
    )
    jobs.delete_from_league(spark, root, "match", spark.createDataFrame([(1,)], "id bigint"))
    moved = spark.createDataFrame([(3, 30), (2, 20)], "oldId int, newId int")
    jobs.remap_in_league(spark, root, "team", moved)
    assert not scored
    assert {t for t, stays in placed if stays} == {"prediction", "team_match", "scored"}
    monkeypatch.undo()
    assert_results_follow(spark, root)
    # The run is no column of the write, which would sort its rows twice.
    assert all(name.split("/")[1].startswith("run=") for name in files(root) if "Versions" not in name)
