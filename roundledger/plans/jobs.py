"""Whole jobs: backfill, new predictions, late results, deletes and key changes.

Those on a league (``sources.league``) leave its stored scores, round totals
and documents equal to what a full recomputation gives, read and write only the
seasons concerned, become visible as a whole, and change nothing when run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundledger.functions.scores import recomputed_correctness
from roundledger.operators import integrity
from roundledger.operators.backfill import add_seasons, backfill_from, predicted_years
from roundledger.operators.keys import dense_keys, numbered_by_task
from roundledger.operators.quality import (
    negative_margins,
    repeated_keys,
    require_empty,
    require_rows_fit,
    require_sound,
)
from roundledger.operators.scoring import score_predictions
from roundledger.operators.totals import (
    as_round_totals,
    merge_totals,
    mergeable_totals,
    refresh_running,
    running_totals,
    taken_off,
)
from roundledger.plans.dashboard import season_documents
from roundledger.schemas import REFERENCES, SCHEMAS, TABLE_NAMES, Tables
from roundledger.sources.league import BY_MATCH, PART, Change, in_parts, parts_of
from roundledger.sources.store import prepare_rows, publish, save_parquet
from roundledger.sources.tables import database_tables


def backfill_job(
    spark: SparkSession, database: str, usage: DataFrame, root: str, run: str
) -> None:
    """Check a database, fill in seasons and model flags, and publish them at once."""
    tables = database_tables(spark, database)
    require_sound(tables)
    years = predicted_years(tables.match, tables.prediction)
    # Stored once: all three results start from the seasons.
    path = f"{root}/{run}/seasons"
    save_parquet(add_seasons(tables.season, years), path)
    season = spark.read.schema(SCHEMAS["season"]).parquet(path)
    filled = backfill_from(tables, season, usage)
    publish(spark, database, filled._asdict(), root, run)


def start_league(tables: Tables, root: str, check_unique: bool = True) -> None:
    """Store all tables and their results as the first version of a league.

    ``check_unique`` can be left out for tables whose natural keys repeat.
    """
    change = Change(tables.match.sparkSession, root, first=True)
    for table in ("season", "team", "ml_model", "ml_model_season", "match", "prediction", "team_match"):
        change.write(table, tables[table])
    change.write("scored", score_predictions(change.tables()))
    totals = mergeable_totals(change.read("scored"))
    change.write("totals", totals)
    change.write("running", running_totals(change.read("totals")))
    _write_documents(change, None)
    change.commit(unique=SCHEMAS if check_unique else (), references=SCHEMAS)


def _years_of(change: Change, seasons: list[int | None]) -> list[int]:
    """Years of seasons; matches without a season have no scores."""
    season = change.read("season").filter(F.col("id").isin([s for s in seasons if s is not None]))
    return sorted({row.year for row in season.select("year").collect()})


def _write_documents(change: Change, years: list[int] | None) -> None:
    """Documents of some years, or of all: they are one aggregate of the totals."""
    tables, totals = change.tables(), change.read("totals")
    season = tables.season
    if years is not None:
        totals = totals.filter(in_parts("totals", years))
        season = season.filter(F.col("year").isin(years))
    documents = season_documents(
        as_round_totals(totals), season, tables.ml_model_season, tables.season
    )
    gone = {part for name, part, _ in change.version.runs if name == "documents"}
    change.write("documents", documents, gone if years is None else years)


def _refresh_totals(change: Change, delta: DataFrame, years: list[int]) -> None:
    """Merge a change of the totals, and what follows from it, season by season.

    Old predictions are not read: only the totals of the years are.
    """
    delta = change.staged(delta, "delta")
    old = change.read("totals").filter(in_parts("totals", years))
    merged = change.staged(merge_totals(old, delta), "totals")
    running = change.read("running").filter(in_parts("running", years))
    changed = delta.select("year", "roundNumber").distinct()
    after = refresh_running(running, merged, changed)
    change.write("totals", merged, years)
    change.write("running", after, years)
    _write_documents(change, years)


def append_predictions(spark: SparkSession, rows: DataFrame, root: str) -> int:
    """Add predictions (without ``id``) to a league and bring its results up to date.

    A model's prediction of a match it has already predicted is left out, which
    makes a second run harmless. Rows without a match, model or team fail the
    job with nothing changed. Keys follow the last one without a gap. The number
    of predictions added is returned.
    """
    change = Change(spark, root)
    tables = change.tables()
    pair = ["matchId", "mlModelId"]
    given = change.staged(rows, "given")
    held = given.join(tables.match, given.matchId == tables.match.id, "left")
    seasons = parts_of(held, "match")
    known = tables.prediction.filter(in_parts("prediction", seasons)).select(*pair)
    new = given.join(known, pair, "left_anti").dropDuplicates(pair)
    numbered = change.staged(numbered_by_task(new), "numbered")
    keyed = change.staged(
        prepare_rows(dense_keys(numbered, tables.prediction), "prediction"), "keyed"
    )
    require_rows_fit(keyed, "prediction", tables)
    match = tables.match.filter(in_parts("match", seasons))
    count = change.write("prediction", keyed, matches=match)
    if count:
        scored = change.staged(score_predictions(tables.swap(match=match, prediction=keyed)), "scored")
        years = _years_of(change, seasons)
        change.write("scored", scored)
        _refresh_totals(change, mergeable_totals(scored), years)
        change.commit()
    return count


def late_results(spark: SparkSession, results: DataFrame, root: str) -> None:
    """Enter results (``id``, ``margin``, ``winnerId``) and all that follows from them.

    ``isCorrect`` of the matches' predictions is worked out and their scores
    replaced; only their seasons are read and written. A match that is not
    stored, or a negative margin, fails the job with nothing changed.
    """
    change = Change(spark, root)
    tables = change.tables()
    results = change.staged(results.select("id", "margin", "winnerId"), "results")
    given = results.select(
        "id", F.col("margin").alias("newMargin"), F.col("winnerId").alias("newWinnerId")
    )
    require_empty(given.join(tables.match, "id", "left_anti"), "results without a match")
    require_empty(negative_margins(results), "margins")
    seasons = parts_of(tables.match.join(given, "id", "left_semi"), "match")
    if not seasons:
        return
    match = tables.match.filter(in_parts("match", seasons))
    entered = F.col("newMargin").isNotNull()
    after = match.join(given, "id", "left").select(
        *(
            F.when(entered, F.col(f"new{c[0].upper()}{c[1:]}")).otherwise(F.col(c)).alias(c)
            if c in ("margin", "winnerId")
            else F.col(c)
            for c in match.columns
        )
    )
    change.write("match", after, seasons)
    match = change.read("match").filter(in_parts("match", seasons))
    outcome = match.join(given, "id", "left_semi").select(
        F.col("id").alias("matchId"), "margin", "winnerId", F.lit(True).alias("entered")
    )
    old = tables.prediction.filter(in_parts("prediction", seasons))
    corrected = old.join(outcome, "matchId", "left").withColumn(
        "isCorrect",
        F.when(F.col("entered"), recomputed_correctness()).otherwise(F.col("isCorrect")),
    )
    change.write("prediction", corrected, seasons, match, placed=_ids_unique(match))
    _replace_scores(change, outcome.select("matchId"), seasons)
    change.commit()


def _ids_unique(match: DataFrame) -> bool:
    """Whether each fact has one match at most, so that its stored season is its match's."""
    return repeated_keys(match, "id").isEmpty()


def _replace_scores(change: Change, matches: DataFrame, seasons: list[int | None]) -> None:
    """Score the predictions of some matches again; totals lose and gain their part."""
    years = _years_of(change, seasons)
    tables = change.tables()
    stored = change.read("scored").filter(in_parts("scored", years))
    gone = stored.join(matches, "matchId", "left_semi")
    match = tables.match.filter(in_parts("match", seasons))
    touched = match.join(matches, match.id == matches.matchId, "left_semi")
    prediction = tables.prediction.filter(in_parts("prediction", seasons))
    new = change.staged(
        score_predictions(tables.swap(match=touched, prediction=prediction)), "rescored"
    )
    # Rounds that end as they were are changed too: the rows are not folded yet.
    delta = taken_off(mergeable_totals(gone)).unionByName(mergeable_totals(new))
    delta = change.staged(delta, "difference")
    kept = stored.join(matches, "matchId", "left_anti")
    change.write("scored", kept.unionByName(new.select(*kept.columns)), years)
    _refresh_totals(change, delta, years)


def _touched(tables: Tables, parent: str, keys: DataFrame) -> dict[str, list[int | None]]:
    """The parts of each table that hold one of the keys (``id``), by a look at keys alone.

    What belongs to a match lies in the match's own season.
    """
    wanted = keys.select(F.col("id").alias("_key")).distinct()

    def holding(table: str, column: str) -> list[int | None]:
        df = tables[table]
        return parts_of(df.join(wanted, df[column] == wanted["_key"], "left_semi"), table)

    found = {parent: holding(parent, "id")}
    for reference in REFERENCES:
        if reference.parent == parent:
            same = parent == "match" and PART.get(reference.child) == PART["match"]
            parts = found[parent] if same else holding(reference.child, reference.column)
            found[reference.child] = sorted({*found.get(reference.child, ()), *parts}, key=str)
    if parent == "season":
        for table in ("prediction", "team_match"):
            found[table] = found["match"]
    return found


def _rewrite(change: Change, parent: str, keys: DataFrame, rule, same_scores: bool) -> None:
    """Apply a rule to the parts that the keys touch and leave the others unread.

    With ``same_scores`` the rule only leaves out predictions, or changes keys
    one to one: stored scores then follow it like the predictions.
    """
    tables = change.tables()
    touched = _touched(tables, parent, keys)
    small = tables.swap(
        **{
            table: tables[table].filter(in_parts(table, parts))
            for table, parts in touched.items()
            if table in PART
        }
    )
    after = rule(small)
    old_years = _years_of(change, touched.get("match", []))
    # The match of a fact stays in its season unless seasons change.
    placed = parent != "season" and _ids_unique(tables.match)
    # Matches come first: their children take their season from them.
    for table in TABLE_NAMES:
        if touched.get(table):
            matches = None
            if parent == "season":
                matches = after.match
            elif table in BY_MATCH:
                matches = change.read("match").filter(in_parts("match", touched[table]))
            stay = placed and table in BY_MATCH
            change.write(table, after[table], touched[table], matches, placed=stay)
    seasons = sorted({p for t in ("match", "prediction") for p in touched.get(t, [])}, key=str)
    _rescore(change, seasons, old_years, rule if placed and same_scores else None)
    # Only its ids may have changed.
    change.commit(unique=[parent], natural=False)


def _rescore(change: Change, seasons: list[int | None], old_years: list[int], rule=None) -> None:
    """Scores and results of whole seasons, and none for years that are no more.

    Scores that a ``rule`` for predictions leaves as they are follow it; others
    are worked out anew.
    """
    tables = change.tables()
    present = [s for s in seasons if s is not None]
    years = _years_of(change, seasons)
    season = tables.season.filter(F.col("id").isin(present) | F.col("year").isin(old_years))
    years = sorted({*years, *old_years, *(r.year for r in season.collect())})
    if rule is None:
        change.write("scored", score_predictions(tables.swap(season=season)), years)
    else:
        stored = change.read("scored").filter(in_parts("scored", years))
        after = rule(tables.swap(prediction=stored)).prediction
        change.write("scored", after, years, placed=True)
    scored = change.read("scored").filter(in_parts("scored", years))
    totals = change.staged(mergeable_totals(scored), "totals")
    for result, rows in (("totals", totals), ("running", running_totals(totals))):
        change.write(result, rows, years)
    # The list of seasons or the models' flags may have changed, which all show.
    _write_documents(change, None)


def delete_from_league(spark: SparkSession, root: str, parent: str, keys: DataFrame) -> None:
    """Delete rows (by ``id``) with all that belongs to them, and empty references.

    Fails with nothing changed while a required reference holds a row.
    """
    change = Change(spark, root)
    keys = change.staged(keys.select("id"), "keys")
    require_empty(
        integrity.restricting_references(change.tables(), parent, keys), f"{parent} still in use"
    )
    # A deleted team empties the winner of its matches, and a season its matches' season.
    _rewrite(
        change, parent, keys, lambda t: integrity.delete_unrestricted(t, parent, keys),
        same_scores=parent in ("match", "ml_model"),
    )


def remap_in_league(spark: SparkSession, root: str, parent: str, key_map: DataFrame) -> None:
    """Change keys by ``key_map`` (oldId, newId) in the parent and in every child."""
    change = Change(spark, root)
    key_map = change.staged(key_map.select("oldId", "newId"), "map")
    keys = key_map.select(F.col("oldId").alias("id"))
    # Keys stay apart, or the commit fails: what was equal stays equal.
    _rewrite(
        change, parent, keys, lambda t: integrity.remap_keys(t, parent, key_map),
        same_scores=parent != "season",
    )
