"""Registered queries: each operator run over the whole test tables."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracles.sql import ORACLES, USAGE  # noqa: E402
from roundledger.functions.text import (  # noqa: E402
    integer_prefix,
    is_metric,
    metric_label,
    present_metric,
    present_number,
    present_percentage,
    within_year,
    year_start,
)
from roundledger.operators import (  # noqa: E402
    backfill,
    integrity,
    metrics,
    pairs,
    predictions,
    quality,
    reports,
    scoring,
    selection,
    totals,
)
from roundledger.operators.keys import append_keys, dense_keys, numbered_by_task  # noqa: E402
from roundledger.plans import dashboard, jobs  # noqa: E402
from roundledger.schemas import SCHEMAS, TABLE_NAMES, Tables  # noqa: E402
from roundledger.session import configure, working_folder  # noqa: E402
from roundledger.sources.evolve import evolve_table, old_name  # noqa: E402
from roundledger.sources.sample import sample_tables  # noqa: E402
from roundledger.sources import league, store  # noqa: E402
from roundledger.sources.fingerprint import table_fingerprint  # noqa: E402
from roundledger.sources.store import prepare_rows  # noqa: E402
from roundledger.sources.tables import database_tables, load_tables  # noqa: E402

# The text operators are optional: the rest works without them.
try:
    import corpus_pipeline
    from roundledger.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "roundledger.llm"):
        raise
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
# The test data has seven line numbers, which stand in for models.
MODEL_NAMES = [f"model_{n}" for n in range(1, 8)]
Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Season metrics of every season."""
    return queries()["season_metrics"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    found = {name: _rounded(query) for name, query in _QUERIES.items()}
    if llm_queries is not None:
        found |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if llm_queries is not None:
        found |= llm_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def _rounded(query: Query) -> Query:
    """Doubles to six places: sums of doubles depend on their order beyond that."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        doubles = {
            f.name: F.round(F.col(f"`{f.name}`"), 6)
            for f in df.schema
            if f.dataType == T.DoubleType()
        }
        return df.withColumns(doubles) if doubles else df

    return run


def _on_tables(query: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(sample_tables(spark, sf_dir))


def _totals(tables: Tables) -> DataFrame:
    return metrics.round_totals(scoring.score_predictions(tables))


def _round_metric(metric: str, cumulative: bool = True) -> Query:
    return _on_tables(
        lambda t: metrics.round_metrics(_totals(t), t.ml_model, metric, cumulative)
    )


def _season_metrics(t: Tables) -> DataFrame:
    scored = scoring.score_predictions(t)
    return metrics.season_metrics(scored, t.season, t.ml_model_season)


def _round_predictions(t: Tables) -> DataFrame:
    scored = scoring.score_predictions(t)
    return predictions.round_predictions(scored, t.ml_model_season, t.team)


def _scored_predictions(t: Tables) -> DataFrame:
    return scoring.score_predictions(t).select(
        "year", "roundNumber", "matchId", "mlModelId", "tip", "absError", "bits"
    )


def _round_metrics_wide(t: Tables) -> DataFrame:
    long = metrics.round_metrics(_totals(t), t.ml_model, "totalTips")
    return metrics.pivot_models(long, MODEL_NAMES)


def _prediction_texts(t: Tables) -> DataFrame:
    margin, probability = F.col("predictedMargin"), F.col("predictedWinProbability")
    return t.prediction.select(
        "id",
        present_number(margin, 2).alias("margin"),
        present_number(margin).alias("wholeMargin"),
        present_number(margin / 8, 2).alias("marginEighth"),
        present_percentage(probability).alias("probability"),
        present_percentage(probability, 0).alias("axisProbability"),
    )


def _metric_texts(t: Tables) -> DataFrame:
    shown = ["accuracy", "mae", "totalTips"]
    scores = metrics.round_scores(_totals(t), t.ml_model)
    keys = ["year", "roundNumber", "name"]
    long = scores.select(*keys, *(F.col(m).cast("double").alias(m) for m in shown)).unpivot(
        keys, shown, "metric", "value"
    )
    metric, value = F.col("metric"), F.col("value")
    return long.select(
        *keys,
        metric_label(metric).alias("label"),
        present_metric(metric, value, 0).alias("axis"),
        present_metric(metric, value, 2).alias("tooltip"),
    )


def _series_colours(t: Tables) -> DataFrame:
    return reports.series_colours(metrics.round_scores(_totals(t), t.ml_model))


def _ranked_models(t: Tables) -> DataFrame:
    long = metrics.round_metrics(_totals(t), t.ml_model, "totalTips")
    return reports.ranked_models(long, "totalTips")


def _without_seasons(t: Tables) -> tuple[Tables, DataFrame]:
    """The tables as they are before a backfill, and the model usage."""
    usage = t.season.sparkSession.createDataFrame(
        list(USAGE), "name string, year int, isPrincipal boolean, isUsedInCompetitions boolean"
    )
    bare = t.swap(
        season=t.season.limit(0),
        ml_model_season=t.ml_model_season.limit(0),
        match=t.match.withColumn("seasonId", F.lit(None).cast("int")),
    )
    return bare, usage


def _season_backfill(t: Tables) -> DataFrame:
    filled = backfill.backfill_seasons(*_without_seasons(t))
    seasons = filled.season.select(F.col("id").alias("seasonId"), "year")
    matches = filled.match.select(F.col("id").alias("matchId"), "seasonId")
    return matches.join(seasons, "seasonId", "left").select("matchId", "seasonId", "year")


def _models_in_use(t: Tables) -> DataFrame:
    return (
        scoring.model_roles(t.ml_model_season)
        .join(t.season.select(F.col("id").alias("seasonId"), "year"), "seasonId")
        .join(t.ml_model.select(F.col("id").alias("mlModelId"), "name"), "mlModelId")
        .select("year", "name", "isPrincipal", "isUsedInCompetitions")
    )


def _timestamp_text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _dup_match_key(t: Tables) -> DataFrame:
    repeated = quality.repeated_keys(t.match, "startDateTime", "venue")
    return repeated.select(_timestamp_text("startDateTime"), "venue", "rows")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


def _orphan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans once the teams of one region are gone."""
    return quality.orphan_references(_without_region(spark, sf_dir))


def _references_held(t: Tables) -> DataFrame:
    return quality.references_held(t)


def _repeated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions, before the mapping makes them distinct."""
    configure(spark)
    picks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("matchId"), F.col("l_linenumber").alias("mlModelId")
    )
    return quality.repeated_predictions(picks)


def _negative_margins(t: Tables) -> DataFrame:
    shifted = t.match.withColumn("margin", F.col("margin") - 30)
    return quality.negative_margins(shifted).select("id", "margin")


def _overlong_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.overlong_text(documents, "text", "source").select(
        "doc_id", F.length("text").alias("length")
    )


def _delete_match_cascade(t: Tables) -> DataFrame:
    left = integrity.delete_cascade(t, "match", t.match.filter("margin = 0"))
    rows = [
        left[table].select(F.lit(label).alias("tableName"), "id")
        for table, label in (
            ("match", "Match"),
            ("prediction", "Prediction"),
            ("team_match", "TeamMatch"),
        )
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _delete_team_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sample_tables(spark, sf_dir)
    gone = _nations(spark, sf_dir).filter("n_regionkey = 2")
    deleted = gone.select(F.col("n_nationkey").cast("int").alias("id"))
    return integrity.delete_set_null(t, "team", deleted).match.select("id", "winnerId")


def _delete_season_set_null(t: Tables) -> DataFrame:
    deleted = t.season.filter("year < 1998")
    return integrity.delete_set_null(t, "season", deleted).match.select("id", "seasonId")


def _delete_model_restricted(t: Tables) -> DataFrame:
    deleted = t.ml_model.filter("predictionType = 'win_probability'")
    return integrity.restricting_references(t, "ml_model", deleted)


def _remap_team_key(t: Tables) -> DataFrame:
    key_map = t.team.filter("id % 2 = 0").select(
        F.col("id").alias("oldId"), (F.col("id") + 100).alias("newId")
    )
    moved = integrity.remap_keys(t, "team", key_map)
    sides = [
        ("Match.winnerId", moved.match, "winnerId"),
        ("Prediction.predictedWinnerId", moved.prediction, "predictedWinnerId"),
        ("TeamMatch.teamId", moved.team_match, "teamId"),
    ]
    rows = moved.team.select(
        F.lit("Team").alias("relation"), F.col("id").cast("bigint").alias("rowId"),
        F.col("id").alias("key"),
    )
    for label, df, column in sides:
        rows = rows.unionByName(
            df.select(
                F.lit(label).alias("relation"), F.col("id").alias("rowId"),
                F.col(column).alias("key"),
            )
        )
    return rows


def _evolve_schema(t: Tables) -> DataFrame:
    """Matches put into the old format and brought back."""
    old_format = t.match.drop("seasonId").withColumn("roundNumber", F.col("roundNumber").cast("short"))
    names = {f.name: old_name(f.name) for f in SCHEMAS["match"]}
    evolved = evolve_table(old_format.withColumnsRenamed(names), "match")
    return evolved.drop("seasonId").withColumn("startDateTime", _timestamp_text("startDateTime"))


def _evolve_prediction(t: Tables) -> DataFrame:
    """Predictions with narrow keys and old names, brought to the present schema."""
    narrow = t.prediction.withColumn("mlModelId", F.col("mlModelId").cast("short"))
    names = {f.name: old_name(f.name) for f in SCHEMAS["prediction"]}
    return evolve_table(narrow.withColumnsRenamed(names), "prediction").drop(
        "createdAt", "updatedAt"
    )


def _insert_defaults(t: Tables) -> DataFrame:
    """Flag rows with one flag sometimes empty and the other left out."""
    given = t.ml_model_season.select(
        "id", F.when(F.col("mlModelId") % 2 == 1, F.col("isPrincipal")).alias("isPrincipal"),
        "seasonId", "mlModelId",
    )
    return prepare_rows(given, "ml_model_season")


def _fact_keys(t: Tables) -> DataFrame:
    """How many new keys there are, and how many are new and distinct."""
    rows = t.prediction.select("matchId", "mlModelId")
    keyed = append_keys(rows, t.match).select(F.col("id").alias("key"))
    clashes = keyed.join(t.match, F.col("key") == F.col("id"), "left_semi").agg(
        F.count("*").alias("clashes")
    )
    return keyed.agg(
        F.count("*").alias("rows"),
        F.count_distinct("key").alias("keys"),
        clashes.scalar().alias("clashes"),
    )


def _dense_fact_keys(t: Tables) -> DataFrame:
    """Bounds and number of the keys that follow the last match's without a gap."""
    spark = t.match.sparkSession
    path = working_folder(spark, "numbered")
    numbered = numbered_by_task(t.prediction.select("matchId", "mlModelId"))
    numbered.write.parquet(path)
    keyed = dense_keys(spark.read.schema(numbered.schema).parquet(path), t.match)
    return keyed.agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("keys"),
        F.min("id").alias("firstKey"),
        F.max("id").alias("lastKey"),
    )


def _season_starts(t: Tables) -> DataFrame:
    year = F.col("year")
    return (
        t.season.select(
            "year", year_start(year).alias("starts"), year_start(year + 1).alias("ends")
        )
        .withColumn("starts", _timestamp_text("starts"))
        .withColumn("ends", _timestamp_text("ends"))
    )


def _without_region(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables once the teams of one region are gone."""
    t = sample_tables(spark, sf_dir)
    kept = _nations(spark, sf_dir).filter("n_regionkey <> 2")
    return t.swap(team=t.team.join(kept, t.team.id == kept.n_nationkey, "left_semi"))


def _round_predictions_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_predictions(_without_region(spark, sf_dir))


def _recomputed_orphans(t: Tables) -> DataFrame:
    """Correctness once the matches without a venue are gone."""
    bare = t.swap(match=t.match.filter("venue IS NOT NULL"))
    return scoring.recompute_correctness(bare, draws_count=True).select("id", "isCorrect")


def _metric_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are a metric and names that are not, for each order."""
    names = [F.lit(n) for n in ("accuracy", "Accuracy", "bits", "totalTips", "mae ", "")]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.col("name")
    return orders.select(
        "o_orderkey", F.explode(F.array(*names, F.lower("o_orderpriority"))).alias("name")
    ).select("o_orderkey", "name", is_metric(name).alias("isMetric"))


def _parameter_rows(t: Tables) -> DataFrame:
    """How many tips a request shows, by its season and round as text."""
    requests = (("1999", "5"), (" 1999x", "5."), (None, "5"), ("soon", "5"), ("1999", ""), ("2050", "1"))
    counted = [
        dashboard.prediction_list(t, season, round_).agg(F.count("*").alias("tips")).select(
            F.lit(i).alias("request"), "tips"
        )
        for i, (season, round_) in enumerate(requests)
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


def _json_series(t: Tables) -> DataFrame:
    """A season's series written as JSON lines and taken apart again."""
    spark = t.match.sparkSession
    path = working_folder(spark, "json")
    store.save_json(dashboard.metric_series(t, "1999", "bits", names=MODEL_NAMES), path)
    fields = ", ".join(f"`{name}` double" for name in MODEL_NAMES)
    lines = spark.read.text(path).select(F.from_json("value", f"roundNumber int, {fields}").alias("r"))
    return lines.select("r.*")


def _fingerprints(tables: Tables) -> DataFrame:
    parts = [
        table_fingerprint(df, table).select(F.lit(TABLE_NAMES[table]).alias("tableName"), "rows", "checksum")
        for table, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _stored_rows(t: Tables) -> DataFrame:
    """Every table's fingerprint after all were written to files and read back."""
    spark = t.match.sparkSession
    root = working_folder(spark, "stored")
    store.save_tables(t, root)
    return _fingerprints(load_tables(spark, root))


def _database_rows(t: Tables) -> DataFrame:
    """Every table's fingerprint in a database reloaded from files."""
    spark = t.match.sparkSession
    root = working_folder(spark, "database")
    database = root.rsplit("/", 1)[-1].replace("-", "_")
    # The derived matches repeat some (start, venue), which a database refuses.
    first = F.min("id").over(Window.partitionBy("startDateTime", "venue"))
    kept = t.match.withColumn("first", F.when(F.col("venue").isNotNull(), first)).filter(
        "first IS NULL OR first = id"
    ).drop("first")
    matched = {
        table: t[table].join(kept.select(F.col("id").alias("matchId")), "matchId", "left_semi")
        for table in ("prediction", "team_match")
    }
    store.save_tables(t.swap(match=kept, **matched), root)
    store.load_database(spark, root, database, f"{root}/tables")
    return _fingerprints(database_tables(spark, database))


def _changing_league(t: Tables) -> str:
    """The folder of a league in which some predictions came in and some results late."""
    spark = t.match.sparkSession
    root = working_folder(spark, "league")
    late = F.col("id") % 7 == 0
    unplayed = t.match.withColumns(
        {c: F.when(~late, F.col(c)) for c in ("margin", "winnerId")}
    )
    unknown = t.prediction.withColumn(
        "isCorrect", F.when(F.col("matchId") % 7 != 0, F.col("isCorrect"))
    )
    early = unknown.filter("matchId % 5 <> 0")
    jobs.start_league(t.swap(match=unplayed, prediction=early), root, check_unique=False)
    jobs.append_predictions(spark, unknown.filter("matchId % 5 = 0").drop("id"), root)
    played = t.match.filter(late & F.col("margin").isNotNull())
    jobs.late_results(spark, played.select("id", "margin", "winnerId"), root)
    return root


def _refreshed_scores(t: Tables) -> DataFrame:
    """Stored scores by year after new predictions and late results."""
    return league.read_result(t.match.sparkSession, _changing_league(t), "scored").groupBy("year").agg(
        F.count("*").alias("predictions"),
        F.sum("tip").alias("totalTips"),
        F.sum("absError").alias("absError"),
        F.sum("bits").alias("bits"),
    )


def _merged_totals(t: Tables) -> DataFrame:
    """Kept totals and running totals, merged with new predictions and late results."""
    spark = t.match.sparkSession
    root = _changing_league(t)
    keys = ["year", "roundNumber", "mlModelId"]
    kept = totals.as_round_totals(league.read_result(spark, root, "totals"))
    running = totals.as_round_totals(league.read_result(spark, root, "running"))
    sums = ("sumTip", "sumAbsError", "sumBits")
    to_date = running.select(*keys, *(F.col(c).alias(f"{c}ToDate") for c in sums))
    return kept.join(to_date, keys).select(
        *keys, *sums, "nTip", "nAbsError", "nBits", *(f"{c}ToDate" for c in sums)
    )


def _season_documents(t: Tables) -> DataFrame:
    """Every season's document, taken apart again for comparison."""
    rounds = metrics.round_totals(scoring.score_predictions(t))
    part = lambda path: F.get_json_object("document", f"$.{path}")
    return dashboard.season_documents(rounds, t.season, t.ml_model_season).select(
        "year",
        part("roundNumbers").alias("roundNumbers"),
        part("metrics.totalTips").cast("bigint").alias("totalTips"),
        part("currentSeasonYear").cast("int").alias("currentSeasonYear"),
        part("seasonYears").alias("seasonYears"),
        *(part(f"metrics.{m}").cast("double").alias(m) for m in ("accuracy", "mae", "bits")),
    )


def _stored_delete(t: Tables) -> DataFrame:
    """A league's scores and team rows by year once the drawn matches are deleted and teams renumbered."""
    spark = t.match.sparkSession
    root = working_folder(spark, "deleted")
    jobs.start_league(t, root, check_unique=False)
    jobs.delete_from_league(spark, root, "match", t.match.filter("margin = 0"))
    moved = t.team.filter("id % 2 = 0").select(
        F.col("id").alias("oldId"), (F.col("id") + 100).alias("newId")
    )
    jobs.remap_in_league(spark, root, "team", moved)
    after = league.read_tables(spark, root)
    sides = after.team_match.groupBy("seasonId").agg(
        F.count("*").alias("teamRows"), F.sum("teamId").alias("teamIds")
    )
    years = after.season.select(F.col("id").alias("seasonId"), "year").join(sides, "seasonId")
    scores = league.read_result(spark, root, "scored").groupBy("year").agg(
        F.count("*").alias("predictions"),
        F.sum("predictedWinnerId").alias("winners"),
        F.sum("absError").alias("absError"),
        F.sum("bits").alias("bits"),
    )
    return years.join(scores, "year").drop("seasonId")


def _integer_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", integer_prefix(F.col("o_orderpriority")).alias("number")
    )


def _dashboard_document(t: Tables) -> DataFrame:
    """The document of one season, taken apart again for comparison."""
    part = lambda path: F.get_json_object("document", f"$.{path}")
    return dashboard.dashboard_document(t, "1999").select(
        part("roundNumbers").alias("roundNumbers"),
        part("metrics.totalTips").cast("bigint").alias("totalTips"),
        part("currentSeasonYear").cast("int").alias("currentSeasonYear"),
        part("seasonYears").alias("seasonYears"),
        *(part(f"metrics.{m}").cast("double").alias(m) for m in ("accuracy", "mae", "bits")),
    )


_QUERIES: dict[str, Query] = {
    "season_metrics": _on_tables(_season_metrics),
    "scored_predictions": _on_tables(_scored_predictions),
    "round_total_tips": _round_metric("totalTips"),
    "round_accuracy": _round_metric("accuracy"),
    "round_mae": _round_metric("mae"),
    "round_bits": _round_metric("bits"),
    "round_total_tips_per_round": _round_metric("totalTips", cumulative=False),
    "round_accuracy_per_round": _round_metric("accuracy", cumulative=False),
    "round_mae_per_round": _round_metric("mae", cumulative=False),
    "round_bits_per_round": _round_metric("bits", cumulative=False),
    "round_metrics_wide": _on_tables(_round_metrics_wide),
    "metric_series": _on_tables(lambda t: dashboard.metric_series(t, "1999", "mae", names=MODEL_NAMES)),
    "round_predictions": _on_tables(_round_predictions),
    "prediction_list": _on_tables(lambda t: dashboard.prediction_list(t, "1999", "5")),
    "round_report": _on_tables(lambda t: reports.round_report(_round_predictions(t))),
    "season_report": _on_tables(lambda t: reports.season_report(_season_metrics(t))),
    "prediction_texts": _on_tables(_prediction_texts),
    "metric_texts": _on_tables(_metric_texts),
    "seasons": _on_tables(lambda t: selection.seasons(t.season)),
    "predicted_rounds": _on_tables(selection.predicted_rounds),
    "latest_rounds": _on_tables(
        lambda t: selection.latest_rounds(selection.predicted_rounds(t))
    ),
    "report_titles": _on_tables(
        lambda t: reports.report_titles(selection.latest_rounds(selection.predicted_rounds(t)))
    ),
    "current_season_default": _on_tables(lambda t: selection.current_value(t.season, "year")),
    "current_season_requested": _on_tables(
        lambda t: selection.current_value(t.season, "year", 1997)
    ),
    "predicted_years": _on_tables(lambda t: backfill.predicted_years(t.match, t.prediction)),
    "season_backfill": _on_tables(_season_backfill),
    "ml_model_season_backfill": _on_tables(
        lambda t: backfill.backfill_seasons(*_without_seasons(t)).ml_model_season
    ),
    "models_in_use": _on_tables(_models_in_use),
    "series_colours": _on_tables(_series_colours),
    "ranked_models": _on_tables(_ranked_models),
    "dup_match_key": _on_tables(_dup_match_key),
    "unique_keys": _on_tables(quality.unique_violations),
    "primary_keys": _on_tables(quality.primary_key_violations),
    "null_required": _on_tables(quality.missing_required),
    "orphan_refs": _orphan_refs,
    "references_held": _on_tables(_references_held),
    "principal_per_season": _on_tables(
        lambda t: quality.principals_per_season(t.season, t.ml_model_season)
    ),
    "repeated_predictions": _repeated_predictions,
    "negative_margins": _on_tables(_negative_margins),
    "overlong_text": _overlong_text,
    "delete_match_cascade": _on_tables(_delete_match_cascade),
    "delete_team_set_null": _delete_team_set_null,
    "delete_season_set_null": _on_tables(_delete_season_set_null),
    "delete_model_restricted": _on_tables(_delete_model_restricted),
    "remap_team_key": _on_tables(_remap_team_key),
    "home_away_pairs": _on_tables(lambda t: pairs.home_away_pairs(t.team_match)),
    "recomputed_correctness": _on_tables(
        lambda t: scoring.recompute_correctness(t, draws_count=True).select("id", "isCorrect")
    ),
    "evolve_schema": _on_tables(_evolve_schema),
    "evolve_prediction": _on_tables(_evolve_prediction),
    "insert_defaults": _on_tables(_insert_defaults),
    "fact_keys": _on_tables(_fact_keys),
    "dense_fact_keys": _on_tables(_dense_fact_keys),
    "season_starts": _on_tables(_season_starts),
    "matches_of_year": _on_tables(
        lambda t: t.match.filter(within_year(F.col("startDateTime"), 1999)).select("id")
    ),
    "integer_prefixes": _integer_prefixes,
    "round_predictions_orphans": _round_predictions_orphans,
    "recomputed_correctness_orphans": _on_tables(_recomputed_orphans),
    "metric_flags": _metric_flags,
    "parameter_rows": _on_tables(_parameter_rows),
    "json_series": _on_tables(_json_series),
    "stored_rows": _on_tables(_stored_rows),
    "database_rows": _on_tables(_database_rows),
    "refreshed_scores": _on_tables(_refreshed_scores),
    "merged_totals": _on_tables(_merged_totals),
    "season_documents": _on_tables(_season_documents),
    "stored_delete": _on_tables(_stored_delete),
    "dashboard_document": _on_tables(_dashboard_document),
}
