"""Writing tables, scores and reports."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.functions.text import finite
from roundledger.operators.quality import (
    require_references,
    require_rows_fit,
    require_unique,
    require_watched,
    watched,
)
from roundledger.schemas import SCHEMAS, TABLE_NAMES, Tables
from roundledger.sources.evolve import fill_defaults
from roundledger.sources.tables import database_tables, load_tables


class Layout(NamedTuple):
    """How a stored table is laid out: folders, then files, then rows in a file."""

    folders: tuple[str, ...] = ()
    gathered: tuple[str, ...] = ()
    sorted: tuple[str, ...] = ()


# A season reads its own folders and a round its own files. Facts are gathered
# by match, so that counting per match shrinks them before any shuffle.
LAYOUTS = {
    "match": Layout(("seasonId",), ("seasonId", "roundNumber"), ("seasonId", "roundNumber", "id")),
    "prediction": Layout((), ("matchId",), ("matchId",)),
    "team_match": Layout((), ("matchId",), ("matchId",)),
}
SCORED_SCHEMA = (
    "year int, seasonId int, roundNumber int, matchId bigint, id bigint, mlModelId int, "
    "predictedWinnerId int, predictedMargin double, predictedWinProbability double, "
    "isCorrect boolean, tip int, absError double, bits double"
)
SCORED_LAYOUT = Layout(("year",), ("year", "roundNumber"), ("year", "roundNumber", "matchId"))


def _arranged(df: DataFrame, layout: Layout, gathered: bool = False) -> DataFrame:
    """Rows gathered into even files; a value too frequent for one file gets several.

    Rows ``gathered`` already are only sorted.
    """
    arranged = df if gathered else df.hint("rebalance", *map(F.col, layout.gathered))
    return arranged.sortWithinPartitions(*layout.sorted) if layout.sorted else arranged


def save_parquet(
    df: DataFrame, path: str, layout: Layout = Layout(), mode: str = "static"
) -> None:
    """Write a table; mode ``dynamic`` replaces only the folders present in ``df``."""
    writer = _arranged(df, layout).write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy(*layout.folders).parquet(path)


def save_checked(df: DataFrame, table: str, path: str) -> DataFrame:
    """Write a table where nothing is yet, and read it back; fails where a row breaks a rule.

    Rules for single rows are counted by the tasks that write.
    """
    layout = LAYOUTS.get(table, Layout())
    arranged, observation = watched(_arranged(df, layout), table)
    arranged.write.partitionBy(*layout.folders).parquet(path)
    require_watched(observation, table)
    return df.sparkSession.read.schema(SCHEMAS[table]).parquet(path)


def save_tables(tables: Tables, root: str) -> None:
    """Write all seven tables under ``root``."""
    for table, df in tables.items():
        save_parquet(df, f"{root}/{TABLE_NAMES[table]}", LAYOUTS.get(table, Layout()))


def save_scored(scored: DataFrame, path: str, replace: bool = False) -> None:
    """Store scored predictions by year: later metrics need no join of facts.

    The years present replace those stored, the others stay; ``replace`` drops
    all that was stored before.
    """
    save_parquet(scored, path, SCORED_LAYOUT, "static" if replace else "dynamic")


def load_scored(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    scored = spark.read.schema(SCORED_SCHEMA).parquet(path)
    return scored if year is None else scored.filter(F.col("year") == year)


def load_database(
    spark: SparkSession, files_root: str, database: str, location: str | None = None
) -> None:
    """Reload a whole catalog database from per-table files, checked and at once.

    A new database is made in ``location`` if that is given, else in the
    warehouse; its tables are written to a run's folder there and published.
    """
    where = f"LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` {where}")
    details = spark.sql(f"DESCRIBE DATABASE `{database}`").collect()
    root = location or next(row[1] for row in details if row[0] == "Location")
    run = f"load_{uuid.uuid4().hex}"
    publish(spark, database, dict(load_tables(spark, files_root).items()), root, run)


def prepare_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows ready to insert: defaults filled in, types cast, required values present."""

    def column(field):
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if not field.nullable:
            message = f"{TABLE_NAMES[table]}.{field.name} is required"
            value = F.coalesce(value, F.raise_error(F.lit(message)))
        return value.alias(field.name)

    filled = fill_defaults(df, table)
    present = set(filled.columns)
    return filled.select(*map(column, SCHEMAS[table]))


def append_rows(df: DataFrame, table: str, root: str) -> None:
    """Bulk insert into a stored table.

    Fails, with nothing written, where a key is taken or a reference has no row.
    Stored scores do not follow by themselves: ``plans.jobs.append_predictions``
    appends and refreshes them.
    """
    layout = LAYOUTS.get(table, Layout())
    prepared = prepare_rows(df, table)
    require_rows_fit(prepared, table, load_tables(df.sparkSession, root))
    rows = _arranged(prepared, layout)
    rows.write.mode("append").partitionBy(*layout.folders).parquet(f"{root}/{TABLE_NAMES[table]}")


def publish(
    spark: SparkSession, database: str, changed: dict[str, DataFrame], root: str, run: str
) -> None:
    """Replace tables of a database of views: write and check every one, then switch.

    Required values and margins are checked by the tasks that write, keys and
    references on what was written; a fault leaves the database as it was. Each run writes to its own folder, so readers keep the old rows until all
    new ones are complete, a failed run changes nothing, and the source of a
    rewrite is never overwritten while it is read. The views stand on tables
    with declared columns, which can be read without any file. ``run`` must be
    new and fit a table's name.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    written = {
        table: save_checked(df, table, f"{root}/{run}/{TABLE_NAMES[table]}")
        for table, df in changed.items()
    }
    whole = SCHEMAS.keys() <= changed.keys()
    tables = Tables(**written) if whole else database_tables(spark, database).swap(**written)
    require_unique(tables, changed)
    require_references(tables, changed)
    views = {}
    for table in changed:
        name, layout = TABLE_NAMES[table], LAYOUTS.get(table, Layout())
        path, stored = f"{root}/{run}/{name}", f"`{database}`.`{name}_{run}`"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[table])
        folders = f"PARTITIONED BY ({', '.join(layout.folders)})" if layout.folders else ""
        spark.sql(f"CREATE TABLE {stored} ({columns}) USING parquet {folders} LOCATION '{path}'")
        if layout.folders:
            spark.sql(f"ALTER TABLE {stored} RECOVER PARTITIONS")
        views[name] = stored, ", ".join(f"`{f.name}`" for f in SCHEMAS[table])
    for stored, columns in views.values():
        spark.sql(f"SELECT {columns} FROM {stored} LIMIT 0").collect()
    for name, (stored, columns) in views.items():
        spark.sql(
            f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS SELECT {columns} FROM {stored}"
        )


def save_json(df: DataFrame, path: str) -> None:
    """One JSON object per row in the row order given; NULLs are written out.

    JSON has no infinities, so those become NULL as well.
    """
    plain = df.select(
        *(
            finite(F.col(f.name)).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
            for f in df.schema
        )
    )
    plain.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
