"""Old-format tables brought to the present schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundledger.operators.quality import overlong_text, require_empty
from roundledger.schemas import SCHEMAS, Tables
from roundledger.session import configure

# Names of the tables in the old format.
OLD_TABLE_NAMES = {
    "match": "server_match",
    "prediction": "server_prediction",
    "team_match": "server_teammatch",
    "team": "server_team",
    "ml_model": "server_mlmodel",
}


# The texts the old format limits.
LIMITED_TEXTS = {"match": ("venue",), "team": ("name",), "ml_model": ("name",)}
# Columns the old format never had.
ADDED_COLUMNS = {"match": ("seasonId",)}


def old_name(column: str) -> str:
    """``camelCase`` as the old format writes it."""
    return re.sub(r"(?<=[a-z])([A-Z])", r"_\1", column).lower()


def evolve_table(df: DataFrame, table: str) -> DataFrame:
    """Rename, widen and complete an old-format table.

    The columns the old format never had are added empty; any other that is
    missing is an error. Everything is one projection, so it costs nothing
    beyond the scan.
    """
    by_old_name = {old_name(field.name): field.name for field in SCHEMAS[table]}
    renamed = df.withColumnsRenamed(by_old_name)
    absent = {f.name for f in SCHEMAS[table]} - set(renamed.columns)
    if unknown := absent - set(ADDED_COLUMNS.get(table, ())):
        raise ValueError(f"{OLD_TABLE_NAMES[table]} lacks {sorted(map(old_name, unknown))}")
    return renamed.select(
        *(
            (F.lit(None) if f.name in absent else F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[table]
        )
    )


def evolve_tables(old: dict[str, DataFrame]) -> Tables:
    """All tables from old-format ones; seasons and their flags start out empty."""
    some = next(iter(old.values()))
    empty = {
        table: some.sparkSession.createDataFrame([], SCHEMAS[table])
        for table in ("season", "ml_model_season")
    }
    evolved = {table: evolve_table(old[table], table) for table in OLD_TABLE_NAMES}
    return Tables(**evolved, **empty)


def load_old_tables(spark: SparkSession, root: str) -> Tables:
    """Old-format parquet tables under ``root``, evolved.

    Texts longer than the old format holds fail the load.
    """
    configure(spark)
    tables = evolve_tables(
        {table: spark.read.parquet(f"{root}/{name}") for table, name in OLD_TABLE_NAMES.items()}
    )
    for table, columns in LIMITED_TEXTS.items():
        require_empty(overlong_text(tables[table], *columns), f"{table} holds too long a text")
    return tables


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """Give omitted or empty columns the table's default values."""
    defaults = {
        "ml_model_season": {"isPrincipal": F.lit(False), "isUsedInCompetitions": F.lit(False)},
        "prediction": {"createdAt": F.current_timestamp(), "updatedAt": F.current_timestamp()},
    }.get(table, {})
    present = set(df.columns)
    filled = {
        name: F.coalesce(F.col(name), default) if name in present else default
        for name, default in defaults.items()
    }
    return df.withColumns(filled) if filled else df
