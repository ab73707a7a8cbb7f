"""A league kept in files and changed as a whole.

Every table is stored by part, its season or year, and every change writes the
parts it touches under a run of its own. Which runs are current is said by one
small file per version, written last: readers see all of a change or none of
it, and what an interrupted change has written is never named, so it is simply
run again. Facts without a season of their own are stored under that of their
match, so a request for one season reads only its own predictions.

One change at a time: of two written at once the one that is named last wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.operators.quality import (
    require_references,
    require_unique,
    require_watched,
    watched,
)
from roundledger.operators.totals import TOTALS_SCHEMA
from roundledger.schemas import SCHEMAS, TABLE_NAMES, Tables
from roundledger.session import configure
from roundledger.sources.store import LAYOUTS, SCORED_LAYOUT, SCORED_SCHEMA, Layout, _arranged

# Results that follow from the tables, stored by year.
RESULTS = {
    "scored": ("Scored", SCORED_SCHEMA),
    "totals": ("RoundTotals", TOTALS_SCHEMA),
    "running": ("RunningTotals", TOTALS_SCHEMA),
    "documents": ("Documents", "year int, document string"),
}
NAMES = TABLE_NAMES | {result: name for result, (name, _) in RESULTS.items()}
# The column whose value is a row's part; the other tables are one part each.
PART = {"match": "seasonId", "prediction": "seasonId", "team_match": "seasonId"} | dict.fromkeys(
    RESULTS, "year"
)
# Facts that have their match's season as a layout column.
BY_MATCH = ("prediction", "team_match")
_VERSIONS = "tableName string, part int, run string, version int"


def _schema(table: str) -> T.StructType:
    """A table's columns, with the part and run they are stored under."""
    if table in RESULTS:
        columns = T.StructType.fromDDL(RESULTS[table][1])
    else:
        columns = T.StructType([*SCHEMAS[table]])
    if table in PART and PART[table] not in columns.names:
        columns.add(PART[table], T.IntegerType())
    return columns


def parts_of(rows: DataFrame, table: str) -> list[int | None]:
    """The parts that hold ``rows``: one value per season or year."""
    if table not in PART:
        return [None]
    return [row[0] for row in rows.select(PART[table]).distinct().collect()]


def in_parts(table: str, parts: Iterable[int | None]) -> Column:
    """Whether a row lies in one of the parts; decides on folders alone."""
    parts = list(parts)
    column = F.col(PART[table])
    within = column.isin([p for p in parts if p is not None])
    return F.coalesce(within, F.lit(False)) | column.isNull() if None in parts else within


class Version:
    """Which runs hold the current parts of each table."""

    def __init__(self, number: int, runs: frozenset[tuple[str, int | None, str]]):
        self.number = number
        self.runs = runs

    def replaced(
        self, table: str, gone: Iterable[int | None], written: Iterable[int | None], run: str
    ) -> Version:
        """With the parts ``gone`` left out and those ``written`` by ``run`` added."""
        gone = set(gone)
        kept = {r for r in self.runs if r[0] != table or r[1] not in gone}
        return Version(self.number, frozenset(kept | {(table, part, run) for part in written}))


def current_version(spark: SparkSession, root: str) -> Version:
    """The last version that was named."""
    rows = spark.read.schema(_VERSIONS).parquet(f"{root}/Versions")
    last = rows.agg(F.max("version").alias("version")).first().version
    named = rows.filter(F.col("version") == last).collect()
    return Version(last, frozenset((r.tableName, r.part, r.run) for r in named))


def read_table(spark: SparkSession, root: str, table: str, version: Version) -> DataFrame:
    """A table, or result, as of a version.

    The runs wanted are compared with the folders' names, before any file is read.
    """
    schema = _schema(table)
    stored = T.StructType([*schema]).add("run", "string")
    rows = spark.read.schema(stored).parquet(f"{root}/{NAMES[table]}")
    part = F.col(PART[table]).cast("string") if table in PART else F.lit(None).cast("string")
    keys = [f"{'-' if p is None else p}/{run}" for name, p, run in version.runs if name == table]
    name = F.concat(F.coalesce(part, F.lit("-")), F.lit("/"), F.col("run"))
    return rows.filter(name.isin(sorted(keys))).select(*schema.names)


def read_tables(spark: SparkSession, root: str, version: Version | None = None) -> Tables:
    """The seven tables; facts carry the season they are stored under."""
    configure(spark)
    version = version or current_version(spark, root)
    return Tables(**{t: read_table(spark, root, t, version) for t in TABLE_NAMES})


def read_result(spark: SparkSession, root: str, result: str, year: int | None = None) -> DataFrame:
    """Scores, totals or documents as stored, of one year if that is given."""
    rows = read_table(spark, root, result, current_version(spark, root))
    return rows if year is None else rows.filter(F.col("year") == year)


class Change:
    """Parts written for one change, and the version that will name them.

    ``commit`` is the switch. Until then ``tables`` shows what the change makes
    of the league, and readers see the version before it.
    """

    def __init__(self, spark: SparkSession, root: str, first: bool = False):
        configure(spark)
        self.spark, self.root = spark, root
        self.version = Version(0, frozenset()) if first else current_version(spark, root)
        self.run = f"r{self.version.number + 1}-{uuid.uuid4().hex[:12]}"
        self.changed: set[str] = set()
        self._steps = 0

    def tables(self) -> Tables:
        return read_tables(self.spark, self.root, self.version)

    def read(self, table: str) -> DataFrame:
        return read_table(self.spark, self.root, table, self.version)

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written once beside the tables and read back."""
        path = f"{self.root}/Staging/{self.run}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(
        self,
        table: str,
        rows: DataFrame,
        gone: Iterable[int | None] = (),
        matches: DataFrame | None = None,
        placed: bool = False,
    ) -> int:
        """Write rows as parts of this change, in place of the parts ``gone``.

        Facts take their season from ``matches`` (those of this change, if not
        given). Rows that are ``placed`` come from the files of this table: they
        carry their part and stay together as they are, so no shuffle is needed.
        Required values and margins are checked as the rows are written; the
        number of rows is returned.
        """
        self._steps += 1
        run = f"{self.run}-{self._steps}"
        if table in BY_MATCH and not placed:
            matches = self.read("match") if matches is None else matches
            seasons = matches.select(F.col("id").alias("matchId"), "seasonId")
            rows = rows.select(*SCHEMAS[table].names).join(seasons, "matchId", "left")
        schema = _schema(table)
        arranged = _arranged(rows.select(*schema.names), self._layout(table), gathered=placed)
        arranged, observation = watched(arranged, table)
        # The run is a folder around those of the parts: as a column it would
        # have Spark sort all rows a second time.
        path = f"{self.root}/{NAMES[table]}/run={run}"
        folders = [PART[table]] if table in PART else []
        arranged.write.partitionBy(*folders).parquet(path)
        count = require_watched(observation, table)
        written = parts_of(self.spark.read.schema(schema).parquet(path), table)
        self.version = self.version.replaced(table, gone, written, run)
        self.changed.add(table)
        return count

    def _layout(self, table: str) -> Layout:
        if table in BY_MATCH:
            return Layout((), ("seasonId", "matchId"), ("seasonId", "matchId"))
        if table in RESULTS:
            return SCORED_LAYOUT if table == "scored" else Layout((), ("year",), ("year",))
        return LAYOUTS.get(table, Layout())

    def commit(
        self, unique: Iterable[str] = (), references: Iterable[str] = (), natural: bool = True
    ) -> None:
        """Name the new version, once the keys of the tables given are checked.

        A change that brings no new keys needs no check: nothing else is read.
        """
        tables = self.tables()
        require_unique(tables, unique, natural)
        require_references(tables, references)
        rows = [(*entry, self.version.number + 1) for entry in sorted(self.version.runs, key=str)]
        named = self.spark.createDataFrame(rows, _VERSIONS).coalesce(1)
        # One task writes one file, which appears whole or not at all.
        named.write.mode("append").partitionBy("version").parquet(f"{self.root}/Versions")
