"""The seven tables: columns, keys and references, each stated once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def _schema(*columns: str) -> T.StructType:
    """Columns written ``name type``; a trailing ``?`` allows NULL."""
    struct = T.StructType()
    for column in columns:
        name, kind = column.rstrip("?").split()
        struct.add(name, _TYPES[kind], nullable=column.endswith("?"))
    return struct


# Keys of the three fact tables are bigint: 32 bits run out long before the
# data volumes this library is meant for. Dimension keys stay int.
SCHEMAS: dict[str, T.StructType] = {
    "match": _schema(
        "id bigint", "startDateTime timestamp", "roundNumber int", "venue string?",
        "margin int?", "winnerId int?", "seasonId int?",
    ),
    "prediction": _schema(
        "id bigint", "predictedMargin double?", "matchId bigint", "mlModelId int",
        "predictedWinnerId int", "isCorrect boolean?", "predictedWinProbability double?",
        "createdAt timestamp", "updatedAt timestamp",
    ),
    "team_match": _schema(
        "id bigint", "atHome boolean", "score int", "matchId bigint", "teamId int",
    ),
    "season": _schema("id int", "year int"),
    "team": _schema("id int", "name string"),
    "ml_model": _schema(
        "id int", "name string", "description string?", "isPrincipal boolean",
        "predictionType string", "usedInCompetitions boolean",
    ),
    "ml_model_season": _schema(
        "id int", "isPrincipal boolean", "isUsedInCompetitions boolean",
        "seasonId int", "mlModelId int",
    ),
}

# Names the tables carry in files, in a database and in reports.
TABLE_NAMES = {
    "match": "Match",
    "prediction": "Prediction",
    "team_match": "TeamMatch",
    "season": "Season",
    "team": "Team",
    "ml_model": "MlModel",
    "ml_model_season": "MlModelSeason",
}

UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "match": ("startDateTime", "venue"),
    "ml_model": ("name",),
    "ml_model_season": ("seasonId", "mlModelId"),
    "team": ("name",),
    "season": ("year",),
}


class Reference(NamedTuple):
    """A child column that must hold the key of a parent row."""

    child: str
    column: str
    parent: str
    on_delete: str

    @property
    def label(self) -> str:
        return f"{TABLE_NAMES[self.child]}.{self.column}"


REFERENCES = (
    Reference("match", "winnerId", "team", "set null"),
    Reference("match", "seasonId", "season", "set null"),
    Reference("prediction", "matchId", "match", "cascade"),
    Reference("prediction", "mlModelId", "ml_model", "restrict"),
    Reference("prediction", "predictedWinnerId", "team", "restrict"),
    Reference("team_match", "matchId", "match", "cascade"),
    Reference("team_match", "teamId", "team", "restrict"),
    Reference("ml_model_season", "seasonId", "season", "restrict"),
    Reference("ml_model_season", "mlModelId", "ml_model", "restrict"),
)


@dataclass(frozen=True)
class Tables:
    """One DataFrame per table."""

    match: DataFrame
    prediction: DataFrame
    team_match: DataFrame
    season: DataFrame
    team: DataFrame
    ml_model: DataFrame
    ml_model_season: DataFrame

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        for field in fields(self):
            yield field.name, getattr(self, field.name)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def swap(self, **changed: DataFrame) -> "Tables":
        """The same tables with some of them replaced."""
        return replace(self, **changed)


def required_columns(table: str) -> list[str]:
    return [field.name for field in SCHEMAS[table] if not field.nullable]
