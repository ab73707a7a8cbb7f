"""A hand-made league, small enough to check by eye.

2020: principal m (margins), secondary p (probabilities); 2021 has no
predictions; match 9 lies outside every season.
"""

from datetime import datetime, timezone

from pyspark.sql import SparkSession

from roundledger.schemas import SCHEMAS, Tables

UTC = timezone.utc


def at(year: int, month: int, day: int, hour: int = 0) -> datetime:
    return datetime(year, month, day, hour, tzinfo=UTC)


NOW = at(2022, 1, 1)

ROWS = {
    "team": [(1, "Ants"), (2, "Bees"), (3, "Cats")],
    "season": [(1, 2020), (2, 2021)],
    "ml_model": [
        (1, "m", None, True, "margin", True),
        (2, "p", "odds", False, "win_probability", True),
        (3, "X", None, False, "margin", False),
    ],
    "ml_model_season": [
        (1, True, True, 1, 1),
        (2, False, True, 1, 2),
        (3, False, False, 1, 3),
        (4, True, True, 2, 1),
    ],
    # id, start, round, venue, margin, winner, season
    "match": [
        (1, at(2020, 3, 1), 1, "Oval", 10, 1, 1),
        (2, at(2020, 3, 2), 1, "Oval", 0, None, 1),
        (3, at(2020, 3, 8), 2, "Park", 30, 2, 1),
        (4, at(2020, 3, 9), 2, None, None, None, 1),
        (5, at(2021, 3, 1), 1, None, 5, 3, 2),
        (9, at(2019, 12, 31, 23), 1, "Oval", 7, 1, None),
    ],
    # id, margin, match, model, winner, correct, probability, created, updated
    "prediction": [
        (11, 4.0, 1, 1, 1, True, None, NOW, NOW),
        (12, None, 1, 2, 2, False, 0.75, NOW, NOW),
        (13, 1.0, 1, 3, 1, True, None, NOW, NOW),
        (21, 6.0, 2, 1, 1, False, None, NOW, NOW),
        (22, None, 2, 2, 1, False, 0.5, NOW, NOW),
        (31, 12.0, 3, 1, 1, False, None, NOW, NOW),
        (32, None, 3, 2, 2, True, 0.5, NOW, NOW),
        (41, 3.0, 4, 1, 2, None, None, NOW, NOW),
        (91, 3.0, 9, 1, 1, True, None, NOW, NOW),
    ],
    "team_match": [
        (1, True, 70, 1, 1), (2, False, 60, 1, 2),
        (3, True, 50, 2, 1), (4, False, 50, 2, 3),
        (5, True, 40, 3, 1), (6, False, 70, 3, 2),
    ],
}


def tiny_tables(spark: SparkSession, **rows: list) -> Tables:
    content = ROWS | rows
    return Tables(
        **{table: spark.createDataFrame(content[table], SCHEMAS[table]) for table in SCHEMAS}
    )


def tuples(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
