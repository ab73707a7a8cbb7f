"""Reading the seven tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roundledger.schemas import SCHEMAS, TABLE_NAMES, Tables
from roundledger.session import configure


def load_tables(spark: SparkSession, root: str, shuffle_bytes: int | None = None) -> Tables:
    """Parquet tables under ``root``, one folder each, with the declared schemas.

    Like every loader this sets the session's time zone, ANSI and adaptive
    settings (``configure``), and its shuffle width if ``shuffle_bytes`` is given.
    """
    configure(spark, shuffle_bytes)
    return Tables(
        **{
            table: spark.read.schema(SCHEMAS[table]).parquet(f"{root}/{name}")
            for table, name in TABLE_NAMES.items()
        }
    )


def database_tables(spark: SparkSession, database: str) -> Tables:
    """Tables or views of a catalog database."""
    configure(spark)
    return Tables(
        **{
            table: conform(spark.table(f"`{database}`.`{name}`"), table)
            for table, name in TABLE_NAMES.items()
        }
    )


def jdbc_tables(
    spark: SparkSession, url: str, properties: dict[str, str], partitions: int = 64
) -> Tables:
    """Tables of a live database, each read by ranges of its key.

    Needs the database's driver on the class path. The key range is asked for
    first, so that the ranges cover the table evenly.
    """
    configure(spark)
    return Tables(
        **{table: _jdbc_table(spark, url, table, properties, partitions) for table in TABLE_NAMES}
    )


def _jdbc_table(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], partitions: int
) -> DataFrame:
    def read(**options: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, **properties, **options).load()

    bounds = read(query=f'SELECT min(id) AS lo, max(id) AS hi FROM "{TABLE_NAMES[table]}"').first()
    return conform(read(**jdbc_options(table, bounds.lo, bounds.hi, partitions)), table)


def jdbc_options(table: str, low: int | None, high: int | None, partitions: int) -> dict[str, str]:
    """Options of a partitioned read; an empty table is read in one piece."""
    options = {"dbtable": f'"{TABLE_NAMES[table]}"'}
    if low is not None:
        options |= {
            "partitionColumn": "id",
            "lowerBound": str(low),
            "upperBound": str(high + 1),
            "numPartitions": str(partitions),
        }
    return options


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and of the declared types."""
    return df.selectExpr(
        *(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in SCHEMAS[table])
    )
