"""Fingerprints of tables: do two hold the same rows, wherever and in whatever order?

A row is written as one text, the text is hashed, and 64 bits of all hashes are
added up. The sum is the same for any order and division of the rows, and other
engines can work it out from the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.schemas import SCHEMAS

# Doubles are compared to this many places.
PLACES = 6


def canonical_text(column: str, kind: T.DataType) -> Column:
    """A value as text that does not depend on how an engine prints numbers.

    Doubles are whole multiples of 10^-6, times are microseconds, texts carry
    their length in bytes, and NULL differs from all of them.
    """
    value = F.col(column)
    if kind == T.DoubleType():
        text = F.round(value * 10**PLACES).cast("decimal(38,0)").cast("string")
    elif kind == T.TimestampType():
        text = F.unix_micros(value).cast("string")
    elif kind == T.StringType():
        text = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("-null-"))


def row_hash(table: str) -> Column:
    """64 bits of the MD5 of a row's text, columns in the declared order."""
    text = F.concat_ws("|", *(canonical_text(f.name, f.dataType) for f in SCHEMAS[table]))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def table_fingerprint(df: DataFrame, table: str) -> DataFrame:
    """(rows, checksum) of a table: its number of rows and the sum of their hashes.

    One aggregate with partial sums; repeated rows count each.
    """
    total = F.sum(row_hash(table)).cast("decimal(38,0)")
    return df.agg(
        F.count("*").alias("rows"), F.coalesce(total, F.lit(0)).cast("string").alias("checksum")
    )
