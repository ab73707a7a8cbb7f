"""Round totals that can be kept and merged.

Sums are decimals and minus infinities are counted apart, so a contribution
taken off leaves exactly what was there before it was added, in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Digits kept behind the point of a sum.
SCALE = 12
KEYS = ("year", "seasonId", "roundNumber", "mlModelId")
PARTS = ("predictions", "sumTip", "nTip", "sumAbsError", "nAbsError", "sumBits", "nBits", "lostBits")
TOTALS_SCHEMA = (
    "year int, seasonId int, roundNumber int, mlModelId int, predictions bigint, "
    f"sumTip bigint, nTip bigint, sumAbsError decimal(38,{SCALE}), nAbsError bigint, "
    f"sumBits decimal(38,{SCALE}), nBits bigint, lostBits bigint"
)


def _exact(score: Column) -> Column:
    return F.sum(score.cast(f"decimal(28,{SCALE})")).cast(f"decimal(38,{SCALE})")


def mergeable_totals(scored: DataFrame) -> DataFrame:
    """``round_totals`` in parts that add up: one pass over scored predictions."""
    certain = F.col("bits") == F.lit(float("-inf"))
    return scored.groupBy(*KEYS).agg(
        F.count("*").alias("predictions"),
        F.coalesce(F.sum("tip"), F.lit(0)).alias("sumTip"),
        F.count("tip").alias("nTip"),
        F.coalesce(_exact(F.col("absError")), F.lit(0)).cast(f"decimal(38,{SCALE})").alias("sumAbsError"),
        F.count("absError").alias("nAbsError"),
        F.coalesce(_exact(F.when(~certain, F.col("bits"))), F.lit(0))
        .cast(f"decimal(38,{SCALE})")
        .alias("sumBits"),
        F.count("bits").alias("nBits"),
        F.count(F.when(certain, 1)).alias("lostBits"),
    )


def taken_off(totals: DataFrame) -> DataFrame:
    """The same totals as a contribution to be removed."""
    return totals.select(*KEYS, *((-F.col(p)).alias(p) for p in PARTS))


def merge_totals(*parts: DataFrame) -> DataFrame:
    """Totals added up; rounds and models without any prediction left are gone."""
    together = reduce(DataFrame.unionByName, parts)
    kinds = {"sumAbsError": f"decimal(38,{SCALE})", "sumBits": f"decimal(38,{SCALE})"}
    return (
        together.groupBy(*KEYS)
        .agg(*(F.sum(p).cast(kinds.get(p, "bigint")).alias(p) for p in PARTS))
        .filter("predictions <> 0")
    )


def as_round_totals(totals: DataFrame) -> DataFrame:
    """In the form of ``metrics.round_totals``: NULL sums where nothing counts."""
    bits = F.when(F.col("lostBits") > 0, F.lit(float("-inf"))).otherwise(
        F.col("sumBits").cast("double")
    )
    return totals.select(
        *KEYS,
        F.when(F.col("nTip") > 0, F.col("sumTip")).alias("sumTip"),
        F.when(F.col("nAbsError") > 0, F.col("sumAbsError").cast("double")).alias("sumAbsError"),
        F.when(F.col("nBits") > 0, bits).alias("sumBits"),
        "nTip", "nAbsError", "nBits",
    )


def running_totals(totals: DataFrame) -> DataFrame:
    """Totals of each season up to and including a round, per model."""
    to_date = (
        Window.partitionBy("year", "seasonId", "mlModelId")
        .orderBy("roundNumber")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kinds = dict(c.rsplit(" ", 1) for c in TOTALS_SCHEMA.split(", "))
    return totals.select(
        *KEYS, *(F.sum(p).over(to_date).cast(kinds[p]).alias(p) for p in PARTS)
    )


def refresh_running(running: DataFrame, totals: DataFrame, changed: DataFrame) -> DataFrame:
    """``running`` brought up to date from the first changed round of each season on.

    ``changed`` (``year``, ``roundNumber``) names the changed rounds. Rows before
    the first one stay; the last of them, per model, starts the sums that follow.
    """
    first = changed.groupBy("year").agg(F.min("roundNumber").alias("firstChanged"))
    before = running.join(first, "year", "left").filter(
        "firstChanged IS NULL OR roundNumber < firstChanged"
    )
    last = Window.partitionBy("year", "seasonId", "mlModelId").orderBy(F.desc("roundNumber"))
    start = (
        before.filter("firstChanged IS NOT NULL")
        .withColumn("back", F.row_number().over(last))
        .filter("back = 1")
    )
    columns = [*KEYS, *PARTS]
    later = totals.join(first, "year").filter("roundNumber >= firstChanged")
    # Starts come before all changed rounds of their season: they add to the sums
    # and are left out again.
    together = start.select(*columns).unionByName(later.select(*columns))
    after = running_totals(together).join(first, "year").filter("roundNumber >= firstChanged")
    return before.select(*columns).unionByName(after.select(*columns))
