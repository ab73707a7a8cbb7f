"""Surrogate keys that need no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last_key(existing: DataFrame) -> Column:
    return existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()


def pair_keys(first: str, second: str, existing: DataFrame, seconds: DataFrame) -> Column:
    """Keys for pairs of positive keys, above those in use in ``existing``.

    The key is arithmetic on the pair, with the largest key of ``seconds`` as
    the step: unique, the same in every run, and without a shuffle or a global
    sort. Like a sequence it may leave gaps.
    """
    step = _last_key(seconds)
    return _last_key(existing) + (F.col(first) - 1) * step + F.col(second)


def append_keys(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Give each fact row a bigint ``id`` above those in use.

    Rows are numbered per task without a shuffle. Write the result before
    using it twice: a recomputation may number rows differently.
    """
    return rows.select(
        (F.monotonically_increasing_id() + _last_key(existing) + 1).alias("id"), "*"
    )


def numbered_by_task(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_task`` and ``_at``, the task and the place in it.

    To be written: once stored, the two are data and number the rows for good.
    """
    low = F.lit((1 << 33) - 1)
    return rows.select(
        "*",
        F.spark_partition_id().alias("_task"),
        F.monotonically_increasing_id().bitwiseAND(low).alias("_at"),
    )


def dense_keys(staged: DataFrame, existing: DataFrame) -> DataFrame:
    """Give staged rows the keys right after those in use, without a gap.

    ``staged`` is ``numbered_by_task`` as it was written. Rows are counted per
    task; a task's keys start after those of the tasks before it, so only the
    counts are ever put in order. The same staged rows get the same keys.
    """
    counts = staged.groupBy("_task").agg(F.count("*").alias("rows"))
    # One row per task that wrote: few enough for one window and a broadcast.
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    key = _last_key(existing) + F.col("_start") + F.col("_at") + 1
    return staged.join(F.broadcast(starts), "_task").select(
        key.alias("id"), *(c for c in staged.columns if c not in ("_task", "_at"))
    )
