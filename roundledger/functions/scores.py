"""Per-prediction scores as columns over a prediction joined to its match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_or_negative_infinity(value: Column) -> Column:
    """Base-2 logarithm that is minus infinity at zero; Spark's own is NULL there."""
    return F.when(value <= 0, F.lit(float("-inf"))).otherwise(F.log2(value))


def drawn() -> Column:
    return F.col("winnerId").isNull() & (F.col("margin") == 0)


def tip() -> Column:
    """1 for a correct pick, 0 for a wrong one, NULL while not known."""
    return F.col("isCorrect").cast("int")


def absolute_error() -> Column:
    """Distance of the predicted margin from the margin seen from the pick."""
    picked = F.col("winnerId") == F.col("predictedWinnerId")
    actual = (
        F.when(picked, F.col("margin")).when(~picked, -F.col("margin")).when(drawn(), 0)
    )
    return F.abs(F.col("predictedMargin") - actual)


def information_bits() -> Column:
    """Dowe et al.'s information score of a win probability, in bits.

    Unplayed matches and predictions without a probability score NULL.
    """
    played = F.col("margin").isNotNull()
    picked = F.col("winnerId") == F.col("predictedWinnerId")
    won = log2_or_negative_infinity(F.col("predictedWinProbability"))
    lost = log2_or_negative_infinity(1 - F.col("predictedWinProbability"))
    return (
        F.when(played & picked, 1 + won)
        .when(played & ~picked, 1 + lost)
        .when(drawn(), 1 + (won + lost) / 2)
    )


def recomputed_correctness(draws_count: bool = False) -> Column:
    """Whether the pick won, from the result; NULL for an unplayed match."""
    return F.when(
        F.col("margin").isNotNull(),
        F.when(drawn(), F.lit(draws_count)).otherwise(
            F.col("predictedWinnerId") == F.col("winnerId")
        ),
    )
