"""Runtime settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Only settings that change results or keep a plan whole under skew belong
# here; shuffle width and memory stay with whoever runs the cluster.
SETTINGS = {
    # Years are UTC years, for season assignment and for the years query alike.
    "spark.sql.session.timeZone": "UTC",
    # Overflow and bad casts fail instead of turning into wrong numbers.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot match even where the split costs the following aggregate one
    # more exchange; the exchange is only added when skew is seen.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Skip the sort of a join whose shuffled partitions all turn out this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


# Bytes a shuffled partition should hold.
PARTITION_BYTES = 256 * 2**20


def configure(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the settings to a running session and return it.

    ``shuffle_bytes``, the expected size of the largest shuffle (the used
    columns of the predictions), sets how many partitions shuffles start with.
    Small shuffles are merged back to fewer at run time.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffle_bytes is not None:
        partitions = -(-shuffle_bytes // PARTITION_BYTES)
        spark.conf.set(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(partitions, 1))
        )
    return spark


def working_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, for results used several times.

    It lies in ``spark.checkpoint.dir``; only a local session without one gets a
    folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="roundledger-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
