"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space (space, \t, \n, \v, \f, \r).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

# bytes.split() without an argument splits at exactly the six blanks above.
_MEMO_WORDS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Later steps then restart from files, not from the whole lineage, when an
    executor is lost, and values given by task (row keys) are fixed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; NULL becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_key(*columns: str) -> Column:
    """A 64-bit hash that also tells NULL from absent values."""
    return F.xxhash64(*(c for name in columns for c in (F.col(name).isNull(), F.col(name))))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, NULL as empty, modulo ``folds``."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value, NULL as empty."""
    binary = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return [value or b"" for value in binary.to_pylist()]


def buffered(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int
) -> Iterator[pa.Table]:
    """Batches joined into tables of about ``most_bytes`` of one column."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class WordMemo(dict):
    """Values by word, worked out once per word; bounded, emptied when full."""

    def __init__(self, value, most: int = _MEMO_WORDS):
        super().__init__()
        self.value = value
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.value(word)
        return found

    def of(self, words: list, dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


def to_64(value: int) -> int:
    """An unsigned 64-bit number as Spark's signed one."""
    return value - (1 << 64) if value >= 1 << 63 else value


def mix64(values: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values, one to one."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k`` word windows; shorter texts give one window."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return total
