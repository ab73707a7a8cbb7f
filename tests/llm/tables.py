"""Small tables with the cases every operator must stand."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "_id long, _row long, key long, id long, length long, score double, word string"


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame(
        [(*row, len(row[1]) if row[1] is not None else None) for row in rows], DOCS
    )


def awkward(spark: SparkSession) -> DataFrame:
    """NULLs in any column, blank and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    return docs(
        spark,
        [
            (1, None, "en", "a"),
            (2, "", "en", "a"),
            (3, " \n\t ", None, None),
            (4, long, "en", "b"),
            (5, "Same text here, SAME words.", "en", "a"),
            (6, "same text HERE, same words.", "de", None),
            (7, "ärger über ÖL   und straße", None, "b"),
            (7, "ärger über ÖL   und straße", None, "b"),
            (8, "one", "en", "a"),
            (None, "no id at all", "en", "a"),
            (None, None, None, None),
            (9, "<|endoftext|> \x00 'tis étude", "fr", "c"),
        ],
    )


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
