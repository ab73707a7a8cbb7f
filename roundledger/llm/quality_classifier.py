"""Quality by compression: which dictionary, of good or bad texts, helps more.

Two Zstandard dictionaries are built from labelled good and bad texts. A text
is compressed with each; its sizes, normalised by its length, and their
difference go through a logistic calibration fitted on labelled texts that no
dictionary has seen. Language, source and id are never inputs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.llm.shared import fold, texts_of

# About so many labelled texts of a class are used for fitting, drawn by hash.
SAMPLE_TEXTS = 2500
DICTIONARY_BYTES = 64 * 1024
PIECE_BYTES = 512
LEVEL = 3
FOLDS = 5
LEAST_SCORE = 0.3


def build_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from pieces of the texts, plain content if there are too few."""
    pieces = [
        text[at : at + PIECE_BYTES] for text in texts for at in range(0, len(text), PIECE_BYTES)
    ]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


class SizeFeatures:
    """The normalised compressed sizes of a text under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress = [_compressor(d) for d in (good, bad)]

    def of(self, text: bytes) -> tuple[float, float, float]:
        good, bad = (len(c.compress(text)) for c in self.compress)
        size = len(text) + 1
        return (bad - good) / max(good, bad), (bad - good) / size, (good + bad) / 2 / size


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL)
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)


def fit_logistic(
    features: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1.0
) -> np.ndarray:
    """Intercept and slopes on the features as they are, by Newton's method."""
    centre = features.mean(axis=0)
    spread = features.std(axis=0) + 1e-9
    x = np.c_[np.ones(len(features)), (features - centre) / spread]
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - ridge @ w
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / spread
    return np.r_[w[0] - slopes @ centre, slopes]


def fit_model(rows: list[tuple[bytes, int, float]]) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries and calibration from (text, label, weight).

    Every other text of a class builds its dictionary, the rest calibrate. With
    a class missing the score is the smoothed share of good texts.
    """
    parts = {label: [r for r in rows if r[1] == label] for label in (1, 0)}
    good, bad = (build_dictionary([r[0] for r in parts[label][::2]]) for label in (1, 0))
    held = parts[1][1::2] + parts[0][1::2]
    if not parts[1][1::2] or not parts[0][1::2]:
        share = (len(parts[1]) + 1) / (len(rows) + 2)
        return good, bad, [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0]
    sizes = SizeFeatures(good, bad)
    features = np.array([sizes.of(text) for text, _, _ in held])
    labels = np.array([label for _, label, _ in held], float)
    weights = np.array([weight for _, _, weight in held])
    weights *= len(held) / weights.sum()
    return good, bad, fit_logistic(features, labels, weights).tolist()


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample_texts: int = SAMPLE_TEXTS,
) -> tuple[bytes, bytes, list[float]]:
    """The model, from labelled texts outside the held-out fold.

    One task fits it on the bounded sample; only the dictionaries and four
    numbers reach the driver. Of several labels of an id the lowest counts.
    """
    usable = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .where(fold(doc_id, FOLDS) != 0)
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.min(label).cast("int").alias("_label"))
    )
    counted = usable.groupBy("_label").agg(F.count("*").alias("n"))
    counts = {row["_label"]: row["n"] for row in counted.collect()}  # two classes at most
    scale = 1 << 30
    share = F.lit(0)
    weight = F.lit(1.0)
    for value, n in counts.items():
        part = min(1.0, sample_texts / n)
        share = F.when(F.col("_label") == value, int(part * scale)).otherwise(share)
        weight = F.when(F.col("_label") == value, 1.0 / part).otherwise(weight)
    drawn = F.xxhash64("_id")
    chosen = usable.where(F.pmod(drawn, F.lit(scale)) < share).withColumn("_weight", weight)
    # About twice ``sample_texts`` small rows at most, so texts are not shuffled.
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), "_id"
    )
    schema = "good binary, bad binary, weights array<double>"

    def run(batches):
        rows = []
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            rows += zip(
                ids, texts_of(batch.column("_text")), batch.column("_label").to_pylist(),
                batch.column("_weight").to_pylist(),
            )
        rows.sort(key=lambda r: (hash_order(r[0]), r[1]))
        good, bad, weights = fit_model([r[1:] for r in rows])
        yield pa.RecordBatch.from_pylist([{"good": good, "bad": bad, "weights": weights}])

    fitted = sample.select("_id", "_text", "_label", "_weight").repartition(1)
    row = fitted.mapInArrow(run, schema).first()
    if row is None:
        return b"", b"", [0.0, 0.0, 0.0, 0.0]
    return bytes(row.good), bytes(row.bad), list(row.weights)


def hash_order(value) -> int:
    """A fixed pseudo-random order of ids."""
    return int.from_bytes(hashlib.blake2b(str(value).encode(), digest_size=8).digest())


def score_texts(
    docs: DataFrame,
    model: tuple[bytes, bytes, list[float]],
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Carried columns, ``score`` and ``predicted`` of every whole text.

    NULL counts as empty; empty texts get a score like any other. Repeated rows
    are scored each.
    """
    good, bad, weights = model
    source = docs.select(
        F.struct(*(F.col(c) for c in carry)).alias("_row"), F.col(text).alias("_text")
    )
    schema = T.StructType([source.schema["_row"]]).add("score", "double")

    def run(batches):
        sizes = SizeFeatures(good, bad)
        slopes = np.array(weights[1:])
        for batch in batches:
            if batch.num_rows:
                features = np.array([sizes.of(t) for t in texts_of(batch.column("_text"))])
                odds = np.clip(weights[0] + features @ slopes, -30, 30)
                scores = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), pa.array(scores, pa.float64())], schema.names
                )

    return source.mapInArrow(run, schema).select(
        *(F.col(f"_row.`{c}`").alias(c) for c in carry),
        "score",
        (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"),
    )


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``.

    An empty table gives an empty result; without labels every score is 0.5.
    """
    model = train(docs, labels, text, doc_id)
    scored = score_texts(docs, model, text, (doc_id,))
    return scored.select(
        doc_id, (fold(doc_id, FOLDS) == 0).alias("held_out"), "score", "predicted"
    )


def drop_bad(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The rows of ``docs`` not judged bad, with their columns."""
    model = train(docs, labels, text, doc_id)
    scored = score_texts(docs, model, text, tuple(docs.columns))
    return scored.where("predicted = 1").select(*docs.columns)
