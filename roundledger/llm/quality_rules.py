"""Quality rules with thresholds that adapt to each language and source.

Every text is measured once. The measures of a language and source go into
KLL quantile sketches, which merge: each task sketches its own rows before the
shuffle, the sketches of a source are merged, and those of its sources give a
language's. The quartiles give fences far outside the bulk of the group; a
text beyond one is dropped. The fences are joined back to the measures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.llm.shared import stored, texts_of

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words, base rule
SKETCH_K = 4096
# A fence lies this many quartile distances beyond its quartile.
REACH = 3.0
# Smallest quartile distance of each measure: groups in which nearly all texts
# measure alike must not drop the others for a trifle.
LEAST_SPREAD = {
    "symbol_rate": 0.03,
    "dup_line_rate": 0.17,
    "repeat_rate": 0.12,
    "word_length": 0.75,
}
# With so many texts the fences of a source and those of its language weigh the same.
EVEN_TEXTS = 25
# The word length has two sides; the rates are bad when high.
LOW_SIDE = ("word_length",)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    for word in words:
        ids.setdefault(word, len(ids))
    coded = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    # Exact codes: pairs first, so that nothing overflows.
    pairs = coded[:-1] * len(ids) + coded[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * len(ids) + coded[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + n] |= twice
    return int(covered.sum())


def measure_text(content: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = content.split()
    joined = b"".join(words)
    # UTF-8 continuation bytes add no code point.
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    seen, repeated = set(), 0
    for line in content.split(b"\n"):
        if line and not line.isspace():
            repeated += line in seen
            seen.add(line)
    return len(words), chars, symbols, repeated, _repeated_words(words)


def measures(
    docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id", "lang", "source")
) -> DataFrame:
    """Carried columns, the five counts and the rates the fences are set on.

    NULL and empty texts count nothing; their rates are NULL.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    carry = tuple(dict.fromkeys(carry))
    # Carried columns by place, so that their names cannot clash.
    source = docs.select(
        F.struct(*(F.col(c) for c in carry)).alias("_row"), F.col(text).alias("_text")
    )
    schema = T.StructType([source.schema["_row"]])
    for name in (*counts, "n_lines"):
        schema = schema.add(name, "long")

    def run(batches):
        for batch in batches:
            contents = texts_of(batch.column("_text"))
            rows = [(*measure_text(c), c.count(b"\n") + 1) for c in contents]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), *(pa.array(c, pa.int64()) for c in columns)], schema.names
            )

    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return source.mapInArrow(run, schema).select(
        "_row",
        *counts,
        (F.col("n_symbols") / words).alias("symbol_rate"),
        (F.col("n_dup_lines") / F.when(words > 0, F.col("n_lines"))).alias("dup_line_rate"),
        (F.col("n_repeat_words") / words).alias("repeat_rate"),
        (F.col("word_chars") / words).alias("word_length"),
    )


def sketches(rows: DataFrame, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch per measure and group.

    Tables of sketches can be kept and merged with those of later data.
    """
    return rows.groupBy(*keys).agg(
        *(F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in LEAST_SPREAD)
    )


def merged(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of larger groups."""
    return sketched.groupBy(*keys).agg(*(F.kll_merge_agg_double(m).alias(m) for m in LEAST_SPREAD))


def fences(sketched: DataFrame, keys: list[str], reach: float = REACH) -> DataFrame:
    """The limits of each group: ``texts`` measured, and per measure most and least."""

    def quartile(measure: str, q: float):
        # A group without measured texts has no quartiles and no fences.
        some = F.kll_sketch_get_n_double(measure) > 0
        return F.when(some, F.kll_sketch_get_quantile_double(measure, F.lit(q)))

    limits = []
    for measure, least in LEAST_SPREAD.items():
        low, high = quartile(measure, 0.25), quartile(measure, 0.75)
        away = F.lit(reach) * F.greatest(high - low, F.lit(least))
        below = low - away if measure in LOW_SIDE else F.lit(None).cast("double")
        limits.append(F.struct((high + away).alias("most"), below.alias("least")).alias(measure))
    texts = F.kll_sketch_get_n_double(next(iter(LEAST_SPREAD))).alias("texts")
    return sketched.select(*keys, F.struct(texts, *limits).alias("limits"))


def adapted_fences(rows: DataFrame, reach: float, k: int, even_texts: int) -> DataFrame:
    """``of_lang``, ``of_source``, ``limits``: the group's own, drawn to its language's.

    Of n texts, the group's own limits weigh n parts and the language's ``even_texts``.
    """
    sketched = stored(sketches(rows, ["_lang", "_source"], k), "quality-sketches")
    own = fences(sketched, ["_lang", "_source"], reach)
    wide = fences(merged(sketched, ["_lang"]), ["_lang"], reach).select(
        F.col("_lang").alias("_wide"), F.col("limits").alias("_wide_limits")
    )
    texts = F.col("limits.texts")
    part = texts / (texts + F.lit(even_texts))

    def blended(measure: str, side: str):
        own_limit, wide_limit = F.col(f"limits.{measure}.{side}"), F.col(f"_wide_limits.{measure}.{side}")
        return (part * own_limit + (1 - part) * wide_limit).alias(side)

    return own.join(wide, F.col("_lang").eqNullSafe(F.col("_wide"))).select(
        F.col("_lang").alias("of_lang"),
        F.col("_source").alias("of_source"),
        F.struct(
            texts.alias("texts"),
            *(F.struct(blended(m, "most"), blended(m, "least")).alias(m) for m in LEAST_SPREAD),
        ).alias("limits"),
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    reach: float = REACH,
    k: int = SKETCH_K,
    even_texts: int = EVEN_TEXTS,
) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``kept``.

    The base rule fails texts under 50 words and those with more than half of
    their words in repeated windows; NULL and empty texts fail it. Of the rest
    a text is kept if it lies within the fences of its language and source;
    NULL is a language or source like any other. Repeated rows are measured and
    returned each, texts of any length whole. The smaller a group is, the more its
    fences are drawn to those of its language (``even_texts``); equal measures
    give equal verdicts in a group. Further columns play no part.
    """
    rows = stored(
        measures(docs, text, (doc_id, lang, source)).select(
            F.col(f"_row.`{doc_id}`").alias(doc_id),
            F.col(f"_row.`{lang}`").alias("_lang"),
            F.col(f"_row.`{source}`").alias("_source"),
            "*",
        ).drop("_row"),
        "quality-measures",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    # Texts that fail anyway do not shape the thresholds.
    limits = adapted_fences(rows.where(~failed), reach, k, even_texts)
    within = F.lit(True)
    for measure in LEAST_SPREAD:
        fine = F.col(measure) <= F.col(f"limits.{measure}.most")
        if measure in LOW_SIDE:
            fine &= F.col(measure) >= F.col(f"limits.{measure}.least")
        within &= F.coalesce(fine, F.lit(True))
    same = F.col("_lang").eqNullSafe(F.col("of_lang")) & F.col("_source").eqNullSafe(
        F.col("of_source")
    )
    return rows.join(limits, same, "left").select(
        doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & within).alias("kept"),
    )
