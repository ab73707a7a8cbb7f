"""Mixing sources to target weights: capped water-filling and seeded repetition.

Targets: every source asks for its share of all words; those above their most
epochs are clamped, and what they leave is shared again by weight among the
rest, until none is above. Each round is one aggregate over the sources.

Sample: a source is repeated whole as often as its target holds it, and the
fraction left is taken from its documents in a seeded random order, up to the
word. The order is found with totals of hash buckets, so that no task has to
sort a source: only the one bucket in which the fraction ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundledger.llm.shared import stored, text_key, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
# A bucket holds this part of a source; prefix sums run over the buckets.
BUCKETS = 4096


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` plus ``rank`` by code point from 0, NULL last.

    The order is a distributed sort; what each sorted part holds before it is
    counted by part, so no task sees all sources.
    """
    parts = stored(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn(
            "_at", F.monotonically_increasing_id()
        ),
        "mix-sources",
    )
    part = F.shiftright("_at", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    return (
        parts.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )


def water_fill(
    sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: float = MOST_EPOCHS
) -> DataFrame:
    """``source``, ``source_size``, ``target`` of sources with their sizes.

    Weights go round by rank. A source without words has target 0. The targets
    add up to all words if the weights are positive and ``most_epochs`` is at
    least 1.
    """
    by_rank = F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")
    )
    state = stored(
        ranked_sources(sources).select(
            "source", "source_size", by_rank.alias("weight"),
            (F.col("source_size") * F.lit(float(most_epochs))).alias("most"),
        ),
        "mix-weights",
    )
    total = state.agg(F.sum("source_size").alias("n")).first().n or 0
    # A clamped source stays clamped: the level only rises from round to round.
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level >= F.col("most")
        now = state.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.coalesce(F.sum(above.cast("long")), F.lit(0)).alias("clamped"),
        ).first()
        if now.clamped == clamped or not now.open:
            break
        clamped, level = now.clamped, (total - now.held) / now.open
    filled = F.least(F.col("most"), F.col("weight") * F.lit(level or 0.0))
    return state.select("source", "source_size", filled.alias("target"))


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most_epochs: float = MOST_EPOCHS,
    seed: int = 17,
    carry: tuple[str, ...] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` counts words; NULL and empty texts have none and are never taken.
    NULL is a source of its own. ``taken`` are the words the mix takes from the
    row: its size times the whole repetitions, plus all, none or, for at most
    one row of a source, some of it once more. Equal seeds give equal mixes;
    repeated rows count each for itself and tie, so which of two equal rows is
    taken is open but changes no value. An empty table gives an empty result.
    """
    columns = list(dict.fromkeys([doc_id, *carry]))
    drawn = F.xxhash64(F.lit(seed), text_key(doc_id, text))
    sized = stored(
        docs.select(
            *(F.col(c) for c in columns),
            F.col(source).alias("_source"),
            word_count(F.col(text)).alias("size"),
            F.pmod(drawn, F.lit(buckets)).alias("_bucket"),
            drawn.alias("_drawn"),
        ),
        "mix-sized",
    )
    in_bucket = stored(
        sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets"
    )
    targets = stored(
        water_fill(
            in_bucket.groupBy(F.col("_source").alias("source")).agg(
                F.sum("_words").alias("source_size")
            ),
            weights,
            most_epochs,
        ),
        "mix-targets",
    )
    # At most ``buckets`` rows of a source are summed up in order.
    by_bucket = Window.partitionBy("_source").orderBy("_bucket")
    # At least one word is needed for a ratio; without one nothing is taken.
    epochs = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    plan = (
        in_bucket.withColumn("_before", F.sum("_words").over(by_bucket) - F.col("_words"))
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .select(
            F.col("_source").alias("_of"), F.col("_bucket").alias("_in"), "source_size", "target",
            F.floor(epochs).alias("_whole"),
            F.round(F.col("target") - F.floor(epochs) * F.col("source_size")).cast("long")
            .alias("_rest"),
            "_before", "_words",
        )
        .withColumn(
            "_cut",
            (F.col("_before") < F.col("_rest"))
            & (F.col("_rest") < F.col("_before") + F.col("_words")),
        )
    )
    planned = sized.join(
        plan, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in"))
    )
    whole = F.col("size") * F.col("_whole")
    out = [*columns, "size", "source_size", "target"]
    plain = planned.where("not _cut").select(
        *out,
        (whole + F.when(F.col("_before") < F.col("_rest"), F.col("size")).otherwise(0)).alias(
            "taken"
        ),
    )
    in_order = Window.partitionBy("_source", "_bucket").orderBy("_drawn", doc_id, "size")
    start = F.col("_before") + F.sum("size").over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - start))
    cut = planned.where("_cut").select(*out, (whole + part).alias("taken"))
    return plain.unionByName(cut)


def first_words(text, count):
    """The text up to the end of its ``count``-th word."""
    pieces = F.regexp_extract_all(
        text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)
    )
    return F.array_join(F.slice(pieces, 1, count.cast("int")), "")


def repeated(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options
) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, with the same columns.

    A row taken in part comes once more, cut after its last word taken, with
    ``n_chars`` to match where there is such a column. What is taken is worked
    out without the texts, which are then shuffled once. Rows equal in id and
    text are taken together, with the other columns of one of them. NULL, empty
    and blank texts are never taken, NULL ids and sources are values like others,
    texts of any length are kept to the word, an empty table gives an empty result.
    Further columns stay as they are, whatever their names.
    """
    # The row as one column, so that no name can clash.
    keyed = docs.select(
        F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(doc_id).alias("_doc"),
        F.col(source).alias("_of"), text_key(doc_id, text).alias("_key"),
    )
    mixed = mix_sources(keyed, "_text", "_doc", "_of", carry=("_key",), **options)
    size = F.greatest(F.col("size"), F.lit(1))
    left = F.col("taken") % size
    # At most one row of a source is cut; NULL stands for a whole copy.
    taken = (
        mixed.where("taken > 0")
        .groupBy("_key")
        .agg(
            F.sum(F.floor(F.col("taken") / size)).cast("int").alias("_whole"),
            F.collect_list(F.when(left > 0, left)).alias("_cuts"),
        )
        .select(
            "_key", F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("_whole")), "_cuts")
            .alias("_copies"),
        )
    )
    copies = (
        keyed.select("_key", "_row").join(taken, "_key").dropDuplicates(["_key"])
        .select("_row", F.explode("_copies").alias("_cut"))
    )
    row = F.col("_row")
    shown = F.when(F.col("_cut").isNull(), row[text]).otherwise(
        first_words(row[text], F.coalesce("_cut", F.lit(0)))
    )
    changed = {text: shown}
    if "n_chars" in docs.columns:
        length = F.length(shown).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_cut").isNull(), row["n_chars"]).otherwise(length)
    return copies.select(*(changed.get(c, row[c]).alias(c) for c in docs.columns))
