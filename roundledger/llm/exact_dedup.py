"""Exact dedup by skew-safe combining in three stages.

1. Each task deduplicates its own rows in buffers of bounded size.
2. The local winners of a digest are dealt over salts and merged per salt.
3. The salt winners of a digest are merged globally.

Each stage compares the full normalised text, never the digest alone: the
digest only gathers texts that may be equal. Texts travel compressed, which
loses nothing: one encoder and level give equal bytes for equal texts only.
Stage 2 sees at most one row of a
group per buffer, and stage 3 at most one per salt, with about as many salts
as the square root of the buffers; so no task gets more than that of one group,
whatever share of all rows the group holds.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.llm.shared import buffered, stored, texts_of

BUFFER_BYTES = 16 * 2**20
LEVEL = 6


def local_groups(docs: DataFrame, buffer_bytes: int, whole: bool) -> DataFrame:
    """``_id`` of ``docs`` (``_id``, ``_text`` and, if ``whole``, ``_doc``) plus ``_row``,
    ``_buffer``, ``_digest``, ``_winner`` (a row of the buffer).

    The winner of a buffer's equal texts is the row with the largest id, the
    last one among equal ids; NULL ids rank lowest. ``_size``, the number of
    equal rows, is given on the winner's row only, and so is the text: as
    ``_content`` or, if ``whole``, within ``_doc``, the row as it came.
    """
    kept = [
        T.StructField(f.name, f.dataType)
        for f in docs.select("_id", *(["_doc"] if whole else [])).schema
    ]
    added = (
        T.StructType()
        .add("_row", "long")
        .add("_buffer", "long")
        .add("_digest", "binary")
        .add("_winner", "long")
        .add("_size", "long")
    )
    if not whole:
        added.add("_content", "binary")

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        partition = TaskContext.get().partitionId()
        row, buffer = partition << 33, partition << 20
        for table in buffered(batches, "_text", buffer_bytes):
            contents = [value.lower() for value in texts_of(table["_text"])]
            ids = table["_id"].to_pylist()
            winners: dict[bytes, int] = {}
            for i, content in enumerate(contents):
                best = winners.get(content)
                if best is None or ids[best] is None or (
                    ids[i] is not None and ids[i] >= ids[best]
                ):
                    winners[content] = i
            sizes = dict.fromkeys(winners, 0)
            for content in contents:
                sizes[content] += 1
            chosen = [winners[content] for content in contents]
            digests = {c: hashlib.sha256(c).digest() for c in winners}
            extra = {
                "_row": pa.array(range(row, row + len(ids)), pa.int64()),
                "_buffer": pa.array([buffer] * len(ids), pa.int64()),
                "_digest": pa.array([digests[c] for c in contents], pa.binary()),
                "_winner": pa.array([row + i for i in chosen], pa.int64()),
                "_size": pa.array(
                    [sizes[c] if chosen[i] == i else None for i, c in enumerate(contents)],
                    pa.int64(),
                ),
            }
            if whole:
                # Only a winner can stay.
                mine = pa.array([chosen[i] == i for i in range(len(ids))])
                doc = table["_doc"].combine_chunks()
                extra["_doc"] = pc.if_else(mine, doc, pa.scalar(None, doc.type))
            else:
                extra["_content"] = pa.array(
                    [compress(c) if chosen[i] == i else None for i, c in enumerate(contents)],
                    pa.binary(),
                )
            table = table.select(["_id"])
            for field in [*kept[1:], *added.fields]:
                table = table.append_column(field.name, extra[field.name])
            row, buffer = row + len(ids), buffer + 1
            yield from table.to_batches(max_chunksize=4096)

    return docs.mapInArrow(run, T.StructType(kept + added.fields))


def _contents(winners: DataFrame, text: str) -> DataFrame:
    """Winners with ``_content``, compressed from the rows they carry."""

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            contents = [compress(value.lower()) for value in texts_of(batch.column("_text"))]
            columns = [batch.column(c) for c in ("_row", "_id", "_digest", "_size", "_buffer")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(contents, pa.binary())],
                ["_row", "_id", "_digest", "_size", "_buffer", "_content"],
            )

    kind = winners.schema["_id"].dataType.simpleString()
    read = winners.select(
        "_row", "_id", "_digest", "_size", "_buffer", F.col(f"_doc.`{text}`").alias("_text")
    )
    return read.mapInArrow(
        run, f"_row long, _id {kind}, _digest binary, _size long, _buffer long, _content binary"
    )


def _linked(local: DataFrame, contents: DataFrame) -> DataFrame:
    """``_winner`` (of a buffer), ``_best`` (``_id``, ``_row``) and ``group_size``."""
    buffers = local.select(F.count_distinct("_buffer").alias("n")).first().n
    salts = max(1, math.isqrt(buffers))
    best = lambda name: F.max(F.struct(name, "_row"))

    # Salts deal the buffers round-robin, so each has its even share of a group.
    salted = (
        contents.select(
            "_row", "_id", "_digest", "_size", "_content",
            F.pmod(F.hash("_buffer"), F.lit(salts)).alias("_salt"),
        )
        .groupBy("_digest", "_salt", "_content")
        .agg(
            best("_id").alias("_best"),
            F.sum("_size").alias("_size"),
            F.collect_list("_row").alias("_rows"),
        )
    )
    overall = (
        salted.select("_digest", "_content", "_size", "_best._id", "_best._row")
        .groupBy("_digest", "_content")
        .agg(
            best("_id").alias("_best"),
            F.sum("_size").alias("group_size"),
            F.collect_list("_row").alias("_rows"),
        )
        .select(F.explode("_rows").alias("_salt_row"), "_best", "group_size")
    )
    # The condition, always true, keeps both uses of the salted groups alike, so
    # that Spark shuffles the contents once for both.
    by_salt = salted.where("_size > 0").select(
        F.explode("_rows").alias("_winner"), F.col("_best._row").alias("_salt_row")
    )
    return by_salt.join(overall, "_salt_row").select("_winner", "_best", "group_size")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    buffer_bytes: int = BUFFER_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A to Z; NULL counts as
    empty, and texts of any length are compared whole. Of equal texts the row
    with the largest id stays; with equal largest ids exactly one of those rows;
    a NULL id only stays where all ids of the group are NULL (``keep_id`` is
    then NULL too). Repeated rows are copies like any other. An empty table
    gives an empty result. Further columns of any name are not read.
    """
    read = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    local = stored(local_groups(read, buffer_bytes, False), "exact-local")
    links = _linked(local, local.where("_size is not null"))
    return local.join(links, "_winner").select(
        F.col("_id").alias(doc_id),
        F.col("_best._id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buffer_bytes: int = BUFFER_BYTES
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever those are called.

    The same rows as ``exact_dedup`` keeps. Each row is stored once, as it came;
    its text is compressed again on the way to the stages that compare it.
    """
    names = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc")
    read = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), whole)
    local = stored(local_groups(read, buffer_bytes, True), "exact-rows")
    winners = local.where("_size is not null")
    kept = _linked(local, _contents(winners, text)).select(F.col("_best._row").alias("_row")).distinct()
    stays = winners.select("_row", "_doc").join(kept, "_row", "left_semi")
    return stays.select(*(F.col(f"_doc.`{c}`").alias(c) for c in names))
