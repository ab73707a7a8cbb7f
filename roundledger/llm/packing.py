"""Packing token sequences: first-fit decreasing on a tournament tree.

Documents are cut into pieces of at most a sequence's length; only documents
longer than a sequence are cut. Pieces are dealt at random to groups of bounded
size, and each group is packed on its own: pieces in decreasing length go into
the first sequence with room, found in a tournament tree whose inner nodes hold
the most room below them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from roundledger.llm.shared import WordMemo, stored, texts_of

SEQUENCE = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# Lower-case letters that normalisation leaves alone.
LATIN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
STOPS = (b".", b",", b"!", b"?", b";", b":")
# Words a task keeps the ids of, about 200 bytes each.
MEMO_WORDS = 1_000_000
# Pieces a group holds on average; a group's work and memory follow it.
GROUP_PIECES = 8192


def first_fit(lengths: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given, by first fit."""
    lengths = list(lengths)
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    placed = []
    for length in lengths:
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        placed.append((node - leaves, capacity - room[node]))
        room[node] -= length
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return placed


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte inside the tokenizer.

    Fixed rule of byte-level tokenizers: printable Latin-1 characters stand for
    themselves, the other bytes for the letters from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(WordMemo):
    """Token ids of words in lower case, little-endian, by word.

    The tokenizer always parts a letter from a stop that follows it, so words
    with and without one share their ids. A word of lower-case Latin letters
    alone is one unit to the tokenizer and normalised already, so its model is
    asked directly; all other words take the whole way.
    """

    def __init__(self, coder: Tokenizer, most: int):
        super().__init__(self.ids, most)
        self.coder, self.model = coder, coder.model
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in c.encode()) for c in LATIN}

    def ids(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1:] in STOPS and word[-2:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode()
        units = list(map(self.letters.get, text))
        if None in units:
            ids = self.coder.encode(text, add_special_tokens=False).ids
        else:
            ids = [token.id for token in self.model.tokenize("".join(units))]
        return struct.pack(f"<{len(ids)}I", *ids)


def token_pieces(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    most: int = SEQUENCE,
    max_batch_bytes: int = 4 * 2**20,
) -> DataFrame:
    """Pieces of all documents: id, ``start``, ``length``, ``doc_tokens``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit token ids. The tokenizer drops
    white space, lower-cases, and merges within words only, so ids are found
    once per word;
    strings that look like special tokens are ordinary text. NULL counts as
    empty: one piece with the end id. Each row is its own document, also where
    rows or ids repeat.
    """
    schema = (
        T.StructType([docs.schema[doc_id]])
        .add("start", "long")
        .add("length", "long")
        .add("doc_tokens", "long")
        .add("ids", "binary")
    )
    kind = pa.int64()

    def run(batches):
        coder = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        coder.encode_special_tokens = True
        memo = WordIds(coder, MEMO_WORDS)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, size = ([], [], [], [], []), 0
            column = batch.column(doc_id)
            for i, content in enumerate(texts_of(batch.column(text))):
                ids = b"".join(map(memo.__getitem__, content.lower().split())) + end
                total = len(ids) // 4
                for start in range(0, total, most):
                    length = min(most, total - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    for values, value in zip(rows, (i, start, length, total, piece)):
                        values.append(value)
                size += len(ids)
                if size >= max_batch_bytes:
                    yield _pieces(column, rows, kind, schema)
                    rows, size = ([], [], [], [], []), 0
            if rows[0]:
                yield _pieces(column, rows, kind, schema)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _pieces(column, rows, kind, schema) -> pa.RecordBatch:
    at, start, length, total, ids = rows
    arrays = [column.take(pa.array(at, pa.int64()))]
    arrays += [pa.array(values, kind) for values in (start, length, total)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())], schema.names)


def pack(
    pieces: DataFrame,
    length: str = "length",
    order: tuple[str, ...] = ("doc_id", "start"),
    most: int = SEQUENCE,
    seed: int = 23,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``.

    ``pieces`` should be stored, as they are counted first. Lengths must lie
    between 1 and ``most``. Groups are drawn by a seeded hash of all of
    ``order``, which should tell pieces apart: equal pieces share a group.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    names = pieces.columns

    def run(key, table):
        # Ties in length go by the order columns, so reruns agree.
        by = [(length, "descending"), *((c, "ascending") for c in order)]
        table = table.drop_columns(["_group"]).sort_by(by)
        placed = first_fit(table[length].to_pylist(), most)
        base = key[0].as_py() << 32
        table = table.append_column(
            "sequence_id", pa.array([base + b for b, _ in placed], pa.int64())
        )
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    group = F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(groups))
    return (
        pieces.select(*names, group.alias("_group"))
        .groupBy("_group")
        .applyInArrow(run, schema)
    )


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All documents as sequences: their pieces with ids, sequence and offset."""
    return pack(stored(token_pieces(docs, text, doc_id), "pieces"), order=(doc_id, "start"))
