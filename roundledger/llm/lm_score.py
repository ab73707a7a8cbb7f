"""Text scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens, its words and one end. A word seen in training
is coded by the bits of its code, 20 bits of its hash, and by its share of the
training tokens of that code. Each bit is predicted from the bits before it in
three contexts: alone, after the previous word, and after the two previous
words; contexts are hashes, and each keeps how many training tokens went on
with a zero and with a one. The predictions are mixed in the logistic domain
with weights chosen by a gate (place in the code, how often the two word
contexts were seen), learned online: each bit is predicted with the occurrence
itself taken off all counts, then the weights move against the error. An
adaptive map of gate and mixed prediction refines the result. A bit that no
training word leaves open costs nothing. Unseen words are announced by an
escape, as likely as words seen once are, and spelled byte by byte after the
last three bytes, with the distinct training words as examples.

Spark does it in this way. Documents travel as word numbers in chunks. A chunk
names its distinct (two previous words, code) items in order of their hash and
deals them, as small sorted blocks, to shards by the previous word; so all
counts of a context meet. A shard learns its weights on its training items,
works out each distinct item once, and sends its value back to the chunks that
named it. The number of shards follows the size of the texts and nothing is
left out. A previous word with
more items than a shard should hold is dealt over several shards by the word
before it; those get its counts by code (2^20 at most) from an aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.llm.shared import buffered, fold, mix64, stored, texts_of

FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 8 * 2**20
# Texts of so many bytes name the items of one shard.
SHARD_BYTES = 5 * 2**19
# Documents are summed up by blocks of about so many tokens.
TOKENS = 1 << 18
# Texts of so many bytes name the words of one bucket.
BUCKET_BYTES = 4 * SHARD_BYTES
# An item: hashes of the previous word and of the one before it, and a code.
LAST_BITS, BEFORE_BITS, CODE_BITS = 26, 18, 20
CODES = 1 << CODE_BITS
START = 0x51A27  # stands for the words before a text
CONTEXTS = 3
GATES, LEVELS = CODE_BITS * 16, 32
RATE = 0.2
# Rows that move the weights together: few at first, then more and more.
FIRST_BATCH, BATCH, GROWTH = 32, 8192, 1.1
# Added to counts: alone (words are known), after one word, after two.
ADDED = (0.02, 0.4, 0.4)
MOST_ODDS = 14.0
# Bytes before the one that is spelled; a context has 16 bits.
SPELL_ORDERS = (1, 2, 3)
# Bytes of a word's hash that travel with its chunk.
HASH_BYTES = 5
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    """The low bytes of Spark's xxhash64 of a binary column."""
    return xxhash.xxh64_intdigest(word, 42) & ((1 << 8 * HASH_BYTES) - 1)


def short(hashes: np.ndarray) -> bytes:
    return hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def whole(blob: bytes) -> np.ndarray:
    hashes = np.zeros((len(blob) // HASH_BYTES, 8), np.uint8)
    hashes[:, :HASH_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, HASH_BYTES)
    return hashes.view(np.uint64).ravel()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By other bits of the hash than a word's code."""
    return ((hashes >> np.uint64(CODE_BITS)) % np.uint64(buckets)).astype(np.int64)


def codes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CODES - 1)).astype(np.int64)


def last_word(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes) >> np.uint64(64 - LAST_BITS)


def item_keys(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The item of each token of a chunk, from word numbers and text starts."""
    # Worked out once a word; the place after the words stands for a text's start.
    words = np.r_[hashes, np.uint64([START])]
    high = last_word(words) << np.uint64(BEFORE_BITS + CODE_BITS)
    with np.errstate(over="ignore"):
        low = mix64(words * ODD + np.uint64(1)) >> np.uint64(64 - BEFORE_BITS) << np.uint64(CODE_BITS)
    keys = (hashes & np.uint64(CODES - 1))[ids]
    part = np.empty_like(keys)
    part[1:] = high[ids[:-1]]
    part[starts] = high[-1]
    keys |= part
    part[2:] = low[ids[:-2]]
    part[starts] = low[-1]
    part[starts[starts + 1 < len(ids)] + 1] = low[-1]
    keys |= part
    return keys


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the number of each key there.

    As np.unique, with half the memory: a chunk has millions of tokens.
    """
    order = keys.argsort()
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], place


def last_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(BEFORE_BITS + CODE_BITS)).astype(np.int64)


class Shards(NamedTuple):
    """How items are dealt: evenly by the previous word, frequent ones further."""

    number: int
    hot: np.ndarray  # contexts of frequent previous words, in order
    first: np.ndarray  # the first of their own shards
    parts: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        last = last_of(keys)
        shard = (last * self.number) >> LAST_BITS
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, last), len(self.hot) - 1)
            before = ((keys >> np.uint64(CODE_BITS)) & np.uint64((1 << BEFORE_BITS) - 1)).astype(np.int64)
            own = self.first[at] + ((before * self.parts[at]) >> BEFORE_BITS)
            shard = np.where(self.hot[at] == last, own, shard)
        return shard


def packed(values: np.ndarray) -> bytes:
    """Numbers with like bytes side by side, compressed."""
    if not len(values):
        return b""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return pa.compress(flat.T.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, number: int, dtype) -> np.ndarray:
    if not number:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(blob, number * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, number).T).view(dtype).ravel()


def joined(words: list[bytes]) -> bytes:
    """Words, none of which holds a blank, and the number of their bytes, compressed."""
    flat = b" ".join(words)
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def parted(blob: bytes) -> list[bytes]:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], size, codec="zstd", asbytes=True).split(b" ")


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes, number: int) -> np.ndarray:
    return np.cumsum(unpacked(blob, number, np.uint64), dtype=np.uint64)


class Mixer(NamedTuple):
    weights: np.ndarray  # gates x contexts
    refined: np.ndarray  # gates x levels: how often the likelier bit came


def start_weights() -> np.ndarray:
    """Before learning: contexts count little, and more the oftener they were seen."""
    weights = np.zeros((GATES, CONTEXTS), np.float32)
    gate = np.arange(GATES)
    two, one = (gate >> 2) & 3, gate & 3
    weights[:, 1] = 0.1 * one
    weights[:, 2] = 0.05 * two
    weights[:, 0] = 1 - weights[:, 1] - weights[:, 2]
    return weights


class Bits(NamedTuple):
    """One place in the code of the rows for which that bit is open.

    ``fresh`` is what training rows show with one occurrence taken off.
    """

    place: int
    rows: np.ndarray
    gate: np.ndarray  # among the gates of the place
    odds: list[np.ndarray]  # by context: log-odds of the bit that came
    fresh_gate: np.ndarray
    fresh_odds: list[np.ndarray]


class Items:
    """A shard's distinct items in order, and the rows that tell them apart.

    Items alone in their context of two words have the same evidence wherever
    their pair of words and their count are the same; they share a row.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, alone: np.ndarray, after: np.ndarray | None):
        """``alone`` and ``after``: running counts by code, of all and after a frequent word."""
        code = np.uint64(CODE_BITS)
        context = keys >> code
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        # Contexts of one item, and contexts that training never met.
        single = np.repeat((sizes == 1) | (np.add.reduceat(n, first) == 0), sizes)
        pairs = ((context >> np.uint64(BEFORE_BITS)) << code) | (keys & np.uint64(CODES - 1))
        self.pairs, pair = np.unique(pairs, return_inverse=True)
        self.pair_n = np.bincount(pair, n, len(self.pairs))
        self.alone, self.after = alone, after
        self.open = np.flatnonzero(~single)
        self.singles = np.flatnonzero(single)
        self.keys, self.n = keys[self.open], n[self.open]
        both = np.stack([pair[self.singles], n[self.singles].astype(np.int64)])
        order = np.lexsort(both[::-1])
        both = both[:, order]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
        self.shared = np.empty(len(order), np.int64)
        self.shared[order] = np.cumsum(new) - 1
        alike = both[:, new]
        self.constant = alike[1].astype(np.float64)
        self.row_pair = np.r_[pair[self.open], alike[0]]
        times = np.bincount(self.shared, minlength=alike.shape[1])
        self.weight = np.r_[self.n, self.constant * times]

    def of_items(self, values: np.ndarray) -> np.ndarray:
        """Values of the items from those of the rows."""
        result = np.empty(len(self.open) + len(self.singles), values.dtype)
        result[self.open] = values[: len(self.open)]
        result[self.singles] = values[len(self.open) + self.shared]
        return result

    def bits(self) -> Iterator[Bits]:
        """The open bits, place by place."""
        code = (self.pairs & np.uint64(CODES - 1)).astype(np.int64)

        def sums(keys, n, depth):
            if not len(keys):
                return n
            node = keys >> np.uint64(CODE_BITS - depth)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            return np.repeat(np.add.reduceat(n, first), np.diff(np.r_[first, len(keys)]))

        def by_code(running, depth):
            shift = CODE_BITS - depth
            return running[((code >> shift) + 1) << shift] - running[(code >> shift) << shift]

        def totals(depth):
            one = sums(self.pairs, self.pair_n, depth) if self.after is None else by_code(self.after, depth)
            return by_code(self.alone, depth), one, sums(self.keys, self.n, depth)

        # Rows that items share have one item after their two words: the bit that came.
        alike = log_odds_of(2, self.constant, self.constant)
        here, every = totals(0), np.arange(len(self.row_pair))
        for place in range(CODE_BITS):
            below = totals(place + 1)
            is_open = here[0] > below[0]
            # Evidence before the last word but one is worked out once a pair.
            if is_open.all():
                rows, pair = every, self.row_pair
                pairs = own = shared = slice(None)
            else:
                rows, pairs = np.flatnonzero(is_open[self.row_pair]), np.flatnonzero(is_open)
                pair = (np.cumsum(is_open) - 1)[self.row_pair[rows]]
                own = rows[: np.searchsorted(rows, len(self.open))]
                shared = rows[len(own) :] - len(self.open)
            zero, one = (log_odds_of(i, here[i][pairs], below[i][pairs]) for i in (0, 1))
            two = [
                np.concatenate([mine, both[shared]])
                for mine, both in zip(log_odds_of(2, here[2][own], below[2][own]), alike)
            ]
            odds, fresh, gate, fresh_gate = zip(*(
                [part.take(pair) for part in zero], [part.take(pair) for part in one], two
            ))
            yield Bits(
                place, rows, (gate[1] + 4 * gate[2]).astype(np.int64), odds,
                (fresh_gate[1] + 4 * fresh_gate[2]).astype(np.int64), fresh,
            )
            here = below


# The gate of a place tells how often both word contexts were seen: over these counts.
SEEN = ((), (0, 3, 31), (0, 1, 3))


def log_odds_of(
    context: int, whole: np.ndarray, bit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the bit that came, and those with one occurrence less; both gates."""
    whole, bit, added = whole.astype(np.float32), bit.astype(np.float32), np.float32(ADDED[context])
    other = np.log(whole - bit + added)
    odds = np.log(bit + added) - other
    fresh = np.log(np.maximum(bit - 1, 0) + added) - other
    gates = [np.zeros(len(whole), np.int8) for _ in range(2)]
    for gate, seen in zip(gates, (whole, whole - 1)):
        for least in SEEN[context]:
            gate += seen > least
    return odds, fresh, *gates


def level_of(log_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level below, share of the level above) of the size of log-odds."""
    place = np.abs(log_odds) * ((LEVELS - 1) / MOST_ODDS)
    level = np.minimum(place, LEVELS - 2).astype(np.int64)
    return level, place - level


def mixed(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    """Log-odds mixed by the weights of a place, contexts x gates."""
    log_odds = weights[0].take(gate) * odds[0]
    for i in range(1, CONTEXTS):
        log_odds += weights[i].take(gate) * odds[i]
    return np.clip(log_odds, -MOST_ODDS, MOST_ODDS)


def learn(weights: np.ndarray, bits: Bits, times: np.ndarray) -> np.ndarray:
    """Moves the weights of a place against the errors; its refinement, by gate and level."""
    moved = np.zeros((CONTEXTS, 16))
    hits, total = np.zeros(16 * LEVELS), np.zeros(16 * LEVELS)
    trained = np.flatnonzero(times > 0)
    n, gate = times[trained], bits.fresh_gate[trained]
    odds = [part[trained] for part in bits.fresh_odds]
    log_odds = np.empty(len(trained), np.float32)
    start, size = 0, FIRST_BATCH
    while start < len(trained):
        part = slice(start, start + size)
        start, size = start + size, min(BATCH, int(size * GROWTH) + 1)
        log_odds[part] = mixed(weights, gate[part], [o[part] for o in odds])
        error = n[part] / (1 + np.exp(log_odds[part]))
        seen = np.bincount(gate[part], n[part], 16)
        slope = np.stack(
            [np.bincount(gate[part], error * o[part], 16) for o in odds]
        ) / np.maximum(seen, 1e-9)
        # Each weight has its own rate, slower the more it has moved.
        moved += slope * slope
        weights += RATE * slope / np.sqrt(moved + 1e-4)
    for start in range(0, len(trained), 4 * BATCH):
        part = slice(start, start + 4 * BATCH)
        level, above = level_of(log_odds[part])
        came = 0.5 + 0.5 * np.sign(log_odds[part])
        cell = gate[part] * LEVELS + level
        for step, part_n in ((0, n[part] * (1 - above)), (1, n[part] * above)):
            total += np.bincount(cell + step, part_n, 16 * LEVELS)
            hits += np.bincount(cell + step, part_n * came, 16 * LEVELS)
    centre = 1 / (1 + np.exp(-np.arange(LEVELS) * (MOST_ODDS / (LEVELS - 1))))
    refined = (hits.reshape(16, -1) + 8 * centre) / (total.reshape(16, -1) + 8)
    return np.clip(refined, 1e-6, 1 - 1e-6)


def item_scores(items: Items, mixer: Mixer | None = None) -> np.ndarray:
    """log10 probability of each item's code in its contexts.

    Place by place, weights and refinement are learned online on the training
    items, unless a ``mixer`` is given; then all items are scored.
    """
    # A place's chance is 1e-7 at least: the product of all of them is far from zero.
    chances = np.ones(len(items.weight))
    all_weights = start_weights() if mixer is None else mixer.weights
    for bits in items.bits():
        gates = slice(bits.place * 16, bits.place * 16 + 16)
        weights = np.ascontiguousarray(all_weights[gates].T)
        if mixer is None:
            refined = learn(weights, bits, items.weight[bits.rows]).ravel()
        else:
            refined = mixer.refined[gates].ravel()
        for start in range(0, len(bits.rows), 4 * BATCH):
            part = slice(start, start + 4 * BATCH)
            log_odds = mixed(weights, bits.gate[part], [odds[part] for odds in bits.odds])
            level, above = level_of(log_odds)
            cell = bits.gate[part] * LEVELS + level
            low, high = refined.take(cell), refined.take(cell + 1)
            likelier = low + above * (high - low)
            likelier = np.where(log_odds > 0, likelier, 1 - likelier)
            chances[bits.rows[part]] *= 0.5 / (1 + np.exp(-log_odds)) + 0.5 * likelier
    return items.of_items(np.log10(chances))


def chunks(docs: DataFrame, text: str, doc_id: str, shards: int, buckets: int) -> DataFrame:
    """Documents as word numbers by chunk (``blob``), and each chunk's word list.

    A chunk is a bounded run of one task's rows; its frequent words have the
    small numbers. Its word list is dealt to buckets by the words' hashes, a
    small block (``size``) each: ``n`` counts a word in the
    chunk's training documents; the empty word is the end of a text. ``last``
    and ``items`` name previous words of many tokens.
    """
    schema = (
        "chunk long, blob binary, tokens binary, hashes binary, bucket long, size int, at binary, words binary, "
        "n binary, last long, items long"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [
        {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[part.split()[1]]
        for part in schema.split(", ")
    ]

    def rows(times, **columns):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[name], kind) if name in columns else pa.nulls(times, kind)
                for name, kind in zip(names, kinds)
            ],
            names,
        )

    def run(batches):
        chunk = TaskContext.get().partitionId() << 24
        for table in buffered(batches, "_text", CHUNK_BYTES):
            held = np.array(table["_held"].to_pylist(), bool)
            contents = texts_of(table["_text"])
            places: dict[bytes, int] = {b"": 0}
            ids, sizes = [], []
            for content in contents:
                words = content.lower().split()
                numbers = [places.setdefault(w, len(places)) for w in words]
                numbers.append(0)
                sizes.append(len(numbers))
                ids.append(np.array(numbers, np.uint32))
            flat = np.concatenate(ids)
            # Every token but a text's end stands before another; a text starts after none.
            before = np.bincount(flat, minlength=len(places))
            order = np.argsort(-before, kind="stable")
            before[0] = 0
            before = before[order]
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            flat = number[flat]
            counts = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(places))
            batch = pa.RecordBatch.from_arrays(
                [
                    table["_id"].combine_chunks(),
                    pa.array(held),
                    pa.array(map(len, contents), pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                ["id", "held", "size", "words"],
            )
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch)
            words = list(places)
            words = [words[i] for i in order]
            hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
            last = np.r_[last_word(hashes), last_word(np.uint64([START]))].astype(np.int64)
            items = np.r_[before, len(contents)]
            often = items * (2 * shards) >= len(flat)
            yield rows(
                1, chunk=[chunk], blob=[sink.getvalue().to_pybytes()], tokens=[packed(flat)],
                hashes=[short(hashes)],
                items=[len(flat)],
            )
            if often.any():
                yield rows(often.sum(), chunk=[chunk] * often.sum(), last=last[often], items=items[often])
            bucket = bucket_of(hashes, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.r_[np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)]
            parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield rows(
                len(parts), chunk=[chunk] * len(parts), bucket=bucket[order[cuts[:-1]]],
                size=list(map(len, parts)),
                at=[packed(np.diff(part, prepend=0).astype(np.uint32)) for part in parts],
                words=[joined([words[i] for i in part]) for part in parts],
                n=[packed(counts[part].astype(np.uint32)) for part in parts],
            )
            chunk += 1

    source = docs.select(
        F.col(doc_id).alias("_id"),
        F.col(text).alias("_text"),
        (fold(doc_id, FOLDS) == HELD_OUT).alias("_held"),
    )
    return source.mapInArrow(run, schema)


def listed_words(lists: pa.Table) -> tuple[pa.Array, list[int]]:
    """The words of all blocks, and how many each block has."""
    words = [w for blob in lists["words"].to_pylist() for w in parted(blob)]
    return pa.array(words, pa.binary()), lists["size"].to_pylist()


def word_counts(lists: DataFrame) -> DataFrame:
    """``bucket``, ``word`` and its training count ``n``."""

    def run(lists):
        words, sizes = listed_words(lists)
        n = np.concatenate([unpacked(b, k, np.uint32) for b, k in zip(lists["n"].to_pylist(), sizes)])
        words = words.dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), n, len(words.dictionary)).astype(np.int64)
        bucket = np.full(len(n), lists["bucket"][0].as_py())
        return pa.table([pa.array(bucket), words.dictionary, pa.array(n)], ["bucket", "word", "n"])

    return lists.select("bucket", "size", "words", "n").groupBy("bucket").applyInArrow(
        run, "bucket long, word binary, n long"
    )


def chunk_tokens(row: dict) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """A chunk's documents, the word number and the item of each of its tokens."""
    batch = pa.ipc.open_stream(row["blob"]).read_all().combine_chunks().to_batches()[0]
    sizes = batch.column("words").to_numpy()
    ids = unpacked(row["tokens"], int(sizes.sum()), np.uint32)
    return batch, ids, item_keys(ids, np.cumsum(sizes) - sizes, whole(row["hashes"]))


def shards_of(busy: DataFrame, number: int, total: int) -> Shards:
    """Previous words with the tokens of two shards or more; at most half as many as shards."""
    rows = (
        busy.groupBy("last").agg(F.sum("items").alias("items"))
        .where(F.col("items") * number > 2 * total).orderBy("last").collect()
    )
    parts = np.array([-(-row["items"] * number // total) for row in rows], np.int64)
    return Shards(
        number, np.array([row["last"] for row in rows], np.int64),
        number + np.cumsum(parts) - parts, parts,
    )


def dealt(blobs: DataFrame, shards: Shards) -> DataFrame:
    """Each chunk's items by shard, with their training counts."""
    schema = "shard long, chunk long, size int, keys binary, n binary"

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                docs, ids, keys = chunk_tokens(row)
                del ids
                keys, place = numbered(keys)
                n = np.bincount(place[trained_tokens(docs)], minlength=len(keys)).astype(np.uint32)
                del place
                shard = shards.of(keys)
                order = np.argsort(shard, kind="stable")
                keys, n, shard = keys[order], n[order], shard[order]
                cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
                columns = zip(*(
                    (int(shard[a]), row["chunk"], int(b - a), packed_keys(keys[a:b]), packed(n[a:b]))
                    for a, b in zip(cuts[:-1], cuts[1:])
                ))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                    ["shard", "chunk", "size", "keys", "n"],
                )

    return blobs.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Its rows, one at a time: a batch may hold many chunks."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def trained_tokens(docs: pa.RecordBatch) -> np.ndarray:
    return np.repeat(
        ~np.array(docs.column("held").to_pylist(), bool), docs.column("words").to_numpy()
    )


def hot_counts(blobs: DataFrame, shards: Shards) -> DataFrame:
    """``last``, ``code``, ``count`` of training tokens after frequent previous words, by chunk."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                docs, _, keys = chunk_tokens(row)
                keys = keys[trained_tokens(docs)]
                keys = keys[np.isin(last_of(keys), shards.hot)]
                pairs = (last_of(keys) << CODE_BITS) | codes_of(keys)
                pairs, counts = np.unique(pairs, return_counts=True)
                for start in range(0, len(pairs), 100_000):
                    some = slice(start, start + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(pairs[some] >> CODE_BITS),
                            pa.array((pairs[some] & (CODES - 1)).astype(np.int32)),
                            pa.array(counts[some].astype(np.int64)),
                        ],
                        ["last", "code", "count"],
                    )

    return blobs.mapInArrow(run, "last long, code int, count long")


def after_hot(counts: DataFrame, shards: Shards) -> DataFrame:
    """``shard`` and the ``codes`` and ``counts`` after its frequent previous word."""
    spark = counts.sparkSession
    hot = spark.createDataFrame(
        list(zip(shards.hot.tolist(), shards.first.tolist(), (shards.first + shards.parts - 1).tolist())),
        "last long, a long, b long",
    )
    lists = (
        counts.groupBy("last", "code").agg(F.sum("count").alias("count"))
        .groupBy("last").agg(F.collect_list(F.struct("code", "count")).alias("v"))  # 2^20 at most
    )
    return lists.join(hot, "last").select(
        F.explode(F.sequence("a", "b")).alias("of"), F.col("v.code").alias("codes"), F.col("v.count").alias("counts")
    )


def _shard(parts: pa.Table, after: pa.Table, alone: np.ndarray) -> tuple[Items, np.ndarray, list[int]]:
    """A shard's items, the place of each named item there, and how many each chunk names."""
    sizes = parts["size"].to_pylist()
    keys = np.concatenate([unpacked_keys(b, k) for b, k in zip(parts["keys"].to_pylist(), sizes)])
    n = np.concatenate([unpacked(b, k, np.uint32) for b, k in zip(parts["n"].to_pylist(), sizes)])
    keys, place = np.unique(keys, return_inverse=True)
    running = None
    if after.num_rows:
        running = np.zeros(CODES)
        codes = after["codes"].combine_chunks().values.to_numpy()
        running[codes] = after["counts"].combine_chunks().values.to_numpy()
        running = np.r_[0.0, np.cumsum(running)]
    return Items(keys, np.bincount(place, n, len(keys)), alone, running), place, sizes


def with_values(parts: DataFrame, after: DataFrame, alone, mixer: Mixer | None) -> DataFrame:
    """``chunk``, ``shard`` and the scores of the items the chunk named there, in order."""

    def run(parts, after):
        out = []
        if parts.num_rows:
            items, place, sizes = _shard(parts, after, alone.value)
            # Values travel rounded to 14 significant bits.
            values = item_scores(items, mixer).astype(np.float32).view(np.uint32)
            values = ((values + np.uint32(512)) & np.uint32(0xFFFFFC00))[place]
            out = [packed(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
        return pa.table(
            [parts["chunk"], parts["shard"], parts["size"], pa.array(out, pa.binary())],
            ["chunk", "shard", "size", "scores"],
        )

    return (
        parts.groupBy("shard").cogroup(after.groupBy("of"))
        .applyInArrow(run, "chunk long, shard long, size int, scores binary")
    )


class Speller(NamedTuple):
    """Counts of bytes by context: sorted codes of 16 + 8 bits an order, and their counts."""

    codes: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]


def spell_codes(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code by order, number of the word) of blocks of words, each ended by a blank."""
    start = 0
    while start < len(words):
        end, size = start, 0
        while end < len(words) and (end == start or size < 2**20):
            size += len(words[end]) + 1
            end += 1
        sizes = np.fromiter((len(w) + 1 for w in words[start:end]), np.int64, end - start)
        # Three blanks before each word: its first bytes have contexts of their own.
        padded = np.frombuffer(b"".join(b"   " + w + b" " for w in words[start:end]), np.uint8)
        of = np.repeat(np.arange(end - start), sizes)
        at = np.arange(len(of)) + 3 * (of + 1)
        past = [padded[at - i].astype(np.uint64) for i in range(4)]
        codes = [past[0], (past[1] << np.uint64(8)) | past[0], (((past[2] << np.uint64(8)) | past[1]) << np.uint64(8)) | past[0]]
        three = mix64((past[3] << np.uint64(16)) | (past[2] << np.uint64(8)) | past[1]) >> np.uint64(48)
        codes.append((three << np.uint64(8)) | past[0])
        yield np.stack(codes), of + start
        start = end


def spelling_counts(words: DataFrame) -> DataFrame:
    """``order``, ``code``, ``n`` over the distinct training words, 2^24 an order at most."""

    def run(batches):
        for table in buffered(batches, "word", 2**20):
            for codes, _ in spell_codes(texts_of(table["word"])):
                for order, values in enumerate(codes):
                    code, n = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(code), order, np.int32)),
                            pa.array(code.astype(np.int32)), pa.array(n),
                        ],
                        ["order", "code", "n"],
                    )

    return (
        words.where("n > 0 and length(word) > 0").mapInArrow(run, "order int, code int, n long")
        .groupBy("order", "code").agg(F.sum("n").alias("n"))
    )


def speller_of(counts: DataFrame) -> Speller:
    table = counts.toArrow().sort_by([("order", "ascending"), ("code", "ascending")])
    order, code, n = (table[c].to_numpy() for c in ("order", "code", "n"))
    parts = [order == i for i in range(len(SPELL_ORDERS) + 1)]
    return Speller(tuple(code[p] for p in parts), tuple(n[p].astype(np.float64) for p in parts))


def spelled(words: list[bytes], speller: Speller) -> np.ndarray:
    """log10 probability of each word with its end; longer contexts fall back to shorter ones.

    A context that was followed by d different bytes leaves them d parts of
    its count for the shorter context.
    """
    held, kinds = [], []
    for codes, counts in zip(speller.codes, speller.counts):
        held.append(np.bincount(codes >> 8, counts, 1 << 16))
        kinds.append(np.bincount(codes >> 8, minlength=1 << 16))
    scores = np.zeros(len(words))
    for codes, of in spell_codes(words):
        chance = np.full(len(of), 1 / 256)
        for order, code in enumerate(codes.astype(np.int64)):
            known, counts = speller.codes[order], speller.counts[order]
            if len(known):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                n = np.where(known[at] == code, counts[at], 0.0)
                total, d = held[order][code >> 8], kinds[order][code >> 8]
                chance = np.where(total > 0, (n + d * chance) / np.maximum(total + d, 1), chance)
        scores += np.bincount(of, np.log10(chance), len(words))
    return scores


def word_scores(words: DataFrame, alone, speller, escape: float) -> DataFrame:
    """``score``: a known word's share of its code, an unseen word's escape and spelling."""

    def run(batches):
        for batch in batches:
            contents, n = texts_of(batch.column("word")), batch.column("n").to_numpy()
            hashes = np.fromiter(map(word_hash, contents), np.uint64, len(contents))
            code = codes_of(hashes)
            held = alone.value[code + 1] - alone.value[code]
            score = np.log10(np.maximum(n, 1) / np.maximum(held, 1)) + math.log10(1 - escape)
            unseen = np.flatnonzero(n == 0)
            score[unseen] = math.log10(escape) + spelled([contents[i] for i in unseen], speller.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("word"), batch.column("n"), pa.array(score)],
                ["bucket", "word", "n", "score"],
            )

    return words.mapInArrow(run, "bucket long, word binary, n long, score double")


def scored_lists(lists: DataFrame, scored: DataFrame) -> DataFrame:
    """``of``: the chunk, and by block the ``at``, ``n`` and ``score`` of its words."""

    def run(lists, scored):
        out = [[], []]
        if lists.num_rows:
            words, sizes = listed_words(lists)
            at = pc.index_in(words, value_set=scored["word"].combine_chunks()).to_numpy()
            cuts = np.cumsum(sizes)[:-1]
            for blobs, name, kind in zip(out, ("n", "score"), (np.int64, np.float32)):
                blobs += [packed(v) for v in np.split(scored[name].to_numpy().astype(kind)[at], cuts)]
        return pa.table(
            [lists["chunk"], lists["size"], lists["at"], *(pa.array(b, pa.binary()) for b in out)],
            ["of", "size", "at", "n", "score"],
        )

    return (
        lists.select("chunk", "bucket", "size", "at", "words").groupBy("bucket")
        .cogroup(scored.groupBy("bucket"))
        .applyInArrow(run, "of long, size int, at binary, n binary, score binary")
    )


def score_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mixer: Mixer | None = None
) -> DataFrame:
    """One row per row of ``docs``, scored by a model of its training rows.

    id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (words alone, add-one), ``score`` (log10 probability) and
    ``bits_per_byte``, of the text's bytes and its end; a training row's own words
    are among the counts. NULL and empty texts
    are an end alone; texts of any length are scored whole, at every word. A
    NULL id counts as empty text when folds are dealt. Repeated rows, and rows
    that share an id, are scored, and counted, each. Nothing is ranked, so ties
    need no rule. Further columns are not read and may have any name. An empty
    table gives an empty result; without training rows every word is spelled,
    all bytes being alike. With a ``mixer`` no weights are learned.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    number = int(size // SHARD_BYTES) + 1
    parts = stored(chunks(docs, text, doc_id, number, int(size // BUCKET_BYTES) + 1), "lm-chunks")
    lists = parts.where("words is not null").select("chunk", "bucket", "size", "at", "words", "n")
    words = stored(word_counts(lists), "lm-words")
    totals = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.when(F.col("n") > 0, 1)).alias("v"),
        F.count(F.when(F.col("n") == 1, 1)).alias("once"),
    ).first()
    # 2^20 codes, whatever the input.
    code = F.xxhash64("word").bitwiseAND(F.lit(CODES - 1)).alias("code")
    by_code = words.where("n > 0").groupBy(code).agg(F.sum("n").cast("double").alias("n")).toArrow()
    counts = np.zeros(CODES)
    counts[by_code["code"].to_numpy()] = by_code["n"].to_numpy()
    alone = spark.sparkContext.broadcast(np.r_[0.0, np.cumsum(counts)])
    speller = spark.sparkContext.broadcast(speller_of(spelling_counts(words)))

    blobs = parts.where("blob is not null").select("chunk", "blob", "tokens", "hashes", "items")
    total = blobs.agg(F.sum("items")).first()[0] or 1
    shards = shards_of(parts.where("last is not null"), number, total)
    items = dealt(blobs, shards)
    # Without frequent words no chunk is read for their counts.
    after = after_hot(hot_counts(blobs if len(shards.hot) else blobs.limit(0), shards), shards)
    values = with_values(items, after, alone, mixer)
    escape = (totals.once + 0.5) / (totals.n + 1)
    scored = word_scores(words, alone, speller, escape)
    of_words = scored_lists(lists, scored)
    kind = docs.schema[doc_id].dataType
    schema = (
        T.StructType([T.StructField("id", kind)])
        .add("held_out", "boolean")
        .add("n_tokens", "long")
        .add("n_known", "long")
        .add("base_score", "double")
        .add("score", "double")
        .add("bits_per_byte", "double")
    )
    even = math.log10(totals.n + totals.v + 1)

    def run(chunk, of_words):
        in_all = sum(of_words["size"].to_pylist())
        n, word = np.zeros(in_all, np.int64), np.zeros(in_all, np.float32)
        for part in of_words.to_pylist():
            at = np.cumsum(unpacked(part["at"], part["size"], np.uint32), dtype=np.int64)
            n[at] = unpacked(part["n"], part["size"], np.int64)
            word[at] = unpacked(part["score"], part["size"], np.float32)
        base = np.log10(n + 1) - even
        blobs = chunk["blob"].is_valid()
        batch, ids, keys = chunk_tokens(chunk.filter(blobs).to_pylist()[0])
        keys, place = numbered(keys)
        found = chunk.filter(pc.invert(blobs)).sort_by("shard")
        of_shards = np.concatenate([
            unpacked(blob.as_py(), size, np.float32)
            for blob, size in zip(found["scores"], found["size"].to_pylist())
        ])
        item = np.empty(len(keys), np.float32)
        item[np.argsort(shards.of(keys), kind="stable")] = of_shards
        del keys, of_shards, found
        sizes = batch.column("words").to_numpy()
        starts = np.cumsum(sizes) - sizes
        # Every document has at least its end, so no sum is empty. Some documents at a time.
        sums, known = np.empty((2, len(sizes))), np.empty(len(sizes), np.int64)
        cuts = np.flatnonzero(np.diff(starts // TOKENS, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(sizes)]):
            some = slice(starts[a], starts[b - 1] + sizes[b - 1])
            tokens, firsts = ids[some], starts[a:b] - starts[a]
            seen = n[tokens] > 0
            score = word[tokens].astype(np.float64) + np.where(seen, item[place[some]], 0.0)
            sums[0, a:b] = np.add.reduceat(base[tokens], firsts)
            sums[1, a:b] = np.add.reduceat(score, firsts)
            known[a:b] = np.add.reduceat(seen.astype(np.int64), firsts)
        bits = -sums[1] / math.log10(2) / (batch.column("size").to_numpy() + 1)
        return pa.table(
            [
                batch.column("id"), batch.column("held"), batch.column("words"),
                pa.array(known), pa.array(sums[0]), pa.array(sums[1]), pa.array(bits),
            ],
            schema.names,
        )

    whole = blobs.select("chunk", "blob", "tokens", "hashes").unionByName(values, allowMissingColumns=True)
    return (
        whole.groupBy("chunk")
        .cogroup(of_words.groupBy("of"))
        .applyInArrow(run, schema)
        .select(
            F.col("id").alias(doc_id), "held_out", "n_tokens", "n_known",
            F.lit(totals.n).cast("long").alias("train_tokens"), "base_score", "score",
            "bits_per_byte",
        )
    )
