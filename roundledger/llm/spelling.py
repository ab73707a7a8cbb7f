"""Spelling variants: words one edit apart, and the form each should take.

Words are counted over all texts and described by a vector: how many of their
letters fall into each letter group. One inserted letter adds one to a count,
one deleted letter takes one off, a replaced one does both at most. So the words
near a given word lie in a trie of successive counts on the paths that spend no
more than one surplus and one deficit. The first levels of the trie are the key
of a shuffle, which deals the vocabulary over tasks; the rest is a trie in the
task, searched depth first by all words at once. Words at leaves are compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundledger.llm.shared import stored, texts_of

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
# One distinct run of a document in so many loses a letter.
DAMAGED = 97
# A form must be so many times as frequent as the word.
FACTOR = 2
# Letter groups, code points modulo this: A to Z have one each.
GROUPS = 32
# Levels of the trie begin with frequent letters, which split it best.
FREQUENT = "entairoshulcdgmbpfvyqwxzkj"
# Levels of the trie that are dealt over tasks.
PREFIX = 3
# Words of a trie, and words looked up in it, at once.
BLOCK = 16_384
SEEKERS = 4 * BLOCK
# Pairs at leaves gathered before they are verified, and verified at once.
CANDIDATES = 1 << 20
VERIFIED = 1 << 16
# Letters compared in a matrix; longer words are compared as texts.
WIDTH = 48
# Distinct words counted in a task before they are passed on.
BUFFER_WORDS = 300_000

_LEVEL = np.empty(GROUPS, np.int64)
_LEVEL[
    list(dict.fromkeys([*(ord(c) % GROUPS for c in FREQUENT), *range(GROUPS)]))
] = np.arange(GROUPS)


def damaged(run: str, seed: int) -> str:
    """``run`` as the test of variants has it: one in ``DAMAGED`` lacks a letter.

    ``seed`` is the crc32 of the id and a colon.
    """
    h = zlib.crc32(run.encode(), seed)
    if h % DAMAGED:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def words_of(text: bytes, seed: int | None = None) -> Counter:
    """How often each word stands in a text; with a ``seed``, in damaged form."""
    runs = Counter(RUN.findall(text.lower().decode("utf-8", "surrogatepass")))
    if seed is None:
        return runs
    words = Counter()
    for run, n in runs.items():
        words[damaged(run, seed)] += n
    return words


def word_counts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damage: bool = False
) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts; NULL texts have none.

    Words are runs of Latin letters (A to Z and U+00C0 to U+00FF) of whole
    texts, A to Z lower-cased. Each task passes on one row a word for as many
    texts as its buffer holds, so frequent words shrink before the shuffle.
    ``damage`` takes a letter out of one run in 97, by the crc32 of id and run;
    a NULL id counts as empty there. Repeated rows count each. Other columns
    are not read.
    """

    def run(batches):
        seen = Counter()

        def out():
            rows = pa.RecordBatch.from_pydict(
                {"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )
            seen.clear()
            return rows

        for batch in batches:
            ids = batch.column("_id").to_pylist()
            for id_, value in zip(ids, texts_of(batch.column("_text"))):
                seed = zlib.crc32(f"{'' if id_ is None else id_}:".encode()) if damage else None
                for word, n in words_of(value, seed).items():
                    seen[word] += n
                if len(seen) >= BUFFER_WORDS:
                    yield out()
        if seen:
            yield out()

    read = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    local = read.mapInArrow(run, "word string, n long").where("word <> ''")
    return local.groupBy("word").agg(F.sum("n").alias("n"))


def matrix_of(words: list[str], width: int) -> np.ndarray:
    """Code points of words, a row each, zeros behind; letters beyond ``width`` are cut."""
    if not words:
        return np.zeros((0, width), np.uint16)
    return np.array([word[:width] for word in words], f"U{width}").view(np.uint32).reshape(
        len(words), width
    ).astype(np.uint16)


def counts_of(words: list[str]) -> np.ndarray:
    """Letters of words by group, in the order of the trie's levels."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % GROUPS
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * GROUPS + _LEVEL[letters], minlength=len(words) * GROUPS)
    return counts.reshape(len(words), GROUPS).astype(np.int32)


def reachable(counts: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Counts that a surplus, and then a deficit, lead to, and how many of the two are spent."""
    yield counts, 0
    for up in range(len(counts)):
        more = (*counts[:up], counts[up] + 1, *counts[up + 1 :])
        yield more, 1
        for down in range(up + 1, len(counts)):
            if counts[down]:
                yield (*more[:down], more[down] - 1, *more[down + 1 :]), 2


class Trie:
    """Words by their counts, level by level; a node is a range of sorted vectors."""

    def __init__(self, counts: np.ndarray, first: int = 0):
        self.first = first
        self.vectors, which = np.unique(counts, axis=0, return_inverse=True)
        self.order = np.argsort(which, kind="stable")
        self.ends = np.searchsorted(which[self.order], np.arange(len(self.vectors) + 1))

    def candidates(
        self, counts: np.ndarray, spent: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Seekers and the words at a leaf they reach, depth first, as index arrays.

        ``spent`` tells what each seeker has left: 0 both, 1 the deficit alone
        (its surplus is spent), 2 nothing. A deficit is spent after a surplus:
        the word on the other side finds the pairs that begin with a deficit.
        """
        open_ = [(0, len(self.vectors), self.first, np.arange(len(counts)), spent)]
        while open_:
            low, high, level, who, used = open_.pop()
            if len(who) == 0 or low == high:
                continue
            if high - low == 1:
                who = who[_within_budget(self.vectors[low, level:] - counts[who, level:], used)]
                words = self.order[self.ends[low] : self.ends[high]]
                yield np.repeat(who, len(words)), np.tile(words, len(who))
                continue
            column = self.vectors[low:high, level]
            own = counts[who, level]
            cuts = np.flatnonzero(np.diff(column)) + 1
            for start, end in zip([0, *cuts], [*cuts, high - low]):
                step = column[start] - own
                go = (step == 0) | ((step == 1) & (used == 0)) | ((step == -1) & (used == 1))
                at = np.flatnonzero(go)
                open_.append((low + start, low + end, level + 1, who[at], used[at] + (step[at] != 0)))


def _within_budget(steps: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """Which rows of steps on the remaining levels the budget pays for."""
    moved = steps != 0
    first = np.where(
        moved.any(axis=1), np.take_along_axis(steps, moved.argmax(axis=1)[:, None], 1)[:, 0], 0
    ) if steps.shape[1] else np.zeros(len(steps), steps.dtype)
    ups, downs, moves = (steps == 1).sum(1), (steps == -1).sum(1), moved.sum(1)
    ordered = (spent > 0) | (first >= 0)
    return (ups + downs == moves) & (ups <= (spent == 0)) & (downs <= (spent < 2)) & ordered


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, letter in enumerate(a) if letter != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def one_edit_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``one_edit`` for rows of ``matrix_of``; ``b`` is as long as ``a`` or one longer."""
    apart = a != b
    replaced = apart.sum(axis=1) == 1
    # Inserted: where the words first differ, the rest of the longer one is shifted by one.
    begin = apart.argmax(axis=1)
    shifted = (a[:, :-1] != b[:, 1:])[:, ::-1]
    end = shifted.shape[1] - 1 - np.where(shifted.any(axis=1), shifted.argmax(axis=1), shifted.shape[1])
    longer = (b != 0).sum(axis=1) > (a != 0).sum(axis=1)
    return np.where(longer, end < begin, replaced)


def _dealt(words: DataFrame) -> DataFrame:
    """``words`` once as members of their own key, and as seekers at all in reach."""

    def run(batches):
        for batch in batches:
            words, rows = batch.column("word").to_pylist(), ([], [], [], [])
            for i, own in enumerate(map(tuple, counts_of(words)[:, :PREFIX].tolist())):
                for at, spent in ((own, None), *reachable(own)):
                    for column, value in zip(rows, (",".join(map(str, at)), spent is None, spent, i)):
                        column.append(value)
            from_ = pa.array(rows[3], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[0], pa.string()),
                    pa.array(rows[1], pa.bool_()),
                    pa.array(rows[2], pa.int32()),
                    batch.column("word").take(from_),
                    batch.column("n").take(from_),
                ],
                ["key", "member", "spent", "word", "n"],
            )

    return words.mapInArrow(run, "key string, member boolean, spent int, word string, n long")


def _near_pairs(seekers: list[str], spent: np.ndarray, members: list[str]):
    """Index pairs of near words, each pair of words once."""
    longest = min(max(map(len, (*seekers, *members)), default=0), WIDTH) + 1
    one, other = matrix_of(seekers, longest), matrix_of(members, longest)
    alike = np.fromiter(map(len, members), np.int64, len(members)) >= longest
    counts = counts_of(seekers)
    held, size = [], 0

    def verified():
        who, words = (np.concatenate(c) for c in zip(*held))
        for at in range(0, len(who), VERIFIED):
            a, b = who[at : at + VERIFIED], words[at : at + VERIFIED]
            good = one_edit_rows(one[a], other[b])
            # Words beyond the matrix are compared as texts.
            for i in np.flatnonzero(alike[b]):
                good[i] = one_edit(seekers[a[i]], members[b[i]])
            yield a[good], b[good]

    for who, words in Trie(counts_of(members), PREFIX).candidates(counts, spent):
        held.append((who, words))
        size += len(who)
        if size >= CANDIDATES:
            yield from verified()
            held, size = [], 0
    if held:
        yield from verified()


def _chief(own: np.ndarray, near: np.ndarray, counts: np.ndarray, ranks: np.ndarray):
    """Of each of ``own`` the number of its near words and the chief one."""
    order = np.lexsort((ranks[near], -counts[near], own))
    own, near = own[order], near[order]
    words, first, numbers = np.unique(own, return_index=True, return_counts=True)
    return words, numbers, near[first]


def _search(key, table):
    """Near words of a block's seekers and members, from the pairs found between them."""
    words, counts = table["word"].to_pylist(), table["n"].to_numpy()
    member = table["member"].to_numpy()
    spent = table["spent"].fill_null(0).to_numpy()
    seek, have = np.flatnonzero(~member), np.flatnonzero(member)
    pairs = list(
        _near_pairs([words[i] for i in seek], spent[seek], [words[i] for i in have])
    )
    one = seek[np.concatenate([a for a, _ in pairs])] if pairs else np.empty(0, np.int64)
    other = have[np.concatenate([b for _, b in pairs])] if pairs else np.empty(0, np.int64)
    # Words with equal counts find each other.
    once = (spent[one] > 0) | ~_equal_counts(words, one, other) | (np.array(
        [words[a] < words[b] for a, b in zip(one, other)], bool
    ))
    one, other = one[once], other[once]
    ranks = np.empty(len(words), np.int64)
    ranks[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    found = [_chief(one, other, counts, ranks), _chief(other, one, counts, ranks)]
    own, numbers, chief = (np.concatenate(c) for c in zip(*found))
    texts = table["word"].combine_chunks()
    return pa.table(
        {
            "word": texts.take(pa.array(own)),
            "n_near": pa.array(numbers.astype(np.int64)),
            "most": pa.array(counts[chief]),
            "first": texts.take(pa.array(chief)),
        }
    )


def _equal_counts(words: list[str], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    if len(one) == 0:
        return np.empty(0, bool)
    counts = counts_of(words)
    return (counts[one] == counts[other]).all(axis=1)


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``most`` and ``first``: its near words, and the chief one.

    ``words`` holds each ``word`` once with its count ``n``. Only words that
    have a near one are returned. A key with more words than a block is cut
    into blocks of members, each searched by all blocks of seekers, so no task
    holds more than two blocks, however many words share their counts. Each pair
    is found from one side, and counts for both words.
    """
    dealt = stored(_dealt(words), "spelling-dealt")
    sizes = dealt.groupBy("key").agg(
        F.ceil(F.sum(F.col("member").cast("int")) / BLOCK).alias("parts"),
        F.ceil(F.sum((~F.col("member")).cast("int")) / SEEKERS).alias("turns"),
    )
    placed = dealt.join(sizes.where("parts > 0"), "key")
    spread = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    chosen = lambda count: F.array(F.pmod(F.xxhash64("word"), F.col(count)))
    blocks = placed.select(
        "key", "member", "spent", "word", "n", "turns",
        F.explode(F.when(F.col("member"), chosen("parts")).otherwise(spread("parts"))).alias("part"),
    ).select(
        "key", "part", "member", "spent", "word", "n",
        F.explode(F.when(F.col("member"), spread("turns")).otherwise(chosen("turns"))).alias("turn"),
    )
    # One name for a block: the three columns would stay where the join by key left them.
    named = blocks.withColumn("block", F.concat_ws("/", "key", "part", "turn"))
    found = named.groupBy("block").applyInArrow(
        _search, "word string, n_near long, most long, first string"
    )
    # Of the most frequent ones the first in code-point order.
    chief = F.min(F.struct((-F.col("most")).alias("less"), "first")).alias("chief")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), chief).select(
        "word", "n_near", (-F.col("chief.less")).alias("most"), "chief.first"
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds ``root``: the last word reached from ``word`` over ``form``.

    A form is at least twice as frequent as its word, so paths end; each round
    doubles the steps taken.
    """
    rest = [c for c in forms.columns if c != "root"]
    now = stored(forms.select(*rest, F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        # Words without a form are at their end: only the others are looked up.
        after = now.where("form is not null").select(
            F.col("word").alias("root"), F.col("root").alias("_next")
        )
        if now.join(after, "root", "left_semi").isEmpty():
            return now
        step = now.join(after, "root", "left").select(
            *rest, F.coalesce("_next", "root").alias("root")
        )
        now = stored(step, "spelling-roots")


def spelling_variants(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each word.

    ``words`` holds each ``word`` once with its count ``n``, as ``word_counts``
    gives them. ``form`` is the near word of largest ``n`` (of equal ones the
    first in code-point order) if it is at least twice as frequent, else NULL;
    ``root`` follows forms to the last. NULL words are left out; a table
    without words gives no rows. Words of any length are compared whole.
    """
    vocabulary = words.select("word", F.col("n").cast("long").alias("n")).where("word is not null")
    near = near_words(vocabulary)
    good = F.col("most") >= FACTOR * F.col("n")
    forms = vocabulary.join(near, "word", "left").select(
        "word",
        F.when(good, F.col("first")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(good, F.col("most")).alias("form_n"),
    )
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The spelling variants among the frequent words of all texts of ``docs``.

    Words of at least five letters that occur three times take part; runs are
    damaged by ``word_counts`` so that variants are there to be found. NULL and
    empty texts have no words, a NULL id counts as empty, repeated rows count
    each, texts of any length are read whole, an empty table gives no rows, and
    further columns of any name are not read. Ties between forms go to the
    first in code-point order.
    """
    counts = word_counts(docs, text, doc_id, damage=True)
    frequent = counts.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    return spelling_variants(stored(frequent, "spelling-words"))
