import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from roundledger.llm import spelling
from tests.llm.tables import awkward, docs, empty

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain(rows):
    """All pairs of words, by the text of the rule."""
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and plain_distance(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def noisy_rows(seed, texts=300):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    rows = []
    for i in range(texts):
        words = []
        for _ in range(30):
            word = rng.choice(base[: rng.randint(1, 120)])
            if rng.random() < 0.15:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "x", "ab"]) + word[at + 1 :]
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((rng.choice([i, i, None]), " ".join(words)))
    # Variants of variants, and a tie between forms.
    rows += [(1000 + i, "planet " * 8 + "planett " * 2 + "planettt " * (i % 2)) for i in range(9)]
    rows += [(2000 + i, "planett planett lantern lantarn " * 2 + "lantirn") for i in range(4)]
    return rows


def test_equals_all_pairs(spark):
    rows = noisy_rows(3)
    wanted = plain(rows)
    assert sum(row[1] is not None for row in wanted) > 20
    assert any(row[2] not in (row[0], row[1]) for row in wanted)
    assert found(spelling.group_spellings(docs(spark, [(i, t, None, None) for i, t in rows]))) == wanted


def test_blocks_change_nothing(spark, monkeypatch):
    rows = noisy_rows(4, 60)
    monkeypatch.setattr(spelling, "BLOCK", 2)
    monkeypatch.setattr(spelling, "SEEKERS", 3)
    monkeypatch.setattr(spelling, "WIDTH", 6)
    table = docs(spark, [(i, t, None, None) for i, t in rows])
    assert found(spelling.group_spellings(table)) == plain(rows)


def test_one_word_in_a_third_of_all_rows(spark):
    rows = [(i, "sunrise " * 40) for i in range(200)] + noisy_rows(5, 100)
    table = docs(spark, [(i, t, None, None) for i, t in rows])
    assert found(spelling.group_spellings(table)) == plain(rows)


WORDS = st.text("abcé", max_size=7)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS)
def test_one_edit_agrees_with_the_distance(a, b):
    near = plain_distance(a, b) == 1
    assert spelling.one_edit(a, b) == near
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) <= 1:
        rows = [spelling.matrix_of([word], 9) for word in (short, long)]
        assert spelling.one_edit_rows(*rows).tolist() == [near]


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS.filter(bool), min_size=1, max_size=25, unique=True))
def test_the_trie_finds_each_near_pair_from_one_side(words):
    wanted = {frozenset((a, b)) for a in words for b in words if plain_distance(a, b) == 1}
    counts = spelling.counts_of(words)
    trie = spelling.Trie(counts, spelling.PREFIX)
    found = []
    for i, word in enumerate(words):
        own = tuple(counts[i, : spelling.PREFIX].tolist())
        for place, spent in spelling.reachable(own):
            for _, reached in trie.candidates(counts[i : i + 1], np.array([spent])):
                found += [
                    (word, words[j]) for j in reached
                    if tuple(counts[j, : spelling.PREFIX].tolist()) == place
                    and spelling.one_edit(word, words[j])
                ]
    pairs = {frozenset(pair) for pair in found}
    assert pairs == wanted
    # Only pairs with equal counts are met from both sides.
    for a, b in found:
        same = (counts[words.index(a)] == counts[words.index(b)]).all()
        assert ((b, a) in found) == same


def test_words_of_texts():
    text = "Öl ÖL straße STRASSE don't x×y".encode()
    assert spelling.words_of(text) == Counter(
        {"Öl": 2, "straße": 1, "strasse": 1, "don": 1, "t": 1, "x×y": 1}
    )
    assert spelling.words_of(b"") == Counter()


def test_roots_of_long_paths(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 20 else None) for i in range(21)]
    forms = spark.createDataFrame(chain, "word string, form string")
    assert {r.root for r in spelling.with_roots(forms).collect()} == {"w20"}


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert found(spelling.group_spellings(awkward(spark))) == plain(rows)
    assert spelling.group_spellings(empty(spark)).collect() == []
    more = awkward(spark).selectExpr("*", "1 AS word", "2 AS n", "3 AS _id", "4 AS _text", "5 AS key")
    assert found(spelling.group_spellings(more)) == plain(rows)
    none = spark.createDataFrame([(None, 5), ("apple", 3)], "word string, n int")
    assert found(spelling.spelling_variants(none)) == [("apple", None, "apple", 3, 0, None)]
