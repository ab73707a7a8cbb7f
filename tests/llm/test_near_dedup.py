import random

import numpy as np
import pytest

from roundledger.llm.components import components
from roundledger.llm.near_dedup import (
    collision_rate,
    drop_near_copies,
    estimated_jaccard,
    hyper_registers,
    near_dedup,
    shingle_set,
    word_hashes,
)
from tests.llm.tables import awkward, docs, empty


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    least = {i: doc_id for i, (doc_id, _) in enumerate(sets)}
    links = [
        (i, j)
        for i, (_, a) in enumerate(sets)
        for j, (_, b) in enumerate(sets)
        if i < j and a and 100 * len(a & b) >= 85 * len(a | b)
    ]
    low = lambda x, y: min((v for v in (x, y) if v is not None), default=None)
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = low(least[i], least[j])
    return sorted(((d, len(s), least[i]) for i, (d, s) in enumerate(sets)), key=repr)


def variants(seed, groups, members, length):
    """Groups of texts in which each differs from the one before by few words."""
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for _ in range(groups):
        words = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(length)]
        for _ in range(members):
            rows.append((doc_id, " ".join(words), "en", "a"))
            doc_id += 1
            words = list(words)
            words[rng.randrange(length)] = f"new{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [7, 60, 400])
def test_chains_of_near_copies_equal_brute_force(spark, length):
    table = docs(spark, variants(length, 4, 12, length))
    got = sorted(
        ((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(table).collect()), key=repr
    )
    assert got == brute_force(table.collect())


def test_one_large_group_with_outliers(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice((1, 2, 4, 9))):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    table = docs(spark, rows)
    got = sorted(
        ((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(table).collect()), key=repr
    )
    assert got == brute_force(table.collect())


def test_awkward_rows(spark):
    rows = near_dedup(awkward(spark)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute_force(
        awkward(spark).collect()
    )
    assert near_dedup(empty(spark)).collect() == []
    kept = drop_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and 5 in ids and 6 not in ids and {1, 2, 3} <= set(ids)
    named = ("_key", "_row", "_id", "_doc", "_text", "digest", "n_shingles", "component_id", "class")
    more = drop_near_copies(awkward(spark).selectExpr("*", *(f"'{n}' AS {n}" for n in named)))
    assert more.columns == [*awkward(spark).columns, *named]
    rows = more.collect()
    assert len(rows) == len(ids) and all(r[n] == n for r in rows for n in named)


def test_registers_estimate_jaccard():
    memo = word_hashes()
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    a = shingle_set(" ".join(words).encode(), memo)
    b = shingle_set(" ".join(words[:2400] + [f"v{i}" for i in range(600)]).encode(), memo)
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = estimated_jaccard(hyper_registers(a), hyper_registers(b), len(a), len(b))
    assert abs(got - exact) < 0.12
    c = shingle_set(" ".join(f"z{i}" for i in range(3000)).encode(), memo)
    assert estimated_jaccard(hyper_registers(a), hyper_registers(c), len(a), len(c)) < 0.03
    assert 0 < collision_rate(3000, 3000) < 2**-10


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    random.Random(2).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert components(df.limit(0)).collect() == []
