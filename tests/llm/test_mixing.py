import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roundledger.llm.mixing import mix_sources, repeated, water_fill
from tests.llm.tables import awkward, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by clamping and sharing again, source by source."""
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    ordered += [None] if None in sizes else []
    weight = {s: weights[i % 3] for i, s in enumerate(ordered)}
    total, held = sum(sizes.values()), {}
    while True:
        left = total - sum(held.values())
        free = [s for s in ordered if s not in held]
        shares = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s: epochs * sizes[s] for s in free if shares[s] > epochs * sizes[s]}
        if not above:
            return held | shares
        held |= above


def test_targets_equal_step_by_step_filling(spark):
    sizes = {"z": 10, "a": 1000, "B": 5, "é": 300, "aa": 40, None: 7, "c": 0, "\U0001f600": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in water_fill(df).collect()}
    expected = filled(sizes)
    assert got.keys() == expected.keys()
    for source, target in expected.items():
        assert got[source] == pytest.approx(target)


def test_taken_words_meet_targets(spark):
    rows = [(i, "w " * (i % 37), "en", "abc"[i % 3] if i % 5 else None) for i in range(900)]
    table = docs(spark, rows)
    for buckets in (1, 4, 4096):
        mixed = mix_sources(table, buckets=buckets).collect()
        assert len(mixed) == 900
        by_source = {}
        for r in mixed:
            assert 0 <= r.taken <= 3 * r.size
            assert r.size == len(WORD.findall(rows[r.doc_id][1]))
            source = rows[r.doc_id][3]
            by_source.setdefault(source, [0, r.target])[0] += r.taken
        for taken, target in by_source.values():
            assert abs(taken - target) <= 1


def test_reruns_agree_and_repeats_follow(spark):
    table = docs(spark, [(i, "some words " * (1 + i % 9), "en", f"s{i % 4}") for i in range(200)])
    first = sorted(mix_sources(table).collect())
    assert first == sorted(mix_sources(table.repartition(7)).collect())
    rows = repeated(table)
    assert rows.columns == table.columns
    words = sum(len(WORD.findall(r.text)) for r in rows.collect())
    assert words == sum(r.taken for r in first)


def test_awkward_rows(spark):
    rows = mix_sources(awkward(spark)).collect()
    assert len(rows) == 12
    assert {r.doc_id: r.size for r in rows}[3] == 0
    assert mix_sources(empty(spark)).collect() == []
    none = docs(spark, [(1, None, "en", "a"), (2, " ", "en", None)])
    assert {(r.size, r.taken, r.target) for r in mix_sources(none).collect()} == {(0, 0, 0.0)}
    assert repeated(none).collect() == []
    more = awkward(spark).selectExpr("*", "1 AS size", "2 AS target", "3 AS rank")
    assert mix_sources(more).count() == 12
    named = ("_key", "_cut", "_copies", "_row", "_text", "_doc", "_of", "size", "_whole")
    more = awkward(spark).selectExpr("*", *(f"'{n}' AS {n}" for n in named))
    rows = repeated(more).collect()
    assert sorted(rows, key=repr) and all(r[n] == n for r in rows for n in named)
    plain = repeated(awkward(spark)).collect()
    assert sorted((tuple(r)[: -len(named)] for r in rows), key=repr) == sorted(map(tuple, plain), key=repr)


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 50), min_size=1, max_size=6))
def test_any_sources(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in water_fill(df).collect()}
    for source, target in filled(sizes).items():
        assert got[source] == pytest.approx(target, abs=1e-6)
