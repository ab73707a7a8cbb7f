import hashlib
from collections import defaultdict

import pytest

from roundledger.llm.exact_dedup import drop_copies, exact_dedup
from tests.llm.tables import awkward, docs, empty

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(row.text or "").translate(UPPER)].append(row.doc_id)
    result = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        result += [(i, keep, len(ids), sha) for i in ids]
    return sorted(result, key=repr)


@pytest.mark.parametrize("buffer_bytes", [1, 200, 2**24])
def test_equals_brute_force_for_any_buffer(spark, buffer_bytes):
    table = awkward(spark).repartition(3)
    rows = exact_dedup(table, buffer_bytes=buffer_bytes).collect()
    assert sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr
    ) == brute_force(awkward(spark).collect())
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_hot_group_over_many_buffers(spark):
    table = docs(spark, [(i, "Hot" if i % 3 else f"own {i}", "en", "a") for i in range(600)])
    rows = exact_dedup(table.repartition(8), buffer_bytes=40).collect()
    hot = [r for r in rows if r.group_size > 1]
    assert {(r.keep_id, r.group_size) for r in hot} == {(599, 400)}
    assert [r.doc_id for r in hot if r.kept] == [599]


def test_drop_keeps_rows_and_columns(spark):
    table = awkward(spark)
    kept = drop_copies(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and 6 in ids and 5 not in ids


def test_empty_table_and_other_columns(spark):
    assert exact_dedup(empty(spark)).collect() == []
    more = docs(spark, [(1, "x", "en", "a")]).selectExpr("*", "1 AS keep_id", "2 AS kept")
    assert exact_dedup(more).count() == 1


def test_dropping_with_clashing_columns_and_many_buffers(spark):
    """Columns may be called like those used inside; the rows kept are the same."""
    names = ("kept", "keep_id", "group_size", "_row", "_id", "_doc", "_text", "_size", "_winner")
    more = awkward(spark).selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)))
    kept = drop_copies(more, buffer_bytes=1)
    assert kept.columns == more.columns
    rows = kept.collect()
    assert all(tuple(r)[-len(names):] == tuple(range(len(names))) for r in rows)
    marked = exact_dedup(awkward(spark)).where("kept").collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r.doc_id for r in marked), key=repr)
    assert drop_copies(empty(spark)).collect() == []
