import math

import numpy as np
import pytest

from roundledger.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def planted(seed, clusters=40, each=6, alone=400, d=32, least=0.9):
    """Clusters of vectors at cosines of ``least`` and more to their centre, and others."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    vectors = [rng.normal(size=d) for _ in range(alone)]
    for _ in range(clusters):
        centre = unit(rng.normal(size=d))
        vectors.append(centre)
        for _ in range(each):
            away = rng.normal(size=d)
            away = unit(away - (away @ centre) * centre)
            c = rng.uniform(least, 1)
            vectors.append(rng.uniform(0.5, 3) * (c * centre + math.sqrt(1 - c * c) * away))
    return [vectors[i] for i in rng.permutation(len(vectors))]


def plain(vectors, ids=None, cosine=0.9):
    """Every vector with every other."""
    ids = list(range(len(vectors))) if ids is None else ids
    n = len(vectors)
    links = np.zeros((n, n), bool)
    fine = [
        i for i, v in enumerate(vectors)
        if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    for i in fine:
        for j in fine:
            if i != j and len(vectors[i]) == len(vectors[j]):
                a, b = (np.asarray(v, np.float32).astype(float) for v in (vectors[i], vectors[j]))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                links[i, j] = a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine
    component = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(links[i]):
            x, y = component[i], component[j]
            component = [min(x, y) if c in (x, y) else c for c in component]
    out = []
    for i in range(n):
        held = [ids[j] for j in range(n) if component[j] == component[i] and ids[j] is not None]
        least = min(held, default=None)
        out.append((ids[i], int(links[i].sum()), least, ids[i] == least))
    return links, sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_close_vectors_equal_brute_force(spark):
    vectors = planted(1, least=0.98)
    links, wanted = plain(vectors)
    assert links.sum() > 500
    assert found(dedup.near_vectors(table(spark, vectors))) == wanted


def test_recall_and_no_link_below(spark):
    """Links at 0.9 and little more are found with the promised probability."""
    got = wanted = 0
    for seed in range(2):
        vectors = planted(10 + seed, clusters=150, each=2, alone=100, least=0.9)
        links, rows = plain(vectors)
        true = {r[0]: r[1] for r in rows}
        for r in dedup.near_vectors(table(spark, vectors)).collect():
            assert r.n_links <= true[r.vec_id]
            got, wanted = got + r.n_links, wanted + true[r.vec_id]
    assert got / wanted >= dedup.RECALL


def test_one_hot_group_in_blocks(spark, monkeypatch):
    """Half of all rows are one group of near copies; a third are equal."""
    monkeypatch.setattr(dedup, "BLOCK", 40)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    vectors = [centre + 0.05 * rng.normal(size=32) for _ in range(150)]
    vectors += [vectors[0]] * 100 + [rng.normal(size=32) for _ in range(50)]
    links, wanted = plain(vectors)
    got = found(dedup.near_vectors(table(spark, vectors)))
    assert max(r[1] for r in got) == 249 and got == wanted


def test_awkward_rows(spark):
    vectors = [
        None, [], [0.0, 0.0], [1.0, None], [1.0, math.nan], [math.inf, 1.0], [1.0, 2.0], [2.0, 4.0],
        [1e-38, 2e-38], [1e38, 2e38], [-1.0, -2.0], [1.0, 2.0, 0.0], [1.0, 2.0], [0.0, 1.0], [-0.0, 1.0],
        [5.0], [3.0], [-3.0],
    ]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, None, 11, 12, 7, None, None, 16, 17, 18]
    _, wanted = plain(vectors, ids)
    wanted = [(i, n, c, i == c) for i, n, c, _ in wanted]
    rows = table(spark, vectors, ids)
    assert found(dedup.near_vectors(rows)) == wanted
    more = rows.selectExpr("*", "1 AS _id", "2 AS _row", "3 AS _vec", "4 AS n_links", "5 AS row")
    assert found(dedup.near_vectors(more)) == wanted
    doubles = rows.selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding")
    assert found(dedup.near_vectors(doubles)) == wanted
    assert dedup.near_vectors(rows.limit(0)).collect() == []


@pytest.mark.parametrize("cosine", [0.9, 0.97])
def test_chances_are_those_of_random_directions(cosine):
    plan = dedup.calibrated(2000, cosine)
    rng = np.random.default_rng(3)
    a, b = np.eye(16)[:2]
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b
    tries, hits, times = 400, [], []
    for _ in range(tries):
        on = rng.normal(size=(plan.directions, 16))
        x, y = on @ a, on @ b
        meet = (np.abs(x) >= plan.far) & (np.abs(y) >= plan.far) & (x * y > 0)
        meet &= np.abs(np.abs(x) - np.abs(y)) <= plan.half
        hits.append(meet.sum() >= plan.count)
        times.append(meet.sum())
    assert abs(np.mean(times) - dedup.EXPECTED) < 0.5
    assert np.mean(hits) > dedup.RECALL - 0.02


def test_each_passing_pair_is_found_in_one_list():
    rng = np.random.default_rng(4)
    plan = dedup.Plan(0, 0.0, 0.3, 3, 0.9)
    lists = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)]
    places = [rng.random(8).astype(np.float32) for _ in lists]
    met = {}
    for i in range(60):
        for j in range(i + 1, 60):
            both = [
                k for k in set(lists[i]) & set(lists[j])
                if abs(places[i][list(lists[i]).index(k)] - places[j][list(lists[j]).index(k)]) <= plan.half
            ]
            if len(both) >= plan.count:
                met[i, j] = sorted(both)[plan.count - 1]
    got = {}
    for k in range(30):
        on = [i for i in range(60) if k in lists[i]]
        at = [list(lists[i]).index(k) for i in on]
        owners = np.repeat(np.arange(len(on)), at)
        keys = np.concatenate([lists[i][:t] for i, t in zip(on, at)])
        values = np.concatenate([places[i][:t] for i, t in zip(on, at)])
        here = np.array([places[i][t] for i, t in zip(on, at)])
        for code in dedup.passing_pairs(here, owners, keys, values, plan):
            pair = on[code // len(on)], on[code % len(on)]
            assert pair not in got
            got[pair] = k
    assert got == met and len(met) > 20
