"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Vectors of length one are projected onto many random directions. Each direction
has a list, ordered by projection, of the vectors that lie far out on it; there
a window centred on a vector holds those it collides with. Directions are drawn
independently, so a pair's collisions follow a binomial distribution, from
which the number a pair must reach is worked out for the recall wanted. Only
pairs that reach it are verified, in double precision.

A pair is verified in one place, the list where its count is reached: each entry
of a list carries the vector's entries in the lists before. So pairs are never
emitted; a block of a list gives out numbers of links and one edge per vector.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.llm.components import components
from roundledger.llm.shared import stored

# Least cosine of a link, and the share of links at just that cosine to be found.
LEAST_COSINE = 0.9
RECALL = 0.99
# Collisions to expect of a pair at just the least cosine.
EXPECTED = 8.5
# Half a window, in standard deviations of the difference of such a pair.
WINDOW = 2.0
# Entries of a list compared with as many others in one task.
BLOCK = 1024
# Pairs counted, or verified, at once.
CHUNK = 1 << 21
VERIFIED = 1 << 15
BUFFER_ROWS = 2048
# Lists whose sizes are broadcast (16 bytes each); beyond, sizes are joined.
BROADCAST_LISTS = 250_000

# More lists than any vector lies on.
MOST_LISTS = 2**31 - 1

_NORMAL = NormalDist()


class Plan(NamedTuple):
    """How vectors are projected and how many collisions a pair must reach."""

    directions: int
    far: float
    half: float
    count: int
    cosine: float


def collision_chance(cosine: float, far: float, half: float) -> float:
    """Chance that two unit vectors both lie beyond ``far`` on one side of a
    random direction, within ``half`` of each other."""
    u = np.linspace(far, far + 8, 4001)
    spread = math.sqrt(max(1 - cosine * cosine, 1e-12))
    upper = [_NORMAL.cdf((x + half - cosine * x) / spread) for x in u]
    lower = [_NORMAL.cdf((max(far, x - half) - cosine * x) / spread) for x in u]
    density = np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
    return float(np.trapezoid(density * (np.array(upper) - np.array(lower)), u))


def recall_of(count: int, trials: int, chance: float) -> float:
    """Probability of at least ``count`` successes."""
    below = sum(
        math.exp(
            math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1)
            + k * math.log(chance) + (trials - k) * math.log1p(-chance)
        )
        for k in range(min(count, trials + 1))
    )
    return 1 - below


def calibrated(vectors: int, cosine: float = LEAST_COSINE, recall: float = RECALL) -> Plan:
    """The plan for so many vectors.

    A list holds about the square root of twice their number, where the work of
    projecting and that of comparing grow alike. The count is the largest that
    pairs at ``cosine`` reach with probability ``recall``.
    """
    share = min(0.2, math.sqrt(2 / max(vectors, 1)))
    far = _NORMAL.inv_cdf(1 - share)
    half = WINDOW * math.sqrt(2 - 2 * cosine)
    # Both ends of a direction are lists; a pair can only meet in one of them.
    chance = 2 * collision_chance(cosine, far, half)
    directions = math.ceil(EXPECTED / chance)
    count = 1
    while recall_of(count + 1, directions, chance) >= recall:
        count += 1
    return Plan(directions, far, half, count, cosine)


@lru_cache(maxsize=4)
def directions(dimensions: int, number: int) -> np.ndarray:
    """Random directions, the same in every task and run."""
    rng = np.random.default_rng([dimensions, 20])
    return rng.standard_normal((number, dimensions)).astype(np.float32).T


def unit(points: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision at any magnitude."""
    points = points.astype(np.float64)
    points /= np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]


def _by_length(column: pa.Array | pa.ChunkedArray):
    """Places and values of lists, one array for all lists of a length.

    NULL and empty lists are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(at)).flatten()
        yield at, flat.to_numpy(zero_copy_only=False).reshape(len(at), length)


def _rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``_id``, ``_row`` (a number of its own) and ``_first``, the first row of the
    buffer with an equal vector, which alone carries ``_vec`` and ``_size``.

    Rows whose vector links with nothing have no ``_first``.
    """
    kind = vectors.schema[vector].dataType
    kind = "float" if kind == T.ArrayType(T.FloatType(), kind.containsNull) else "double"

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, BUFFER_ROWS):
                part = batch.slice(start, BUFFER_ROWS)
                first = np.full(part.num_rows, -1, np.int64)
                for at, points in _by_length(part.column("_vec")):
                    # NULL components read as NaN.
                    fine = np.isfinite(points).all(axis=1) & (points != 0).any(axis=1)
                    points = points + points.dtype.type(0)
                    seen: dict[bytes, int] = {}
                    for i, point in zip(at[fine], points[fine]):
                        first[i] = seen.setdefault(point.tobytes(), i)
                sizes = np.bincount(first[first >= 0], minlength=part.num_rows)
                chosen = first == np.arange(part.num_rows)
                column = part.column("_vec")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array(np.arange(row, row + part.num_rows)),
                        pa.array(first + row, mask=first < 0),
                        pa.array(sizes, mask=~chosen),
                        pc.if_else(pa.array(chosen), column, pa.scalar(None, column.type)),
                    ],
                    ["_id", "_row", "_first", "_size", "_vec"],
                )
                row += part.num_rows

    read = vectors.select(
        F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast(f"array<{kind}>").alias("_vec")
    )
    return read.mapInArrow(
        run, f"_id long, _row long, _first long, _size long, _vec array<{kind}>"
    )


def _projected(points: DataFrame, plan: Plan) -> DataFrame:
    """Each vector with its lists, ascending, and its places on them."""

    def run(batches):
        for batch in batches:
            for at, vecs in _by_length(batch.column("_vec")):
                along = directions(vecs.shape[1], plan.directions)
                for part in np.array_split(np.arange(len(at)), -(-len(at) // 512)):
                    values = unit(vecs[part]).astype(np.float32) @ along
                    who, on = np.nonzero(np.abs(values) >= plan.far)
                    value = values[who, on]
                    ends = np.searchsorted(who, np.arange(len(part) + 1)).astype(np.int32)
                    own = batch.take(pa.array(at[part]))
                    lists = (2 * on + (value < 0)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(own.column(c) for c in ("_row", "_size", "_vec")),
                            pa.ListArray.from_arrays(ends, lists),
                            pa.ListArray.from_arrays(ends, np.abs(value)),
                        ],
                        ["_row", "_size", "_vec", "_lists", "_places"],
                    )

    kind = points.schema["_vec"].dataType.simpleString()
    return points.select("_row", "_size", "_vec").mapInArrow(
        run, f"_row long, _size long, _vec {kind}, _lists array<int>, _places array<float>"
    )


def _entries(projected: DataFrame, plan: Plan) -> DataFrame:
    """One row per list in which a pair of the vector can reach its count.

    ``before`` and ``at`` are the vector's lists before that one and its places.
    """
    spread = projected.select(
        "*", F.posexplode(F.slice("_lists", plan.count, MOST_LISTS)).alias("k", "list")
    )
    own = F.col("k") + plan.count - 1
    return spread.select(
        "list",
        F.get("_places", own).alias("place"),
        F.col("_row").alias("row"),
        F.col("_size").alias("size"),
        F.col("_vec").alias("vec"),
        F.slice("_lists", F.lit(1), own).alias("before"),
        F.slice("_places", F.lit(1), own).alias("at"),
    )


def _window_pairs(keys: np.ndarray, places: np.ndarray, owners: np.ndarray, half: float, total: int):
    """Pairs of owners whose entries share a key and a window, as ``low * total + high``.

    Entries come ordered by key and place, so those in the window of an entry
    follow it directly.
    """
    for step in range(1, len(keys)):
        near = (keys[step:] == keys[:-step]) & (places[step:] - places[:-step] <= half)
        hits = np.flatnonzero(near)
        if len(hits) == 0:
            return
        one, other = owners[hits], owners[hits + step]
        yield np.minimum(one, other) * total + np.maximum(one, other)


def _counted(pairs, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often each came, counted in chunks."""
    kept, counts, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def merge():
        codes, times = np.unique(np.concatenate(held), return_counts=True)
        both, place = np.unique(np.concatenate([kept, codes]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([counts, times]), len(both))
        return both, sums.astype(np.int64)

    for codes in pairs:
        held.append(codes)
        size += len(codes)
        if size >= CHUNK:
            kept, counts = merge()
            held, size = [], 0
    if held:
        kept, counts = merge()
    return kept, counts


def passing_pairs(
    places: np.ndarray, owners: np.ndarray, keys: np.ndarray, values: np.ndarray, plan: Plan
) -> np.ndarray:
    """Pairs (``low * n + high``) that collide in this list and reach their count here.

    ``places`` are those of the ``n`` entries in this list; ``keys`` and
    ``values`` the earlier lists, and places on them, of the entries ``owners``.
    """
    n = len(places)
    order = np.argsort(places, kind="stable")
    here = list(_window_pairs(np.zeros(n, np.int8), places[order], order, plan.half, n))
    if not here:
        return np.empty(0, np.int64)
    here = np.sort(np.concatenate(here))
    order = np.lexsort((values, keys))
    codes, times = _counted(
        _window_pairs(keys[order], values[order], owners[order], plan.half, n), n
    )
    had = np.zeros(len(here), np.int64)
    if len(codes):
        found = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
        had = np.where(codes[found] == here, times[found], 0)
    return here[had == plan.count - 1]


def _links(vecs: np.ndarray, one: np.ndarray, other: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs reach the cosine, in double precision."""
    good = [
        np.einsum("ij,ij->i", vecs[one[i : i + VERIFIED]], vecs[other[i : i + VERIFIED]]) >= cosine
        for i in range(0, len(one), VERIFIED)
    ]
    return np.concatenate(good) if good else np.empty(0, bool)


def _rooted(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of ``n`` the smallest it is connected with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[one], root[other])
        after = root.copy()
        np.minimum.at(after, one, least)
        np.minimum.at(after, other, least)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists end to end, and the list each came from."""
    column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy()
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), lengths)


def _compared(blocks: DataFrame, plan: Plan) -> DataFrame:
    """``row``, ``n`` (vectors linked in this block) and ``root`` (a row to link to)."""

    def run(key, table):
        out = []
        # Only vectors of equally many dimensions can be compared.
        for at, vecs in _by_length(table["vec"]):
            own = table.take(pa.array(at))
            n = len(at)
            keys, owners = _flat(own["before"])
            pairs = passing_pairs(
                own["place"].to_numpy(), owners, keys, _flat(own["at"])[0], plan
            )
            one, other = pairs // n, pairs % n
            if key[1].as_py() != key[2].as_py():
                # Pairs within one side belong to another block.
                side = own["side"].to_numpy()
                crossing = side[one] != side[other]
                one, other = one[crossing], other[crossing]
            good = _links(unit(vecs), one, other, plan.cosine)
            one, other = one[good], other[good]
            ids, sizes = own["row"].to_numpy(), own["size"].to_numpy()
            linked = np.bincount(one, sizes[other], n) + np.bincount(other, sizes[one], n)
            has = np.flatnonzero(linked)
            out.append((ids[has], linked[has].astype(np.int64), ids[_rooted(n, one, other)[has]]))
        columns = map(np.concatenate, zip(*out)) if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("row", "n", "root"), map(pa.array, columns))))

    return blocks.groupBy("list", "turn", "part").applyInArrow(run, "row long, n long, root long")


def _blocks(entries: DataFrame, projected: DataFrame, plan: Plan) -> DataFrame:
    """Entries dealt to blocks: long lists are cut and every two parts compared."""
    sizes = (
        projected.select(F.explode(F.slice("_lists", plan.count, MOST_LISTS)).alias("list"))
        .groupBy("list")
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    )
    if 2 * plan.directions <= BROADCAST_LISTS:
        sizes = F.broadcast(sizes)
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("side", other).alias("turn"), F.greatest("side", other).alias("part")),
    )
    return (
        entries.join(sizes, "list")
        .withColumn("side", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        .select("*", F.explode(others).alias("pair"))
        .select("*", "pair.*")
        .drop("pair", "parts")
    )


def near_vectors(
    vectors: DataFrame,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    cosine: float = LEAST_COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` is the number of other rows whose vectors are found to have a
    cosine of at least ``cosine``; none below it is linked, and pairs at just
    that cosine are found with probability ``recall``, closer ones more surely.
    ``component_id`` is the smallest id reachable over links, NULL if all those
    ids are NULL; ``kept`` tells whether the row's own id is that one.

    A vector that is NULL, empty, zero or holds NULL or a number that is not
    finite links with nothing, as do vectors of different lengths. Equal vectors
    are one point that counts once for each row, so repeated rows link with one
    another. Ids may repeat or be NULL; rows of the
    same smallest id are all kept. Vectors have any number of dimensions. An
    empty table gives no rows; further columns are not read.
    """
    rows = stored(_rows(vectors, vec_id, vector), "vectors")
    firsts = rows.where("_vec is not null")
    # Equal vectors of different buffers: one row of each buffer takes part.
    points = stored(
        firsts.groupBy("_vec").agg(F.min("_row").alias("_row"), F.sum("_size").alias("_size")),
        "vector-points",
    )
    key = F.xxhash64("_vec").alias("_key")
    own = (
        firsts.select(F.col("_row").alias("_first"), "_vec", key)
        .join(points.select(F.col("_row").alias("_point"), F.col("_vec").alias("_same"), "_size", key), "_key")
        .where("_vec = _same")
        .select("_first", "_point", F.col("_size").alias("_copies"))
    )
    placed = stored(rows.select("_id", "_row", "_first").join(own, "_first", "left"), "vector-rows")

    plan = calibrated(points.count(), cosine, recall)
    projected = stored(_projected(points, plan), "vector-lists")
    found = stored(
        _compared(_blocks(_entries(projected, plan), projected, plan), plan), "vector-links"
    )
    roots = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("row").agg(F.sum("n").alias("_n")).join(
        roots.withColumnRenamed("node", "row"), "row"
    )
    by_point = placed.where("_point is not null").groupBy("_point").agg(F.min("_id").alias("_least"))
    grouped = by_point.join(
        links.select(F.col("row").alias("_point"), "_n", "root"), "_point", "left"
    ).withColumn("_root", F.coalesce("root", "_point"))
    smallest = grouped.groupBy("_root").agg(F.min("_least").alias("component_id"))
    points_out = stored(
        grouped.join(smallest, "_root").select("_point", "_n", "component_id"), "vector-components"
    )
    out = placed.join(points_out, "_point", "left")
    component = F.when(F.col("_point").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_id").alias("vec_id"),
        (F.coalesce("_n", F.lit(0)) + F.coalesce(F.col("_copies") - 1, F.lit(0)))
        .cast("long")
        .alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
