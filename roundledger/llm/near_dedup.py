"""Near-duplicates by HyperMinHash, banded registers and exact verification.

A document is the set of its distinct five-word shingles. Its shingle hashes
are dealt to 256 buckets by their leading bits; of the smallest hash of each
bucket only the number of leading zeros and some bits after the leading one are
stored, in 16 bits. Empty buckets borrow from others in a fixed random order.
Documents that agree in all registers of a band are candidates. A candidate
pair is dropped where the Jaccard similarity estimated from the registers,
corrected for chance collisions, is far below the threshold; every other pair
is verified on the full sets.

Copies of a set are one class. Within a bucket of a band not all pairs are
verified, as a bucket may hold a third of all documents; only what decides the
components is, and that exactly:

- every class is compared with the first of its bucket (one partner each);
- each class outside its bucket's largest component is compared with one drawn
  from it, a few times over: that brings nearly all classes of a group together
  for a few comparisons each;
- then, where a bucket still holds several components, all its members outside
  its largest one are compared with every member of another component, in blocks
  of bounded size that give out links only. A pair inside one component needs
  no comparing, and every pair across components has such a member at one end.
  So two classes that share a bucket and are similar enough always end up in
  one component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundledger.llm.components import components
from roundledger.llm.shared import WordMemo, mix64, shingle_hashes, stored, text_key, texts_of

SHINGLE_WORDS = 5
BUCKET_BITS = 8
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
# Pairs just at the threshold share no band this rarely, at most.
MOST_MISSED = 4e-5
# Links need 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 85
# A pair is dropped unverified only this many standard errors below the threshold.
ERRORS = 6.0
# How often classes draw a partner before they are compared with all others.
DRAWS = 1
# Rows of a bucket in a block, and up to which size buckets share blocks.
BLOCK_ROWS = 1024
SMALL_BUCKET = 64


def banding(link_percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss few enough pairs at the threshold.

    32 bands of 8 for 85 percent, 42 bands of 6 for 80.
    """
    j = link_percent / 100
    for rows in range(16, 1, -1):
        bands = REGISTERS // rows
        if (1 - j**rows) ** bands <= MOST_MISSED:
            return bands, rows
    return REGISTERS, 1


def word_hashes() -> WordMemo:
    return WordMemo(xxhash.xxh3_64_intdigest)


def shingle_set(content: bytes, memo: WordMemo, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text, lower-cased A to Z."""
    words = content.lower().split()
    return np.unique(shingle_hashes(memo.of(words), k))


def hyper_registers(hashes: np.ndarray) -> np.ndarray:
    """The 256 compressed registers of a non-empty sorted set of hashes.

    The leading bits pick the bucket. As the set is sorted, the first hash of a
    bucket is its smallest. A register holds the leading zeros of the other 56
    bits and ``MANTISSA_BITS`` bits after the leading one.
    """
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = hashes[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    # frexp gives the place of the leading one; the low bits lost do not matter.
    _, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(64 - BUCKET_BITS - exponent, 63).astype(np.uint64)
    shift = np.maximum(exponent - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    found = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    found[bucket[first]] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    filled[bucket[first]] = True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _borrow_order(empty)
        found[empty] = found[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return found


_ORDERS: dict[int, np.ndarray] = {}


def _borrow_order(buckets: np.ndarray) -> np.ndarray:
    """For each bucket all buckets in a fixed random order of its own."""
    if not _ORDERS:
        ids = np.arange(REGISTERS, dtype=np.uint64)
        keys = mix64((ids[:, None] << np.uint64(32)) + ids[None, :] + np.uint64(1))
        _ORDERS[0] = keys.argsort(axis=1)
    return _ORDERS[0][buckets]


def collision_rate(n_a: int, n_b: int) -> float:
    """How often registers of two sets without common hashes agree.

    A bucket holds about n / 256 hashes; its smallest has z leading zeros if it
    lies in [2**-(z + 1), 2**-z), and then the mantissas agree by chance.
    """
    edges = 2.0 ** -np.arange(65 - BUCKET_BITS)

    def zeros(n: int) -> np.ndarray:
        none_below = (1 - edges) ** max(1.0, n / REGISTERS)
        return np.diff(none_below)

    return float((zeros(n_a) * zeros(n_b)).sum()) / (1 << MANTISSA_BITS)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Jaccard similarity from registers, corrected for chance collisions."""
    return corrected(float((a == b).mean()), n_a, n_b)


def corrected(agreeing: float, n_a: int, n_b: int) -> float:
    """The similarity that a share of agreeing registers stands for."""
    chance = collision_rate(n_a, n_b)
    return max(0.0, (agreeing - chance) / (1 - chance))


def least_estimate(size: int, link_percent: int) -> float:
    """Below this estimate a pair with ``size`` shingles cannot well be a link."""
    j = link_percent / 100
    return j - ERRORS * math.sqrt(j * (1 - j) / max(1, min(size, REGISTERS)))


def linked(a: np.ndarray, b: np.ndarray, link_percent: int) -> bool:
    """Whether two full sets are similar enough."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= link_percent * (len(a) + len(b) - common)


def signatures(docs: DataFrame, text: str, doc_id: str, key: str = "_key") -> DataFrame:
    """id, key, ``n_shingles``, ``digest`` of the set and its ``registers``."""
    schema = (
        T.StructType([T.StructField("_id", docs.schema[doc_id].dataType)])
        .add("_key", "long")
        .add("n_shingles", "long")
        .add("digest", "binary")
        .add("registers", "binary")
    )

    def run(batches):
        memo = word_hashes()
        for batch in batches:
            rows = []
            for content in texts_of(batch.column("_text")):
                hashes = shingle_set(content, memo)
                if len(hashes):
                    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                    rows.append((len(hashes), digest, hyper_registers(hashes).tobytes()))
                else:
                    rows.append((0, None, None))
            sizes, digests, registers = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_key"), pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()), pa.array(registers, pa.binary()),
                ],
                schema.names,
            )

    source = docs.select(
        F.col(doc_id).alias("_id"), F.col(key), F.col(text).alias("_text")
    )
    return source.mapInArrow(run, schema)


def _verified(pairs: DataFrame, link_percent: int) -> DataFrame:
    """Edges ``a``, ``b`` of the pairs that are links, from texts and registers."""

    def run(batches):
        memo = word_hashes()
        last = (None, None)
        for batch in batches:
            keep = []
            ids = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            registers = [
                [np.frombuffer(r, np.uint16) for r in batch.column(c).to_pylist()]
                for c in ("a_registers", "b_registers")
            ]
            sizes = list(zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist()))
            left, right = texts_of(batch.column("a_text")), texts_of(batch.column("b_text"))
            for i, (a, _) in enumerate(ids):
                estimate = estimated_jaccard(registers[0][i], registers[1][i], *sizes[i])
                if estimate < least_estimate(min(sizes[i]), link_percent):
                    continue
                if last[0] != a:
                    last = (a, shingle_set(left[i], memo))
                if linked(last[1], shingle_set(right[i], memo), link_percent):
                    keep.append(ids[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keep], pa.int64()) for i in range(2)], ["a", "b"]
            )

    return pairs.mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, classes: DataFrame, link_percent: int) -> DataFrame:
    """Verified edges among pairs ``a`` (pivot), ``b`` of class ids."""
    side = lambda s: classes.select(
        F.col("class").alias(s), F.col("n_shingles").alias(f"{s}_n"),
        F.col("registers").alias(f"{s}_registers"), F.col("text").alias(f"{s}_text"),
    )
    # Sets too different in size cannot be similar; sizes alone are joined first.
    sizes = classes.select("class", "n_shingles")
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    alike = (
        pairs.join(sizes.toDF("b", "b_n"), "b")
        .join(sizes.toDF("a", "a_n"), "a")
        .where(100 * small >= link_percent * large)
        .select("a", "b")
    )
    full = alike.join(side("b"), "b").join(side("a"), "a")
    return _verified(full, link_percent)


def _split_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets with several components.

    ``bucket``, ``band``, ``class``, ``root``, the bucket's largest component ``top`` and
    how many members that has (``n_top``).
    """
    member = buckets.join(roots.toDF("class", "root"), "class", "left").select(
        "bucket", "band", "class", F.coalesce("root", "class").alias("root")
    )
    parts = member.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    top = (
        parts.groupBy("bucket")
        .agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("bucket", F.col("top.root").alias("top"), F.col("top.n").alias("n_top"))
    )
    return stored(member.join(top, "bucket"), "near-split")


def _drawn_pairs(split: DataFrame, round_: int) -> DataFrame:
    """Each member outside its bucket's largest component with about one drawn from it."""
    place = lambda *by: F.pmod(F.xxhash64(F.lit(round_), *by), F.col("n_top"))
    inside = split.where("root = top").select(
        "bucket", place("class").alias("place"), F.col("class").alias("a")
    )
    outside = split.where("root != top").select(
        "bucket", place("class", "bucket").alias("place"), F.col("class").alias("b")
    )
    return inside.join(outside, ["bucket", "place"]).select("a", "b").distinct()


def _blocks(split: DataFrame) -> DataFrame:
    """Pairs of a split bucket's members and its open ones, dealt out in blocks.

    Open are the members outside the largest component. Members and open ones
    of a large bucket are cut into shards of bounded size, with a block for
    each pair of shards; many small buckets share a block.
    """
    sizes = split.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum((F.col("root") != F.col("top")).cast("long")).alias("n_open")
    )
    shards = lambda column: F.ceil(F.col(column) / F.lit(BLOCK_ROWS))
    shard = lambda of: F.pmod(F.xxhash64("class"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    small = max(1, -(-split.count() // BLOCK_ROWS))
    rows = split.join(sizes, "bucket").select(
        "bucket", "band", "class", "root", "top", (F.col("n") <= SMALL_BUCKET).alias("small"),
        shards("n").alias("shards"), shards("n_open").alias("open_shards"),
    )
    members = rows.select(
        "*", F.lit(False).alias("pivot"), shard("shards").alias("m"), each("open_shards").alias("p")
    )
    pivots = rows.where("root != top").select(
        "*", F.lit(True).alias("pivot"), each("shards").alias("m"), shard("open_shards").alias("p")
    )
    block = F.when(F.col("small"), F.pmod(F.xxhash64("bucket"), F.lit(small))).otherwise(
        F.xxhash64("bucket", "m", "p")
    )
    return members.unionByName(pivots).select(
        block.alias("block"), "bucket", "band", "class", "root", "pivot"
    )


def _block_links(split: DataFrame, classes: DataFrame, link_percent: int) -> DataFrame:
    """All links between components that share a bucket, as edges ``a``, ``b``.

    A pair is looked at in the first band it shares only. The registers are
    compared first, the full sets where they leave a chance.
    """

    bands_, rows_ = banding(link_percent)

    def run(table):
        memo = word_hashes()
        bucket, band, class_, root, n = (
            table[c].to_numpy() for c in ("bucket", "band", "class", "root", "n_shingles")
        )
        pivot = np.array(table["pivot"].to_pylist(), bool)
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16)
        registers = registers.reshape(-1, REGISTERS)
        texts, sets = table["text"], {}

        def set_of(row: int) -> np.ndarray:
            found = sets.get(class_[row])
            if found is None:
                found = shingle_set((texts[row].as_py() or "").encode(), memo)
                sets[class_[row]] = found
            return found

        edges = []
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            members = rows[~pivot[rows]]
            for i in rows[pivot[rows]]:
                alike = (100 * np.minimum(n[members], n[i]) >= link_percent * np.maximum(
                    n[members], n[i]
                )) & (root[members] != root[i])
                near = members[alike]
                same = registers[near] == registers[i]
                bands = same[:, : bands_ * rows_].reshape(len(near), bands_, rows_).all(axis=2)
                first = bands.argmax(axis=1) == band[i]
                for j, agreeing in zip(near[first], same[first].mean(axis=1)):
                    estimate = corrected(float(agreeing), int(n[i]), int(n[j]))
                    if estimate >= least_estimate(int(min(n[i], n[j])), link_percent) and linked(
                        set_of(i), set_of(j), link_percent
                    ):
                        edges.append((class_[i], class_[j]))
        return pa.table({c: pa.array([e[k] for e in edges], pa.int64()) for k, c in enumerate("ab")})

    return (
        _blocks(split).join(classes, "class").groupBy("block").applyInArrow(run, "a long, b long")
    )


def class_components(
    buckets: DataFrame, classes: DataFrame, link_percent: int, draws: int = DRAWS
) -> DataFrame:
    """``node``, ``root`` of the classes that have links.

    ``buckets`` (``bucket``, ``band``, ``class``) holds buckets of two or more.
    """
    # The smallest bucket mate over all bands: one partner for each class.
    first = buckets.groupBy("bucket").agg(F.min("class").alias("a"))
    pairs = (
        buckets.join(first, "bucket")
        .where("a != class")
        .groupBy(F.col("class").alias("b"))
        .agg(F.min("a").alias("a"))
    )
    edges = stored(_links(pairs, classes, link_percent), "near-links")
    roots = stored(components(edges), "near-roots")
    split = _split_buckets(buckets, roots)
    for draw in range(draws):
        found = stored(_links(_drawn_pairs(split, draw), classes, link_percent), "near-links")
        if found.isEmpty():
            break
        edges = edges.union(found)
        roots = stored(components(edges), "near-roots")
        split = _split_buckets(buckets, roots)
    found = stored(_block_links(split, classes, link_percent), "near-links")
    if found.isEmpty():
        return roots
    return stored(components(edges.union(found)), "near-roots")


def near_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    link_percent: int = LINK_PERCENT,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if the Jaccard similarity of their shingle sets is
    at least ``link_percent`` / 100; the component's id is the smallest id
    reachable over links, and ``kept`` tells the document of that id. A text of
    fewer than five words is one shingle; NULL, empty and blank texts have none,
    are linked with nothing and stay. Rows with equal ids count as one document
    each; if several rows of a component carry its smallest id, all are marked
    kept (``drop_near_copies`` keeps one of them). Rows with a NULL id are
    linked like others, but a NULL id is never a component's id unless all its
    ids are NULL. An empty table gives an empty result.
    """
    keyed = docs.select(doc_id, text).withColumn("_key", text_key(doc_id, text))
    signed = stored(signatures(keyed, text, doc_id), "near-signatures")
    marked = _marked(keyed, signed, text, doc_id, link_percent)
    return marked.select(
        F.col("_id").alias(doc_id), "n_shingles", "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _marked(
    keyed: DataFrame, signed: DataFrame, text: str, doc_id: str, link_percent: int
) -> DataFrame:
    """``signed`` rows plus ``component_id``."""
    # A class is known by a row of it, the one with the smallest key.
    copies = (
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("_key").alias("class"),
            F.min("_id").alias("class_id"),
            F.first("registers").alias("registers"),
            F.first("n_shingles").alias("n_shingles"),
        )
    )
    copies = stored(copies, "near-classes")
    n_bands, rows = banding(link_percent)
    bands = F.array(
        *(
            F.xxhash64(F.lit(band), F.substring("registers", 1 + 2 * rows * band, 2 * rows))
            for band in range(n_bands)
        )
    )
    banded = copies.select("class", F.posexplode(bands).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stored(banded.join(shared, "bucket").select("bucket", "band", "class"), "near-buckets")
    wanted = buckets.select("class").distinct()
    # Texts of the classes with bucket mates; equal keys are equal rows.
    texts = (
        keyed.select(F.col("_key").alias("class"), F.col(text).alias("text"))
        .join(wanted, "class", "left_semi")
        .dropDuplicates(["class"])
    )
    classes = stored(
        copies.select("class", "n_shingles", "registers").join(texts, "class"), "near-texts"
    )
    roots = class_components(buckets, classes, link_percent)
    by_class = copies.select("digest", "class", "class_id").join(
        roots.toDF("class", "root"), "class", "left"
    ).select("digest", "class_id", F.coalesce("root", "class").alias("root"))
    least = by_class.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = by_class.join(least, "root").select("digest", "component_id")
    # Rows without shingles are components of their own.
    some = signed.where("digest is not null").join(named, "digest")
    none = signed.where("digest is null").withColumn("component_id", F.col("_id"))
    columns = ["_id", "_key", "n_shingles", "component_id"]
    return some.select(*columns).unionByName(none.select(*columns))


def drop_near_copies(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    link_percent: int = LINK_PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each component.

    Of several rows with a component's smallest id one stays, whichever. Components
    whose ids are all NULL, and rows without shingles (NULL, empty and blank
    texts), stay whole. Texts of any length are compared whole; further columns
    stay as they are, whatever their names. An empty table gives an empty result.
    """
    # The row as one column, so that no name can clash.
    keyed = docs.select(
        F.struct("*").alias("_row"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text"),
        text_key(doc_id, text).alias("_key"),
    )
    signed = stored(signatures(keyed, "_text", "_doc"), "near-signatures")
    marked = _marked(keyed, signed, "_text", "_doc", link_percent)
    rows = keyed.select("_key", "_row")
    chosen = (
        marked.where("n_shingles > 0 and _id = component_id")
        .groupBy("component_id")
        .agg(F.min("_key").alias("_key"))
        .select("_key")
    )
    others = marked.where("n_shingles = 0 or component_id is null").select("_key").distinct()
    # Rows equal in id and text share a key; of those with shingles one is enough.
    one = rows.join(chosen, "_key", "left_semi").dropDuplicates(["_key"])
    return one.union(rows.join(others, "_key", "left_semi")).select("_row.*")
