import math
import zlib
from collections import Counter

import numpy as np
import pytest

from roundledger.llm import lm_score
from tests.llm.tables import awkward, docs, empty


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base(rows):
    """(id, held out, tokens, known, base score) by the plain formula."""
    held = lambda r: zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 == 2
    counts = Counter(t for r in rows if not held(r) for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    return [
        (
            r.doc_id, held(r), len(tokens(r.text)), sum(counts[t] > 0 for t in tokens(r.text)), n,
            sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r.text)),
        )
        for r in rows
    ]


def prose(spark, n=400):
    words = ["the", "of", "house", "houses", "river", "run", "running", "runs", "and", "tree"]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 40)), "en", "a") for i in range(n)]
    return docs(spark, rows)


@pytest.mark.parametrize("make", [awkward, prose])
def test_base_counts_and_scores(spark, make):
    table = make(spark)
    got = lm_score.score_documents(table).collect()
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    plain = [
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got
    ]
    expected = base(table.collect())
    for a, b in zip(sorted(plain, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5])
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_model_beats_the_base_on_held_out_prose(spark):
    rows = [r for r in lm_score.score_documents(prose(spark)).collect() if r.held_out]
    assert len(rows) > 20
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def plain_mixer():
    levels = 0.5 + 0.49 * np.arange(lm_score.LEVELS) / lm_score.LEVELS
    return lm_score.Mixer(
        lm_score.start_weights(), np.tile(levels, (lm_score.GATES, 1)).astype(np.float32)
    )


def keys_of(words):
    """Item keys of one text's words, the end among them."""
    names = sorted(set(words))
    hashes = np.array([lm_score.word_hash(w) for w in names], np.uint64)
    ids = np.array([names.index(w) for w in words])
    return lm_score.item_keys(ids, np.array([0]), hashes).tolist()


def brute_scores(rows, mixer):
    """Scores of all rows by counts in dictionaries, one bit after the other."""
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    words, nodes, codes = Counter(), Counter(), Counter()
    bits, low = lm_score.CODE_BITS, (1 << lm_score.CODE_BITS) - 1
    contexts = lambda key: (0, ("one", key >> (bits + lm_score.BEFORE_BITS)), ("two", key >> bits))
    for r in rows:
        if not held(r):
            words.update(tokens(r.text))
            for key in keys_of(tokens(r.text)):
                codes[key & low] += 1
                for context in contexts(key):
                    for depth in range(bits + 1):
                        nodes[context, depth, (key & low) >> (bits - depth)] += 1
    total, once = sum(words.values()), sum(n == 1 for n in words.values())
    escape = (once + 0.5) / (total + 1)
    examples = [w for w in words if w]
    speller = Counter()
    for block, _ in lm_score.spell_codes(examples):
        for order, values in enumerate(block):
            speller.update((order, int(c)) for c in values)
    scores = []
    for r in rows:
        score = 0.0
        for word, key in zip(tokens(r.text), keys_of(tokens(r.text))):
            if not words[word]:
                chance = [1 / 256] * (len(word) + 1)
                for block, _ in lm_score.spell_codes([word]):
                    for order, values in enumerate(block):
                        for i, code in enumerate(values.tolist()):
                            after = [n for (o, c), n in speller.items() if o == order and c >> 8 == code >> 8]
                            if after:
                                chance[i] = (speller[order, code] + len(after) * chance[i]) / (
                                    sum(after) + len(after)
                                )
                score += math.log10(escape) + sum(map(math.log10, chance))
                continue
            score += math.log10(1 - escape) + math.log10(words[word] / codes[key & low])
            for place in range(bits):
                counts = [
                    (
                        nodes[c, place, (key & low) >> (bits - place)],
                        nodes[c, place + 1, (key & low) >> (bits - place - 1)],
                    )
                    for c in contexts(key)
                ]
                if counts[0][0] == counts[0][1]:
                    continue
                odds = [
                    math.log(bit + a) - math.log(whole - bit + a)
                    for (whole, bit), a in zip(counts, lm_score.ADDED)
                ]
                one, two = counts[1][0], counts[2][0]
                gate = place * 16 + 4 * sum(two > x for x in (0, 1, 3)) + sum(one > x for x in (0, 3, 31))
                mixed = float(np.clip(np.dot(mixer.weights[gate], odds), -lm_score.MOST_ODDS, lm_score.MOST_ODDS))
                place = abs(mixed) * (lm_score.LEVELS - 1) / lm_score.MOST_ODDS
                likelier = np.interp(place, range(lm_score.LEVELS), mixer.refined[gate])
                score += math.log10(
                    0.5 / (1 + math.exp(-mixed)) + 0.5 * (likelier if mixed > 0 else 1 - likelier)
                )
        scores.append((r.doc_id, score))
    return scores


@pytest.mark.parametrize("shard_bytes", [2**23, 200])
def test_scores_are_those_of_plain_counting(spark, monkeypatch, shard_bytes):
    """With few and many shards, the latter with frequent words dealt over several."""
    monkeypatch.setattr(lm_score, "SHARD_BYTES", shard_bytes)
    rng = np.random.default_rng(7)
    words = ["the", "a", *(f"w{i}" for i in range(60))]
    chances = np.array([20.0, 10.0, *[1.0] * 60])
    texts = [" ".join(rng.choice(words, 30, p=chances / chances.sum())) for _ in range(40)]
    texts += [texts[0], texts[1] + " neverseen" + str(shard_bytes), "", None]
    table = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.score for r in lm_score.score_documents(table, mixer=plain_mixer()).collect()}
    for doc_id, score in brute_scores(table.collect(), plain_mixer()):
        assert got[doc_id] == pytest.approx(score, rel=1e-4)


def test_frequent_words_get_shards_of_their_own(spark):
    busy = spark.createDataFrame([(5, 700), (9, 100), (5, 100), (7, 210)], "last long, items long")
    shards = lm_score.shards_of(busy, 10, 1000)
    assert shards.hot.tolist() == [5, 7] and shards.parts.tolist() == [8, 3]
    keys = np.array(
        [(last << 38) | (before << 20) for last in (5, 7, 9) for before in range(0, 1 << 18, 999)],
        np.uint64,
    )
    of = shards.of(keys)
    last = lm_score.last_of(keys)
    assert set(of[last == 5]) == set(range(10, 18)) and set(of[last == 7]) == set(range(18, 21))
    assert set(of[last == 9]) == {0}


def test_scrambled_texts_score_lower(spark):
    """Held-out texts that keep the order of words against the same words shuffled."""
    rng = np.random.default_rng(3)
    follows = {w: rng.choice(40, 3, replace=False) for w in range(40)}

    def walk():
        at, out = int(rng.integers(40)), []
        for _ in range(40):
            out.append(f"word{at}")
            at = int(rng.choice(follows[at]))
        return out

    rows, pairs = [], []
    for i in range(0, 1200, 2):
        words = walk()
        held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in (i, i + 1)]
        rows.append((i, " ".join(words), "en", "a"))
        if all(held):
            rows.append((i + 1, " ".join(rng.permutation(words)), "en", "a"))
            pairs.append((i, i + 1))
    got = {r.doc_id: r.score for r in lm_score.score_documents(docs(spark, rows)).collect()}
    assert len(pairs) > 3
    assert all(got[a] > got[b] + 5 for a, b in pairs)


def test_spelling_is_a_distribution():
    """A word and all words that are one byte longer share its prefix: at most one in sum."""
    words = [b"abc", b"abd", b"xab", b"y" * 5000]
    codes, counts = [], []
    stacked = np.concatenate([c for c, _ in lm_score.spell_codes(words)], axis=1)
    for values in stacked:
        code, n = np.unique(values.astype(np.int64), return_counts=True)
        codes.append(code)
        counts.append(n.astype(float))
    speller = lm_score.Speller(tuple(codes), tuple(counts))
    longer = [b"ab", *(b"ab" + bytes([c]) for c in range(256) if c != 0x20)]
    scores = lm_score.spelled([*longer, *words], speller)
    assert 0 < (10 ** scores[: len(longer)]).sum() <= 1
    # Words spelled alone or together get the same.
    assert scores[len(longer) :] == pytest.approx([lm_score.spelled([w], speller)[0] for w in words])


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm_score.unpacked_keys(lm_score.packed_keys(keys), len(keys)) == keys).all()
    assert len(lm_score.unpacked(lm_score.packed(np.zeros(0, np.float32)), 0, np.float32)) == 0


def test_word_lists_travel_in_blocks(spark):
    """A block a chunk and bucket, not a row a word; counts and places are those of the texts."""
    table = prose(spark, 60).coalesce(2)
    parts = lm_score.chunks(table, "text", "doc_id", 1, 3)
    lists = parts.where("words is not null")
    blocks = lists.collect()
    assert len(blocks) <= 3 * parts.where("blob is not null").count()
    assert len({(r.chunk, r.bucket) for r in blocks}) == len(blocks)
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    expected = Counter({t: 0 for r in table.collect() for t in tokens(r.text)})
    for r in table.collect():
        expected.update([] if held(r) else tokens(r.text))
    counted = lm_score.word_counts(lists).collect()
    assert {bytes(r.word): r.n for r in counted} == dict(expected) and len(counted) == len(expected)
    scored = lm_score.word_counts(lists).selectExpr("*", "length(word) + 0.5D AS score")
    found = {(r.of, r.at): r for r in lm_score.scored_lists(lists, scored).collect()}
    for r in blocks:
        got = found[r.chunk, r.at]
        words = lm_score.parted(r.words)
        assert lm_score.unpacked(got.n, got.size, np.int64).tolist() == [expected[w] for w in words]
        assert lm_score.unpacked(got.score, got.size, np.float32).tolist() == [len(w) + 0.5 for w in words]


def test_joined_words_come_back():
    for words in ([b""], [b"a"], [b"a", b"", "ø\u00a0x".encode()]):
        assert lm_score.parted(lm_score.joined(words)) == words


def test_keys_are_numbered_as_by_unique():
    for keys in ([], [5], [7, 2, 7, 2**63 + 1, 0]):
        keys = np.array(keys, np.uint64)
        for got, expected in zip(lm_score.numbered(keys), np.unique(keys, return_inverse=True)):
            assert got.tolist() == expected.tolist()


def test_documents_summed_in_blocks_score_the_same(spark, monkeypatch):
    table = prose(spark, 60)
    whole = {r.doc_id: r for r in lm_score.score_documents(table).collect()}
    monkeypatch.setattr(lm_score, "TOKENS", 100)
    assert {r.doc_id: r for r in lm_score.score_documents(table).collect()} == whole


def test_empty_table_and_no_training_rows(spark):
    assert lm_score.score_documents(empty(spark)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score.score_documents(docs(spark, [(held, "some words", "en", "a")])).collect()[0]
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert row.base_score == 0.0 and row.score < 0
