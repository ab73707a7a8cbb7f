import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from roundledger.llm import quality_classifier, quality_rules
from tests.llm.tables import awkward, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    lines = text.split("\n")
    repeated = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


@settings(max_examples=300)
@given(st.text(alphabet="ab \n\t#|é　\x0b\x85", max_size=60))
def test_measures_equal_plain_counts(text):
    assert quality_rules.measure_text(text.encode()) == plain_measures(text)


def prose(rng, words=120):
    vocabulary = [f"{a}{b}" for a in ("house", "river", "tree", "stone") for b in range(200)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def test_far_outliers_go_and_the_bulk_stays(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, prose(rng).replace(" ", " ### "), "en", "s0") for i in range(5)]
    rows += [(2000, "too short", "en", "s0"), (2001, "same words again " * 60, "en", "s1")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(5))
    assert got[2000].base_failed and got[2001].base_failed


def test_thresholds_adapt_to_the_source(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng), "en", "plain") for i in range(150)]
    rows += [(1000 + i, prose(rng).replace(" ", " # "), "en", "code") for i in range(150)]
    rows += [(5000, prose(rng).replace(" ", " # "), "en", "plain")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert all(got[1000 + i] for i in range(150)) and not got[5000]


def test_merged_sketches_equal_one_sketch(spark):
    rows = spark.range(20_000).selectExpr(
        "id % 4 AS g", *(f"CAST(id % 1000 AS double) AS {m}" for m in quality_rules.LEAST_SPREAD)
    )
    apart = quality_rules.merged(quality_rules.sketches(rows, ["g"]).selectExpr("*", "0 AS h"), ["h"])
    limits = quality_rules.fences(apart, ["h"]).first().limits
    assert limits.texts == 20_000
    assert abs(limits.symbol_rate.most - (750 + 3 * 500)) < 25


def test_fences_move_with_the_group_without_a_jump(spark):
    """Against the limits worked out from the quartiles of group and language."""
    rng = random.Random(4)
    table = []
    for source, n in (("a", 99), ("b", 100), ("c", 1), ("d", 700)):
        table += [
            ("en", source, *(float(rng.randrange(1000)) for _ in quality_rules.LEAST_SPREAD))
            for _ in range(n)
        ]
    rows = spark.createDataFrame(table, ["_lang", "_source", *quality_rules.LEAST_SPREAD])
    got = {r.of_source: r.limits for r in quality_rules.adapted_fences(rows, 3.0, 4096, 100).collect()}

    def limit(values):
        low, high = (np.quantile(values, q, method="inverted_cdf") for q in (0.25, 0.75))
        return high + 3 * (high - low)

    for at, measure in enumerate(quality_rules.LEAST_SPREAD, 2):
        wide = limit([r[at] for r in table])
        for source in "abcd":
            own = [r[at] for r in table if r[1] == source]
            part = len(own) / (len(own) + 100)
            low, high = (np.quantile(own, q, method="inverted_cdf") for q in (0.25, 0.75))
            mine = high + 3 * max(high - low, quality_rules.LEAST_SPREAD[measure])
            assert abs(got[source][measure].most - (part * mine + (1 - part) * wide)) < 15
    assert got["a"].symbol_rate.least is None and got["a"].word_length.least is not None


def test_rules_on_awkward_rows(spark):
    rows = quality_rules.quality_rules(awkward(spark)).collect()
    assert len(rows) == 12
    assert {r.doc_id for r in rows if r.kept} == {4}
    assert quality_rules.quality_rules(empty(spark)).collect() == []
    more = awkward(spark).selectExpr("*", "1 AS n_words", "2 AS limits", "3 AS of_lang")
    assert quality_rules.quality_rules(more).count() == 12


def labelled(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(rng, 60)
        rows.append((i, text.replace(" ", "$$$ ### ") if bad else text, "en", "a"))
        labels.append((i, 0 if bad else 1, 0))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_tells_held_out_texts_apart(spark):
    table, labels = labelled(spark)
    rows = quality_classifier.classify(table, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r.predicted == (r.doc_id % 4 != 0) for r in held)
    assert right / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    kept = quality_classifier.drop_bad(table, labels)
    assert kept.columns == table.columns and 280 <= kept.count() <= 320


def test_classifier_without_labels_and_on_awkward_rows(spark):
    _, labels = labelled(spark, 8)
    none = quality_classifier.classify(awkward(spark), labels.limit(0)).collect()
    assert len(none) == 12 and {r.score for r in none} == {0.5}
    odd = spark.createDataFrame(
        [(1, None, 0), (None, 1, 0), (4, 1, 0), (4, 0, 0), (5, 7, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = quality_classifier.classify(awkward(spark), odd).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.classify(empty(spark), labels).collect() == []


def test_logistic_fit_finds_the_slope():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0])))).astype(float)
    weights = quality_classifier.fit_logistic(x, y, np.ones(4000))
    assert np.abs(weights - [1, 2, 0]).max() < 0.25
