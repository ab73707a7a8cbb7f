"""The pipeline's stages one by one, each against a plain version of its job."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from roundledger.llm import quality_classifier
from tests.llm.tables import docs
from tests.llm.test_mixing import WORD, filled
from tests.llm.test_near_dedup import brute_force
from tests.llm.test_packing import whole_ids
from tests.llm.test_quality import prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = prose(rng, 80)
        rows.append((i, text.replace(" ", "$$$ ### ") if bad else text, "en", f"s{i % 5}"))
        labels.append((i, 0 if bad else 1, 0))
    for i in range(30):
        source = rows[4 * i + 1][1]
        words = source.split()
        words[i % 40] = "changed"
        rows.append((300 + i, source.upper() if i % 2 else " ".join(words), "en", f"s{i % 5}"))
    rows += [(400, None, None, None), (401, "", "en", "s1")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    return folder


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    """Each stage's output, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {"documents": table}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, sf_dir).write.parquet(f"{root}/{name}")
        table = found[name] = spark.read.parquet(f"{root}/{name}")
    return found


def test_stages_keep_the_columns(outputs):
    *before, last = outputs
    assert list(outputs) == [
        "documents", "quality_classifier", "exact_dedup", "near_dedup", "mix_sources", "packing"
    ]
    for name in before:
        assert outputs[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(outputs[last].columns)


def test_quality_stage_drops_what_the_classifier_rejects(spark, sf_dir, outputs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_classifier.classify(outputs["documents"], labels).collect()
    kept = {r.doc_id for r in outputs["quality_classifier"].collect()}
    assert kept == {r.doc_id for r in judged if r.predicted == 1}
    clean = {i for i in range(240) if i % 4}
    assert len(clean & kept) >= 0.98 * len(clean) and len(kept & {i for i in range(0, 240, 4)}) <= 3


def test_dedup_stages(outputs):
    texts = {}
    for r in outputs["quality_classifier"].collect():
        key = (r.text or "").lower()
        texts[key] = max(texts.get(key, -1), r.doc_id)
    exact = outputs["exact_dedup"].collect()
    assert sorted(r.doc_id for r in exact) == sorted(texts.values())
    # Texts without words stay; of each component the smallest id does.
    roots = {least for doc_id, n, least in brute_force(exact) if n}
    blank = {doc_id for doc_id, n, _ in brute_force(exact) if not n}
    assert {r.doc_id for r in outputs["near_dedup"].collect()} == roots | blank


def test_near_stage_drops_copies_similar_to_four_fifths(spark, sf_dir):
    """Two words changed of 100: 86 of 106 shingles shared at most, 0.81 and above; with three less."""
    rng = random.Random(5)
    rows, kept = [], set()
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((4 * i, " ".join(words), "en", "a"))
        for copy, places in ((1, (30, 60)), (2, (10, 36, 72))):
            changed = list(words)
            for place in places:
                changed[place] = f"new{i}x{copy}x{place}"
            rows.append((4 * i + copy, " ".join(changed), "en", "a"))
        kept |= {4 * i, 4 * i + 2}
    shingles = lambda text: {tuple(text.split()[j : j + 5]) for j in range(96)}
    for first, near, far in zip(rows[::3], rows[1::3], rows[2::3]):
        a, b, c = (shingles(r[1]) for r in (first, near, far))
        assert 0.80 <= len(a & b) / len(a | b) < 0.85
        assert max(len(x & c) / len(x | c) for x in (a, b)) < 0.80
    got = corpus_pipeline.near(spark, docs(spark, rows), sf_dir).collect()
    assert {r.doc_id for r in got} == kept


def test_mix_meets_the_targets(outputs):
    size = lambda text: len(WORD.findall(text or ""))
    sizes, taken = Counter(), Counter()
    for r in outputs["near_dedup"].collect():
        sizes[r.source] += size(r.text)
    for r in outputs["mix_sources"].collect():
        taken[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    for source, target in filled(sizes).items():
        assert abs(taken[source] - target) <= 1


def test_packing_holds_every_token_once(outputs):
    expected = sum(len(whole_ids(r.text)) for r in outputs["mix_sources"].collect())
    rows = outputs["packing"].collect()
    assert sum(r.length for r in rows) == expected
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in rows)
    ends = Counter()
    for r in rows:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    lengths = Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert ends == lengths and max(ends.values()) <= 4096


def test_run_gives_the_last_stage(spark, sf_dir, outputs):
    rows = corpus_pipeline.run(spark, sf_dir).drop("ids").collect()
    assert sorted(rows) == sorted(outputs["packing"].drop("ids").collect())
