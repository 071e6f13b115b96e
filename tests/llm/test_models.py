"""Learnt operators: exact statistics, constraints, and accuracy on held-out documents."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlens.llm.boosted_trees import fit, score
from burstlens.llm.label_model import fit_label_model, fit_linear
from burstlens.llm.language_id import fit_language, identify_language
from burstlens.llm.quality import fit_quality, score_quality
from burstlens.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm.conftest import ODD_TEXTS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held_out(n, r):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == r


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    n_symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), n_symbols, dup, len(covered)


def check_stats(rows, text_of):
    for r in rows:
        want = plain_stats(text_of(r))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_statistics_of_odd_texts(odd, none):
    found = score_quality(odd, None)
    assert found.columns[:4] == odd.columns
    rows = found.collect()
    assert len(rows) == len(ODD_TEXTS) and all(r.kept != r.base_failed for r in rows)
    check_stats(rows, lambda r: ODD_TEXTS[r.position][1])
    assert score_quality(none, None).count() == 0


def test_quality_of_documents(documents, labels):
    learn = labels.filter(F.col("doc_id") % 4 != 0)
    found = score_quality(documents, fit_quality(documents, learn))
    check_stats(found.collect(), lambda r: r.text)
    held = found.join(labels.filter(F.col("doc_id") % 4 == 0), "doc_id").filter("not base_failed")
    right = held.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert held.count() > 50 and right > 0.95


def test_models_need_both_labels(documents, labels):
    assert fit_quality(documents, labels.limit(0)) is None
    assert fit_quality(documents, labels.filter("quality = 1")) is None
    assert fit_toxicity(documents, labels.limit(0)) is None
    assert fit_language(documents.limit(0)) is None


def test_trees_keep_their_directions():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + 0.4 * r.normal(size=3000) > 0.6).astype(float)
    model = fit(x, y, [1, 0, -1], rounds=40)
    assert ((score(model, x) > 0.5) == y).mean() > 0.8
    for f, sign in ((0, 1), (2, -1)):
        line = np.repeat(r.random((20, 3)), 50, axis=0)
        line[:, f] = np.tile(np.linspace(0, 1, 50), 20)
        steps = np.diff(score(model, line).reshape(20, 50), axis=1) * sign
        assert steps.min() >= -1e-12


def test_label_model_finds_good_voters_and_copies():
    r = np.random.default_rng(0)
    y = r.random(5000) < 0.2
    good = [np.where(y, r.random(5000) < 0.8, r.random(5000) < 0.05) for _ in range(4)]
    noise = r.random(5000) < 0.3
    votes = np.column_stack([*good, noise, noise, noise])
    model = fit_label_model(votes, np.where(votes[:, :4].sum(axis=1) > 1, 0.7, 0.2))
    assert ((model.posterior > 0.5) == y).mean() > 0.95
    assert (model.fires1[:4] > 0.7).all() and (model.fires0[:4] < 0.1).all()
    assert model.correlation[4, 5] > 0.9 and model.weight[4] < 0.4 < model.weight[0]


def test_linear_classifier_follows_soft_targets():
    x = np.random.default_rng(1).normal(size=(2000, 2))
    target = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    assert np.allclose(fit_linear(x, target, 1e-3), [2, -1, 0.5], atol=0.05)


def test_toxicity_of_documents(documents, labels, odd, none):
    model = fit_toxicity(documents, labels.filter(~held_out(5, 0)))
    found = score_toxicity(documents, model).join(labels, "doc_id").filter(held_out(5, 0))
    right = found.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert found.count() > 40 and right > 0.93
    scored = score_toxicity(odd, model)
    assert scored.columns == ["doc_id", "text", "position", "score", "predicted"]
    rows = scored.collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert not any(r.predicted for r in rows)
    assert score_toxicity(none, model).count() == 0
    assert {r.score for r in score_toxicity(odd, None).collect()} == {0.0}


def test_language_of_documents(documents, odd, none):
    model = fit_language(documents.filter(~held_out(4, 2)))
    found = identify_language(documents, model).filter(held_out(4, 2))
    right = found.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97 and model.n_weights < 1 << 16
    scored = identify_language(odd, model)
    assert scored.columns == ["doc_id", "text", "position", "lang_pred", "score"]
    rows = scored.collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        text = ODD_TEXTS[r.position][1] or ""
        lettered = any(c.isalpha() for c in text)
        assert (r.lang_pred == "und") == (not lettered)
        assert (0 < r.score <= 1) if lettered else r.score == 0
    assert identify_language(none, model).count() == 0
    assert {r.lang_pred for r in identify_language(odd, None).collect()} == {"und"}


def test_hash_shares_of_any_size(spark):
    from pyspark.sql import functions as F

    from burstlens.llm.places import hash_share

    keys = spark.range(100_000).select(F.xxhash64("id").alias("k")).cache()
    for share in (0.0, 0.001, 0.25, 1.0):
        n = keys.filter(hash_share(F.col("k"), share)).count()
        assert abs(n - 100_000 * share) <= 5 * (100_000 * share * (1 - share)) ** 0.5
    least = spark.createDataFrame([(0,), (1 << 30,), (-1,)], "k long")
    assert least.filter(hash_share(F.col("k"), 1e-9)).count() == 2


def test_extra_columns_of_odd_types(odd):
    from burstlens.llm.places import added

    more = odd.selectExpr("*", "named_struct('content-type', 1, 'b c', map('x', array(1))) as s")
    plain, schema = added(more, {"n": "long", "SCORE": "array<int>"})
    assert schema.names == ["doc_id", "text", "position", "s", "n", "SCORE"]
    got = plain.mapInArrow(lambda batches: iter(()), schema)
    assert got.schema["s"].dataType == more.schema["s"].dataType and got.count() == 0
