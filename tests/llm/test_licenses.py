import random
import re

import pytest

from burstlens.llm.licenses import BASE, NOTICES, WORD, Notice, license_digest, scan_licenses

EVERY = (*BASE, *NOTICES)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def walk(text):
    """All notices at all places, by comparing each place with each notice."""
    words = re.findall(WORD, lower(text))
    found = []
    for start in range(len(words)):
        for n, notice in enumerate(EVERY):
            own = words[start : start + len(notice.tokens)]
            if len(own) < len(notice.tokens):
                continue
            same = [a == b for a, b in zip(own, notice.tokens)]
            if sum(same) >= notice.needed and all(same[i] for i in notice.mandatory):
                found.append((notice.label, start, start + len(own), sum(same) / len(own), n < len(BASE)))
    return len(words), found


def scanned(docs):
    return [(r.text, r.n_words, [tuple(x) for x in r.licenses]) for r in scan_licenses(docs).collect()]


def test_random_texts_equal_a_walk(spark):
    rng = random.Random(4)
    filler = ["the", "By", "license", "é", "Public", "Kit", "x1", "software"]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            own = list(rng.choice(EVERY).tokens)
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(filler)
            cut = rng.choice([0, 0, 0, 1])
            words += own[cut:] + rng.choices(filler, k=rng.randrange(3))
        texts.append(rng.choice([" ", "\n", "-", ", "]).join(w.upper() if rng.random() < 0.3 else w for w in words))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = scanned(docs)
    assert len(got) == len(texts)
    for text, n, found in got:
        assert (n, found) == walk(text)
    assert sum(len(f) for _, _, f in got) > 200


def test_odd_texts(odd, none):
    more = odd.selectExpr("*", "named_struct('content-type', 1) as s", "map('a', 1) as m", "array(1) as N_Words")
    got = scan_licenses(more)
    assert got.columns == [*odd.columns, "s", "m", "n_words", "licenses"]
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, r.licenses) == walk(r.text)
    assert scan_licenses(none).count() == 0


def test_a_text_of_many_notices(spark):
    docs = spark.createDataFrame([("MIT license. " * 20_000,)], "text string")
    r = license_digest(scan_licenses(docs)).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (40_000, 20_000, 0, 39_998)
    assert (r.base_labels, r.labels, r.score) == ("mit", "mit", 1.0)


def test_no_python_and_no_window(odd):
    plan = scan_licenses(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


def test_key_phrases_belong_to_their_notice():
    with pytest.raises(ValueError):
        Notice("x", "a b c", ("b d",)).mandatory
