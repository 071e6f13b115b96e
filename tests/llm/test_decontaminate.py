"""The FM-index against plain search, and contamination against a plain walk."""

import re

import numpy as np
import pytest

from burstlens.llm import decontaminate
from burstlens.llm.fm_index import FMIndex, suffix_order

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "Alpha, beta-gamma!"), (3, None), (4, ""), (None, "lonely phrase"), (2, "delta")]
DOCS = [
    (1, None, "a"),
    (2, "", "b"),
    (3, "no hit here", "c"),
    (4, f"before {PASSAGE.upper()} after alpha beta. GAMMA delta", "d"),
    (5, "one two three four five six seven eight nine ten", "e"),
    (5, "one two three four five six seven eight nine ten", "e"),
    (6, "one two three four five six seven eight nine", "f"),
    (7, ("filler " * 500 + PASSAGE + " ") * 40, "g"),
    (8, "é lonely\nphrase 日本 alpha", "h"),
    (9, " ".join([PASSAGE] * 3), "i"),
]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def walk(text):
    """Hit words and items of a text."""
    own, hit, items = words(text), set(), set()
    for name, item in ITEMS:
        w = words(item)
        for p in [w[i : i + 10] for i in range(max(1, len(w) - 9))] if w else []:
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    items.add("null" if name is None else str(name))
    return len(own), len(hit), sorted(items)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, Spans string").repartition(2)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("index_words, block_words", [(2_000_000, 10**6), (50, 10**6), (10**6, 8)])
def test_hits_equal_the_walk(tables, monkeypatch, index_words, block_words):
    monkeypatch.setattr(decontaminate, "INDEX_WORDS", index_words)
    docs, items = tables
    found = decontaminate.find_contamination(docs, items, block_words=block_words)
    assert found.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    rows = found.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == walk(r.text), r.doc_id
        raw = (r.text or "").encode()
        inside = [w for a, b in r.spans for w in words(raw[a:b].decode())]
        assert len(inside) == r.n_hit
        assert all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:]))


def test_cut_texts_have_no_hit_left(tables):
    docs, items = tables
    found = decontaminate.find_contamination(docs, items)
    cut = decontaminate.without_spans(found)
    assert cut.columns == found.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "no hit here"
    assert texts[4] == "before  after " and texts[6] == DOCS[6][1]
    again = decontaminate.find_contamination(cut, items)
    assert again.agg({"n_hit": "sum"}).first()[0] == 0


def test_empty_tables(tables):
    docs, items = tables
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0
    clean = decontaminate.find_contamination(docs, items.limit(0))
    assert clean.count() == len(DOCS) and clean.agg({"n_hit": "sum"}).first()[0] == 0


def test_index_finds_and_locates_all_occurrences():
    r = np.random.default_rng(1)
    for _ in range(60):
        sizes = r.integers(0, 40, r.integers(1, 8))
        first = np.concatenate([[0], np.cumsum(sizes)])
        n_symbols = int(r.integers(1, 5))
        text = r.integers(1, n_symbols + 1, first[-1])
        index = FMIndex(text, first, n_symbols)
        phrases = r.integers(0, n_symbols + 1, (10, 3))
        lengths = r.integers(1, 4, 10)
        for p, n, lo, hi in zip(phrases, lengths, *index.find(phrases, lengths)):
            want = [
                i
                for a, b in zip(first, first[1:])
                for i in range(a, b - n + 1)
                if (text[i : i + n] == p[:n]).all()
            ]
            assert sorted(index.locate(np.arange(lo, max(lo, hi))).tolist()) == want


def test_suffix_order_of_repetitive_text():
    for symbols in ([1] * 50, [2, 1] * 30, list(range(20)), [3]):
        want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert suffix_order(np.array(symbols)).tolist() == want
