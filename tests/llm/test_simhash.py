"""SimHash near duplicates against plain fingerprints and all pairs."""

import re

import numpy as np
import pytest
import xxhash

from burstlens.llm import simhash
from burstlens.llm.components import components
from tests.llm.conftest import ODD_TEXTS


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(prints):
    """For each value the first value of its class, by comparing all pairs."""
    prints = np.array(prints, np.uint64)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_classes_of_odd_texts(odd, none):
    prints = [plain_fingerprint(t) for _, t in ODD_TEXTS]
    root = classes(prints)
    found = simhash.near_duplicates(odd).collect()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str)
    want = []
    for (i, _), p, c in zip(ODD_TEXTS, prints, root):
        ids = [j for (j, _), k in zip(ODD_TEXTS, root) if k == c and j is not None]
        want.append((i, signed(p), min(ids, default=None)))
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_class_stays_with_all_columns(odd, none):
    root = classes([plain_fingerprint(t) for _, t in ODD_TEXTS])
    kept = simhash.keep_one(odd)
    assert sorted(kept.columns) == sorted(odd.columns)
    rows = kept.collect()
    assert sorted(root[r.position] for r in rows) == sorted(set(root))
    assert simhash.keep_one(none).count() == 0


def dense(seed):
    """Balls of near values, one of them large, and a long chain."""
    r = np.random.default_rng(seed)
    found = set()
    for base in r.integers(0, 1 << 63, 25):
        for _ in range(20):
            flips = r.integers(0, 64, r.integers(0, 4))
            found.add(int(base) ^ sum(1 << int(b) for b in set(flips.tolist())))
    hot = int(r.integers(0, 1 << 63))
    found |= {hot ^ (int(x) << 5) for x in r.integers(0, 1 << 14, 400)}
    chain = int(r.integers(0, 1 << 63))
    for b in range(0, 60, 3):
        chain ^= 0b111 << b
        found.add(chain)
    return sorted(found)


@pytest.mark.parametrize(
    "hot, long_list, short_list", [(4096, 8192, 48), (40, 8192, 5), (40, 30, 5)]
)
def test_lists_of_all_kinds_lose_no_link(spark, monkeypatch, hot, long_list, short_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    monkeypatch.setattr(simhash, "SHORT_LIST", short_list)
    prints = dense(hot + long_list)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long").repartition(3)
    links = simhash.linked_fingerprints(df, hot)
    near = [(r.a ^ r.b) & (2**64 - 1) for r in links.collect()]
    assert near and (hot > 4000 or long_list == 30 or max(x.bit_count() for x in near) <= 3)
    root = {r.node: r.root for r in components(links).collect()}
    label = [root.get(signed(p), signed(p)) for p in prints]
    first = {}
    assert [first.setdefault(x, i) for i, x in enumerate(label)] == classes(prints)


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}
    assert got == want
    assert components(df.limit(0)).count() == 0
