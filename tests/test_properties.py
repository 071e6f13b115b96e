"""Random traces against the sequential walk, and invariance of the plan."""

import random

import pytest

from burstlens import (
    PROFILES,
    access_gaps,
    assign_bursts,
    burst_stats,
    detect,
    detections_by_set,
    link_bursts,
    prune_sets,
    qualifying,
    qualifying_bursts,
    with_cache_coords,
)
from tests.helpers import access, keyed, table, walk

TIGHT = PROFILES["L1D"].with_(assoc=2, size=2 * 64 * 4, intra=3, inter=12, line=64)
LOOSE = PROFILES["L1D"].with_(assoc=4, size=4 * 64 * 4, intra=9, inter=40, line=64)
FETCHES = TIGHT.with_(has_kinds=False)


def random_trace(seed, n=600):
    r = random.Random(seed)
    rows, t, s = [], 0, 0
    for _ in range(n):
        t += r.choice([1, 1, 1, 2, 3, 8, 30]) if r.random() < 0.4 else 1
        if r.random() < 0.3:
            s = r.randrange(4)
        rows.append((t, int(r.random() < 0.7), access(s, r.randrange(6))))
    return rows


def hot_trace(n=500):
    """One set that is never left for long: bursts across many chunks."""
    r = random.Random(7)
    return [(t, 1, access(0 if t % 3 else r.randrange(4), t % 11)) for t in range(n)]


TRACES = {"random": random_trace(0), "other": random_trace(3), "hot": hot_trace()}


@pytest.mark.parametrize(
    "name, profile",
    [("random", TIGHT), ("other", LOOSE), ("random", FETCHES), ("hot", LOOSE)],
    ids=["tight", "loose", "fetches", "hot"],
)
def test_bursts_and_detections_equal_the_walk(spark, name, profile):
    rows = TRACES[name]
    trace = table(spark, rows, partitions=3).cache()
    bursts, found = walk(rows, profile, (0, 1))
    coords = with_cache_coords(trace, profile)
    for chunk in (1 << 20, 17, 1):
        got = burst_stats(coords, profile, chunk)
        columns = ("rw", "set_idx", "n_lines", "center", "n_access", "first_idx", "last_idx")
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == bursts, chunk
    want = [(None if k == -1 else k, *rest) for k, *rest in found]
    for options in (dict(), dict(chunk=29), dict(chunk=3)):
        got = detect(trace, profile, "BOTH", **options)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), options


@pytest.mark.parametrize("name", ["other", "hot"])
def test_all_chains_equal_the_walk(spark, name):
    rows = TRACES[name]
    _, found = walk(rows, LOOSE, (0, 1), all_chains=True)
    for options in (dict(), dict(chunk=50)):
        got = detect(table(spark, rows), LOOSE, "BOTH", all_chains=True, **options)
        assert keyed(got) == found


def test_dropping_hopeless_rows_changes_no_qualifying_burst(spark):
    for name, rows in TRACES.items():
        coords = with_cache_coords(table(spark, rows), LOOSE)
        plain = qualifying(burst_stats(coords, LOOSE, 23), LOOSE)
        assert keyed(qualifying_bursts(coords, LOOSE, 23)) == keyed(plain), name


def test_result_does_not_depend_on_partitions_or_input_order(spark):
    rows = random_trace(11)
    want = keyed(detect(table(spark, rows), TIGHT, "BOTH"))
    assert want
    random.Random(1).shuffle(rows)
    for parts, chunk in ((1, 40), (64, 40), (8, 1 << 20)):
        assert keyed(detect(table(spark, rows, parts), TIGHT, "BOTH", chunk=chunk)) == want


def test_gaps_and_burst_ids_across_chunks(spark):
    rows = random_trace(5, n=300)
    coords = with_cache_coords(table(spark, rows), TIGHT)
    last, ids, want = {}, {}, []
    for t, rw, paddr in sorted(rows):
        key = (rw, paddr >> 6 & 3)
        gap = t - last[key] if key in last else None
        ids[key] = ids.get(key, 0) + (gap is None or gap >= TIGHT.intra)
        last[key] = t
        want.append((t, gap, ids[key]))
    for chunk in (1 << 20, 13, 1):
        gaps = sorted((r.rec_idx, r.gap) for r in access_gaps(coords, chunk).collect())
        assert gaps == [(t, g) for t, g, _ in want]
        got = sorted((r.rec_idx, r.burst_id) for r in assign_bursts(coords, TIGHT, chunk).collect())
        assert got == [(t, b) for t, _, b in want]


def test_pruning_sets_keeps_detections(spark):
    rows = random_trace(2) + [(10_000, 1, access(3, 1))]
    trace = table(spark, rows)
    coords = with_cache_coords(trace, LOOSE)
    kept = prune_sets(coords, LOOSE)
    assert keyed(qualifying_bursts(kept, LOOSE)) == keyed(qualifying_bursts(coords, LOOSE))


def test_linking_before_and_after_the_set_filter_agree(spark):
    coords = with_cache_coords(table(spark, random_trace(3)), TIGHT)
    bursts = qualifying_bursts(coords, TIGHT)
    for chunk in (1 << 20, 30):
        assert keyed(link_bursts(bursts, TIGHT, chunk=chunk)) == keyed(
            detect(table(spark, random_trace(3)), TIGHT, "BOTH")
        )


def test_arrays_per_set_hold_the_same_bursts(spark):
    found = detect(table(spark, random_trace(11)), TIGHT, "BOTH")
    flat = keyed(found)
    for span in (1 << 20, 64):
        nested = detections_by_set(found, span).collect()
        again = sorted(
            (r.rw, r.set_idx, b.n_lines, b.center) for r in nested for b in r.bursts
        )
        assert again == flat
        assert all(list(r.bursts) == sorted(r.bursts) for r in nested)


def test_positions_count_through_whatever_the_span(spark):
    found = detect(table(spark, random_trace(11)), TIGHT, "BOTH", all_chains=True)
    want = {}
    for rw, s, n, c in sorted(keyed(found), key=lambda x: (x[0], x[1], x[3])):
        want[rw, s, c] = sum(k[:2] == (rw, s) for k in want)
    for span in (1 << 20, 2000, 64, 7):
        got = {
            (r.rw, r.set_idx, b.center): r.first_pos + i
            for r in detections_by_set(found, span).collect()
            for i, b in enumerate(r.bursts)
        }
        assert got == want, span


def test_records_without_address_or_number_are_in_no_burst(spark):
    # A fetch trace with a hole in each burst finds nothing; filling the holes with
    # records that have no address must not change that.
    holes = {4, 104}
    rows = [(t, None, access(0, 1 + t % 100)) for t0 in (0, 100) for t in range(t0, t0 + 8)]
    kept = [r for r in rows if r[0] not in holes]
    filled = kept + [(t, None, None) for t in holes] + [(None, None, access(0, 5))]
    assert detect(table(spark, kept), "L1I").count() == 0
    trace = table(spark, filled)
    assert detect(trace, "L1I").count() == 0
    coords = with_cache_coords(trace, PROFILES["L1I"])
    assert burst_stats(coords, PROFILES["L1I"]).agg({"n_access": "sum"}).first()[0] == len(kept)
    for result, name in (
        (access_gaps(coords), "gap"),
        (assign_bursts(coords, PROFILES["L1I"]), "burst_id"),
    ):
        got = result.collect()
        assert len(got) == len(filled)
        unplaced = [r for r in got if r.rec_idx is None or r.set_idx is None]
        assert len(unplaced) == 3 and all(r[name] is None for r in unplaced)


def test_chunks_change_nothing_under_adaptive_execution(spark):
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.codegen.wholeStage": "true",
        "spark.sql.codegen.factoryMode": "FALLBACK",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = TRACES["hot"]
        _, found = walk(rows, LOOSE, (0, 1))
        for chunk in (1 << 20, 29):
            assert keyed(detect(table(spark, rows), LOOSE, "BOTH", chunk=chunk)) == found
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_uniform_noise_is_not_detected(spark):
    r = random.Random(0)
    rows = [(t, 1, r.randrange(1 << 34)) for t in range(20_000)]
    assert detect(table(spark, rows), "L1D", "BOTH", chunk=1000).count() == 0


def test_record_numbers_near_the_top_of_a_long(spark):
    base = 1 << 60
    rows = [(base + t, rw, a) for t, rw, a in hot_trace(200)]
    bursts, _ = walk(rows, LOOSE, (0, 1))
    got = burst_stats(with_cache_coords(table(spark, rows), LOOSE), LOOSE, chunk=16)
    columns = ("rw", "set_idx", "n_lines", "center", "n_access", "first_idx", "last_idx")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == bursts
