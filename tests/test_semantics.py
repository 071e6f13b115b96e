"""Hand-made traces with written-out answers."""

import pytest

from burstlens import (
    PROFILES,
    burst_stats,
    detect,
    set_histogram,
    verdict,
    with_cache_coords,
)
from tests.helpers import READ, WRITE, access, burst, keyed, table, triples

PLANS = [dict(), dict(chunk=5)]
L1 = PROFILES["L1D"]


def l1(spark, rows, mode="READ", scope="L1D", **options):
    return triples(detect(table(spark, rows), scope, mode, **options))


@pytest.mark.parametrize("plan", PLANS)
def test_two_bursts_are_found_with_floored_centres(spark, plan):
    assert l1(spark, burst(0) + burst(100), **plan) == [(5, 8, 3), (5, 8, 103)]


def test_one_burst_is_not_enough(spark):
    assert l1(spark, burst(0)) == []


def test_tags_must_be_distinct(spark):
    tags = [1, 2, 3, 4, 5, 6, 7, 7]
    assert l1(spark, burst(0, tags=tags) + burst(100, tags=tags)) == []


@pytest.mark.parametrize("plan", PLANS)
def test_only_the_first_chain_counts(spark, plan):
    rows = burst(0) + burst(1000) + burst(6000) + burst(7000)
    first = [(5, 8, 3), (5, 8, 1003)]
    assert l1(spark, rows, **plan) == first
    later = [(5, 8, 6003), (5, 8, 7003)]
    assert l1(spark, rows, all_chains=True, **plan) == first + later


@pytest.mark.parametrize("plan", PLANS)
def test_a_lone_first_burst_hides_later_chains(spark, plan):
    rows = burst(0) + burst(5000) + burst(6000)
    assert l1(spark, rows, **plan) == []
    assert l1(spark, rows, all_chains=True, **plan) == [(5, 8, 5003), (5, 8, 6003)]


@pytest.mark.parametrize("plan", PLANS)
def test_link_bound_is_inclusive(spark, plan):
    assert l1(spark, burst(0) + burst(3600), **plan) == [(5, 8, 3), (5, 8, 3603)]
    assert l1(spark, burst(0) + burst(3601), **plan) == []


def test_a_hole_splits_an_l1_burst(spark):
    def holed(t0):
        return [(t + (1 if i > 3 else 0), rw, a) for i, (t, rw, a) in enumerate(burst(t0))]

    assert l1(spark, holed(0) + holed(100)) == []


@pytest.mark.parametrize("plan", PLANS)
def test_llc_gap_is_exclusive(spark, plan):
    def rows(step):
        return burst(0, tags=range(16), step=step) + burst(5000, tags=range(16), step=step)

    assert l1(spark, rows(23), scope="LLC", **plan) == [(5, 16, 172), (5, 16, 5172)]
    assert l1(spark, rows(24), scope="LLC", **plan) == []


def test_numbers_are_given_before_the_kind_filter(spark):
    rows = burst(0, step=2) + burst(100, step=2)
    rows += [(t + 1, WRITE, access(9, 1)) for t, _, _ in rows]
    assert l1(spark, rows) == []


def test_tag_shift_merges_lines_unless_exact(spark):
    rows = [(t0 + i, READ, i * 4096 + 320) for t0 in (0, 100) for i in range(8)]
    assert l1(spark, rows) == []
    assert l1(spark, rows, exact_tag=True) == [(5, 8, 3), (5, 8, 103)]


def test_address_zero_is_kept(spark):
    rows = [(t0 + i, READ, 0) for t0 in (0, 100) for i in range(8)]
    assert l1(spark, rows) == []
    h = set_histogram(with_cache_coords(table(spark, rows), L1)).collect()
    assert [(r.rw, r.set_idx, r.n_access, r.n_tags, r.first_idx, r.last_idx) for r in h] == [
        (1, 0, 16, 1, 0, 107)
    ]


@pytest.mark.parametrize("plan", PLANS)
def test_kinds_are_kept_apart(spark, plan):
    rows = burst(0) + burst(100)
    rows += burst(200, s=7, rw=WRITE) + burst(300, s=7, rw=WRITE) + burst(400, rw=WRITE)
    trace = table(spark, rows)
    reads = [(1, 5, 8, 3), (1, 5, 8, 103)]
    writes = [(0, 7, 8, 203), (0, 7, 8, 303)]
    assert keyed(detect(trace, "L1D", "READ", **plan)) == reads
    assert keyed(detect(trace, "L1D", "WRITE", **plan)) == writes
    assert keyed(detect(trace, "L1D", "BOTH", **plan)) == writes + reads
    fetches = [(5, 8, 3), (5, 8, 103), (5, 8, 403), (7, 8, 203), (7, 8, 303)]
    got = detect(trace, "L1I", **plan)
    assert triples(got) == fetches
    assert {r.rw for r in got.collect()} == {None}
    assert detect(trace, "L1D", **plan).count() == 0


def test_fetch_set_without_link_gives_a_negative_verdict(spark):
    found = detect(table(spark, [(t, None, a) for t, _, a in burst(0)]), "L1I")
    assert [tuple(r) for r in verdict(found, "L1I").collect()] == [("FETCH", 0, False)]


def test_single_accesses_touch_no_line(spark):
    one_way = L1.with_(assoc=1)
    rows = [(t, READ, access(5, t)) for t in (0, 10, 20)]
    assert l1(spark, rows, scope=one_way) == []
    stats = burst_stats(with_cache_coords(table(spark, rows), one_way), one_way)
    assert {(r.n_lines, r.n_access) for r in stats.collect()} == {(0, 1)}


def test_addresses_are_unsigned(spark):
    (row,) = with_cache_coords(table(spark, [(0, READ, -1)]), L1).collect()
    assert (row.set_idx, row.tag) == (63, 562949953421311)


@pytest.mark.parametrize("plan", PLANS)
def test_without_inter_all_qualifying_bursts_count(spark, plan):
    unlinked = L1.with_(inter=None)
    rows = burst(0) + burst(9000) + burst(50, s=6)
    assert l1(spark, rows, scope=unlinked, **plan) == [(5, 8, 3), (5, 8, 9003)]


@pytest.mark.parametrize("plan", PLANS)
def test_num_pp_raises_the_needed_number(spark, plan):
    rows = burst(0) + burst(100) + burst(200) + burst(300, s=6) + burst(400, s=6)
    assert l1(spark, rows, num_pp=2, **plan) == [(5, 8, 3), (5, 8, 103), (5, 8, 203)]
    assert l1(spark, rows, num_pp=3, **plan) == []


def test_unknown_settings_are_refused(spark):
    trace = table(spark, burst(0))
    for bad in (dict(mode="ALL"), dict(mode="READ", chunk=0)):
        with pytest.raises(ValueError):
            detect(trace, "L1D", **bad)
    with pytest.raises(ValueError):
        detect(trace, "L2", "READ")
    with pytest.raises(ValueError):
        L1.with_(line=48)
