"""Record numbers, address translation, operands, reports and plans."""

import io
import re
from contextlib import redirect_stdout

import pytest

from burstlens import (
    PROFILES,
    append_report,
    burst_stats,
    decode_pagemap,
    detect,
    detect_file,
    detected_sets,
    explode_operands,
    profile_table,
    read_reports,
    report_lines,
    representative,
    translate,
    verdict,
    with_cache_coords,
    with_ordinal,
    write_report,
)
from burstlens.operators import bursts, chains
from burstlens.sources.checkpoints import stored
from burstlens.sources.tables import events_trace
from tests.helpers import WRITE, burst, table

PRESENT, SWAPPED = -(2**63), 2**62


def test_fixed_profiles():
    l1 = (8, 2, 6, 63, 9, 3600)
    assert PROFILES["L1D"].echo == l1 and PROFILES["L1I"].echo == l1
    assert PROFILES["LLC"].echo == (16, 24, 6, 2047, 10, 10000)
    assert (PROFILES["L1D"].tag_shift, PROFILES["LLC"].tag_shift) == (15, 16)
    assert (PROFILES["L1D"].exact_tag_shift, PROFILES["LLC"].exact_tag_shift) == (12, 17)


def test_profile_table_derives_the_same_geometry(spark):
    for r in profile_table(spark).collect():
        p = PROFILES[r.scope]
        assert (r.line_bits, r.set_mask, r.set_bits) == (p.line_bits, p.set_mask, p.set_bits)
        assert r.total_sets == p.total_sets


@pytest.mark.parametrize("parts", [1, 9])
def test_ordinal_follows_the_order_columns(spark, parts):
    rows = [((i * 37) % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(parts)
    got = {r.k: r.rec_idx for r in with_ordinal(df, ["k"]).collect()}
    assert got == {k: k for k in range(101)}


def test_pagemap_bits(spark):
    df = spark.createDataFrame(
        [(0, PRESENT + 5), (1, PRESENT + SWAPPED + 7), (2, SWAPPED + 9), (3, -1)],
        "vpn long, entry long",
    )
    assert [tuple(r) for r in decode_pagemap(df).orderBy("vpn").collect()] == [
        (0, True, False, 5),
        (1, True, True, 7),
        (2, False, True, 9),
        (3, True, True, 2**55 - 1),
    ]


@pytest.mark.parametrize("limit", [0, 100])
def test_translation(spark, limit):
    pagemap = spark.createDataFrame(
        [(1, PRESENT + 5), (2, 6), (3, PRESENT + SWAPPED + 7), (2**52 - 1, PRESENT + 8)],
        "vpn long, entry long",
    )
    vaddrs = [4096 + 17, 8192 + 1, 3 * 4096, 9 * 4096, -1]
    trace = spark.createDataFrame(
        [(i, i % 2, v) for i, v in enumerate(vaddrs)], "rec_idx long, rw long, vaddr long"
    )
    got = translate(trace, pagemap, chunk=2, broadcast_entries=limit).orderBy("rec_idx").collect()
    assert [r.paddr for r in got] == [5 * 4096 + 17, 0, 7 * 4096, 0, 8 * 4096 + 4095]
    assert [r.swapped for r in got] == [False, False, True, False, False]
    assert [(r.rec_idx, r.rw, r.vaddr) for r in got] == [(i, i % 2, v) for i, v in enumerate(vaddrs)]


def test_operands_give_reads_before_writes(spark):
    df = spark.createDataFrame(
        [(1, [(10, True, True), (20, False, True)]), (2, []), (3, [(30, True, False)])],
        "instr_id long, operands array<struct<vaddr:long,is_read:boolean,is_written:boolean>>",
    )
    assert [tuple(r) for r in explode_operands(df).collect()] == [
        (1, 0, 1, 10),
        (1, 0, 0, 10),
        (1, 1, 0, 20),
        (3, 0, 1, 30),
    ]


def _mixed(spark):
    rows = burst(0) + burst(100) + burst(50, s=6) + burst(90, s=6)
    return table(spark, rows + burst(300, s=7, rw=WRITE))


def test_result_shapes(spark):
    found = detect(_mixed(spark), "L1D", "BOTH")
    assert sorted(map(tuple, representative(found).collect())) == [(1, 5, 8, 3), (1, 6, 8, 53)]
    assert [tuple(r) for r in detected_sets(found).collect()] == [(1, [5, 6], 2)]
    assert sorted(map(tuple, verdict(found, "L1D", "BOTH").collect())) == [
        ("READ", 2, True),
        ("WRITE", 0, False),
    ]


# The text of a report.
REPORT = """BOTH, L1D

Cache parameters (assoc, intra_group_threshold, line_bits, set_mask, set_bits, \
inter_group_threshold): (8, 2, 6, 63, 9, 3600)

Data cache read mode detected set idx | (#lines, cluster_center)
==========================================================================
5 | (8, 3)
------------------------------------------------
6 | (8, 53)
------------------------------------------------

Sets: [5, 6]

#Sets: 2

prime+probe pattern is detected!

Data cache write mode detected set idx | (#lines, cluster_center)
==========================================================================

No prime+probe pattern is detected!

"""


def test_report_text_and_appending(spark, tmp_path):
    lines = report_lines(detect(_mixed(spark), "L1D", "BOTH"), "L1D", "BOTH")
    path = str(tmp_path / "out")
    for n in (1, 2):
        write_report(lines, path)
        texts = [p.read_text() for p in (tmp_path / "out").glob("part-*.txt")]
        assert texts == [REPORT] * n


def test_report_without_mode_is_only_a_header(spark):
    lines = report_lines(detect(_mixed(spark), "L1D"), "L1D").orderBy("line_no").collect()
    assert [r.line_no for r in lines] == [0, 1, 2, 3]
    assert lines[0].text == "None, L1D"


def test_fetch_report(spark):
    found = detect(table(spark, burst(0) + burst(100)), "L1I")
    texts = [r.text for r in report_lines(found, "L1I").orderBy("line_no").collect()]
    assert texts[4].startswith("L1I detected") and "Sets: [5]" in texts


def _plan(df, final=False):
    if final:
        df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


SF = "/root/testdata/sf0.001"


def test_one_scan_and_one_sort_of_all_rows(spark, monkeypatch):
    # Without broadcasts, as on tables too large for them. Each stored table is one plan.
    plans = []

    def recorded(df, kind):
        plans.append(_plan(df))
        return stored(df, kind)

    for module in (bursts, chains):
        monkeypatch.setattr(module, "stored", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = detect(events_trace(spark, SF), "L1D", "BOTH", chunk=97)
        tags, qualifying, linked = plans + [_plan(found)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in tags
    assert (tags.count("FileScan"), tags.count("Exchange"), tags.count("Sort [")) == (1, 1, 1)
    assert tags.count("Window [") == 2
    # From here on only what was left of the trace is read.
    assert "event_id" not in qualifying + linked
    assert qualifying.count("Window [") <= 4
    assert "Window [" not in linked
    assert all("Python" not in p for p in (tags, qualifying, linked))


def test_bursts_are_aggregated_in_the_stage_of_the_shuffle(spark):
    p = PROFILES["LLC"]
    plan = _plan(burst_stats(with_cache_coords(events_trace(spark, SF), p), p))
    assert "hashpartitioning(cell" in plan and "hashpartitioning(cell#, first" not in re.sub(
        r"#\d+L?", "#", plan
    )


def test_reports_are_read_back_in_order(spark, tmp_path):
    path = str(tmp_path / "reports")
    found = detect(_mixed(spark), "L1D", "BOTH")
    append_report(report_lines(found, "L1D", "BOTH"), path, 1)
    append_report(report_lines(found.limit(0), "L1D", "BOTH"), path, 2)
    rows = read_reports(spark, path).collect()
    assert "\n".join(r.text for r in rows if r.run == 1) + "\n" == REPORT
    assert [r.run for r in rows] == sorted(r.run for r in rows)
    assert [r.line_no for r in rows if r.run == 2] == list(range(sum(r.run == 2 for r in rows)))


@pytest.mark.parametrize("limit", [0, 100])
def test_translation_of_records_without_a_number(spark, limit):
    pagemap = spark.createDataFrame([(1, PRESENT + 5)], "vpn long, entry long")
    trace = spark.createDataFrame([(None, 1, 4096)], "rec_idx long, rw long, vaddr long")
    got = translate(trace, pagemap, broadcast_entries=limit).collect()
    assert [r.paddr for r in got] == [5 * 4096]


def test_detect_file_decodes_once(spark, tmp_path):
    from burstlens import write_trace

    write_trace(events_trace(spark, SF), str(tmp_path / "t"))
    plan = _plan(detect_file(spark, str(tmp_path / "t"), "L1D", "BOTH"))
    assert "FileScan parquet" in plan and "burstlens_trace" not in plan
