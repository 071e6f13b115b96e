"""WARC files: round trips, revisits, and recovery of damaged files."""

import hashlib

import pyarrow.fs as pafs
import pytest

from burstlens.llm.warc import member, page_number, read_warc, record, salvage, write_warc

BIG, WIDE = "<p>" + "x" * 200, "日本" * 60
PAGES = [
    (5, "u", BIG),
    (3, "u\r\nv", BIG),
    (3, None, BIG),
    (None, "u", BIG),
    (1, "a", None),
    (2, "b", "short"),
    (4, "b", "short"),
    (9, "z", WIDE),
    (8, "z", WIDE),
    (10, "", ""),
    (11, "c", "y" * 300_000),
    (12, "d", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 5),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as Digest", "'y' as payload")


def digest(html):
    return hashlib.sha256((html or "").encode()).hexdigest()


@pytest.mark.parametrize("compressed", [True, False])
def test_pages_come_back(spark, pages, tmp_path, compressed):
    path = str(tmp_path / "w")
    write_warc(pages.repartition(3), path, compressed=compressed, file_bytes=2000)
    rows = read_warc(spark, path, with_payload=True).withColumn("page_id", page_number("record_id"))
    rows = rows.withColumn("to", page_number("refers_to")).collect()
    assert not [r.gap for r in rows if r.gap]
    first = {}
    for i, _, html in PAGES:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html in PAGES:
        to = first.get(html) if first.get(html, i) != i else None
        n = len((html or "").encode())
        want.append((i, "revisit" if to else "response", to, n, digest(html)))
    got = [(r.page_id, r.record_type, r.to, r.payload_bytes, r.payload_digest) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    texts = {r.payload_digest: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert all(texts[digest(html)] == (html or "").encode() for _, _, html in PAGES)


def test_empty_table(spark, pages, tmp_path):
    write_warc(pages.limit(0), str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_records_after_damage_are_recovered(tmp_path, compressed):
    pack = member if compressed else bytes
    made = [record(i, u, (h or "").encode(), digest(h), None) for i, u, h in PAGES[:-1]]
    raw = b"".join(map(pack, made))
    (tmp_path / "good").write_bytes(raw)
    whole = list(salvage(pafs.LocalFileSystem().open_input_file(str(tmp_path / "good")), "f"))
    assert len(whole) == len(made) and whole[-1]["end"] == len(raw)
    a, b = whole[1], whole[5]
    broken = bytearray(raw[: b["start"]])
    broken[a["end"] - 12] ^= 0xFF
    junk = b"junk\x1f\x8b\x08\x00 not a member, no WARC/1 line\n"
    damaged = bytes(broken) + junk + raw[b["start"] : -7]
    (tmp_path / "bad").write_bytes(damaged)
    found = list(salvage(pafs.LocalFileSystem().open_input_file(str(tmp_path / "bad")), "f"))
    kept = [r["record_id"] for r in found if not r.get("gap")]
    assert kept == [r["record_id"] for r in whole if r is not a and r is not whole[-1]]
    gaps = [(r["start"], r["end"]) for r in found if r.get("gap")]
    assert (a["start"], a["end"]) in gaps and (b["start"], b["start"] + len(junk)) in gaps
    assert gaps[-1][1] == len(damaged) and len(gaps) == 3
    # Every byte is in a record or in a gap.
    assert [r["start"] for r in found] == [0, *(r["end"] for r in found[:-1])]
