"""Binary traces: numbering, splitting, pruning, writing."""

import glob
import json
import random
import struct

import pytest
from pyspark import cloudpickle

from burstlens import (
    PROFILES,
    detect,
    detect_file,
    pruning,
    read_trace,
    release_scratch,
    write_trace,
)
from burstlens.sources.binary import TraceReader
from burstlens.sources.checkpoints import shared_dir
from tests.helpers import access, burst, keyed, table
from tests.test_properties import LOOSE, TIGHT


def rows_of(df):
    return sorted(tuple(r) for r in df.select("rec_idx", "rw", "paddr").collect())


def dump(path, records, kind="data"):
    with open(path, "wb") as f:
        for rw, paddr in records:
            f.write(struct.pack("<2Q", rw, paddr) if kind == "data" else struct.pack("<Q", paddr))
    return str(path)


def records(seed, n):
    r = random.Random(seed)
    out, s = [], 0
    for _ in range(n):
        if r.random() < 0.3:
            s = r.randrange(4)
        out.append((int(r.random() < 0.7), access(s, r.randrange(6))))
    return out


def test_several_files_are_numbered_through(spark, tmp_path):
    a, b, c = records(1, 100), [], records(2, 57)
    paths = [dump(tmp_path / n, r) for n, r in (("b.bin", a), ("a.bin", b), ("c.bin", c))]
    want = [(i, *r) for i, r in enumerate(a + b + c)]
    assert rows_of(read_trace(spark, paths)) == want
    assert rows_of(read_trace(spark, ",".join(paths), split_bytes=160)) == want
    by_name = [(i, *r) for i, r in enumerate(b + a + c)]
    assert rows_of(read_trace(spark, str(tmp_path))) == by_name
    assert rows_of(read_trace(spark, str(tmp_path / "*.bin"))) == by_name
    assert rows_of(read_trace(spark, f"file://{tmp_path}")) == by_name
    assert read_trace(spark, paths, split_bytes=160).rdd.getNumPartitions() == 16


def test_patterns_in_any_part_of_a_path(spark, tmp_path):
    a, b = records(1, 20), records(2, 30)
    for name, recs in (("x", a), ("y", b), ("z", a)):
        (tmp_path / name).mkdir()
        dump(tmp_path / name / "t.bin", recs)
    want = [(i, *r) for i, r in enumerate(a + b)]
    assert rows_of(read_trace(spark, f"{tmp_path}/{{x,y}}/t.bin")) == want
    assert rows_of(read_trace(spark, f"{tmp_path}/[xy]/*")) == want
    assert read_trace(spark, f"{tmp_path}/*/t.bin").count() == 70


def test_splits_are_small(spark):
    files = [["hdfs://host:8020/a/rather/long/path/to/a/trace/part-00000000.bin", 16 << 20]]
    options = {"files": json.dumps(files), "kind": "data", "splitbytes": "1048576"}
    splits = TraceReader(options).partitions()
    assert len(splits) == 16 and len(cloudpickle.dumps(splits[0])) < 300


def test_detect_file_leaves_nothing_behind(spark, tmp_path):
    path = dump(tmp_path / "t.bin", records(9, 200))
    detect_file(spark, path, "L1D", "READ").collect()
    folder = shared_dir(spark).removeprefix("file:")
    assert glob.glob(f"{folder}/candidates-*")
    release_scratch(spark)
    assert not glob.glob(f"{folder}/candidates-*")


def test_fetches_have_no_kind(spark, tmp_path):
    path = dump(tmp_path / "f.bin", records(3, 40), "fetch")
    got = read_trace(spark, path, "fetch")
    assert [r.rw for r in got.collect()] == [None] * 40
    assert [r.paddr for r in got.orderBy("rec_idx").collect()] == [p for _, p in records(3, 40)]


def test_hadoop_engine_reads_the_same(spark, tmp_path):
    path = dump(tmp_path / "t.bin", records(4, 300) + [(1, 2**64 - 1)])
    assert rows_of(read_trace(spark, path, engine="hadoop")) == rows_of(read_trace(spark, path))
    fetch = dump(tmp_path / "f.bin", records(4, 9), "fetch")
    by_hadoop = read_trace(spark, fetch, "fetch", engine="hadoop")
    assert sorted(map(str, by_hadoop.collect())) == sorted(
        map(str, read_trace(spark, fetch, "fetch").collect())
    )


def test_addresses_above_63_bits_keep_their_bits(spark, tmp_path):
    path = dump(tmp_path / "t.bin", [(1, 2**64 - 1), (0, 2**63)])
    assert rows_of(read_trace(spark, path)) == [(0, 1, -1), (1, 0, -(2**63))]


def test_a_partial_record_is_an_error(spark, tmp_path):
    path = tmp_path / "t.bin"
    path.write_bytes(bytes(24))
    with pytest.raises(Exception, match="whole number of 16-byte records"):
        read_trace(spark, str(path)).collect()
    assert read_trace(spark, str(path), "fetch").count() == 3


def test_missing_files_and_bad_settings(spark, tmp_path):
    with pytest.raises(Exception, match="no trace file"):
        read_trace(spark, str(tmp_path / "none.bin")).collect()
    with pytest.raises(ValueError):
        read_trace(spark, "x", "video")
    with pytest.raises(ValueError):
        read_trace(spark, "x", engine="rdd")


def test_written_traces_read_back(spark, tmp_path):
    rows = [(i, rw, a) for i, (rw, a) in enumerate(records(5, 500))]
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    write_trace(table(spark, shuffled, partitions=7), str(tmp_path / "d"), partitions=5)
    names = sorted(p.name for p in (tmp_path / "d").iterdir())
    assert len(names) > 1 and all(n.startswith("part-") for n in names)
    assert rows_of(read_trace(spark, str(tmp_path / "d"))) == rows
    write_trace(table(spark, shuffled), str(tmp_path / "f"), "fetch")
    assert rows_of(read_trace(spark, str(tmp_path / "f"), "fetch")) == [
        (i, None, a) for i, _, a in rows
    ]
    with pytest.raises(FileExistsError):
        write_trace(table(spark, shuffled), str(tmp_path / "d"))


def test_a_null_field_cannot_be_written(spark, tmp_path):
    with pytest.raises(Exception, match="NULL field"):
        write_trace(table(spark, [(0, None, 5)]), str(tmp_path / "d"))


@pytest.mark.parametrize("profile", [TIGHT, LOOSE], ids=["tight", "loose"])
def test_pruning_while_decoding_changes_no_detection(spark, tmp_path, profile):
    recs = records(6, 1500)
    path = dump(tmp_path / "t.bin", recs)
    trace = read_trace(spark, path).cache()
    # All chains: more bursts to lose than in the first ones.
    for mode, split in (("READ", 1 << 20), ("READ", 16 * 60), ("BOTH", 16 * 200)):
        want = keyed(detect(trace, profile, mode, all_chains=True))
        assert want
        pruned = read_trace(spark, path, split_bytes=split, prune=pruning(profile, mode))
        assert keyed(detect(pruned, profile, mode, all_chains=True)) == want
    dropped = read_trace(spark, path, prune=pruning(profile, "BOTH"))
    assert dropped.count() < trace.count()


def test_detect_file_equals_detect(spark, tmp_path):
    rows = [(i, 0, access(60, i)) for i in range(3000)]
    for t0 in (100, 900, 2900):
        for t, rw, a in burst(t0):
            rows[t] = (t, rw, a)
    path = dump(tmp_path / "t.bin", [r[1:] for r in rows])
    want = [(1, 5, 8, 103), (1, 5, 8, 903), (1, 5, 8, 2903)]
    assert keyed(detect_file(spark, path, "L1D", "READ")) == want
    assert keyed(detect_file(spark, path, "L1D", "READ", chunk=105)) == want
    fetch = dump(tmp_path / "f.bin", [r[1:] for r in rows], "fetch")
    fetched = detect_file(spark, fetch, PROFILES["L1I"])
    assert {r.rw for r in fetched.collect()} == {None}
    assert keyed(fetched.filter("set_idx = 5").fillna(1)) == want
