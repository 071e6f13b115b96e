"""Fixed-width binary traces as a Spark data source.

A data trace is a run of 16-byte records (kind, address), a fetch trace a run of
8-byte records (address); all fields are unsigned 64-bit little-endian. There is
no header, so a file splits at any record border and a record's number follows
from its byte offset: no counting job is needed.

Inputs are listed by Hadoop, so patterns, default file system and schemes are those of
Spark; workers open them through ``pyarrow.fs`` (local files, hdfs, s3, gs, ...).
``engine="hadoop"`` reads through Hadoop's fixed-length input format instead, for any
other file system.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from burstlens.functions.candidates import candidate_mask
from burstlens.workers import ship_code

FORMAT = "burstlens_trace"
# 64-bit words per record of each trace kind.
WORDS = {"data": 2, "fetch": 1}
WORD_BYTES = 8
TRACE_SCHEMA = "rec_idx long, rw long, paddr long"
_ARROW_SCHEMA = pa.schema([("rec_idx", pa.int64()), ("rw", pa.int64()), ("paddr", pa.int64())])
SPLIT_BYTES = 128 << 20
# Files that a commit moves at the same time.
COMMIT_THREADS = 32
# Records decoded, and pruned, at a time.
BLOCK = 1 << 20


# Hadoop's names of schemes that pyarrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss"}


def _open(path: str):
    """File system and path inside it for a full URI or a local path."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _children(fs, directory: str) -> list:
    infos = fs.get_file_info(pafs.FileSelector(directory, allow_not_found=True))
    shown = [i for i in infos if not i.base_name.startswith(("_", "."))]
    return sorted((i for i in shown if i.type == pafs.FileType.File), key=lambda i: i.path)


def _hadoop_path(spark: SparkSession, path: str):
    """Hadoop's file system and path of an input, as Spark resolves them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; without one it is in the default file system."""
    fs, where = _hadoop_path(spark, path)
    return fs.makeQualified(where).toString()


def _list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of one input, a file, a directory or a pattern, in name order, and their sizes."""
    fs, where = _hadoop_path(spark, path)
    found = []
    for status in fs.globStatus(where) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        shown = [f for f in inside if not f.isDirectory()]
        if status.isDirectory():
            shown = [f for f in shown if not f.getPath().getName().startswith(("_", "."))]
        named = [(f.getPath().toString(), f.getLen()) for f in shown]
        found += sorted(named)
    if not found and not fs.globStatus(where):
        raise FileNotFoundError(f"no trace file at {path}")
    return found


@dataclass
class FileWritten(WriterCommitMessage):
    temporary: str
    final: str


class TraceReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.files = json.loads(options["files"])
        self.words = WORDS[options["kind"]]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.prune = json.loads(options.get("prune", "null"))

    def partitions(self):
        """Splits as plain tuples: path, first record in it, records, first record number."""
        record = self.words * WORD_BYTES
        per_split = max(1, self.split_bytes // record)
        splits, base = [], 0
        for path, size in self.files:
            if size % record:
                raise ValueError(f"{path}: {size} bytes is not a whole number of {record}-byte records")
            count = size // record
            for at in range(0, count, per_split):
                splits.append(InputPartition((path, at, min(per_split, count - at), base + at)))
            base += count
        return splits or [InputPartition(("", 0, 0, 0))]

    def read(self, split):
        path, first_record, records, first_idx = split.value
        if not records:
            return
        fs, inner = _open(path)
        record = self.words * WORD_BYTES
        with fs.open_input_file(inner) as f:
            for at in range(0, records, BLOCK):
                count = min(BLOCK, records - at)
                raw = f.read_at(count * record, (first_record + at) * record)
                block = np.frombuffer(raw, dtype="<u8").reshape(count, self.words)
                yield from self._batches(block, first_idx + at)

    def _batches(self, block, lo: int):
        hi = lo + len(block)
        idx = np.arange(lo, hi, dtype=np.int64)
        if self.prune:
            mask = candidate_mask(idx, block[:, 0], block[:, -1], lo, hi, self.prune)
            block, idx = block[mask], idx[mask]
        words = block.astype("<u8").view("<i8")
        for at in range(0, len(idx), 1 << 16):
            part = slice(at, at + (1 << 16))
            paddr = pa.array(np.ascontiguousarray(words[part, -1]))
            rw = (
                pa.array(np.ascontiguousarray(words[part, 0]))
                if self.words == 2
                else pa.nulls(len(paddr), pa.int64())
            )
            yield pa.RecordBatch.from_arrays([pa.array(idx[part]), rw, paddr], schema=_ARROW_SCHEMA)


class TraceWriter(DataSourceArrowWriter):
    """One file per task, named by partition so that name order is record order.

    A task attempt writes under a hidden name; only committed attempts get their
    final name, so retries and lost executors leave no stray records.
    """

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.words = WORDS[options["kind"]]

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        final = posixpath.join(root, f"part-{task.partitionId():08d}.bin")
        temporary = posixpath.join(root, f".attempt-{task.taskAttemptId()}")
        with fs.open_output_stream(temporary) as out:
            for batch in iterator:
                columns = [batch.column("paddr")]
                if self.words == 2:
                    columns.insert(0, batch.column("rw"))
                if any(c.null_count for c in columns):
                    raise ValueError("a record to write has a NULL field")
                block = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
                out.write(np.ascontiguousarray(block.astype("<i8")).tobytes())
        return FileWritten(temporary, final)

    def commit(self, messages) -> None:
        fs, _ = _open(self.path)
        done = [m for m in messages if m is not None]
        with ThreadPoolExecutor(COMMIT_THREADS) as pool:
            list(pool.map(lambda m: fs.move(m.temporary, m.final), done))

    def abort(self, messages) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TRACE_SCHEMA

    def reader(self, schema):
        return TraceReader(self.options)

    def writer(self, schema, overwrite):
        return TraceWriter(self.options)


def _register(spark: SparkSession) -> None:
    ship_code()
    spark.dataSource.register(TraceSource)


def _as_list(paths) -> list[str]:
    """Inputs of a comma-separated list; commas in braces belong to a pattern."""
    return re.split(r",(?![^{]*})", paths) if isinstance(paths, str) else list(paths)


def read_trace(
    spark: SparkSession,
    paths: str | list[str],
    kind: str = "data",
    engine: str = "arrow",
    split_bytes: int = SPLIT_BYTES,
    prune: dict | None = None,
) -> DataFrame:
    """``(rec_idx, rw, paddr)`` of a binary trace; ``rw`` is NULL for fetches.

    ``paths``: files, directories or patterns of any part, as a list or comma-separated;
    records are numbered through in that order. A file with a partial last record
    is an error. ``prune`` comes from ``plans.detect.pruning``: records that cannot matter
    to one given analysis are left out while decoding (numbers stay the same).
    """
    if kind not in WORDS:
        raise ValueError(f"kind must be one of {sorted(WORDS)}, got {kind!r}")
    if engine == "hadoop":
        return _read_by_hadoop(spark, _as_list(paths), kind)
    if engine != "arrow":
        raise ValueError(f"engine must be 'arrow' or 'hadoop', got {engine!r}")
    _register(spark)
    files = [f for p in _as_list(paths) for f in _list_files(spark, p)]
    return (
        spark.read.format(FORMAT)
        .option("files", json.dumps(files))
        .option("kind", kind)
        .option("splitbytes", str(split_bytes))
        .option("prune", json.dumps(prune))
        .load()
    )


def _read_by_hadoop(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    ship_code()
    words = WORDS[kind]
    records = spark.sparkContext.binaryRecords(",".join(paths), words * WORD_BYTES)
    numbered = spark.createDataFrame(
        records.zipWithIndex().map(lambda r: (r[1], bytearray(r[0]))), "rec_idx long, raw binary"
    )

    def decode(batches):
        for batch in batches:
            raw = b"".join(v.as_py() for v in batch.column(1))
            block = np.frombuffer(raw, dtype="<i8").reshape(batch.num_rows, words)
            rw = (
                pa.array(np.ascontiguousarray(block[:, 0]))
                if words == 2
                else pa.nulls(batch.num_rows, pa.int64())
            )
            paddr = pa.array(np.ascontiguousarray(block[:, -1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), rw, paddr], names=["rec_idx", "rw", "paddr"]
            )

    return numbered.mapInArrow(decode, TRACE_SCHEMA)


def write_trace(
    trace: DataFrame, path: str, kind: str = "data", partitions: int | None = None
) -> None:
    """Write a trace table as binary files whose name order is record order.

    ``path`` must be new or empty. Record numbers are not stored: reading numbers
    the records 0, 1, ... in the written order.
    """
    if kind not in WORDS:
        raise ValueError(f"kind must be one of {sorted(WORDS)}, got {kind!r}")
    path = _qualified(trace.sparkSession, path)
    fs, root = _open(path)
    if fs.get_file_info(root).type == pafs.FileType.File or _children(fs, root):
        raise FileExistsError(f"{path} is not empty")
    _register(trace.sparkSession)
    rows = trace.selectExpr("rec_idx", "cast(rw as bigint) as rw", "paddr")
    by_range = (
        rows.repartitionByRange(partitions, "rec_idx")
        if partitions
        else rows.repartitionByRange("rec_idx")
    )
    (
        by_range.sortWithinPartitions("rec_idx")
        .write.format(FORMAT)
        .option("path", path)
        .option("kind", kind)
        .mode("append")
        .save()
    )
