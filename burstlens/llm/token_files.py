"""Flat token-ID files: unsigned integers end to end, with 64-bit document offsets.

A folder holds, per partition of the ordered documents,

* ``<name>.bin``: token ids, little-endian unsigned 16 or 32 bits, nothing else;
* ``<name>.idx``: little-endian 64-bit integers: the number of documents n, then n + 1
  offsets (in ids) into the ``.bin`` file, then the n document ids, then n flags
  (1: the id is null);

and ``manifest/``, a Parquet table with a row per partition: its position, file name,
documents, ids and ``base``, the number of ids before it: a prefix sum over the
partitions. A document's place in the whole corpus is base + offset.

Task attempts write under names of their own and only the manifest says which of them
count, so retries and lost executors leave no stray or double ids.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstlens.llm import blocks as B
from burstlens.llm.places import prepare
from burstlens.llm.pretokens import Encoder

MANIFEST = "part long, name string, n_docs long, n_ids long, width int"


def opened(path: str):
    """File system and path inside it."""
    if ":" in path.split("/", 1)[0]:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 0,
    width: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode whole texts and write their ids in ascending ``doc_id`` order under ``path``.

    ``width`` is the bytes of an id (2 or 4; a vocabulary must fit). Every document
    gets ``end_id`` after its ids; a null or empty text has that id only. Null ids come
    first; documents with equal ids are all kept, next to each other, in the order of
    their texts. An empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    prepare(docs.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[width]

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        encoder = B.worker_cache("encoder", vocabulary, lambda: Encoder(vocabulary))
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:08d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        sizes, numbers, nulls = [], [], []
        with fs.open_output_stream(f"{root}/{name}.bin") as out:
            for block in B.blocks(batches, text):
                ids, first = encoder.ids_of(block)
                if max(end_id, int(ids.max(initial=0))) >= 1 << (8 * width):
                    raise ValueError(f"an id does not fit {width} bytes")
                out.write(np.insert(ids, first[1:], end_id).astype(kind).tobytes())
                sizes.append(np.diff(first) + 1)
                column = block.batch.column(doc_id)
                nulls.append(column.is_null().to_numpy(zero_copy_only=False))
                numbers.append(column.fill_null(0).to_numpy(zero_copy_only=False))
        if not sizes:
            fs.delete_file(f"{root}/{name}.bin")
            return
        sizes = np.concatenate(sizes)
        index = [[len(sizes)], [0], np.cumsum(sizes), *numbers, np.concatenate(nulls)]
        with fs.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.concatenate(index).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "name": name, "n_docs": len(sizes), "n_ids": int(sizes.sum())}],
            schema=pa.schema(
                [("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()),
                 ("n_ids", pa.int64()), ("width", pa.int32())]
            ),
        ).set_column(4, "width", pa.array([width], pa.int32()))

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    placed = rows.repartitionByRange(F.col(doc_id)).sortWithinPartitions(doc_id, text)
    placed.mapInArrow(write, MANIFEST).write.parquet(f"{path}/attempts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: a window over all of them is small.
    spark.read.schema(MANIFEST).parquet(f"{path}/attempts").withColumn(
        "base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    ).write.parquet(f"{path}/manifest")


def _mapped(fs, path: str, kind: str) -> np.ndarray:
    """A file's numbers: mapped into memory if it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone.

    ``ids_crc32`` is the unsigned CRC-32 of the ids, end id included, as little-endian
    unsigned 32-bit integers; ``with_ids`` adds ``ids`` (array of long).
    """
    prepare(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""

    def read(batches):
        fs, root = opened(path)
        for batch in batches:
            for row in batch.to_pylist():
                index = _mapped(fs, f"{root}/{row['name']}.idx", "<i8")
                ids = _mapped(fs, f"{root}/{row['name']}.bin", f"<u{row['width']}")
                n = int(index[0])
                offsets, numbers = index[1 : n + 2], index[n + 2 : 2 * n + 2]
                nulls = index[2 * n + 2 :].astype(bool)
                if n != row["n_docs"] or len(ids) != row["n_ids"] or offsets[n] != len(ids):
                    raise ValueError(f"{row['name']}: files and manifest differ")
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    at = offsets[lo : hi + 1]
                    own = ids[at[0] : at[-1]].astype("<u4")
                    raw, cut = memoryview(own).cast("B"), (at - at[0]).tolist()
                    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut, cut[1:], strict=False)]
                    columns = [
                        pa.array(np.array(numbers[lo:hi]), mask=nulls[lo:hi]),
                        pa.array(row["base"] + np.array(at[:-1])),
                        pa.array(np.diff(at)),
                        pa.array(crcs, pa.int64()),
                    ]
                    if with_ids:
                        lists = pa.ListArray.from_arrays(
                            pa.array(at - at[0], pa.int32()), pa.array(own.astype(np.int64))
                        )
                        columns.append(lists)
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    manifest = spark.read.parquet(f"{path}/manifest")
    # A file is a task's work. Their number is given, or the small manifest would be one task's.
    return manifest.repartitionByRange(max(1, manifest.count()), "name").mapInArrow(read, schema)
