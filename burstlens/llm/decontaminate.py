"""Benchmark phrases in training texts, found with an FM-index per training shard.

A shard is a run of a task's rows, about ``SHARD_BYTES`` of text. Its words are numbered
and indexed, and every phrase of the benchmark is searched for by backward search in
that index; occurrences are located and merged into spans. A document's words are in one
shard unless it has more than ``INDEX_WORDS``: then consecutive indexes overlap by the
longest phrase less one word, so memory stays bounded and no occurrence is lost.

Phrases are the windows of ``window`` consecutive words of an item, or all words of a
shorter item. They are broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words,
whatever the size of the benchmark: each further block is one more pass over the texts
in the same task, which adds to what earlier passes found. Texts are never shuffled.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm import blocks as B
from burstlens.llm.fm_index import FMIndex
from burstlens.llm.places import added, prepare

SHARD_BYTES = 4 << 20
INDEX_WORDS = 2_000_000
BLOCK_WORDS = 1_000_000

#: Fixed value: digits, letters after lower-casing A-Z, and all bytes beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = True
IN_WORD[ord("a") : ord("z") + 1] = True
IN_WORD[0x80:] = True

NEW = {
    "n_words": "long",
    "n_hit": "long",
    "items": "array<string>",
    "spans": "array<struct<start:bigint,end:bigint>>",
}


def text_words(text: str | None) -> list[bytes]:
    """The words of one short text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low = B.LOWER[raw]
    return np.where(IN_WORD[low], low, 0x20).astype(np.uint8).tobytes().split()


def phrases_of(items: list[tuple[str, str | None]], window: int) -> SimpleNamespace:
    """Distinct phrases of some items as numbers of their distinct words, from 1 on.

    The result is broadcast, so it is made of plain types that every worker has.
    """
    number: dict[bytes, int] = {}
    phrases: dict[tuple[int, ...], set[int]] = {}
    for i, (_, text) in enumerate(items):
        words = [number.setdefault(w, len(number) + 1) for w in text_words(text)]
        for at in range(max(1, len(words) - window + 1)):
            if phrase := tuple(words[at : at + window]):
                phrases.setdefault(phrase, set()).add(i)
    lengths = np.array([len(p) for p in phrases], np.int64)
    table = np.zeros((len(phrases), int(lengths.max(initial=1))), np.int32)
    for row, phrase in enumerate(phrases):
        table[row, : len(phrase)] = phrase
    owners = [sorted(p) for p in phrases.values()]
    n_owners = np.array([len(o) for o in owners], np.int64)
    return SimpleNamespace(
        names=[name for name, _ in items],
        vocabulary=list(number),
        lengths=lengths,
        words=table,
        n_owners=n_owners,
        owner_first=np.cumsum(n_owners) - n_owners,
        owners=np.array([i for o in owners for i in o], np.int64),
    )


def occurrences(phrases: SimpleNamespace, codes: np.ndarray, known: pa.Array, row_first: np.ndarray):
    """Phrases and first words of all occurrences in a block's words."""
    number = pc.index_in(pa.array(phrases.vocabulary, known.type), value_set=known)
    number = np.append(0, number.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    wanted = number[phrases.words]
    overlap = phrases.words.shape[1] - 1
    which, where = [], []
    for a in range(0, len(codes), INDEX_WORDS):
        b = min(len(codes), a + INDEX_WORDS + overlap)
        first = np.unique(np.clip(row_first, a, b)) - a
        index = FMIndex(codes[a:b].astype(np.int64) + 1, first, len(known))
        lo, hi = index.find(wanted, phrases.lengths)
        n = hi - lo
        which.append(np.repeat(np.arange(len(n)), n))
        where.append(index.locate(B.ranges(lo, n)) + a)
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(where)


def _lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    """Values by row, given in row order, as one list per row."""
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _searched(block: B.Block, phrases: SimpleNamespace, earlier: bool) -> list[pa.Array]:
    starts, ends, codes, known = B.words(block, IN_WORD, lower=True)
    row_first = np.searchsorted(starts, block.first)
    which, where = occurrences(phrases, codes, known, row_first)
    row = np.searchsorted(row_first, where, "right") - 1
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, where, 1)
    np.add.at(change, where + phrases.lengths[which], -1)
    n_owners = phrases.n_owners[which]
    owner = phrases.owners[B.ranges(phrases.owner_first[which], n_owners)]
    found = {(r, phrases.names[i]) for r, i in set(
        zip(np.repeat(row, n_owners).tolist(), owner.tolist(), strict=True)
    )}
    if earlier:
        spans, items = block.batch.column("spans"), block.batch.column("items")
        own = np.repeat(np.arange(block.rows), pc.list_value_length(spans).to_numpy())
        flat = spans.flatten()
        at = block.first[own]
        np.add.at(change, np.searchsorted(starts, flat.field(0).to_numpy() + at), 1)
        np.add.at(change, np.searchsorted(ends, flat.field(1).to_numpy() + at, "right"), -1)
        found |= {(r, name) for r, names in enumerate(items.to_pylist()) for name in names}
    hit = np.cumsum(change)[:-1] > 0
    a, b = B.runs(hit, row_first)
    own = np.searchsorted(row_first, a, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(starts[a] - block.first[own]), pa.array(ends[b - 1] - block.first[own])],
        ["start", "end"],
    )
    pairs = sorted(found)
    item_row = np.array([r for r, _ in pairs], np.int64)
    names = pa.array([name for _, name in pairs], pa.string())
    return [
        pa.array(np.diff(row_first)),
        pa.array(B.summed(hit, row_first)),
        _lists(names, item_row, block.rows),
        _lists(spans, own, block.rows),
    ]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Adds to the rows of ``docs`` what they share with the benchmark.

    ``n_words``; ``n_hit``, the words inside any occurrence of a phrase; ``items``, the ids
    of items with an occurring phrase, as sorted strings; ``spans``, the merged hit stretches
    as byte offsets into the UTF-8 text. Words are runs of digits, letters and bytes
    beyond ASCII, with A-Z lower-cased. Null and empty texts have no words and so no
    hits; items without words match nothing; an item with a null id is called "null"; rows
    of equal ids are one item. Columns of ``docs`` with the names of new ones are
    replaced.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"),
        F.col(item_text).alias("text"),
    )
    # A word needs two bytes with its border.
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n_blocks = int(size // block_words) + 1
    of_block = F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks))
    plain, schema = added(docs, NEW)
    width = len(plain.columns)
    found = plain
    for k in range(n_blocks):
        rows = items.filter(of_block == k).collect()
        shared = spark.sparkContext.broadcast(phrases_of([(r[0], r[1]) for r in rows], window))

        def search(batches, shared=shared, earlier=k > 0):
            for block in B.blocks(batches, text, SHARD_BYTES):
                columns = [*block.batch.columns[:width], *_searched(block, shared.value, earlier)]
                names = [*block.batch.schema.names[:width], *NEW]
                yield pa.RecordBatch.from_arrays(columns, names)

        found = found.mapInArrow(search, schema)
    return found


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Cuts ``spans`` (byte offsets, ascending) out of the text of each row."""
    prepare(found.sparkSession)
    schema = found.schema

    def cut(batches):
        for block in B.blocks(batches, text):
            spans = block.batch.column("spans")
            own = np.repeat(np.arange(block.rows), pc.list_value_length(spans).to_numpy())
            flat = spans.flatten()
            change = np.zeros(len(block.data) + 1, np.int64)
            np.add.at(change, flat.field(0).to_numpy() + block.first[own], 1)
            np.add.at(change, flat.field(1).to_numpy() + block.first[own], -1)
            keep = np.cumsum(change)[:-1] == 0
            ends = np.concatenate([[0], np.cumsum(B.summed(keep, block.first))])
            old = block.batch.column(text)
            new = B.binary_array(block.data[keep], ends).cast(old.type)
            new = pc.if_else(pc.is_valid(old), new, pa.scalar(None, old.type))
            at = block.batch.schema.names.index(text)
            columns = [*block.batch.columns[:at], new, *block.batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, block.batch.schema.names)

    return found.mapInArrow(cut, schema)
