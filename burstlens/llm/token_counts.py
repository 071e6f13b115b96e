"""Token counts of whole texts: frequent words from a broadcast table, others encoded once.

Two tiers, both on the map side. First the most frequent words (pre-tokens) of the corpus
are found: every task keeps a bounded summary of its own words and hands on its most
frequent ones, so what is shuffled depends on the number of tasks and not on the text.
Their token counts are packed into a table of at most ``table_size`` entries, which is
broadcast. Then each task cuts its texts into words and adds up their counts; a word that
is not in the table is encoded with the library and remembered by the worker.

The summaries only decide which words are looked up faster: every count is exact.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm import blocks as B
from burstlens.llm.places import added, prepare
from burstlens.llm.pretokens import Encoder, kinds_of, slices, word_offsets

# Bounds of a task's summary, of what it hands on, and of the broadcast table.
SUMMARY = 200_000
HANDED_ON = 20_000
TABLE_SIZE = 50_000
# Longer words are rare and would make the table large.
TABLE_WORD_BYTES = 40


def frequent_words(docs: DataFrame, text: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """``(word, n)``: about the ``size`` most frequent words, their counts from below.

    A task whose summary is full halves it (all counts lose the median count), and
    words that a block has once are not counted: counts are lower bounds.
    """
    prepare(docs.sparkSession)

    def summarise(batches):
        seen: Counter = Counter()
        for block in B.blocks(batches, text):
            offsets = word_offsets(block, kinds_of(block.data))
            counted = B.binary_array(block.data, offsets).value_counts()
            values, counts = counted.field(0), counted.field(1).to_numpy()
            # What a block has once only is not frequent.
            often = np.flatnonzero(counts > 1)
            taken = slices(values.take(pa.array(often)))
            for word, n in zip(taken, counts[often].tolist(), strict=True):
                if len(word) <= TABLE_WORD_BYTES:
                    seen[word] += n
            if len(seen) > SUMMARY:
                loss = int(np.median(np.fromiter(seen.values(), np.int64, len(seen))))
                seen = Counter({k: v - loss for k, v in seen.items() if v > loss})
        top = seen.most_common(HANDED_ON)
        if top:
            names, counts = zip(*top, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"]
            )

    handed = docs.select(text).mapInArrow(summarise, "word binary, n long")
    return (
        handed.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    )


class _Counts:
    """The two tiers of one worker."""

    def __init__(self, path: str, packed: tuple[bytes, np.ndarray, np.ndarray]) -> None:
        data, lengths, counts = packed
        ends = np.cumsum(lengths, dtype=np.int64)
        cut = zip((ends - lengths).tolist(), ends.tolist(), strict=True)
        self.table = dict(zip((data[a:b] for a, b in cut), counts.tolist(), strict=True))
        self.encoder = Encoder(path)

    def of_words(self, distinct: list[bytes]) -> np.ndarray:
        found = np.fromiter(
            (self.table.get(p, -1) for p in distinct), np.int64, len(distinct)
        )
        missed = np.flatnonzero(found < 0)
        if len(missed):
            slots = self.encoder.slots([distinct[i] for i in missed])
            found[missed] = self.encoder.length[slots]
        return found

    def of_rows(self, block: B.Block) -> np.ndarray:
        codes, row_first, words, whole = self.encoder.cut(block)
        counts = B.summed(self.of_words(words)[codes], row_first)
        if len(whole):
            counts[whole] = [len(x) for x in self.encoder.encode([block.text(r) for r in whole])]
        return counts


def count_tokens(
    docs: DataFrame,
    tokenizer: str | None = None,
    text: str = "text",
    limit: int = 512,
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` to the rows of ``docs``.

    ``tokenizer`` is the path of a byte-level vocabulary of the tokenizers library.
    Special strings inside a text are special tokens, as is its default; none are
    added. A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted
    each; columns of ``docs`` with the names of new ones are replaced.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = frequent_words(docs, text, table_size).select("word").collect()
    frequent = [bytes(r[0]) for r in rows]
    counts = [len(x) for x in Encoder(path).encode(frequent)]
    packed = (
        b"".join(frequent),
        np.fromiter(map(len, frequent), np.int64, len(frequent)),
        np.asarray(counts, np.uint16),
    )
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    key = uuid.uuid4().hex
    new = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}
    kept, schema = added(docs, new)

    def count(batches):
        tiers = B.worker_cache("token_counts", key, lambda: _Counts(path, shared.value))
        for block in B.blocks(batches, text):
            n = tiers.of_rows(block)
            yield pa.RecordBatch.from_arrays(
                [
                    *block.batch.columns,
                    pa.array(np.diff(block.first)),
                    pa.array(n),
                    pa.array(n > limit),
                ],
                [*block.batch.schema.names, *new],
            )

    return kept.mapInArrow(count, schema)
