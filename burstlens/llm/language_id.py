"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (1 to 3 code points, lower-cased, all
other characters as blanks), hashed into ``DIMENSIONS`` buckets: the share of a text's
n-grams that are in a bucket, times its inverse document frequency. Frequencies are
counted over all training documents. The classifier follows the regularised leader with
an elastic-net penalty, in one pass over a bounded sample (``TRAIN_ROWS``) that is read
by one task as a stream; weights that the penalty holds at zero are not kept. The part
of the sample it did not learn from sets the temperature of its probabilities.

Since features are linear in n-grams, whole texts are scored by adding up a table of
bucket weights over all their n-grams; only that table is broadcast.
"""

from __future__ import annotations

import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm import blocks as B
from burstlens.llm.places import added, hash_share, prepare

DIMENSIONS = 1 << 17
SIZES = (1, 2, 3)
TRAIN_ROWS = 8000
#: One in so many rows of the sample is kept for the temperature.
CALIBRATION = 5
# Of the learner: step size, its offset, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
SCALE = 30.0
NEW = {"lang_pred": "string", "score": "double"}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points, and which are letters, below 2^16."""
    chars = [chr(c) for c in range(1 << 16)]
    low = [c.lower() for c in chars]
    return (
        np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32),
        np.array([c.isalpha() for c in chars]),
    )


def _code_points(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block's rows and where each row's begin (one more at the end)."""
    text = block.data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    if leads[-1] == len(points):
        return points, leads[block.first]
    rows = [block.text(r).decode("utf-8", "replace") for r in range(block.rows)]  # damaged text
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32), first


def ngrams(block: B.Block):
    """Buckets of n-grams, a pair ``(buckets, first)`` for each size; rows with letters."""
    lower, letter = B.worker_cache("language_tables", 1, _tables)
    points, first = _code_points(block)
    small = points < 1 << 16
    at = np.where(small, points, 0)
    is_letter = letter[at] & small
    lettered = B.summed(is_letter, first) > 0
    for r in np.flatnonzero(~lettered & (B.summed(~small, first) > 0)):
        lettered[r] = any(chr(c).isalpha() for c in points[first[r] : first[r + 1]])
    plain = np.where(is_letter, lower[at], np.where(small, 0x20, points)).astype(np.uint64)
    shift = np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    found, mixed = [], np.zeros(len(plain), np.uint64)
    for n in SIZES:
        # Of a row, all but the last n - 1 places begin an n-gram.
        mixed = mixed[: len(plain) - n + 1] * np.uint64(0x100000001B3) + plain[n - 1 :]
        bucket = ((mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        sizes = np.maximum(np.diff(first) - (n - 1), 0)
        own = bucket[B.ranges(first[:-1], sizes)].astype(np.int64)
        found.append((own, np.append(0, np.cumsum(sizes))))
    return found, lettered


def _row_buckets(block: B.Block):
    """Distinct ``row * DIMENSIONS + bucket`` of a block, their counts, n-grams per row."""
    found, _ = ngrams(block)
    total = sum(np.diff(first) for _, first in found)
    keys = [np.repeat(np.arange(block.rows), np.diff(first)) * DIMENSIONS + b for b, first in found]
    seen, counts = np.unique(np.concatenate(keys), return_counts=True)
    return seen, counts, total


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents and, per bucket, of documents with an n-gram in it."""
    prepare(docs.sparkSession)

    def count(batches):
        seen, rows = np.zeros(DIMENSIONS, np.int64), 0
        for block in B.blocks(batches, text):
            keys, _, _ = _row_buckets(block)
            seen += np.bincount(keys % DIMENSIONS, minlength=DIMENSIONS)
            rows += block.rows
        at = np.flatnonzero(seen)
        columns = [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n"])

    counted = docs.select(text).mapInArrow(count, "bucket long, n long")
    total = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(DIMENSIONS + 1, np.int64)
    found[total["bucket"].to_numpy()] = total["n"].to_numpy()
    return int(found[-1]), found[:-1]


class _Leader:
    """Follow the regularised leader, for several classes at once."""

    def __init__(self, classes: int) -> None:
        self.z = np.zeros((DIMENSIONS + 1, classes))  # the last row is the constant
        self.n = np.zeros((DIMENSIONS + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def logits(self, at, x) -> np.ndarray:
        return x @ self.weights(at)

    def learn(self, at, x, label: int) -> None:
        w = self.weights(at)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which held-back labels are likeliest."""
    if not len(labels):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 121):
        scaled = logits / t
        top = scaled.max(axis=1, keepdims=True)
        loss = (top[:, 0] + np.log(np.exp(scaled - top).sum(axis=1))) - scaled[
            np.arange(len(labels)), labels
        ]
        best = min(best, (float(loss.mean()), float(t)))
    return best[1]


def fit_language(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    train_rows: int = TRAIN_ROWS,
) -> SimpleNamespace | None:
    """A model of ``lang`` from the text of ``docs``; rows without either are not used.

    The id only chooses and orders the sample. None if there is nothing to learn from.
    """
    prepare(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(
        F.xxhash64(F.lit("language"), F.col(id_column).cast("string")).alias("_key"),
        F.col(text).alias("text"),
        F.col(lang).alias("lang"),
    )
    langs = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(langs)
    if not names:
        return None
    n_docs, frequency = document_frequencies(known)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    # Every language gets its part of the sample, in full if it is small.
    part = train_rows / len(names)
    share = F.create_map(
        *(F.lit(v) for name in names for v in (name, min(1.0, part / langs[name])))
    )
    sample = known.filter(hash_share(F.col("_key"), share[F.col("lang")]))
    number = {name: i for i, name in enumerate(names)}

    def train(batches):
        leader, held, seen = _Leader(len(names)), [], 0
        for block in B.blocks(batches):
            keys, counts, total = _row_buckets(block)
            cut = np.searchsorted(keys, np.arange(block.rows + 1) * DIMENSIONS)
            for r, name in enumerate(block.batch.column("lang").to_pylist()):
                bucket = keys[cut[r] : cut[r + 1]] - r * DIMENSIONS
                if not len(bucket):
                    continue
                x = SCALE * counts[cut[r] : cut[r + 1]] / total[r] * idf[bucket]
                at, x = np.append(bucket, DIMENSIONS), np.append(x, 1.0)
                seen += 1
                if seen % CALIBRATION:
                    leader.learn(at, x, number[name])
                elif seen > train_rows // 4:  # judged as met; by then it has learnt enough
                    held.append((leader.logits(at, x), number[name]))
        weights = leader.weights(slice(None))
        used = np.flatnonzero(np.any(weights != 0, axis=1))
        t = _temperature(np.array([x for x, _ in held]), np.array([y for _, y in held], np.int64))
        model = pickle.dumps((used, weights[used].astype(np.float32), t))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    # The sample is bounded, so one task may read it; sorted, it is the same every time.
    stream = sample.repartition(1).sortWithinPartitions("_key", "lang", "text")
    row = stream.select("text", "lang").mapInArrow(train, "model binary").first()
    used, weights, temperature = pickle.loads(bytes(row[0]))
    table = np.zeros((DIMENSIONS + 1, len(names)), np.float32)
    table[used] = weights
    table[:-1] *= (SCALE * idf[:, None]).astype(np.float32)
    return SimpleNamespace(names=names, table=table, temperature=temperature, n_weights=len(used))


def identify_language(docs: DataFrame, model: SimpleNamespace | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the calibrated chance of it, 0 to 1).

    Only the text is looked at. ``und`` with score 0 if it is null or has no letter, or if
    there is no model. Columns with the new names are replaced.
    """
    prepare(docs.sparkSession)
    plain, schema = added(docs, NEW)
    parts = (model.names, model.table, model.temperature) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def judge(batches):
        for block in B.blocks(batches, text):
            found, lettered = ngrams(block)
            if shared.value:
                names, table, temperature = shared.value
                total = np.maximum(sum(np.diff(first) for _, first in found), 1)
                logits = np.zeros((block.rows, len(names)))
                for c in range(len(names)):
                    column = np.ascontiguousarray(table[:, c])
                    for bucket, first in found:
                        values = np.append(column[bucket], 0).astype(np.float64)
                        sums = np.add.reduceat(values, np.minimum(first[:-1], len(bucket)))
                        logits[:, c] += np.where(np.diff(first) > 0, sums, 0.0)
                logits = (logits / total[:, None] + table[-1]) / temperature
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                name = np.where(lettered, np.array(names, object)[best], "und")
                score = np.where(lettered, p[np.arange(block.rows), best], 0.0)
            else:
                name, score = np.full(block.rows, "und", object), np.zeros(block.rows)
            columns = [*block.batch.columns, pa.array(name, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*block.batch.schema.names, *NEW])

    return plain.mapInArrow(judge, schema)
