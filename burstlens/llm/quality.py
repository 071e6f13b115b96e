"""Quality rules: gradient-boosted trees over document statistics.

The model learns from a bounded sample of labelled documents (``TRAIN_ROWS``); statistics
of all documents are taken from their whole texts, in the pass that scores them. The
sample of labels is small enough to broadcast by that bound, so texts are not shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm import blocks as B
from burstlens.llm.boosted_trees import fit, score
from burstlens.llm.doc_stats import COUNTS, FEATURES, document_stats
from burstlens.llm.places import added, hash_share, prepare

# Most labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
LEAST_WORDS = 50
# A document is rejected if more than this percentage of its words is repeated.
MOST_REPEATED = 50
NEW = {c: "long" for c in COUNTS}
NEW |= {"base_failed": "boolean", "quality_score": "double", "kept": "boolean"}


def label_sample(labels: DataFrame, id_column: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` rows ``(_id, _label)``, chosen by a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    known = known.select(F.col(id_column).alias("_id"), F.col(label).cast("double").alias("_label"))
    n = known.count()
    share = min(1.0, 0.97 * rows / max(n, 1))
    return known.filter(hash_share(F.xxhash64(F.lit("sample"), "_id"), share)).limit(rows)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    train_rows: int = TRAIN_ROWS,
):
    """A model of the label (1: good) from at most ``train_rows`` labelled documents.

    None if the sample doesn't have both labels.
    """
    prepare(docs.sparkSession)
    sample = label_sample(labels, id_column, label, train_rows)
    named = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text"))
    rows = named.join(F.broadcast(sample), "_id").select("_label", "text")

    def measure(batches):
        for block in B.blocks(batches):
            _, x = document_stats(block)
            columns = [block.batch.column("_label"), *(pa.array(c) for c in x.T)]
            yield pa.RecordBatch.from_arrays(columns, ["_label", *FEATURES])

    schema = "_label double, " + ", ".join(f"{f} double" for f in FEATURES)
    # Ids may repeat in either table; the bound holds for what is collected.
    found = rows.mapInArrow(measure, schema).limit(2 * train_rows).toPandas()
    # In a fixed order, so that a model does not depend on the order of tasks.
    found = found.sort_values([*FEATURES, "_label"]).to_numpy(float)
    y = (found[:, 0] > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    return fit(found[:, 1:], y, list(FEATURES.values()))


def score_quality(docs: DataFrame, model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``COUNTS`` (long), ``base_failed``, ``quality_score`` (double) and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word
    windows. ``kept`` is false for those, else whether the score reaches ``threshold``;
    without a model the score is 1. A null or empty text has no words and so fails.
    Columns of ``docs`` with the names of new ones are replaced.
    """
    prepare(docs.sparkSession)
    plain, schema = added(docs, NEW)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for block in B.blocks(batches, text):
            counts, x = document_stats(block)
            n_words, n_repeat = counts[:, 0], counts[:, 4]
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
            good = score(shared.value, x) if shared.value else np.ones(block.rows)
            columns = [
                *block.batch.columns,
                *(pa.array(np.ascontiguousarray(c)) for c in counts.T),
                pa.array(failed),
                pa.array(good),
                pa.array(~failed & (good >= threshold)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*block.batch.schema.names, *NEW])

    return plain.mapInArrow(judge, schema)
