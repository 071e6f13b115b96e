"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Terms (whole words, and beginnings of words) that set toxic documents of a bounded
   labelled sample apart make lexicons; counts come from all documents of the sample.
2. Many voters look at a document: single terms, how many terms and different terms of
   each lexicon it has, how dense they are, and patterns such as shouting. The sample's
   own label is a voter too: it may be wrong like any other.
3. The label model estimates how reliable and how correlated the voters are, and gives
   each document of the sample a posterior chance of being toxic.
4. A linear classifier on term counts learns those chances, and scores all documents in
   one pass over their whole texts. Nothing but the model is broadcast.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm import blocks as B
from burstlens.llm.label_model import fit_label_model, fit_linear
from burstlens.llm.places import added, prepare
from burstlens.llm.pretokens import slices
from burstlens.llm.quality import label_sample

# Most labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
MOST_TERMS = 192
SINGLE_VOTERS = 32
PREFIXES = range(3, 8)  # lengths in characters
LEAST_ODDS, LEAST_GAIN, LEAST_DOCS = 2.0, 25.0, 4
SAME_FAMILY = 0.7

#: Bytes of words: letters, and all bytes beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("a") : ord("z") + 1] = True
_IN_WORD[0x80:] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[ord("A") : ord("Z") + 1] = True
NEW = {"score": "double", "predicted": "int"}


def _terms_of(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if n < len(word))]


def _occurrences(block: B.Block, number: dict[str, int] | None):
    """Row and term of each occurrence of a term; without ``number`` terms are numbered anew.

    Also the number of words in each row.
    """
    starts, _, codes, known = B.words(block, _IN_WORD, lower=True)
    row_first = np.searchsorted(starts, block.first)
    fresh: dict[str, int] = {}
    terms, sizes = [], []
    for word in slices(known):
        own = _terms_of(word.decode("utf-8", "replace").lower())
        if number is None:
            own = [fresh.setdefault(t, len(fresh)) for t in own]
        else:
            own = [number[t] for t in own if t in number]
        terms += own
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    term = np.array(terms, np.int64)[B.ranges(first[codes], n)] if n.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.repeat(np.arange(block.rows), np.diff(row_first)), n)
    return row, term, np.diff(row_first), fresh


def _labelled(docs: DataFrame, sample: DataFrame, id_column: str, text: str) -> DataFrame:
    named = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text"))
    return named.join(F.broadcast(sample), "_id").select("_label", "text")


def _mined_terms(rows: DataFrame) -> list[str]:
    """Terms by how well they tell toxic documents apart, best first."""

    def count(batches):
        for block in B.blocks(batches):
            row, term, _, fresh = _occurrences(block, None)
            if not len(fresh):
                continue
            toxic = block.batch.column("_label").to_numpy() > 0
            seen = np.unique(row * len(fresh) + term)
            row, term = seen // len(fresh), seen % len(fresh)
            n1 = np.bincount(term[toxic[row]], minlength=len(fresh))
            n0 = np.bincount(term[~toxic[row]], minlength=len(fresh))
            columns = [pa.array(list(fresh)), pa.array(n1), pa.array(n0)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "n1", "n0"])

    total = rows.agg(F.sum((F.col("_label") > 0).cast("long")), F.count("*")).first()
    toxic, clean = float(total[0] or 0), float(total[1] - (total[0] or 0))
    counted = rows.mapInArrow(count, "term string, n1 long, n0 long").groupBy("term")
    counted = counted.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (toxic + 1)) - F.log((F.col("n0") + 0.5) / (clean + 1))
    share = (F.col("n1") + F.col("n0")) / F.lit(toxic + clean)
    gain = 2 * (
        F.col("n1") * F.log(F.col("n1") / (share * toxic) + 1e-9)
        + F.col("n0") * F.log(F.col("n0") / (share * clean) + 1e-9)
    )
    best = (
        counted.filter((F.col("n1") >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (gain >= LEAST_GAIN))
        .orderBy(gain.desc(), "term")
        .limit(4 * MOST_TERMS)
    )
    found = {r.term: r.n1 for r in best.select("term", "n1").collect()}
    return _without_shorter(found)[:MOST_TERMS]


def _without_shorter(found: dict[str, int]) -> list[str]:
    """Terms without beginnings that say little more than one longer term.

    A beginning stands for a family of words. If most of its documents have it by the same
    longer term, it would only add other words that happen to begin alike.
    """
    shorter = set()
    for term, n in found.items():
        for size in PREFIXES:
            start = term.rstrip("$")[:size]
            if start != term and start in found and n >= SAME_FAMILY * found[start]:
                shorter.add(start)
    return [t for t in found if t not in shorter]


def _features(block: B.Block, terms: list[str]):
    """Term counts of each row (rows x terms), its words, and its shares of shouting."""
    number = {t: i for i, t in enumerate(terms)}
    row, term, n_words, _ = _occurrences(block, number)
    counts = np.bincount(row * len(terms) + term, minlength=block.rows * len(terms))
    letters = np.maximum(B.summed(_IN_WORD[B.LOWER[block.data]], block.first), 1)
    upper = B.summed(_IS_UPPER[block.data], block.first) / letters
    bangs = B.summed(block.data == ord("!"), block.first) / np.maximum(n_words, 1)
    return counts.reshape(block.rows, -1).astype(np.float32), n_words, upper, bangs


def _votes(counts: np.ndarray, n_words, upper, bangs, whole: np.ndarray) -> np.ndarray:
    """Votes of all voters (rows x voters)."""
    found = counts > 0
    voters = list(found[:, :SINGLE_VOTERS].T)
    for lexicon in (whole, ~whole):
        n, kinds = counts[:, lexicon].sum(axis=1), found[:, lexicon].sum(axis=1)
        voters += [n >= k for k in (1, 2, 3, 5)] + [kinds >= k for k in (2, 3)]
        voters += [n > share * np.maximum(n_words, 1) for share in (0.005, 0.02)]
    voters += [upper > 0.5, bangs > 0.3]
    return np.stack(voters, axis=1)


def _inputs(counts: np.ndarray, n_words) -> np.ndarray:
    """What the linear classifier sees of each row."""
    total = counts.sum(axis=1)
    return np.column_stack(
        [
            np.log1p(counts),
            np.log1p(total),
            np.log1p((counts > 0).sum(axis=1)),
            np.sqrt(total / np.maximum(n_words, 1)),
        ]
    )


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_rows: int = TRAIN_ROWS,
) -> SimpleNamespace | None:
    """A model from at most ``train_rows`` labelled documents; None without both labels."""
    prepare(docs.sparkSession)
    sample = label_sample(labels, id_column, label, train_rows)
    rows = _labelled(docs, sample, id_column, text)
    terms = _mined_terms(rows)
    if not terms:
        return None
    n_terms = len(terms)

    def measure(batches):
        for block in B.blocks(batches):
            counts, n_words, upper, bangs = _features(block, terms)
            packed = pa.array([c.tobytes() for c in counts.astype(np.uint32)], pa.binary())
            columns = [block.batch.column("_label"), packed, pa.array(n_words), pa.array(upper)]
            names = ["_label", "counts", "n_words", "upper", "bangs"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bangs)], names)

    schema = "_label double, counts binary, n_words long, upper double, bangs double"
    found = rows.mapInArrow(measure, schema).limit(2 * train_rows).toPandas()
    found = found.sort_values(["_label", "n_words", "upper", "counts"])
    y = found["_label"].to_numpy() > 0
    if not 0 < y.sum() < len(y):
        return None
    counts = np.frombuffer(b"".join(found["counts"]), np.uint32).reshape(-1, n_terms)
    counts = counts.astype(np.float32)
    n_words = found["n_words"].to_numpy()
    whole = np.array([t.endswith("$") for t in terms])
    votes = _votes(counts, n_words, found["upper"].to_numpy(), found["bangs"].to_numpy(), whole)
    model = fit_label_model(np.column_stack([votes, y]), np.where(y, 0.9, 0.05))
    weights = fit_linear(_inputs(counts, n_words).astype(float), model.posterior)
    return SimpleNamespace(terms=terms, weights=weights, label_model=model)


def score_toxicity(
    docs: DataFrame, model: SimpleNamespace | None, text: str = "text", threshold: float = 0.5
) -> DataFrame:
    """Adds ``score`` (double, 0 to 1) and ``predicted`` (int: 1 from the threshold on).

    Only the text is looked at. A null or empty text has no terms and gets the score of
    that; without a model all scores are 0. Columns with the new names are replaced.
    """
    prepare(docs.sparkSession)
    plain, schema = added(docs, NEW)
    parts = (model.terms, model.weights) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def judge(batches):
        for block in B.blocks(batches, text):
            if shared.value:
                terms, weights = shared.value
                counts, n_words, _, _ = _features(block, terms)
                x = _inputs(counts, n_words)
                score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            else:
                score = np.zeros(block.rows)
            columns = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            names = [*block.batch.schema.names, *NEW]
            yield pa.RecordBatch.from_arrays([*block.batch.columns, *columns], names)

    return plain.mapInArrow(judge, schema)
