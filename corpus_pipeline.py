"""The corpus pipeline: quality, toxicity, near duplicates, contamination, token ids.

Each stage takes what the one before it has kept and calls one operator. All but the
last return the columns of ``documents``; ``run`` writes every result to the shared folder and
reads it again, so that no lineage grows and a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.llm.decontaminate import find_contamination, without_spans
from burstlens.llm.places import written
from burstlens.llm.quality import fit_quality, score_quality
from burstlens.llm.simhash import keep_one
from burstlens.llm.toxicity import fit_toxicity, score_toxicity
from burstlens.llm.word_bpe import encode_texts


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``docs`` under names that no operator gives to new columns, and those names."""
    name = {c: f"document_{i}_{c}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in name.items()))
    return renamed, name.__getitem__


def _back(found: DataFrame, docs: DataFrame, name: Callable[[str], str], *more) -> DataFrame:
    return found.select(*(F.col(f"`{name(c)}`").alias(c) for c in docs.columns), *more)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the model reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels)
    apart, name = _apart(docs)
    return _back(score_quality(apart, model, name("text")).filter("kept"), docs, name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels)
    apart, name = _apart(docs)
    return _back(score_toxicity(apart, model, name("text")).filter("predicted = 0"), docs, name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    apart, name = _apart(docs)
    return _back(keep_one(apart, name("doc_id"), name("text")), docs, name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut out of their texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    apart, name = _apart(docs)
    text, n_chars = name("text"), name("n_chars")
    found = without_spans(find_contamination(apart, benchmark, text=text), text)
    length = F.when(F.col("n_hit") > 0, F.char_length(f"`{text}`").cast("long"))
    found = found.withColumn(n_chars, F.coalesce(length, F.col(f"`{n_chars}`")))
    return _back(found, docs, name)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``n_tokens`` and their token ids as ``token_ids``."""
    apart, name = _apart(docs)
    found = encode_texts(apart, text=name("text"))
    n = F.size("ids").cast("long").alias("n_tokens")
    return _back(found, docs, name, n, F.col("ids").alias("token_ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", token_ids),
]

#: Learnt models, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
