"""Licence notices in texts, by a positional index of the rarest words of notices.

A notice is a run of words, some of which (its key phrases) must all be there; of all its words a
share of ``SHARE`` is enough. The index holds, for each notice, the places of its words with the highest
inverse document frequency, counted over all documents. A document's words that are in the index give
(notice, start) pairs; a start that enough of them agree on is compared with the whole notice.

If ``k`` words may differ, ``k + 2`` indexed places leave at least two that agree, so no notice is missed, and the
choice of words changes the work only, never the result.

Everything is a column function: a document's words are an array in its own row, and only counts of
the notices' words are shuffled.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of a notice's words that must stand in place.
SHARE = 0.8


@dataclass(frozen=True)
class Notice:
    """``words`` (in lower case) that tell of ``label``; ``keys`` are phrases of it that must be whole."""

    label: str
    words: str
    keys: tuple[str, ...]

    @property
    def tokens(self) -> list[str]:
        return self.words.split(" ")

    @property
    def needed(self) -> int:
        """Words that must stand in place."""
        return math.ceil(SHARE * len(self.tokens))

    @property
    def mandatory(self) -> list[int]:
        """Places of the words of key phrases."""
        found = set()
        for key in self.keys:
            own = key.split(" ")
            starts = [i for i in range(len(self.tokens)) if self.tokens[i : i + len(own)] == own]
            if not starts:
                raise ValueError(f"{key!r} is no phrase of {self.words!r}")
            found |= {starts[0] + j for j in range(len(own))}
        return sorted(found)


def phrase(label: str, words: str) -> Notice:
    """A notice that must be there word by word."""
    return Notice(label, words, (words,))


#: Phrases whose places are counted, and their labels.
BASE = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
)

#: Notices as the licences word them.
NOTICES = (
    phrase("cc-by-nc", "cc by nc"),
    phrase("cc-by-nd", "cc by nd"),
    phrase("cc-by-sa", "cc by sa"),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Notice("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Notice("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    phrase("lgpl", "gnu lesser general public license"),
    phrase("agpl", "gnu affero general public license"),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files",
        ("permission is hereby granted", "this software"),
    ),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("with or without fee",),
    ),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    Notice(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Notice(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software",),
    ),
    Notice(
        "cc0",
        "has waived all copyright and related or neighboring rights",
        ("waived all copyright",),
    ),
)

#: Fixed value: what words are, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def word_documents(docs: DataFrame, words: set[str], text: str = "text") -> dict[str, int]:
    """Documents that hold each of ``words``, of all documents. The answer is as small as the question."""
    own = F.array_distinct(F.filter(_words(text), lambda w: w.isin(*sorted(words))))
    counts = docs.select(F.explode(own).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def _index(notices: tuple[Notice, ...], counts: dict[str, int]):
    """(word, notice, place) of the rarest places of each notice, and how many must agree."""
    postings, votes = [], []
    for n, notice in enumerate(notices):
        may_differ = len(notice.tokens) - notice.needed
        places = sorted(range(len(notice.tokens)), key=lambda i: (counts.get(notice.tokens[i], 0), i))
        places = places[: may_differ + 2]
        postings += [(notice.tokens[i], n, i) for i in places]
        votes.append(len(places) - may_differ)
    return postings, votes


def _array(values, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def scan_licenses(
    docs: DataFrame, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES, text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: what notices stand where.

    ``licenses`` is an array of structs (``label``, ``start`` and ``end`` in words from 0, ``share`` of words in
    place, ``is_base``), by start, then in the order of ``base`` and ``notices``. Notices may overlap.

    A null or empty text has no words and an empty array. A text of any length is taken whole, as one array
    of words. Each place counts, repeated ones too; equal rows are scanned each for itself and stay. No documents
    give no rows. Columns of the new names, in any case, are replaced; others stay whatever their type.
    """
    every = (*base, *notices)
    postings, votes = _index(every, word_documents(docs, {w for n in every for w in n.tokens}, text))
    indexed = sorted({w for w, _, _ in postings})
    by_word = [
        F.array(*(F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for w, n, i in postings if w == word))
        for word in indexed
    ]
    index = F.create_map(*(c for word, own in zip(indexed, by_word, strict=True) for c in (F.lit(word), own)))
    tokens = F.array(*(_array(n.tokens, "string") for n in every))
    mandatory = F.array(*(_array(n.mandatory, "int") for n in every))
    votes_of = _array(votes, "int")
    needed = _array([n.needed for n in every], "int")

    plain = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in ("n_words", "licenses", "_words")))
    words = plain.withColumn("_words", _words(text))
    at = F.col("_words")
    hits = F.filter(
        F.transform(at, lambda w, p: F.when(w.isin(*indexed), p)), lambda p: p.isNotNull()
    )
    pairs = F.array_sort(F.flatten(F.transform(hits, lambda p: F.transform(
        F.element_at(index, F.get(at, p)), lambda o: F.struct((p - o["i"]).alias("start"), o["n"].alias("n"))
    ))))
    # Equal pairs are neighbours: the first of each run is taken if the run is long enough.
    found = words.select("*", pairs.alias("_pairs"))
    agreed = F.filter("_pairs", lambda x, i: (
        (x["start"] >= 0)
        & (x["start"] + F.size(F.get(tokens, x["n"])) <= F.size("_words"))
        & ((i == 0) | (F.get("_pairs", i - 1) != x))
        & F.coalesce(F.get("_pairs", i + F.get(votes_of, x["n"]) - 1) == x, F.lit(False))
    ))
    found = found.withColumn("_pairs", agreed)

    def in_place(x, j):
        return F.get("_words", x["start"] + j) == F.get(F.get(tokens, x["n"]), j)

    def share(x):
        length = F.size(F.get(tokens, x["n"]))
        return F.size(F.filter(F.sequence(F.lit(0), length - 1), lambda j: in_place(x, j)))

    whole = F.filter("_pairs", lambda x: F.forall(F.get(mandatory, x["n"]), lambda j: in_place(x, j)))
    counted = F.transform(whole, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), share(x).alias("same")))
    kept = F.filter(counted, lambda x: x["same"] >= F.get(needed, x["n"]))
    labels = _array([n.label for n in every], "string")
    licenses = F.transform(kept, lambda x: F.struct(
        F.get(labels, x["n"]).alias("label"),
        x["start"].alias("start"),
        (x["start"] + F.size(F.get(tokens, x["n"]))).alias("end"),
        (x["same"] / F.size(F.get(tokens, x["n"]))).alias("share"),
        (x["n"] < len(base)).alias("is_base"),
    ))
    return found.select(
        *(f"`{c}`" for c in plain.columns), F.size("_words").cast("long").alias("n_words"), licenses.alias("licenses")
    )


def license_digest(found: DataFrame) -> DataFrame:
    """``scan_licenses`` rows with the places and labels of base phrases, all labels, and the greatest share as a score."""
    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    base = F.filter("licenses", lambda x: x["is_base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "*", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("licenses")).alias("labels"), best.alias("score"),
    )
