"""Near duplicates by 64-bit SimHash fingerprints over word shingles.

Fingerprints that differ in at most ``MAX_BITS`` = 3 bits differ in at most three of
their eight bytes, so they share at least five bytes at the same positions: the
guaranteed minimum of matches. The inverted index has a posting list for bytes at byte
positions: of five shared positions three lie in the same half of the fingerprint,
so the lists of any three positions of a half (eight kinds) bring every such pair
together. In a list the shared positional bytes of pairs are tallied, pairs with five
or more are retained, and their bit distance is verified.

Only distinct fingerprints are indexed: exact copies never meet. Lists of more than
``HOT_LIST`` entries are not compared as they are; their entries go to longer lists,
of two more positions each (any five shared positions), which leave three bytes free and
so hold at most 2^24 entries. Links inside a list are returned as a spanning forest, not
as all pairs, so a group of thousands of near copies costs about as many links as it
has members. Nothing is capped: every linked pair ends up connected.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm import blocks as B
from burstlens.llm.components import components
from burstlens.llm.places import added, prepare, written

SEED = 42
MAX_BITS = 3
POSITIONS = 8
# Of eight bytes at most MAX_BITS differ.
LEAST_SHARED = POSITIONS - MAX_BITS
# Longer lists are split by two more positions. Result-neutral.
HOT_LIST = 4096
# Up to this length a list's pairs are compared shift by shift, all lists at once.
SHORT_LIST = 48
# Above this length a list of five positions is searched by flipping bits.
LONG_LIST = 8192

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints_of(block: B.Block, shingle: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints of a block's rows; zero for a row without words."""
    data = B.LOWER[block.data]
    inside = B.NOT_WHITE[data]
    starts, ends = B.runs(inside, block.first)
    lengths = ends - starts
    # Words with one blank after each.
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    flat = np.full(int(at[-1]), 0x20, np.uint8)
    flat[B.ranges(at[:-1], lengths)] = data[inside]
    raw = flat.tobytes()
    word_first = np.searchsorted(starts, block.first)
    n_words = np.diff(word_first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    begin = B.ranges(word_first[:-1], n_shingles)
    row = np.repeat(np.arange(block.rows), n_shingles)
    last = np.minimum(begin + shingle, word_first[1:][row])
    digest = xxhash.xxh64_intdigest
    cuts = zip(at[begin].tolist(), (at[last] - 1).tolist(), strict=True)
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in cuts), np.uint64, len(begin))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, POSITIONS)
    ones = np.empty((block.rows, 64), np.int64)
    for p in range(POSITIONS):
        seen = np.bincount((row << 8) + octets[:, p], minlength=block.rows << 8)
        ones[:, 8 * p : 8 * p + 8] = seen.reshape(block.rows, 256) @ _BITS
    set_bits = (2 * ones > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<i8").ravel()


def with_fingerprints(
    docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint"
) -> DataFrame:
    """``docs`` with a column of fingerprints (long)."""
    prepare(docs.sparkSession)
    plain, schema = added(docs, {name: "long"})

    def fingerprint(batches):
        for block in B.blocks(batches, text):
            columns = [*block.batch.columns, pa.array(fingerprints_of(block, shingle))]
            yield pa.RecordBatch.from_arrays(columns, [*block.batch.schema.names, name])

    return plain.mapInArrow(fingerprint, schema)


def _mask(positions) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _lists() -> list[tuple[int, ...]]:
    """Triples of positions of which any five positions contain one."""
    halves = (range(POSITIONS // 2), range(POSITIONS // 2, POSITIONS))
    return [triple for half in halves for triple in combinations(half, 3)]


def _longer() -> list[list[tuple[int, ...]]]:
    """For each triple, the sets of five positions that contain it."""
    return [
        [tuple(sorted({*t, *more})) for more in combinations(sorted({*range(POSITIONS)} - {*t}), 2)]
        for t in _lists()
    ]


def _similar(a: np.ndarray, b) -> np.ndarray:
    """Which pairs share the least number of positional bytes and are near in bits."""
    differing = a ^ b
    octets = differing.view(np.uint8).reshape(-1, POSITIONS)
    near = np.count_nonzero(octets, axis=1) <= POSITIONS - LEAST_SHARED
    near[near] = np.bitwise_count(differing[near]) <= MAX_BITS
    return near


def _walk(prints: np.ndarray):
    """Spanning links of one list: neighbours of neighbours until none is left."""
    left = prints
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            here = todo.pop()
            near = _similar(left, here)
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), here, np.uint64), found
                todo.extend(found)


def _flip(prints: np.ndarray):
    """Spanning links of a long list of prints that differ in three bytes only.

    Looks up each print with up to MAX_BITS of its free bits flipped, in a table of all
    values of the free bytes, and spreads least labels until they stay.
    """
    octets = prints.view(np.uint8).reshape(-1, POSITIONS)
    free = np.flatnonzero((octets != octets[0]).any(axis=0))
    code = np.zeros(len(prints), np.int64)
    for i, p in enumerate(free):
        code |= octets[:, p].astype(np.int64) << (8 * i)
    n_bits = 8 * len(free)
    table = np.full(1 << n_bits, -1, np.int32)
    table[code] = np.arange(len(prints))
    flips = [
        sum(1 << b for b in bits)
        for size in range(1, MAX_BITS + 1)
        for bits in combinations(range(n_bits), size)
    ]
    label = np.arange(len(prints))
    while True:
        before = label.copy()
        for flip in flips:
            other = table[code ^ flip]
            hit = other >= 0
            label[hit] = np.minimum(label[hit], label[other[hit]])
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    linked = label != np.arange(len(prints))
    yield prints[label[linked]], prints[linked]


def links_in_lists(kind: np.ndarray, key: np.ndarray, prints: np.ndarray):
    """Spanning links of consecutive lists of distinct prints, as pairs of arrays."""
    n = len(prints)
    change = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
    first = np.concatenate([[0], change]).astype(np.int64)
    size = np.diff(np.append(first, n))
    short = size <= SHORT_LIST
    remaining = np.repeat(np.where(short, first + size, 0), size) - np.arange(n)
    for shift in range(1, int(size[short].max(initial=1))):
        at = np.flatnonzero(remaining > shift)
        near = _similar(prints[at], prints[at + shift])
        yield prints[at[near]], prints[at[near] + shift]
    for a, length in zip(first[~short], size[~short], strict=True):
        own = prints[a : a + length]
        yield from _flip(own) if length > LONG_LIST else _walk(own)


def _linked(postings: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` of all posting lists ``(kind, key, fingerprint)``."""
    prepare(postings.sparkSession)

    def search(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            kind = table["kind"].to_numpy()
            key = table["key"].to_numpy()
            prints = table["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
            for a, b in links_in_lists(kind, key, prints):
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                    )

        for batch in batches:
            # The last list of a batch may go on in the next one.
            n = batch.num_rows
            if not n:
                continue
            kind, key = batch["kind"].to_numpy(), batch["key"].to_numpy()
            last = np.flatnonzero((kind != kind[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (
                held[-1]["kind"][-1].as_py() != kind[0] or held[-1]["key"][-1].as_py() != key[0]
            ):
                yield from flush(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return (
        postings.repartition("kind", "key")
        .sortWithinPartitions("kind", "key", "fingerprint")
        .mapInArrow(search, "a long, b long")
    )


def linked_fingerprints(prints: DataFrame, hot_list: int = HOT_LIST) -> DataFrame:
    """Links ``(a, b)`` that connect distinct ``fingerprint`` values at most 3 bits apart.

    Two values are connected by these links if and only if they are by all such pairs.
    """
    value = F.col("fingerprint")
    keys = F.array(*(value.bitwiseAND(F.lit(_mask(t))) for t in _lists()))
    postings = prints.select(F.posexplode(keys).alias("kind", "key"), "fingerprint")
    sizes = postings.groupBy("kind", "key").agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > hot_list).select("kind", "key")
    hot = written(hot, "hot-lists")
    plain = postings.join(hot, ["kind", "key"], "left_anti")
    longer = F.array(
        *(
            F.array(*(value.bitwiseAND(F.lit(_mask(five))) for five in of_triple))
            for of_triple in _longer()
        )
    )
    split = (
        postings.join(hot, ["kind", "key"], "left_semi")
        .select("kind", "fingerprint", F.posexplode(longer[F.col("kind")]).alias("more", "key"))
        .select((F.col("kind") * 16 + F.col("more") + 100).alias("kind"), "key", "fingerprint")
    )
    return _linked(plain).union(_linked(split))


def _classes(prints: DataFrame) -> DataFrame:
    """``(fingerprint, root)`` of the distinct values in ``fingerprint``."""
    distinct = written(prints.select("fingerprint").distinct(), "distinct")
    roots = components(linked_fingerprints(distinct)).withColumnRenamed("node", "fingerprint")
    return distinct.join(roots, "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )


def _rows(docs: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text"))
    return written(with_fingerprints(rows, "text", shingle).drop("text"), "fingerprints")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3
) -> DataFrame:
    """``(<id_column>, fingerprint long, component_id)`` of every row.

    Lower-cases A-Z, takes words between ASCII white space and shingles of ``shingle``
    words (a shorter text is one shingle, a null or empty one has fingerprint zero).
    ``component_id`` is the least id that is reachable over fingerprints at most 3 bits
    apart. Repeated rows stay, each with its class. Null ids are no one's least id
    unless a class has no other.
    """
    rows = _rows(docs, id_column, text, shingle)
    least = rows.groupBy("fingerprint").agg(F.min("_id").alias("_least"))
    classed = written(_classes(rows).join(least, "fingerprint"), "classes")
    of_class = classed.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = classed.join(of_class, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        F.col("_id").alias(id_column), "fingerprint", "component_id"
    )


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3
) -> DataFrame:
    """One row of each class of near duplicates, with all columns of ``docs``.

    The row with the least id stays (a null id only if there is no other); of several with
    that id, one with the least fingerprint. Null and empty texts are a class of their own.
    """
    rows = _rows(docs, id_column, text, shingle)
    counted = rows.groupBy("_id", "fingerprint").agg(F.count("*").alias("_n"))
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "fingerprint", "_n")
    first = counted.join(_classes(rows), "fingerprint").groupBy("root")
    kept = first.agg(F.min(place).alias("k")).select(
        F.col("k._id").alias("_kept"), F.col("k.fingerprint").alias("_print"), F.col("k._n").alias("_n")
    )
    kept = written(kept, "kept")
    printed = with_fingerprints(docs, text, shingle, "_fingerprint")

    def of(chosen: DataFrame) -> DataFrame:
        same = F.col(f"`{id_column}`").eqNullSafe(F.col("_kept"))
        return printed.join(chosen, same & (F.col("_fingerprint") == F.col("_print")), "left_semi")

    result = of(kept.filter("_n = 1"))
    several = kept.filter("_n > 1")
    if not several.isEmpty():  # rows of equal id and fingerprint, of which one stays
        once = of(several).dropDuplicates([id_column, "_fingerprint"])
        result = result.union(once)
    return result.drop("_fingerprint")
