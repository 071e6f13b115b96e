"""Row-level views of a trace: gaps inside a set, burst numbers, histograms.

A cache has few sets (64 to 2048), so a window over a whole set would put
billions of rows into one task. Windows over rows are therefore partitioned by
``(rw, set_idx, chunk)``, where a chunk is a range of ``chunk`` record numbers,
and only one summary row per chunk is windowed over the whole set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstlens.profiles import CacheProfile

DEFAULT_CHUNK = 1 << 20

_CHUNK_KEYS = ["rw", "set_idx", "chunk"]
# A table with one row per set and kind does not grow with the trace; up to this
# many sets it is small enough to broadcast.
_BROADCAST_SETS = 1 << 18


def per_set_table(df: DataFrame, profile: CacheProfile) -> DataFrame:
    return F.broadcast(df) if profile.n_sets <= _BROADCAST_SETS else df


# A record has a place in a set if its number and its address are known.
_PLACED = "rec_idx is not null and set_idx is not null"


def _with_unplaced(result: DataFrame, coords: DataFrame, name: str) -> DataFrame:
    """Adds the records without a place, which have no ``name``."""
    unplaced = coords.filter(f"not ({_PLACED})")
    kind = F.coalesce("rw", F.lit(-1).cast("long"))
    return result.unionByName(
        unplaced.withColumn("rw", kind).withColumn(name, F.lit(None).cast("long"))
    )


def _by_chunk(coords: DataFrame, chunk: int):
    """Rows with their chunk and the gap inside it, and the window used."""
    w = Window.partitionBy(*_CHUNK_KEYS).orderBy("rec_idx")
    rows = coords.filter(_PLACED).withColumn("rw", F.coalesce("rw", F.lit(-1).cast("long"))).withColumn(
        "chunk", F.expr(f"rec_idx div {chunk}")
    )
    return rows.withColumn("gap", F.col("rec_idx") - F.lag("rec_idx").over(w)), w


def _entry_gaps(rows: DataFrame, *extra) -> DataFrame:
    """One row per chunk with the gap between its first access and the set's previous one."""
    by_set = Window.partitionBy("rw", "set_idx").orderBy("chunk")
    return (
        rows.groupBy(*_CHUNK_KEYS)
        .agg(F.min("rec_idx").alias("first_idx"), F.max("rec_idx").alias("last_idx"), *extra)
        .withColumn("entry_gap", F.col("first_idx") - F.lag("last_idx").over(by_set))
    )


def access_gaps(coords: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``gap``: records since the previous access of the same set and kind.

    NULL for the first access of a set, and for records without number or address.
    """
    rows, _ = _by_chunk(coords, chunk)
    entries = _entry_gaps(rows).select(*_CHUNK_KEYS, "entry_gap")
    gaps = rows.join(entries, _CHUNK_KEYS).select(
        *coords.columns, F.coalesce("gap", "entry_gap").alias("gap")
    )
    return _with_unplaced(gaps, coords, "gap")


def assign_bursts(
    coords: DataFrame, profile: CacheProfile, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Adds ``burst_id``: 1, 2, ... inside each set and kind, in trace order.

    NULL for records without number or address.
    """
    rows, w = _by_chunk(coords, chunk)
    # Breaks inside a chunk; its first access is judged by the entry gap.
    rows = rows.withColumn(
        "brk", F.when(F.col("gap") >= profile.intra, 1).otherwise(0).cast("long")
    )
    by_set = (
        Window.partitionBy("rw", "set_idx")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = F.when(F.col("entry_gap") < profile.intra, 0).otherwise(1) + F.col("breaks")
    entries = (
        _entry_gaps(rows, F.sum("brk").alias("breaks"))
        .withColumn("entry_id", F.sum(starts).over(by_set) - F.col("breaks"))
        .select(*_CHUNK_KEYS, "entry_id")
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        rows.withColumn("local", F.sum("brk").over(so_far))
        .join(entries, _CHUNK_KEYS)
        .select(*coords.columns, (F.col("entry_id") + F.col("local")).alias("burst_id"))
    )
    return _with_unplaced(numbered, coords, "burst_id")


def set_histogram(coords: DataFrame) -> DataFrame:
    """Accesses, distinct tags and extent of every set and kind."""
    return coords.groupBy("rw", "set_idx").agg(
        F.count("*").alias("n_access"),
        F.count_distinct("tag").alias("n_tags"),
        F.min("rec_idx").alias("first_idx"),
        F.max("rec_idx").alias("last_idx"),
    )


def prune_sets(coords: DataFrame, profile: CacheProfile) -> DataFrame:
    """Keep the accesses of sets with at least ``assoc`` distinct tags.

    A burst cannot have more tags than its set, so no detection is lost.
    """
    kept = (
        set_histogram(coords.filter(F.col("rw").isin(0, 1, -1)))
        .filter(F.col("n_tags") >= profile.assoc)
        .select("rw", "set_idx")
    )
    return coords.join(per_set_table(kept, profile), ["rw", "set_idx"], "left_semi").select(
        *coords.columns
    )
