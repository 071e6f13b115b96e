"""Selecting access kinds and mapping addresses to cache coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.functions import line_tag, set_index
from burstlens.profiles import FETCH, READ, WRITE, CacheProfile

# Kinds analysed by each mode. Without a mode, data traces are not analysed.
MODES = {"READ": (READ,), "WRITE": (WRITE,), "BOTH": (READ, WRITE), None: ()}


def only_reads(trace: DataFrame) -> DataFrame:
    return trace.filter(F.col("rw") == READ)


def only_writes(trace: DataFrame) -> DataFrame:
    return trace.filter(F.col("rw") == WRITE)


def kinds_of(profile: CacheProfile, mode: str | None) -> tuple[int, ...]:
    """The access kinds that an analysis covers, in report order."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {list(MODES)}, got {mode!r}")
    return MODES[mode] if profile.has_kinds else (FETCH,)


def select_kinds(trace: DataFrame, profile: CacheProfile, mode: str | None) -> DataFrame:
    """Keep the kinds of ``mode``; a profile without kinds takes every record."""
    if not profile.has_kinds:
        return trace
    kinds = kinds_of(profile, mode)
    return trace.filter(F.col("rw").isin(*kinds)) if kinds else trace.filter(F.lit(False))


def with_cache_coords(
    trace: DataFrame, profile: CacheProfile, exact_tag: bool = False
) -> DataFrame:
    """``(rec_idx, rw, set_idx, tag)`` of every record of ``trace``.

    ``rw`` becomes FETCH for profiles without kinds, so that both trace forms
    share one grouping key. A record without an address has no set and no tag: it
    belongs to no burst, and row-level operators pass it on with NULL results.
    """
    kind = F.col("rw") if profile.has_kinds else F.lit(FETCH).cast("long")
    return trace.select(
        "rec_idx",
        kind.alias("rw"),
        set_index("paddr", profile).alias("set_idx"),
        line_tag("paddr", profile, exact_tag).alias("tag"),
    )
