"""The detection query and the shapes its result can take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstlens.operators.bursts import qualifying_bursts
from burstlens.operators.chains import detections
from burstlens.operators.coords import kinds_of, select_kinds, with_cache_coords
from burstlens.operators.gaps import DEFAULT_CHUNK
from burstlens.profiles import FETCH, CacheProfile, profile_of
from burstlens.sources.binary import read_trace
from burstlens.sources.checkpoints import scratch_dir

# Kind names in verdicts.
KIND_NAMES = {1: "READ", 0: "WRITE", FETCH: "FETCH"}


def detect(
    trace: DataFrame,
    scope: str | CacheProfile,
    mode: str | None = None,
    num_pp: int = 1,
    exact_tag: bool = False,
    all_chains: bool = False,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Linked bursts ``(rw, set_idx, n_lines, center)`` of every suspicious set.

    Reads and writes are analysed separately but in one pass. ``mode`` None
    analyses nothing on data scopes; fetch scopes ignore it and report ``rw`` NULL.
    ``exact_tag`` and ``all_chains`` are additions with a default of off.

    Records without a number or an address belong to no burst. ``chunk`` changes the
    distribution of the work, never the result.
    """
    profile = profile_of(scope)
    kept = select_kinds(trace, profile, mode)
    coords = with_cache_coords(kept, profile, exact_tag)
    bursts = qualifying_bursts(coords, profile, chunk)
    found = detections(bursts, profile, num_pp, all_chains, chunk)
    return found.select(
        F.nullif(F.col("rw"), F.lit(FETCH).cast("long")).alias("rw"),
        "set_idx",
        "n_lines",
        "center",
    )


def pruning(
    scope: str | CacheProfile, mode: str | None = None, exact_tag: bool = False
) -> dict:
    """What may be left out of a trace for one analysis.

    For ``read_trace(prune=...)``. Only accesses in runs of at
    least ``min_len`` accesses and ``min_tags`` tags can make a qualifying burst, so
    ``detect`` gives the same result from far fewer rows. Other operators
    (histograms, all bursts) need the unpruned trace.
    """
    profile = profile_of(scope)
    return {
        "kinds": list(kinds_of(profile, mode)) if profile.has_kinds else None,
        "line_bits": profile.line_bits,
        "set_mask": profile.set_mask,
        "tag_shift": profile.exact_tag_shift if exact_tag else profile.tag_shift,
        "min_len": max(profile.assoc, 2),
        "min_tags": profile.assoc,
        "intra": profile.intra,
    }


def detect_file(
    spark: SparkSession,
    paths: str | list[str],
    scope: str | CacheProfile,
    mode: str | None = None,
    exact_tag: bool = False,
    **options,
) -> DataFrame:
    """``detect`` on binary traces, decoded once and pruned while decoding.

    The candidate accesses, commonly a small part of the trace, are written to the
    checkpoint folder as a table, and the analysis runs on that: the trace itself is
    never shuffled, and a lost executor does not cause it to be decoded again.
    """
    profile = profile_of(scope)
    kind = "data" if profile.has_kinds else "fetch"
    rule = pruning(profile, mode, exact_tag)
    candidates = read_trace(spark, paths, kind, prune=rule)
    table = scratch_dir(spark, "candidates")
    candidates.write.parquet(table)
    stored = spark.read.schema(candidates.schema).parquet(table)
    return detect(stored, profile, mode, exact_tag=exact_tag, **options)


def detections_by_set(found: DataFrame, span: int = DEFAULT_CHUNK) -> DataFrame:
    """Detections as arrays of ``(center, n_lines)`` per set, in trace order.

    A set's list is cut into segments of ``span`` record numbers, which bounds the
    length of each array. ``first_pos`` is the number of the set's detections in
    earlier segments: positions count through, whatever the span.
    """
    earlier = Window.partitionBy("rw", "set_idx").orderBy("segment")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("bursts").cast("long")
    return (
        found.withColumn("segment", F.expr(f"center div {span}"))
        .groupBy("rw", "set_idx", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("center", "n_lines"))).alias("bursts"))
        .withColumn("first_pos", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    )


def representative(found: DataFrame) -> DataFrame:
    """The earliest linked burst of every set."""
    return found.groupBy("rw", "set_idx").agg(
        F.min_by("n_lines", "center").alias("n_lines"), F.min("center").alias("center")
    )


def detected_sets(found: DataFrame) -> DataFrame:
    """Sorted detected sets and their number, per kind with any detection."""
    return found.groupBy("rw").agg(
        F.sort_array(F.collect_set("set_idx")).alias("sets"),
        F.count_distinct("set_idx").alias("n_sets"),
    )


def verdict(found: DataFrame, scope: str | CacheProfile, mode: str | None = None) -> DataFrame:
    """One row per analysed kind, also when nothing was found."""
    profile = profile_of(scope)
    kinds = [(i, k, KIND_NAMES[k]) for i, k in enumerate(kinds_of(profile, mode))]
    wanted = found.sparkSession.createDataFrame(kinds, "pos int, k long, kind string")
    per_kind = (
        found.select(F.coalesce("rw", F.lit(FETCH)).alias("k"), "set_idx")
        .groupBy("k")
        .agg(F.count_distinct("set_idx").alias("hits"))
    )
    n_sets = F.coalesce("hits", F.lit(0).cast("long"))
    return wanted.join(per_kind, "k", "left").select(
        "kind", n_sets.alias("n_sets"), (n_sets > 0).alias("detected")
    )
