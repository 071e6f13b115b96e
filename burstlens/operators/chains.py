"""Linking bursts of a set that follow each other closely, and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.operators.gaps import DEFAULT_CHUNK, per_set_table
from burstlens.profiles import CacheProfile
from burstlens.sources.checkpoints import stored

_TILE_KEYS = ["rw", "set_idx", "tile"]


# Tiles whose chain states are combined in one task.
_TILES = 64
# The chain state of a run of bursts: centres of its ``first`` and ``last`` one, the length
# ``n`` of its first chain, and its ``cut``, the centre of the burst that breaks that chain
# (NULL: none does). Those of two adjacent runs make the state of both, however runs are
# grouped, so the bursts of a set can be combined in as many steps as their number needs.
_COMBINED = """aggregate(
    sort_array(collect_list(state)),
    named_struct('first', 0L, 'last', 0L, 'n', 0L, 'cut', cast(NULL AS bigint)),
    (a, b) -> CASE
        WHEN a.n = 0 THEN b
        WHEN a.cut IS NOT NULL
            THEN named_struct('first', a.first, 'last', b.last, 'n', a.n, 'cut', a.cut)
        WHEN b.first - a.last > {inter}
            THEN named_struct('first', a.first, 'last', b.last, 'n', a.n, 'cut', b.first)
        ELSE named_struct('first', a.first, 'last', b.last, 'n', a.n + b.n, 'cut', b.cut) END)
    AS state"""
_CHAINS = """
WITH single AS (
    SELECT /*+ REPARTITION(rw, set_idx, region) */ *
    FROM (SELECT rw, set_idx, center div {chunk} AS tile, center div {chunk} div {tiles} AS region,
                 named_struct('first', center, 'last', center, 'n', 1L,
                              'cut', cast(NULL AS bigint)) AS state
          FROM {{bursts}})),
  tiles AS (
    SELECT rw, set_idx, region, {combined} FROM single GROUP BY rw, set_idx, region, tile),
  regions AS (
    SELECT rw, set_idx, {combined} FROM tiles GROUP BY rw, set_idx, region),
  sets AS (SELECT rw, set_idx, {combined} FROM regions GROUP BY rw, set_idx)
SELECT rw, set_idx, state.cut AS chain_end, state.n AS chain_len FROM sets"""


def _chains_sql(inter: int, chunk: int) -> str:
    combined = _COMBINED.format(inter=inter)
    return _CHAINS.format(chunk=chunk, tiles=_TILES, combined=combined)


def first_chains(bursts: DataFrame, inter: int, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Length of the first chain of every set and kind, and where it ends.

    The first chain runs until the first burst that lies more than ``inter`` after
    its predecessor; ``chain_end`` is that burst's centre, NULL if there is none.
    Bursts are combined to one state per tile of ``chunk`` records, tiles to one per
    region of ``_TILES``, and only regions are gathered by set.
    """
    return bursts.sparkSession.sql(_chains_sql(inter, chunk), bursts=bursts)


def _with_neighbours(bursts: DataFrame, chunk: int) -> DataFrame:
    """Bursts with the centres of their set's previous and next burst."""
    in_tile = "over (partition by rw, set_idx, tile order by center)"
    in_set = "over (partition by rw, set_idx order by tile)"
    tiled = bursts.selectExpr("*", f"center div {chunk} as tile")
    edges = (
        tiled.groupBy(*_TILE_KEYS)
        .agg(F.expr("min(center) as low"), F.expr("max(center) as high"))
        .selectExpr(
            *_TILE_KEYS, f"lag(high) {in_set} as tile_prev", f"lead(low) {in_set} as tile_next"
        )
    )
    return (
        tiled.selectExpr(
            "*", f"lag(center) {in_tile} as in_prev", f"lead(center) {in_tile} as in_next"
        )
        .join(edges, _TILE_KEYS)
        .selectExpr(
            *bursts.columns,
            "coalesce(in_prev, tile_prev) as prev",
            "coalesce(in_next, tile_next) as next",
        )
    )


def link_bursts(
    bursts: DataFrame,
    profile: CacheProfile,
    all_chains: bool = False,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Bursts that follow another one of their set within ``inter``.

    By default only the first chain of a set counts, and only if it has at least
    two bursts; ``all_chains=True`` takes every such chain. Without ``inter`` all
    bursts are returned.
    """
    if profile.inter is None:
        return bursts
    if all_chains:
        bursts = stored(bursts, "bursts")
        near = f"center - prev <= {profile.inter} or next - center <= {profile.inter}"
        neighbours = _with_neighbours(bursts, chunk)
        return neighbours.filter(near).select(*bursts.columns)
    return _members(bursts, profile, 2, chunk)


def _members(bursts: DataFrame, profile: CacheProfile, min_len: int, chunk: int) -> DataFrame:
    """Bursts of first chains of at least ``min_len``; bursts are computed once and stored."""
    bursts = stored(bursts, "bursts")
    chains = per_set_table(first_chains(bursts, profile.inter, chunk), profile)
    in_chain = f"chain_len >= {min_len} and (chain_end is null or center < chain_end)"
    return bursts.join(chains, ["rw", "set_idx"]).filter(in_chain).drop("chain_end", "chain_len")


def detections(
    bursts: DataFrame,
    profile: CacheProfile,
    num_pp: int = 1,
    all_chains: bool = False,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Linked bursts of the sets that have more than ``num_pp`` of them."""
    if profile.inter is not None and not all_chains:
        return _members(bursts, profile, max(2, num_pp + 1), chunk)
    linked = link_bursts(bursts, profile, all_chains, chunk)
    enough = (
        linked.groupBy("rw", "set_idx")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > num_pp)
        .select("rw", "set_idx")
    )
    return linked.join(per_set_table(enough, profile), ["rw", "set_idx"], "left_semi").select(
        *linked.columns
    )
