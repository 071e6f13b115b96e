"""Bursts: runs of accesses to one set with small gaps, and their statistics.

Chunked plan, for a trace of any size and any skew over sets:

1. One shuffle of the trace by cell, that is chunk, set and kind; at most ``chunk``
   rows share a key. Inside it, accesses are cut into fragments and each fragment is
   aggregated, all in one stage.
2. Only a fragment that comes within ``intra`` of its chunk's border can go on in
   the next chunk: at most two per chunk and set. These are stitched by a window
   over the set; all other fragments are final and keep to their own chunk.
3. The few bursts made of several fragments get their distinct tags from a join
   of their extents with the accesses of step 1 and a two-step distinct count, so no tag
   list is ever held.

Where only qualifying bursts are wanted, step 1 drops hopeless accesses and stores one row
per fragment and tag. Steps 2 and 3 read that table: the trace is shuffled and sorted
once, and nothing of its size is shuffled again. Without that table, steps 2 and 3 share
the exchange of step 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.operators.gaps import DEFAULT_CHUNK
from burstlens.profiles import FETCH, READ, WRITE, CacheProfile
from burstlens.sources.checkpoints import stored

# Kinds are numbered from FETCH on.
_KINDS = 3
# Parts of window expressions.
_UP_TO_NOW = "rows unbounded preceding"
_IN_CELL = "over (partition by cell order by rec_idx"


def _rows(coords: DataFrame, profile: CacheProfile, chunk: int) -> DataFrame:
    """The trace as shuffled: chunk, set and kind packed into ``cell``.

    ``cell`` is a computed, non-null column on purpose. A nullable key, or a plain
    copy of a column, would let the join of step 3 change this projection (null
    filters, dropped aliases) and the two uses could no longer share one exchange.
    """
    kind = f"(coalesce(rw, {FETCH}) - {FETCH})"
    cell = f"(rec_idx div {chunk}) * {_lanes(profile)} + set_idx * {_KINDS} + {kind}"
    # Records without a number or an address are in no set, so in no burst.
    known = coords.filter("rec_idx is not null and set_idx is not null")
    return known.filter(f"coalesce(rw, {FETCH}) in ({FETCH}, {WRITE}, {READ})").selectExpr(
        f"coalesce({cell}, 0L) as cell", "rec_idx", "tag"
    )


def _lanes(profile: CacheProfile) -> int:
    """Pairs of set and kind; a cell is ``chunk number * lanes + lane``."""
    return profile.n_sets * _KINDS


# In a burst of m accesses every access has at least m // 2 others on one side, so its
# (m // 2)-th neighbour on that side is at most m // 2 * (intra - 1) away. A neighbour
# outside the chunk counts as if it sat right at the border. Bursts large enough stay whole;
# what is left of others stays too small to qualify, and as it only loses accesses, it comes
# no nearer to its neighbours.
_DENSE_TAGS = """
WITH near AS (
    SELECT *, if(rec_idx - lag(rec_idx) OVER cells < {intra}, NULL, rec_idx) AS start,
           coalesce(rec_idx - lag(rec_idx, {k}) OVER cells, rec_idx % {chunk} + 1) AS before,
           coalesce((lead(rec_idx, {k}) OVER cells) - rec_idx, {chunk} - rec_idx % {chunk}) AS after
    FROM {{rows}} WINDOW cells AS (PARTITION BY cell ORDER BY rec_idx)),
  marked AS (
    SELECT *, max(start) OVER (PARTITION BY cell ORDER BY rec_idx ROWS UNBOUNDED PRECEDING) AS first
    FROM near)
SELECT cell, first, tag, max(rec_idx) AS last, count(*) AS n, sum(rec_idx % {chunk}) AS offsets
FROM marked WHERE before <= {reach} OR after <= {reach}
GROUP BY cell, first, tag"""


def _dense_tags(rows: DataFrame, profile: CacheProfile, chunk: int) -> DataFrame:
    """One row per fragment and tag, without rows that can't be part of a qualifying burst."""
    k = max(profile.assoc, 2) // 2
    text = _DENSE_TAGS.format(
        intra=profile.intra, k=k, chunk=chunk, reach=k * (profile.intra - 1)
    )
    return rows.sparkSession.sql(text, rows=rows)


# Stitches fragments and counts the tags of what spans chunks; one statement, as many
# small steps would each be analysed again.
#
# ``strand`` is what windows run over. A fragment near a chunk border may go on beyond it:
# such open fragments share the strand of their lane, while a closed fragment stays in the
# strand of its cell. A stitched burst's ``tags`` are their number if the burst is one
# fragment, else a number that it can't exceed. Record numbers of a whole burst can add up
# beyond a LONG. All accesses of a lane inside a burst's extent are the burst's, in every
# chunk of it. The conditions on the accesses are in a form that adds no filter on their side,
# which would keep an exchange from being shared.
_BURSTS = """
WITH strands AS (
    SELECT if({is_open}, -1 - cell % {lanes}, cell) AS strand, first, last, n, tags,
           cast(cast(first - first % {chunk} AS decimal(19, 0)) * cast(n AS decimal(18, 0))
                + offsets AS decimal(38, 0)) AS positions
    FROM {{frags}} WHERE {wanted}),
  cuts AS (
    SELECT *, if(first - lag(last) OVER (PARTITION BY strand ORDER BY first) < {intra}, NULL, first)
              AS start
    FROM strands),
  linked AS (
    SELECT *, max(start) OVER (PARTITION BY strand ORDER BY first ROWS UNBOUNDED PRECEDING)
              AS burst_first
    FROM cuts),
  stitched AS (
    SELECT if(strand < 0, -1 - strand, strand % {lanes}) AS lane, burst_first,
           max(last) AS burst_last, count(*) AS frags, sum(n) AS n, sum(positions) AS positions,
           sum(tags) AS tags
    FROM linked GROUP BY strand, burst_first HAVING {qualified}),
  parts AS (
    SELECT lane, burst_first, burst_last, n, positions, part * {lanes} + lane AS cell
    FROM stitched
    LATERAL VIEW explode(sequence(burst_first div {chunk}, burst_last div {chunk})) AS part
    WHERE frags > 1),
  spanning AS (
    SELECT lane, burst_first, burst_last, n, positions, count(DISTINCT tag) AS n_lines
    FROM {{accesses}} JOIN parts USING (cell)
    WHERE coalesce(from, -1) >= burst_first AND coalesce(to, -1) <= burst_last
    GROUP BY lane, burst_first, burst_last, n, positions),
  found AS (
    -- A single access makes no pair and so counts no line.
    SELECT lane, burst_first, burst_last, n, positions, if(n > 1, tags, 0L) AS n_lines
    FROM stitched WHERE frags = 1
    UNION ALL SELECT * FROM spanning)
SELECT lane % {kinds} + {fetch}L AS rw, lane div {kinds} AS set_idx, n_lines,
       cast(positions div n AS bigint) AS center, n AS n_access,
       burst_first AS first_idx, burst_last AS last_idx
FROM found WHERE n_lines >= {least}"""


def _bursts(
    frags: DataFrame, accesses: DataFrame, profile: CacheProfile, chunk: int, least: int = 0
) -> DataFrame:
    """Bursts of at least ``least`` lines from their fragments.

    ``accesses (cell, tag, from, to)`` says what tags there are, and where.
    """
    near_border = f"(first % {chunk} < {profile.intra - 1} or last % {chunk} > {chunk - profile.intra})"
    text = _BURSTS.format(
        is_open=near_border,
        wanted=f"{near_border} or (n > 1 and tags >= {least})" if least else "true",
        qualified=f"sum(n) > 1 and sum(tags) >= {least}" if least else "true",
        lanes=_lanes(profile),
        chunk=chunk,
        intra=profile.intra,
        kinds=_KINDS,
        fetch=FETCH,
        least=least,
    )
    return frags.sparkSession.sql(text, frags=frags, accesses=accesses)


def _check(chunk: int) -> None:
    if chunk < 1:
        raise ValueError("chunk must be positive")


def burst_stats(
    coords: DataFrame, profile: CacheProfile, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Every burst: distinct lines, centre, accesses and extent.

    The centre is the floor of the mean record number. ``chunk`` changes the
    distribution of the work, never the result.
    """
    _check(chunk)
    rows = _rows(coords, profile, chunk)
    start = f"if(rec_idx - lag(rec_idx) {_IN_CELL}) < {profile.intra}, null, rec_idx) as start"
    marked = rows.selectExpr("*", start).selectExpr(
        "*", f"max(start) {_IN_CELL} {_UP_TO_NOW}) as first"
    )
    frags = marked.groupBy("cell", "first").agg(
        F.expr("max(rec_idx) as last"),
        F.expr("count(*) as n"),
        F.expr(f"sum(rec_idx % {chunk}) as offsets"),
        F.expr("count(distinct tag) as tags"),
    )
    accesses = rows.selectExpr("cell", "tag", "rec_idx as from", "rec_idx as to")
    return _bursts(frags, accesses, profile, chunk)


def qualifying(bursts: DataFrame, profile: CacheProfile) -> DataFrame:
    """Keep the bursts that touch at least ``assoc`` distinct lines."""
    return bursts.filter(F.col("n_lines") >= profile.assoc)


def qualifying_bursts(
    coords: DataFrame, profile: CacheProfile, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """``qualifying(burst_stats(...))``, dropping hopeless accesses before aggregating.

    The tags of what is left are stored in the shared space when this is called.
    """
    _check(chunk)
    tags = stored(_dense_tags(_rows(coords, profile, chunk), profile, chunk), "tags")
    frags = tags.groupBy("cell", "first").agg(
        F.expr("max(last) as last"),
        F.expr("sum(n) as n"),
        F.expr("sum(offsets) as offsets"),
        F.expr("count(*) as tags"),
    )
    accesses = tags.selectExpr("cell", "tag", "first as from", "last as to")
    return _bursts(frags, accesses, profile, chunk, least=profile.assoc)
