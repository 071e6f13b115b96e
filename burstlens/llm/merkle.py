"""Merkle tree over a table: a manifest whose root changes with any row, and proofs of rows.

Every row has a digest, its leaf. The leaves of a group, in order, are the lowest level of
the group's tree: every ``arity`` consecutive nodes of a level, fewer at its end, become
one node, until one is left. The roots of the groups, in order, are the leaves of a last
tree. All of it is column functions and windows.

A level is not a table of its own. Rows stay where they are, and a node's digest is
held by the row of its first leaf: nodes of level ``k`` are ``arity ** k`` rows apart, so lags and
leads of that fixed offset, masked by the node's place in its run and the run's length,
are its siblings. The rows of first children hash the parents. Afterwards every row takes the
siblings of its ancestors from the nearest such row above it.

``LEVELS`` levels are built in blocks of ``arity ** LEVELS`` rows, one window partition each, however
large a group is; the roots of blocks are the rows of the next round. Each round is written
to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlens.llm.places import written
from burstlens.operators.ordinal import with_ordinal

# Levels of a round: blocks of 4096 rows with two children per node.
LEVELS = 12
# A table of upper nodes with more rows than this is joined by a shuffle; a row has two
# digests or fewer for each level, so about 4 kB at most.
BROADCAST_ROWS = 8192
_STEP = "struct<before: string, after: string>"


def _sha(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order: ``-`` for a null, else byte count, ``:`` and value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        size = F.octet_length(text).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-")))
    return _sha(F.concat(*parts))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level, left to right."""
    siblings = F.transform(proof, lambda s: F.concat(s["before"], s["after"]))
    return _sha(F.array_join(siblings, ""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(
        proof, leaf, lambda node, s: _sha(F.concat(s["before"], node, s["after"]))
    )


def _round(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``steps``, their proofs inside the block, and ``top``, the block's root.

    ``nodes``: ``tree``, ``pos`` (0, 1, ... in the tree), ``digest``, and ``total``, the
    nodes of the tree. Only the first row of a block has a ``top``.
    """
    span = arity**LEVELS
    over = Window.partitionBy("tree", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.expr(f"pos div {span}")).withColumn("top", F.col("digest"))
    nothing = F.lit("")
    for level in range(LEVELS):
        width = arity**level
        # Nodes of this level in the tree, and this row's place among its siblings.
        slot = F.expr(f"pos div {width} % {arity}")
        run = F.expr(
            f"least({arity}L, (total + {width - 1}) div {width} - pos div {width * arity} * {arity})"
        )
        is_node = F.expr(f"total > {width} and pos % {width} = 0")
        before = [
            F.when(slot >= j, F.lag("top", j * width).over(over)).otherwise(nothing)
            for j in range(arity - 1, 0, -1)
        ]
        after = [
            F.when(slot + j < run, F.lead("top", j * width).over(over)).otherwise(nothing)
            for j in range(1, arity)
        ]
        step = F.struct(F.concat(*before).alias("before"), F.concat(*after).alias("after"))
        rows = rows.withColumn(f"step{level}", F.when(is_node, step))
        parent = _sha(F.concat("top", F.col(f"step{level}.after")))
        # Where one node is left, it is the root already.
        rows = rows.withColumn(
            "top",
            F.when(F.col("total") <= width, F.col("top")).when(is_node & (slot == 0), parent),
        )
    above = over.rowsBetween(Window.unboundedPreceding, 0)
    steps = [F.last(f"step{k}", ignorenulls=True).over(above) for k in range(LEVELS)]
    found = F.array_compact(F.array(*steps)).cast(f"array<{_STEP}>")
    names = [c for c in nodes.columns if c != "steps"]
    return rows.select(*names, "block", F.when(F.expr(f"pos % {span} = 0"), F.col("top")).alias("top"),
                       found.alias("steps"))


def _tree_rounds(nodes: DataFrame, largest: int, arity: int) -> list[DataFrame]:
    """Rounds until every tree has one node; ``largest``: the nodes of the largest tree."""
    rounds = [written(_round(nodes, arity), "merkle")]
    span = arity**LEVELS
    while largest > span:
        largest = -(-largest // span)
        tops = rounds[-1].filter("top is not null").selectExpr(
            "tree", "block as pos", "top as digest", f"(total + {span - 1}) div {span} as total"
        )
        rounds.append(written(_round(tops, arity), "merkle"))
    return rounds


def _joined(rows: DataFrame, upper: DataFrame, on: Column) -> DataFrame:
    if upper.count() <= BROADCAST_ROWS:
        upper = F.broadcast(upper)
    return rows.join(upper, on)


def _under(rows: DataFrame, upper: DataFrame) -> DataFrame:
    """``rows`` of a round with the steps and roots of the round above."""
    on = (F.col("tree") == F.col("u_tree")) & (F.col("block") == F.col("u_pos"))
    renamed = upper.select(
        F.col("tree").alias("u_tree"), F.col("pos").alias("u_pos"),
        F.col("steps").alias("u_steps"), F.col("apex"),
    )
    steps = F.concat("steps", "u_steps").alias("steps")
    kept = [c for c in rows.columns if c not in ("steps", "top")]
    return _joined(rows, renamed, on).select(*kept, steps, "apex")


def _with_apex(rounds: list[DataFrame]) -> DataFrame:
    """Rows of the first round with ``apex``, their tree's root, and all ``steps`` to it."""
    upper = rounds[-1]
    roots = upper.filter("top is not null").selectExpr("tree as r_tree", "top as apex")
    upper = _joined(upper, roots, F.col("tree") == F.col("r_tree")).drop("r_tree", "top")
    return reduce(lambda above, rows: _under(rows, above), reversed(rounds[:-1]), upper)


def with_proofs(
    leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", arity: int = 2
) -> DataFrame:
    """Adds ``subroot`` (of the row's group), ``root`` and ``proof`` to rows with leaves.

    ``proof`` is an array, from the lowest level to the root: for each level the digests
    ``before`` and ``after`` the row's ancestor in its run, joined. Rows are ordered by ``order`` and
    then by leaf, nulls first; rows equal in all of these are interchangeable. Groups are
    ordered by value, a null first: a group of its own. A lone row is its group's root, a lone
    group's root the root. No rows give no rows. All columns are passed on (pass narrow
    rows: they are shuffled); those with the names of new columns are replaced.
    """
    new = ("subroot", "root", "proof")
    kept = [c for c in leaves.columns if c.lower() not in new]
    names = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = leaves.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    by = names[group]
    first = [F.col(c).asc_nulls_first() for c in (by, *(names[o] for o in order), names[leaf])]
    numbered = written(with_ordinal(rows, first, "ordinal"), "merkle")
    sizes = numbered.groupBy(by).agg(F.min("ordinal").alias("start"), F.count("*").alias("total"))
    groups = written(
        with_ordinal(sizes.withColumnRenamed(by, "value"), [F.col("value").asc_nulls_first()], "tree"),
        "merkle",
    )
    largest, n_groups = groups.agg(F.max("total"), F.count("*")).first()
    own = _joined(numbered, groups, F.col(by).eqNullSafe(F.col("value")))
    nodes = own.select(
        *names.values(), "tree", (F.col("ordinal") - F.col("start")).alias("pos"),
        F.col(names[leaf]).alias("digest"), "total",
    )
    low = _with_apex(_tree_rounds(nodes, largest or 0, arity))
    subroots = low.filter("pos = 0").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("apex").alias("digest"),
        F.lit(n_groups).cast("long").alias("total"),
    )
    high = _with_apex(_tree_rounds(subroots, n_groups, arity)).select(
        F.col("pos").alias("g_tree"), F.col("digest").alias("subroot"),
        F.col("apex").alias("root"), F.col("steps").alias("g_steps"),
    )
    high = written(high, "merkle")
    return _joined(low, high, F.col("tree") == F.col("g_tree")).select(
        *(F.col(n).alias(c) for c, n in names.items()),
        "subroot", "root", F.concat("steps", "g_steps").alias("proof"),
    )
