"""Shards with the mixture of the whole: proportional stratified interleaving.

Rows are put into a seeded random order within each source; the i-th of the n rows of a
source gets the fractional rank (i + 1/2) / n. Sorted by that rank, every stretch of
the result has the sources in their overall proportions, and cutting it into equal
stretches gives shards whose sizes differ by one row at most.

Neither order is made by one task per source or for all rows. Random keys are cut into
ranges that hold about ``GROUP_ROWS`` rows each, and so are fractional ranks, which are
spread evenly by construction. Windows run inside these ranges; the numbers of rows
before each range come from counting them. So a source with a third of all rows is
as many groups as it needs. Only the named columns are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstlens.llm.places import written

# Rows of a range on average, for the largest source and for fractional ranks.
GROUP_ROWS = 4000
KEY_BITS = 60


def shuffle_key(seed: int, *columns: str):
    """A random 60-bit number that depends on the seed and the columns' values."""
    values = (F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns)
    text = F.concat_ws(":", F.lit(str(seed)), *values)
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _before(rows: DataFrame, keys: list[str], over) -> DataFrame:
    """``keys`` and the number of rows in earlier groups."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def shard_by_mixture(
    rows: DataFrame,
    n_shards: int = 16,
    id_column: str = "doc_id",
    source: str = "source",
    seed: int = 20,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Adds ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, 0, 1, ... in each shard).

    Pass the columns that are wanted: all of them are shuffled, and break ties (they
    must be sortable). Columns of ``rows`` called ``shard`` or ``slot`` are replaced. A
    null source is a source of its own; null ids are rows like others. Rows that are
    equal in all columns each get a place of their own. No rows give no shards; with fewer
    rows than shards, some shards are empty. The result depends on the rows and the
    seed only, not on their order or partitions.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    total = rows.count()
    groups = max(1, -(-total // group_rows))
    names = [f"_c{i}" for i in range(len(kept))]
    named = rows.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        F.col(source).isNull().alias("_none"),
        shuffle_key(seed, id_column).alias("_key"),
    ).withColumn("_range", F.floor(F.col("_key") / F.lit((1 << KEY_BITS) // groups + 1)))
    stratum = ["_source", "_none"]
    in_source = Window.partitionBy(*stratum).orderBy("_range")
    before = _before(named, [*stratum, "_range"], in_source)
    sizes = named.groupBy(*stratum).agg(F.count("*").alias("_size"))
    in_range = Window.partitionBy(*stratum, "_range").orderBy("_key", *names)
    ranked = (
        named.join(before.join(sizes, stratum), [*stratum, "_range"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(in_range) - 1)
        .withColumn("_share", (F.col("_rank") + F.lit(0.5)) / F.col("_size"))
        .select(*names, *stratum, "_key", "_share")
        .withColumn("_stretch", F.floor(F.col("_share") * F.lit(groups)))
    )
    # Read twice below, so the texts behind it would be read twice as well.
    ranked = written(ranked, "ranked")
    order = Window.partitionBy("_stretch").orderBy("_share", *stratum, "_key", *names)
    place = F.col("_before") + F.row_number().over(order) - 1
    # Whole-number arithmetic: the shard of a place, and the first place of a shard.
    shard = F.expr(f"(_place * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return (
        ranked.join(_before(ranked, ["_stretch"], Window.orderBy("_stretch")), "_stretch")
        .withColumn("_place", place)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("_place") - first)
        .select(
            *(F.col(n).alias(c) for n, c in zip(names, kept, strict=True)),
            F.col("shard").cast("int").alias("shard"),
            "slot",
        )
    )
