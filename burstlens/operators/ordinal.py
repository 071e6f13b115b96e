"""Consecutive record numbers for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlens.sources.checkpoints import shared_dir

# monotonically_increasing_id keeps the row number in its low 33 bits.
_ROW_BITS = 33


def with_ordinal(
    df: DataFrame, order_cols: list[str | Column], name: str = "rec_idx"
) -> DataFrame:
    """Adds 0-based row numbers in the order of ``order_cols``.

    The columns should identify a row: the order of equal rows is arbitrary, and
    rows that are equal in all of them end up in one partition.

    A range shuffle puts the rows in order; the number of a row is its position in
    its partition plus the sizes of the partitions before. Since a range shuffle is
    sampled, both must come from the same run: it is checkpointed.
    """
    shared_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1))
        .checkpoint()
    )
    # One row per partition, so one window over all of them is small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return placed.join(F.broadcast(bases), "_part").select(
        (F.col("_base") + F.col("_pos")).alias(name), *df.columns
    )
