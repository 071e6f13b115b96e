"""Shared folders of a session, for tables that cut a lineage and for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burstlens.sources.checkpoints import scratch_dir
from burstlens.workers import ship_code


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder, which outlives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes of rows that Spark hands to a Python worker at a time.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send this package's code along, and bound what a worker gets at a time.

    The bound is a setting of the session; a lower one is left as it is.
    """
    ship_code()
    now = spark.conf.get(_BATCH_SETTING, "64m").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(now[:-1]) * units[now[-1]] if now[-1:] in units else int(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def added(docs: DataFrame, new: dict[str, str]) -> tuple[DataFrame, StructType]:
    """``docs`` without columns of the new names, and the schema with them at the end.

    Names are compared as Spark does, without regard to case.
    """
    names = {name.lower() for name in new}
    plain = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in names))
    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in new.items()))
    return plain, StructType([*plain.schema.fields, *more.fields])


def hash_share(key: Column, share: float | Column) -> Column:
    """Whether a 64-bit hash is in the lowest ``share`` (0 to 1) of its range, which may be as small as 2^-53."""
    share = F.lit(share) if isinstance(share, float) else share
    return F.shiftrightunsigned(key, 11) < F.floor(share * F.lit(float(1 << 53)))
