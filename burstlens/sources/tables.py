"""Traces, page maps and instructions shaped from ordinary tables.

They feed the registered queries and the benchmark: every record derives from a
row of the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.operators.ordinal import with_ordinal


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace with bursts in every set, one record per event."""
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id as rec_idx",
        "cast(if((event_id div 20) % 3 = 2, 0, 1) as bigint) as rw",
        """(user_id * 16 + event_id % 16) * 131072
           + if(event_type = 'error' and value < 4, user_id % 64,
                (event_id div 4000) % 2 * 16 + (event_id div 20) % 16) * 64
           + event_id % 64 as paddr""",
    )


def orders_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace without any burst: consecutive records fall into different sets."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as rec_idx",
        "o_orderkey % 2 as rw",
        "(o_custkey * 64 + o_orderkey % 64) * 64 as paddr",
    )


def part_pagemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page map with absent and swapped pages; every 37th entry is for a far page."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey + if(p_partkey % 37 = 36, 1099511627776, 0) as vpn",
        """(p_partkey * 7919) % 1048576
           | if(p_size % 25 = 0, 4611686018427387904, 0)
           | if(p_size % 10 <> 0, -9223372036854775808, 0) as entry""",
    )


def lineitem_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Virtual addresses, one per lineitem row; record numbers repeat."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as rec_idx",
        "cast(if(l_returnflag = 'R', 1, 0) as bigint) as rw",
        "l_partkey * 4096 + (l_suppkey * 64) % 4096 as vaddr",
    )


def lineitem_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered trace with bursts in sets all over a large cache, and broken chains.

    Blocks of 256 records have bursts of 32 in two sets, in turns, and come back to their
    sets 97 blocks later. Every fifth block has too few lines in its second half, every
    seventh has addresses beyond 2^63, and every eleventh has kinds that are not
    analysed; every 1000th record has no address.
    """
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    numbered = with_ordinal(rows, ["l_orderkey", "l_linenumber"])
    return numbered.selectExpr("rec_idx", "rec_idx div 256 as b").selectExpr(
        "rec_idx",
        "if(b % 11 = 10, 2, b % 2) as rw",
        """if(rec_idx % 1000 = 999, null,
              if(b % 7 = 6, -9223372036854775808, 0)
              | ((rec_idx % if(b % 5 = 4 and rec_idx div 128 % 2 = 1, 8, 32)) * 131072
                 + (b % 97 * 21 + b div 388 * 7 + rec_idx div 32 % 2 * 1024) % 2048 * 64))
           as paddr""",
    )


def part_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions with an address of their own and two memory operands each."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("instr_id"),
        F.expr("p_partkey * 4096 + p_size * 4").alias("vaddr"),
        F.expr(
            """array(
                 named_struct('vaddr', p_partkey * 4096,
                              'is_read', p_size % 2 = 0, 'is_written', p_size % 3 = 0),
                 named_struct('vaddr', p_partkey * 4096 + p_size * 64,
                              'is_read', p_size % 5 <> 0, 'is_written', p_size % 7 = 0))"""
        ).alias("operands"),
    )


def lineitem_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction per lineitem row; those of four orders read the same cache set."""
    return _table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("instr_id"),
        F.expr("l_suppkey * 4096 + l_linenumber * 4").alias("vaddr"),
        F.expr(
            """array(named_struct('vaddr', l_partkey * 4096 + l_orderkey div 4 % 64 * 64,
                                  'is_read', true, 'is_written', l_linenumber = 7))"""
        ).alias("operands"),
    )
