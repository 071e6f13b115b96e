"""From instructions and virtual addresses to a physical trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.functions import (
    frame_number,
    is_present,
    is_swapped,
    page_number,
    physical_address,
)
from burstlens.operators.gaps import DEFAULT_CHUNK
from burstlens.profiles import READ, WRITE

# Page maps of up to this many entries are broadcast: about 50 MB as a hash table.
BROADCAST_ENTRIES = 1 << 19


def decode_pagemap(pagemap: DataFrame) -> DataFrame:
    """``(vpn, present, swapped, pfn)`` of page-map entries."""
    return pagemap.select(
        "vpn",
        is_present("entry").alias("present"),
        is_swapped("entry").alias("swapped"),
        frame_number("entry").alias("pfn"),
    )


def translate(
    trace: DataFrame,
    pagemap: DataFrame,
    page_size: int = 4096,
    chunk: int = DEFAULT_CHUNK,
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """``(rec_idx, rw, vaddr, paddr, swapped)`` of a trace of virtual addresses.

    The address is 0 where the page has no entry or is not present; a swapped page
    is translated and flagged. ``vpn`` must be unique in ``pagemap``.

    A map of at most ``broadcast_entries`` present pages (counted) is broadcast.
    Beyond that the map is first joined to the distinct pages of each chunk of the
    trace, and the trace to that: a page that takes a third of all accesses costs
    one row per chunk in the first join and at most ``chunk`` rows per key in the
    second.
    """
    pages = (
        decode_pagemap(pagemap).filter("present").select("vpn", "pfn", "swapped")
    )
    rows = trace.withColumn("vpn", page_number("vaddr", page_size))
    if pages.count() <= broadcast_entries:
        joined = rows.join(F.broadcast(pages), "vpn", "left")
    else:
        # Records without a number are spread over chunks of their own.
        spread = "-1 - pmod(xxhash64(vaddr), 4096)"
        rows = rows.withColumn("chunk", F.expr(f"coalesce(rec_idx div {chunk}, {spread})"))
        used = rows.select("chunk", "vpn").distinct().join(pages, "vpn")
        joined = rows.join(used, ["chunk", "vpn"], "left")
    paddr = physical_address("pfn", "vaddr", page_size)
    return joined.select(
        "rec_idx",
        "rw",
        "vaddr",
        F.coalesce(paddr, F.lit(0).cast("long")).alias("paddr"),
        F.coalesce("swapped", F.lit(False)).alias("swapped"),
    )


def instruction_fetches(instructions: DataFrame) -> DataFrame:
    """``(instr_id, rw, vaddr)``: one fetch, of its own address, per executed instruction."""
    return instructions.select("instr_id", F.lit(None).cast("long").alias("rw"), "vaddr")


def explode_operands(instructions: DataFrame) -> DataFrame:
    """One access per operand and direction; a read comes before a write.

    ``instructions``: ``instr_id`` and ``operands``, an array of structs
    ``(vaddr, is_read, is_written)``.
    """
    access = F.explode(
        F.filter(
            F.array(
                F.struct(F.lit(READ).cast("long").alias("rw"), F.col("op.is_read").alias("on")),
                F.struct(F.lit(WRITE).cast("long").alias("rw"), F.col("op.is_written").alias("on")),
            ),
            lambda a: a["on"],
        )
    )
    return (
        instructions.select("instr_id", F.posexplode("operands").alias("op_pos", "op"))
        .select("instr_id", F.col("op_pos").cast("long").alias("op_pos"), "op", access.alias("a"))
        .select("instr_id", "op_pos", F.col("a.rw").alias("rw"), F.col("op.vaddr").alias("vaddr"))
    )
