"""Bit-field functions on addresses and page-map entries.

Addresses are unsigned 64-bit values held in a LONG, so every right shift is
a logical one and no arithmetic that could overflow is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstlens.profiles import CacheProfile

# Layout of a page-map entry. Bit 63 is the sign of the LONG.
SWAPPED_BIT = 62
FRAME_BITS = 55


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def set_index(paddr: Column | str, profile: CacheProfile) -> Column:
    """Cache set of an address: plain address bits above the line offset."""
    line = F.shiftrightunsigned(_col(paddr), profile.line_bits)
    return line.bitwiseAND(F.lit(profile.set_mask).cast("long"))


def line_tag(paddr: Column | str, profile: CacheProfile, exact: bool = False) -> Column:
    """Line tag of an address.

    The default shift is by the bytes of one set, which merges or splits some
    lines; ``exact=True`` shifts by the width of the set field instead.
    """
    shift = profile.exact_tag_shift if exact else profile.tag_shift
    return F.shiftrightunsigned(_col(paddr), shift)


def is_present(entry: Column | str) -> Column:
    return _col(entry) < 0


def is_swapped(entry: Column | str) -> Column:
    return _col(entry).bitwiseAND(F.lit(1 << SWAPPED_BIT)) != 0


def frame_number(entry: Column | str) -> Column:
    return _col(entry).bitwiseAND(F.lit((1 << FRAME_BITS) - 1))


def _page_bits(page_size: int) -> int:
    if page_size < 1 or page_size & (page_size - 1):
        raise ValueError(f"page_size must be a power of two, got {page_size}")
    return page_size.bit_length() - 1


def page_number(vaddr: Column | str, page_size: int) -> Column:
    return F.shiftrightunsigned(_col(vaddr), _page_bits(page_size))


def physical_address(frame: Column | str, vaddr: Column | str, page_size: int) -> Column:
    """``frame * page_size + vaddr % page_size`` with unsigned wrap-around."""
    offset = _col(vaddr).bitwiseAND(F.lit(page_size - 1).cast("long"))
    return F.shiftleft(_col(frame), _page_bits(page_size)).bitwiseOR(offset)
