"""Column functions."""

from burstlens.functions.address import (
    frame_number,
    is_present,
    is_swapped,
    line_tag,
    page_number,
    physical_address,
    set_index,
)

__all__ = [
    "frame_number",
    "is_present",
    "is_swapped",
    "line_tag",
    "page_number",
    "physical_address",
    "set_index",
]
