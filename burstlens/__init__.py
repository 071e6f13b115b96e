"""Cache-trace analytics on Spark: bursts, chains and suspicious cache sets."""

from burstlens.operators.bursts import burst_stats, qualifying, qualifying_bursts
from burstlens.operators.chains import detections, first_chains, link_bursts
from burstlens.operators.coords import (
    only_reads,
    only_writes,
    select_kinds,
    with_cache_coords,
)
from burstlens.operators.gaps import access_gaps, assign_bursts, prune_sets, set_histogram
from burstlens.operators.ordinal import with_ordinal
from burstlens.operators.translate import (
    decode_pagemap,
    explode_operands,
    instruction_fetches,
    translate,
)
from burstlens.plans.detect import (
    detect,
    detect_file,
    detected_sets,
    detections_by_set,
    pruning,
    representative,
    verdict,
)
from burstlens.plans.report import append_report, read_reports, report_lines, write_report
from burstlens.profiles import PROFILES, CacheProfile, profile_of, profile_table
from burstlens.sources.binary import read_trace, write_trace
from burstlens.sources.checkpoints import release_scratch

__all__ = [
    "PROFILES",
    "CacheProfile",
    "access_gaps",
    "append_report",
    "assign_bursts",
    "burst_stats",
    "decode_pagemap",
    "detect",
    "detect_file",
    "detected_sets",
    "detections",
    "detections_by_set",
    "explode_operands",
    "instruction_fetches",
    "first_chains",
    "link_bursts",
    "only_reads",
    "only_writes",
    "profile_of",
    "profile_table",
    "prune_sets",
    "pruning",
    "qualifying",
    "qualifying_bursts",
    "read_reports",
    "read_trace",
    "release_scratch",
    "report_lines",
    "representative",
    "select_kinds",
    "set_histogram",
    "translate",
    "verdict",
    "with_cache_coords",
    "with_ordinal",
    "write_report",
    "write_trace",
]
