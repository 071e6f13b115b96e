"""Which accesses of a gap-free piece of a trace can matter to an analysis.

A helper of the binary reader, which sees a trace in record order before any shuffle.
It only ever drops accesses that cannot be part of a qualifying burst; everything else
is decided by the DataFrame operators.
"""

from __future__ import annotations

import numpy as np


def candidate_mask(idx, rw, paddr, lo: int, hi: int, rule: dict):
    """Mask over the accesses ``idx``, all records of [lo, hi) in order.

    Accesses of the wanted kinds are grouped into runs as bursts are. A run is kept
    if it has enough accesses and tags, or if it comes so close to either end of
    the piece that it may go on outside. ``rule`` is made by ``plans.detect.pruning``.
    """
    mask = np.zeros(len(idx), dtype=bool)
    key = (paddr >> np.uint64(rule["line_bits"])) & np.uint64(rule["set_mask"])
    wanted = slice(None)
    if rule["kinds"] is not None:
        wanted = np.flatnonzero(np.isin(rw, np.array(rule["kinds"], dtype=rw.dtype)))
        key = (key[wanted] << np.uint64(1)) | rw[wanted].astype(np.uint64)
    if not len(key):
        return mask
    # Sets and kind fit 16 bits on common caches, which sort much faster.
    if rule["set_mask"] < 1 << 15:
        key = key.astype(np.uint16)

    order = np.argsort(key, kind="stable")
    k, i = key[order], idx[wanted][order]
    new_run = np.ones(len(i), dtype=bool)
    new_run[1:] = (k[1:] != k[:-1]) | (i[1:] - i[:-1] >= rule["intra"])
    start = np.flatnonzero(new_run)
    length = np.diff(np.append(start, len(i)))
    at_edge = (i[start] - lo < rule["intra"] - 1) | (hi - i[start + length - 1] < rule["intra"])
    keep = at_edge | (length >= rule["min_len"])

    # Count the tags of the long inner runs.
    run = np.repeat(np.arange(len(start)), length)
    inner = (keep & ~at_edge)[run]
    r = run[inner]
    t = (paddr[wanted][order][inner]) >> np.uint64(rule["tag_shift"])
    by_tag = np.lexsort((t, r))
    r, t = r[by_tag], t[by_tag]
    first_seen = np.ones(len(r), dtype=bool)
    first_seen[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    tags = np.bincount(r[first_seen], minlength=len(start))
    keep &= at_edge | (tags >= rule["min_tags"])

    kept = order[keep[run]]
    mask[kept if isinstance(wanted, slice) else wanted[kept]] = True
    return mask
