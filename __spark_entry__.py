"""Registered queries and their DuckDB equivalents.

``entry`` is the flagship query on the smallest tables, ``queries`` has one entry
per operator, ``oracle_sql`` states each of them once more in plain SQL.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import burstlens as bl  # noqa: E402
from burstlens.sources import tables  # noqa: E402
from burstlens.sources.checkpoints import scratch_dir  # noqa: E402



def _optional(absent: ImportError) -> bool:
    """Whether an absent module belongs to the training-text part or to what only that needs."""
    name = absent.name or ""
    return name in ("corpus_pipeline", "public_tokenizers") or name.startswith("burstlens.llm")


try:  # the operators for training text are an optional part
    from burstlens.llm import queries as training_text
except ImportError as absent:
    if not _optional(absent):
        raise
    training_text = None
try:
    import corpus_pipeline
except ImportError as absent:
    if not _optional(absent):
        raise
    corpus_pipeline = None

L1D, L1I, LLC = bl.PROFILES["L1D"], bl.PROFILES["L1I"], bl.PROFILES["LLC"]
# Chunk size of the *_chunked queries: small, and no divisor of the traces' periods,
# so that many bursts cross a chunk border even on small tables.
SMALL_CHUNK = 997


def entry(spark: SparkSession) -> DataFrame:
    """Suspicious L1 data-cache sets of the events trace, reads and writes."""
    return bl.detect(tables.events_trace(spark, "/root/testdata/sf0.001"), "L1D", "BOTH")


# --------------------------------------------------------------------------- queries


def _trace(spark, d) -> DataFrame:
    return tables.events_trace(spark, d)


def _coords(spark, d, profile, exact=False) -> DataFrame:
    return bl.with_cache_coords(_trace(spark, d), profile, exact)


def _detect(scope, mode, **options):
    return lambda spark, d: bl.detect(_trace(spark, d), scope, mode, **options)


def _written(spark, d, kind) -> str:
    """The events trace as binary files in a new folder of the shared space."""
    path = scratch_dir(spark, "trace")
    bl.write_trace(_trace(spark, d), path, kind)
    return path


def _two_files(spark, d) -> DataFrame:
    """A trace in four files, and a second one after it."""
    first, second = scratch_dir(spark, "trace"), scratch_dir(spark, "trace")
    bl.write_trace(_trace(spark, d), first, "data", partitions=4)
    bl.write_trace(tables.orders_trace(spark, d), second, "data", partitions=2)
    return bl.read_trace(spark, [first, f"{second}/part-*.bin"])


def _lineitem(spark, d) -> DataFrame:
    return tables.lineitem_trace(spark, d)


def _numbered_fetches(spark, d) -> DataFrame:
    """Instructions to a numbered physical trace of their own addresses."""
    fetches = bl.instruction_fetches(tables.lineitem_instructions(spark, d))
    numbered = bl.with_ordinal(fetches, ["instr_id", "vaddr"])
    return bl.translate(numbered, tables.part_pagemap(spark, d)).select("rec_idx", "rw", "paddr")


def _end_to_end(spark, d) -> DataFrame:
    """Instructions to suspicious sets: operands, numbers, translation, detection."""
    accesses = bl.explode_operands(tables.lineitem_instructions(spark, d))
    order = ["instr_id", "op_pos", F.col("rw").desc(), "vaddr"]  # ids repeat in that table
    numbered = bl.with_ordinal(accesses, order)
    trace = bl.translate(numbered, tables.part_pagemap(spark, d))
    return bl.detect(trace, "L1D", "BOTH")


def _two_reports(spark, d) -> DataFrame:
    """A report with detections and one without, appended and read back."""
    path = scratch_dir(spark, "reports")
    bl.append_report(bl.report_lines(_both(spark, d), "L1D", "BOTH"), path, 1)
    bl.append_report(bl.report_lines(_negative(spark, d), "L1D", "BOTH"), path, 2)
    return bl.read_reports(spark, path)


def _negative(spark, d) -> DataFrame:
    return bl.detect(tables.orders_trace(spark, d), "L1D", "BOTH")


def _both(spark, d) -> DataFrame:
    return bl.detect(_trace(spark, d), "L1D", "BOTH")


def _sets_as_text(found: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("sets", lambda s: s.cast("string")), ",")
    return bl.detected_sets(found).select("rw", text.alias("sets"), "n_sets")


def _unnested(found: DataFrame, **options) -> DataFrame:
    return (
        bl.detections_by_set(found, **options)
        .select("rw", "set_idx", "first_pos", F.posexplode("bursts").alias("pos", "b"))
        .select(
            "rw", "set_idx", (F.col("first_pos") + F.col("pos")).alias("pos"), "b.center", "b.n_lines"
        )
    )


def _translated(spark, d, **options) -> DataFrame:
    return bl.translate(
        tables.lineitem_accesses(spark, d), tables.part_pagemap(spark, d), **options
    )


def _collected(spark, d) -> DataFrame:
    """Instructions to a numbered physical trace, as a collector would record it."""
    accesses = bl.explode_operands(tables.part_instructions(spark, d))
    numbered = bl.with_ordinal(accesses, ["instr_id", "op_pos", F.col("rw").desc()])
    return bl.translate(numbered, tables.part_pagemap(spark, d)).select("rec_idx", "rw", "paddr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "trace_records": _trace,
        "trace_ordinal": lambda s, d: bl.with_ordinal(
            tables.orders_trace(s, d).select(F.col("rec_idx").alias("o_orderkey"), "paddr"),
            ["o_orderkey"],
        ),
        "binary_roundtrip": lambda s, d: bl.read_trace(s, _written(s, d, "data")),
        "binary_roundtrip_fetch": lambda s, d: bl.read_trace(s, _written(s, d, "fetch"), "fetch"),
        "reads_only": lambda s, d: bl.only_reads(_trace(s, d)),
        "writes_only": lambda s, d: bl.only_writes(_trace(s, d)),
        "cache_coords_l1_exact": lambda s, d: _coords(s, d, L1D, exact=True),
        "access_gaps_l1": lambda s, d: bl.access_gaps(_coords(s, d, L1D)),
        "access_gaps_llc_chunked": lambda s, d: bl.access_gaps(_coords(s, d, LLC), SMALL_CHUNK),
        "burst_ids_llc_chunked": lambda s, d: bl.assign_bursts(
            _coords(s, d, LLC), LLC, SMALL_CHUNK
        ),
        "bursts_chunked_l1": lambda s, d: bl.burst_stats(_coords(s, d, L1D), L1D, SMALL_CHUNK),
        "bursts_chunked_llc": lambda s, d: bl.burst_stats(_coords(s, d, LLC), LLC, SMALL_CHUNK),
        "bursts_l1i": lambda s, d: bl.burst_stats(_coords(s, d, L1I), L1I),
        "detect_l1i": _detect("L1I", None),
        "detect_l1d_both_chunked": _detect("L1D", "BOTH", chunk=SMALL_CHUNK),
        "detect_llc_both_chunked": _detect("LLC", "BOTH", chunk=SMALL_CHUNK),
        "detect_l1d_all_chains": _detect("L1D", "BOTH", all_chains=True),
        "detect_l1d_unlinked": _detect(L1D.with_(inter=None), "BOTH"),
        "detect_file_l1d_both": lambda s, d: bl.detect_file(
            s, _written(s, d, "data"), "L1D", "BOTH"
        ),
        "detect_file_llc_read": lambda s, d: bl.detect_file(
            s, _written(s, d, "data"), "LLC", "READ", chunk=SMALL_CHUNK
        ),
        "detect_file_l1i": lambda s, d: bl.detect_file(s, _written(s, d, "fetch"), "L1I"),
        "detections_by_set_l1d": lambda s, d: _unnested(_both(s, d)),
        "representative_burst": lambda s, d: bl.representative(_both(s, d)),
        "detected_sets": lambda s, d: _sets_as_text(_both(s, d)),
        "verdict_found": lambda s, d: bl.verdict(_both(s, d), "L1D", "BOTH"),
        "verdict_not_found": lambda s, d: bl.verdict(_negative(s, d), "L1D", "BOTH"),
        "report_lines_l1d": lambda s, d: bl.report_lines(_both(s, d), "L1D", "BOTH"),
        "report_lines_not_found": lambda s, d: bl.report_lines(_negative(s, d), "L1D", "BOTH"),
        "pagemap_decoded": lambda s, d: bl.decode_pagemap(tables.part_pagemap(s, d)),
        "translated_addresses": _translated,
        "translated_addresses_unbroadcast": lambda s, d: _translated(s, d, broadcast_entries=0),
        "operand_accesses": lambda s, d: bl.explode_operands(tables.part_instructions(s, d)),
        "collected_trace": _collected,
        "collected_fetches": _numbered_fetches,
        "detect_collected_l1d": _end_to_end,
        "reports_appended": _two_reports,
        "binary_roundtrip_multifile": _two_files,
        "detections_by_set_l1d_spans": lambda s, d: _unnested(_both(s, d), span=64),
        "detect_l1d_no_mode": _detect("L1D", None),
        "detect_l1d_exact_tag": _detect("L1D", "BOTH", exact_tag=True),
        "detect_l1d_num_pp2": _detect("L1D", "BOTH", num_pp=2),
        "translated_addresses_2mb": lambda s, d: _translated(s, d, page_size=2 << 20),
        "lineitem_records": _lineitem,
        "access_gaps_lineitem": lambda s, d: bl.access_gaps(
            bl.with_cache_coords(_lineitem(s, d), LLC), SMALL_CHUNK
        ),
        "burst_stats_lineitem": lambda s, d: bl.burst_stats(
            bl.with_cache_coords(_lineitem(s, d), LLC), LLC, SMALL_CHUNK
        ),
        "bursts_qualifying_lineitem": lambda s, d: bl.qualifying_bursts(
            bl.with_cache_coords(_lineitem(s, d), LLC), LLC
        ),
        "linked_bursts_lineitem": lambda s, d: bl.link_bursts(
            bl.qualifying_bursts(bl.with_cache_coords(_lineitem(s, d), LLC), LLC), LLC
        ),
        "detect_lineitem": lambda s, d: bl.detect(_lineitem(s, d), "LLC", "BOTH"),
        "detect_lineitem_all_chains": lambda s, d: bl.detect(
            _lineitem(s, d), "LLC", "BOTH", all_chains=True
        ),
        "detect_lineitem_num_pp2": lambda s, d: bl.detect(_lineitem(s, d), "LLC", "BOTH", num_pp=2),
    }
    for name, p in (("l1", L1D), ("llc", LLC)):
        q[f"cache_coords_{name}"] = lambda s, d, p=p: _coords(s, d, p)
        q[f"set_histogram_{name}"] = lambda s, d, p=p: bl.set_histogram(_coords(s, d, p))
        q[f"sets_pruned_{name}"] = lambda s, d, p=p: bl.prune_sets(_coords(s, d, p), p)
        q[f"burst_ids_{name}"] = lambda s, d, p=p: bl.assign_bursts(_coords(s, d, p), p)
        q[f"burst_stats_{name}"] = lambda s, d, p=p: bl.burst_stats(_coords(s, d, p), p)
        q[f"bursts_qualifying_{name}"] = lambda s, d, p=p: bl.qualifying_bursts(
            _coords(s, d, p), p
        )
        q[f"linked_bursts_{name}"] = lambda s, d, p=p: bl.link_bursts(
            bl.qualifying_bursts(_coords(s, d, p), p), p
        )
    for scope in ("l1d", "llc"):
        for mode in ("read", "write", "both"):
            q[f"detect_{scope}_{mode}"] = _detect(scope.upper(), mode.upper())
    if training_text:
        q |= training_text.queries()
    if corpus_pipeline:
        q["pipeline"] = corpus_pipeline.run
    return q


# --------------------------------------------------------------------------- oracles


class Cache(NamedTuple):
    """Numbers of a cache as the SQL needs them, written out."""

    line_bits: int
    set_mask: int
    tag_shift: int
    assoc: int
    intra: int
    inter: int | None
    has_kinds: bool = True


# Stated here once more, so that a wrong one in the package shows.
L1D_SQL = Cache(6, 63, 15, 8, 2, 3600)
L1I_SQL = Cache(6, 63, 15, 8, 2, 3600, has_kinds=False)
LLC_SQL = Cache(6, 2047, 16, 16, 24, 10000)
# The texts of a report.
REPORT_PARAMETERS = (
    "Cache parameters (assoc, intra_group_threshold, line_bits, set_mask, set_bits, "
    "inter_group_threshold): (8, 2, 6, 63, 9, 3600)"
)
REPORT_TITLES = {
    1: "Data cache read mode detected set idx | (#lines, cluster_center)",
    0: "Data cache write mode detected set idx | (#lines, cluster_center)",
}
TITLE_RULE = "=" * 74
ROW_RULE = "-" * 48
FOUND = "prime+probe pattern is detected!"
NOT_FOUND = "No prime+probe pattern is detected!"

_EVENTS = """
  SELECT event_id AS rec_idx,
         CAST(CASE WHEN (event_id // 20) % 3 = 2 THEN 0 ELSE 1 END AS BIGINT) AS rw,
         (user_id * 16 + event_id % 16) * 131072
         + (CASE WHEN event_type = 'error' AND value < 4 THEN user_id % 64
                 ELSE ((event_id // 4000) % 2) * 16 + (event_id // 20) % 16 END) * 64
         + event_id % 64 AS paddr
  FROM events"""

_PAGEMAP = """
  SELECT p_partkey + CASE WHEN p_partkey % 37 = 36 THEN 1099511627776 ELSE 0 END AS vpn,
         p_size % 10 <> 0 AS present, p_size % 25 = 0 AS swapped,
         (p_partkey * 7919) % 1048576 AS pfn
  FROM part"""

_OPERANDS = """
  SELECT p_partkey AS instr_id, CAST(0 AS BIGINT) AS op_pos, p_partkey * 4096 AS vaddr,
         p_size % 2 = 0 AS is_read, p_size % 3 = 0 AS is_written FROM part
  UNION ALL
  SELECT p_partkey, 1, p_partkey * 4096 + p_size * 64, p_size % 5 <> 0, p_size % 7 = 0 FROM part"""

_ACCESSES = """
  SELECT instr_id, op_pos, CAST(1 AS BIGINT) AS rw, vaddr FROM ops WHERE is_read
  UNION ALL
  SELECT instr_id, op_pos, CAST(0 AS BIGINT) AS rw, vaddr FROM ops WHERE is_written"""


def _coords_sql(p, tag_shift=None, trace=_EVENTS) -> str:
    rw = "rw" if p.has_kinds else "CAST(-1 AS BIGINT) AS rw"
    return f"""tr AS ({trace}),
  co AS (SELECT rec_idx, {rw}, (paddr >> {p.line_bits}) & {p.set_mask} AS set_idx,
                (paddr >> {tag_shift or p.tag_shift}) & {(1 << (64 - (tag_shift or p.tag_shift))) - 1}
                AS tag FROM tr)"""


def _ids_sql(p, trace=_EVENTS, tag_shift=None) -> str:
    return f"""{_coords_sql(p, tag_shift, trace)},
  g AS (SELECT *, rec_idx - lag(rec_idx) OVER (PARTITION BY rw, set_idx ORDER BY rec_idx) AS gap
        FROM co WHERE set_idx IS NOT NULL),
  r AS (SELECT *, CAST(sum(CASE WHEN gap < {p.intra} THEN 0 ELSE 1 END) OVER
                       (PARTITION BY rw, set_idx ORDER BY rec_idx ROWS UNBOUNDED PRECEDING)
                       AS BIGINT) AS burst_id FROM g)"""


def _bursts_sql(p, trace=_EVENTS, tag_shift=None) -> str:
    return f"""{_ids_sql(p, trace, tag_shift)},
  b AS (SELECT rw, set_idx,
               CASE WHEN count(*) > 1 THEN count(DISTINCT tag) ELSE 0 END AS n_lines,
               CAST(sum(rec_idx) // count(*) AS BIGINT) AS center, count(*) AS n_access,
               min(rec_idx) AS first_idx, max(rec_idx) AS last_idx
        FROM r WHERE rw IN (-1, 0, 1) GROUP BY rw, set_idx, burst_id),
  c AS (SELECT * FROM b WHERE n_lines >= {p.assoc})"""


def _linked_sql(p, trace=_EVENTS, all_chains=False, num_pp=1, tag_shift=None) -> str:
    keep = "1 = 1" if all_chains or p.inter is None else "chain = 0"
    inter = "NULL" if p.inter is None else p.inter
    return f"""{_bursts_sql(p, trace, tag_shift)},
  l AS (SELECT *, CASE WHEN center - lag(center) OVER (PARTITION BY rw, set_idx ORDER BY center)
                            > {inter} THEN 1 ELSE 0 END AS far FROM c),
  m AS (SELECT *, sum(far) OVER (PARTITION BY rw, set_idx ORDER BY center
                                 ROWS UNBOUNDED PRECEDING) AS chain FROM l),
  n AS (SELECT *, count(*) OVER (PARTITION BY rw, set_idx, chain) AS nb FROM m WHERE {keep}),
  found AS (SELECT CASE WHEN rw < 0 THEN NULL ELSE rw END AS rw, set_idx, n_lines, center,
                   n_access, first_idx, last_idx FROM n WHERE nb > {1 if all_chains and p.inter else num_pp})"""


def _found_sql(p, kinds=(0, 1), trace=_EVENTS, **options) -> str:
    where = f"WHERE rw IN ({', '.join(map(str, kinds))})" if p.has_kinds else ""
    return f"""WITH {_linked_sql(p, trace, **options)}
SELECT rw, set_idx, n_lines, center FROM found {where}"""


def _verdict_sql(trace) -> str:
    return f"""WITH {_linked_sql(L1D_SQL, trace)},
  k AS (SELECT 1 AS rw, 'READ' AS kind UNION ALL SELECT 0, 'WRITE')
SELECT kind, count(DISTINCT set_idx) AS n_sets, count(set_idx) > 0 AS detected
FROM k LEFT JOIN found USING (rw) GROUP BY kind"""


def _report_sql(trace) -> str:
    blocks = [
        f"SELECT 0 AS block, ['BOTH, L1D', '', '{REPORT_PARAMETERS}', ''] AS lines"
    ]
    for block, kind in ((1, 1), (2, 0)):
        head = f"'{REPORT_TITLES[kind]}', '{TITLE_RULE}'"
        blocks.append(f"""SELECT {block}, CASE WHEN count(*) = 0
    THEN [{head}, '', '{NOT_FOUND}', '']
    ELSE list_concat([{head}],
      flatten(list([set_idx || ' | (' || n_lines || ', ' || center || ')', '{ROW_RULE}']
                   ORDER BY set_idx)),
      ['', 'Sets: [' || string_agg(CAST(set_idx AS VARCHAR), ', ' ORDER BY set_idx) || ']', '',
       '#Sets: ' || count(*), '', '{FOUND}', '']) END
    FROM rep WHERE rw = {kind}""")
    return f"""WITH {_linked_sql(L1D_SQL, trace)},
  rep AS (SELECT rw, set_idx, arg_min(n_lines, center) AS n_lines, min(center) AS center
          FROM found GROUP BY rw, set_idx),
  blocks AS ({' UNION ALL '.join(blocks)}),
  u AS (SELECT block, unnest(lines) AS text, generate_subscripts(lines, 1) AS i FROM blocks)
SELECT CAST(row_number() OVER (ORDER BY block, i) - 1 AS BIGINT) AS line_no, text FROM u"""


_LINEITEM = """
  SELECT rec_idx, CASE WHEN b % 11 = 10 THEN 2 ELSE b % 2 END AS rw,
         CASE WHEN rec_idx % 1000 = 999 THEN NULL
              WHEN b % 7 = 6 THEN low - 9223372036854775807 - 1 ELSE low END AS paddr
  FROM (SELECT *, (rec_idx % CASE WHEN b % 5 = 4 AND rec_idx // 128 % 2 = 1 THEN 8 ELSE 32 END)
                  * 131072 + (b % 97 * 21 + b // 388 * 7 + rec_idx // 32 % 2 * 1024) % 2048 * 64 AS low
        FROM (SELECT *, rec_idx // 256 AS b
              FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rec_idx
                    FROM lineitem)))"""

_ORDERS = """
  SELECT o_orderkey AS rec_idx, o_orderkey % 2 AS rw,
         (o_custkey * 64 + o_orderkey % 64) * 64 AS paddr FROM orders"""

_FETCHES = f"""
  WITH pm AS ({_PAGEMAP}),
    num AS (SELECT row_number() OVER (ORDER BY instr_id, vaddr) - 1 AS rec_idx, vaddr
            FROM (SELECT l_orderkey * 8 + l_linenumber AS instr_id,
                         l_suppkey * 4096 + l_linenumber * 4 AS vaddr FROM lineitem))
  SELECT rec_idx, CAST(NULL AS BIGINT) AS rw,
         CASE WHEN present THEN pfn * 4096 + vaddr % 4096 ELSE 0 END AS paddr
  FROM num LEFT JOIN pm ON vpn = vaddr // 4096"""

_LINE_ACCESSES = f"""
  WITH pm AS ({_PAGEMAP}),
    ops AS (SELECT l_orderkey * 8 + l_linenumber AS instr_id, l_linenumber,
                   l_partkey * 4096 + l_orderkey // 4 % 64 * 64 AS vaddr FROM lineitem),
    acc AS (SELECT instr_id, CAST(1 AS BIGINT) AS rw, vaddr FROM ops
            UNION ALL SELECT instr_id, 0, vaddr FROM ops WHERE l_linenumber = 7),
    num AS (SELECT *, row_number() OVER (ORDER BY instr_id, rw DESC, vaddr) - 1 AS rec_idx FROM acc)
  SELECT rec_idx, rw, CASE WHEN present THEN pfn * 4096 + vaddr % 4096 ELSE 0 END AS paddr
  FROM num LEFT JOIN pm ON vpn = vaddr // 4096"""

_TRANSLATED = f"""WITH pm AS ({_PAGEMAP}),
  va AS (SELECT l_orderkey * 8 + l_linenumber AS rec_idx,
                CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS rw,
                l_partkey * 4096 + (l_suppkey * 64) % 4096 AS vaddr FROM lineitem)
SELECT rec_idx, rw, vaddr,
       CASE WHEN present THEN pfn * 4096 + vaddr % 4096 ELSE 0 END AS paddr,
       coalesce(present AND swapped, FALSE) AS swapped
FROM va LEFT JOIN pm ON vpn = vaddr // 4096"""


def oracle_sql() -> dict[str, str]:
    burst_columns = "rw, set_idx, n_lines, center, n_access, first_idx, last_idx"
    fetches = _EVENTS.replace(" AS rw,", " AS kind,", 1)
    o = {
        "trace_records": _EVENTS,
        "trace_ordinal": f"""WITH t AS ({_ORDERS})
SELECT row_number() OVER (ORDER BY rec_idx) - 1 AS rec_idx, rec_idx AS o_orderkey, paddr FROM t""",
        "binary_roundtrip": _EVENTS,
        "binary_roundtrip_fetch": f"""WITH t AS ({fetches})
SELECT rec_idx, CAST(NULL AS BIGINT) AS rw, paddr FROM t""",
        "reads_only": f"WITH t AS ({_EVENTS}) SELECT * FROM t WHERE rw = 1",
        "writes_only": f"WITH t AS ({_EVENTS}) SELECT * FROM t WHERE rw = 0",
        "cache_coords_l1_exact": f"WITH {_coords_sql(L1D_SQL, 12)} SELECT * FROM co",
        "access_gaps_l1": f"WITH {_ids_sql(L1D_SQL)} SELECT * EXCLUDE (burst_id) FROM r",
        "access_gaps_llc_chunked": f"WITH {_ids_sql(LLC_SQL)} SELECT * EXCLUDE (burst_id) FROM r",
        "burst_ids_llc_chunked": f"WITH {_ids_sql(LLC_SQL)} SELECT * EXCLUDE (gap) FROM r",
        "bursts_l1i": f"WITH {_bursts_sql(L1I_SQL)} SELECT {burst_columns} FROM b",
        "detect_l1i": _found_sql(L1I_SQL),
        "detect_l1d_all_chains": _found_sql(L1D_SQL, all_chains=True),
        "detect_l1d_unlinked": _found_sql(L1D_SQL._replace(inter=None)),
        "detections_by_set_l1d": f"""WITH {_linked_sql(L1D_SQL)}
SELECT rw, set_idx, row_number() OVER (PARTITION BY rw, set_idx ORDER BY center) - 1 AS pos,
       center, n_lines FROM found""",
        "representative_burst": f"""WITH {_linked_sql(L1D_SQL)}
SELECT rw, set_idx, arg_min(n_lines, center) AS n_lines, min(center) AS center
FROM found GROUP BY rw, set_idx""",
        "detected_sets": f"""WITH {_linked_sql(L1D_SQL)},
  s AS (SELECT DISTINCT rw, set_idx FROM found)
SELECT rw, string_agg(CAST(set_idx AS VARCHAR), ',' ORDER BY set_idx) AS sets,
       count(*) AS n_sets FROM s GROUP BY rw""",
        "verdict_found": _verdict_sql(_EVENTS),
        "verdict_not_found": _verdict_sql(_ORDERS),
        "report_lines_l1d": _report_sql(_EVENTS),
        "report_lines_not_found": _report_sql(_ORDERS),
        "pagemap_decoded": f"SELECT vpn, present, swapped, pfn FROM ({_PAGEMAP})",
        "translated_addresses": _TRANSLATED,
        "translated_addresses_unbroadcast": _TRANSLATED,
        "operand_accesses": f"WITH ops AS ({_OPERANDS}) {_ACCESSES}",
        "collected_trace": f"""WITH pm AS ({_PAGEMAP}), ops AS ({_OPERANDS}),
  acc AS ({_ACCESSES}),
  num AS (SELECT *, row_number() OVER (ORDER BY instr_id, op_pos, rw DESC) - 1 AS rec_idx FROM acc)
SELECT rec_idx, rw, CASE WHEN present THEN pfn * 4096 + vaddr % 4096 ELSE 0 END AS paddr
FROM num LEFT JOIN pm ON vpn = vaddr // 4096""",
    }
    o |= {
        "collected_fetches": _FETCHES,
        "detect_collected_l1d": _found_sql(L1D_SQL, trace=_LINE_ACCESSES),
        "reports_appended": f"""SELECT CAST(1 AS BIGINT) AS run, * FROM ({_report_sql(_EVENTS)})
UNION ALL SELECT 2, * FROM ({_report_sql(_ORDERS)})""",
        "binary_roundtrip_multifile": f"""{_EVENTS}
UNION ALL SELECT row_number() OVER (ORDER BY rec_idx) - 1 + (SELECT count(*) FROM events), rw, paddr
FROM ({_ORDERS})""",
        "detections_by_set_l1d_spans": o["detections_by_set_l1d"],
        "detect_l1d_no_mode": f"{o['detect_l1d_all_chains']} AND FALSE",
        "detect_l1d_exact_tag": _found_sql(L1D_SQL, tag_shift=12),
        "detect_l1d_num_pp2": _found_sql(L1D_SQL, num_pp=2),
        "translated_addresses_2mb": _TRANSLATED.replace("4096 + vaddr % 4096", "2097152 + vaddr % 2097152")
        .replace("vaddr // 4096", "vaddr // 2097152"),
        "lineitem_records": _LINEITEM,
        "access_gaps_lineitem": f"""WITH {_ids_sql(LLC_SQL, _LINEITEM)}
SELECT * EXCLUDE (burst_id) FROM r
UNION ALL SELECT *, CAST(NULL AS BIGINT) FROM co WHERE set_idx IS NULL""",
        "burst_stats_lineitem": f"WITH {_bursts_sql(LLC_SQL, _LINEITEM)} SELECT {burst_columns} FROM b",
        "bursts_qualifying_lineitem": f"WITH {_bursts_sql(LLC_SQL, _LINEITEM)} SELECT {burst_columns} FROM c",
        "linked_bursts_lineitem": f"WITH {_linked_sql(LLC_SQL, _LINEITEM)} SELECT {burst_columns} FROM found",
        "detect_lineitem": _found_sql(LLC_SQL, trace=_LINEITEM),
        "detect_lineitem_all_chains": _found_sql(LLC_SQL, trace=_LINEITEM, all_chains=True),
        "detect_lineitem_num_pp2": _found_sql(LLC_SQL, trace=_LINEITEM, num_pp=2),
    }
    for name, p in (("l1", L1D_SQL), ("llc", LLC_SQL)):
        o[f"cache_coords_{name}"] = f"WITH {_coords_sql(p)} SELECT * FROM co"
        o[f"set_histogram_{name}"] = f"""WITH {_coords_sql(p)}
SELECT rw, set_idx, count(*) AS n_access, count(DISTINCT tag) AS n_tags,
       min(rec_idx) AS first_idx, max(rec_idx) AS last_idx FROM co GROUP BY rw, set_idx"""
        o[f"sets_pruned_{name}"] = f"""WITH {_coords_sql(p)},
  k AS (SELECT rw, set_idx FROM co GROUP BY rw, set_idx HAVING count(DISTINCT tag) >= {p.assoc})
SELECT co.* FROM co SEMI JOIN k USING (rw, set_idx)"""
        o[f"burst_ids_{name}"] = f"WITH {_ids_sql(p)} SELECT * EXCLUDE (gap) FROM r"
        o[f"burst_stats_{name}"] = f"WITH {_bursts_sql(p)} SELECT {burst_columns} FROM b"
        o[f"bursts_chunked_{name}"] = o[f"burst_stats_{name}"]
        o[f"bursts_qualifying_{name}"] = f"WITH {_bursts_sql(p)} SELECT {burst_columns} FROM c"
        o[f"linked_bursts_{name}"] = f"WITH {_linked_sql(p)} SELECT {burst_columns} FROM found"
    kinds = {"read": (1,), "write": (0,), "both": (0, 1)}
    for scope, p in (("l1d", L1D_SQL), ("llc", LLC_SQL)):
        for mode, wanted in kinds.items():
            o[f"detect_{scope}_{mode}"] = _found_sql(p, wanted)
        o[f"detect_{scope}_both_chunked"] = o[f"detect_{scope}_both"]
    o["detect_file_l1d_both"] = o["detect_l1d_both"]
    o["detect_file_llc_read"] = o["detect_llc_read"]
    o["detect_file_l1i"] = o["detect_l1i"]
    if training_text:
        o |= training_text.oracle_sql()
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        o["pipeline"] = corpus_pipeline.ORACLE_SQL
    return o
