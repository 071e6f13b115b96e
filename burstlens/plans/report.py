"""The text report of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.operators.coords import kinds_of
from burstlens.plans.detect import representative
from burstlens.profiles import FETCH, READ, WRITE, CacheProfile, profile_of

# The texts of a report.
PARAMETERS = (
    "Cache parameters (assoc, intra_group_threshold, line_bits, set_mask, set_bits, "
    "inter_group_threshold): "
)
TITLES = {
    READ: "Data cache read mode detected set idx | (#lines, cluster_center)",
    WRITE: "Data cache write mode detected set idx | (#lines, cluster_center)",
    FETCH: "L1I detected set idx | (#lines, cluster_center)",
}
TITLE_RULE = "=" * 74
ROW_RULE = "-" * 48
ROW = "%d | (%d, %d)"
SETS = "Sets: [%s]"
COUNT = "#Sets: %d"
FOUND = "prime+probe pattern is detected!"
NOT_FOUND = "No prime+probe pattern is detected!"


def _texts(*values: str):
    return F.array(*(F.lit(v) for v in values))


def report_lines(
    found: DataFrame, scope: str | CacheProfile, mode: str | None = None
) -> DataFrame:
    """``(line_no, text)`` of the report on the detections ``found``.

    A report has one entry per detected set, so its size is bounded by the cache,
    not by the trace.
    """
    profile = profile_of(scope)
    # Block 0 is the header; then comes one block per analysed kind.
    blocks = [(0, None, None)]
    blocks += [(i, k, TITLES[k]) for i, k in enumerate(kinds_of(profile, mode), start=1)]
    wanted = found.sparkSession.createDataFrame(blocks, "block int, k long, title string")
    header = _texts(f"{mode}, {profile.name}", "", PARAMETERS + str(profile.echo), "")

    hits = (
        representative(found)
        .select(F.coalesce("rw", F.lit(FETCH)).alias("k"), "set_idx", "n_lines", "center")
        .groupBy("k")
        .agg(F.sort_array(F.collect_list(F.struct("set_idx", "n_lines", "center"))).alias("hits"))
    )
    rows = F.flatten(
        F.transform(
            "hits",
            lambda h: F.array(
                F.format_string(ROW, h["set_idx"], h["n_lines"], h["center"]), F.lit(ROW_RULE)
            ),
        )
    )
    sets = F.array_join(F.transform("hits", lambda h: h["set_idx"].cast("string")), ", ")
    some = F.concat(
        F.array("title", F.lit(TITLE_RULE)),
        rows,
        F.array(
            F.lit(""),
            F.format_string(SETS, sets),
            F.lit(""),
            F.format_string(COUNT, F.size("hits")),
            F.lit(""),
            F.lit(FOUND),
            F.lit(""),
        ),
    )
    none = F.array("title", F.lit(TITLE_RULE), F.lit(""), F.lit(NOT_FOUND), F.lit(""))
    lines = (
        F.when(F.col("block") == 0, header).when(F.col("hits").isNull(), none).otherwise(some)
    )
    return (
        wanted.join(hits, "k", "left")
        .select("block", lines.alias("lines"))
        .agg(F.sort_array(F.collect_list(F.struct("block", "lines"))).alias("all"))
        .select(F.posexplode(F.flatten(F.col("all.lines"))).alias("line_no", "text"))
        .select(F.col("line_no").cast("long").alias("line_no"), "text")
    )


def write_report(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Add a report's lines, in order, as one text file under ``path``."""
    (
        lines.coalesce(1)
        .sortWithinPartitions("line_no")
        .select("text")
        .write.mode(mode)
        .text(path)
    )


def append_report(lines: DataFrame, path: str, run: int) -> None:
    """Add a report's lines to the table of reports at ``path``, as those of ``run``."""
    rows = lines.select(F.lit(run).cast("long").alias("run"), "line_no", "text")
    rows.coalesce(1).sortWithinPartitions("line_no").write.mode("append").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``(run, line_no, text)`` of all reports, in order."""
    return spark.read.parquet(path).orderBy("run", "line_no")
