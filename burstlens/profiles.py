"""Cache profiles: geometry and burst thresholds of one cache level."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Access kinds as stored in a trace's ``rw`` column.
WRITE = 0
READ = 1
# Kind used inside the analysis for traces without kinds (instruction fetches).
FETCH = -1


@dataclass(frozen=True)
class CacheProfile:
    """Geometry of one cache level plus the two thresholds of the analysis.

    ``intra``: two accesses of a set belong to one burst when their record
    numbers are less than ``intra`` apart. ``inter``: two bursts of a set are
    linked when their centres are at most ``inter`` apart; ``None`` turns
    linking off.
    """

    name: str
    size: int
    line: int
    assoc: int
    slices: int
    intra: int
    inter: int | None
    has_kinds: bool = True

    def __post_init__(self) -> None:
        for field in ("line", "assoc", "n_sets"):
            value = getattr(self, field)
            if value < 1 or value & (value - 1):
                raise ValueError(f"{field} must be a power of two, got {value}")
        if self.intra < 1:
            raise ValueError("intra must be at least 1")

    @property
    def line_bits(self) -> int:
        return self.line.bit_length() - 1

    @property
    def n_sets(self) -> int:
        """Sets that an address can select (per slice)."""
        return self.size // (self.assoc * self.slices * self.line)

    @property
    def set_mask(self) -> int:
        return self.n_sets - 1

    @property
    def total_sets(self) -> int:
        """Sets over all slices."""
        return self.size // self.assoc // self.line

    @property
    def set_bits(self) -> int:
        """log2 of the bytes in one set; this, not log2(n_sets), shifts the tag."""
        return (self.assoc * self.line).bit_length() - 1

    @property
    def tag_shift(self) -> int:
        return self.line_bits + self.set_bits

    @property
    def exact_tag_shift(self) -> int:
        """Shift that drops exactly the line and set fields."""
        return self.line_bits + self.n_sets.bit_length() - 1

    @property
    def echo(self) -> tuple:
        """The parameters as printed in a report."""
        return (self.assoc, self.intra, self.line_bits, self.set_mask, self.set_bits, self.inter)

    def with_(self, **changes) -> "CacheProfile":
        return replace(self, **changes)


KB = 1024
MB = 1024 * KB

# Geometry and thresholds of the three scopes.
PROFILES = {
    "L1I": CacheProfile("L1I", 32 * KB, 64, 8, 1, 2, 3600, has_kinds=False),
    "L1D": CacheProfile("L1D", 32 * KB, 64, 8, 1, 2, 3600),
    "LLC": CacheProfile("LLC", 8 * MB, 64, 16, 4, 24, 10000),
}


def profile_of(scope: str | CacheProfile) -> CacheProfile:
    """The profile of a scope name, or the given profile itself."""
    if isinstance(scope, CacheProfile):
        return scope
    if scope not in PROFILES:
        raise ValueError(f"scope must be one of {sorted(PROFILES)}, got {scope!r}")
    return PROFILES[scope]


def profile_table(spark: SparkSession, profiles=None) -> DataFrame:
    """The derived geometry as a table, computed by Spark from the inputs."""
    rows = [
        (p.name, p.size, p.line, p.assoc, p.slices, p.intra, p.inter)
        for p in (profiles or PROFILES.values())
    ]
    schema = (
        "scope string, size long, line long, assoc long, slices long, intra long, inter long"
    )
    return spark.createDataFrame(rows, schema).select(
        "*",
        F.log2("line").cast("long").alias("line_bits"),
        F.expr("size div (assoc * slices * line) - 1").alias("set_mask"),
        F.log2(F.col("assoc") * F.col("line")).cast("long").alias("set_bits"),
        F.expr("size div assoc div line").alias("total_sets"),
    )
