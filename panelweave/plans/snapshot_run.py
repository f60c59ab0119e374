"""From a raw snapshot to a verdict: universe, provenance, integrity, readiness and the research run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.config import ResearchConfig
from panelweave.operators import borrow as locates
from panelweave.operators import provenance, quality, universe
from panelweave.plans.research import Research, claimed_flags
from panelweave.session import stage
from panelweave.sources.panel import calendar, read_snapshot, with_date_index


class SnapshotRun:
    """Tables of a run on the snapshot at ``path`` from ``start`` to ``end``.

    The universe is ``membership`` (raw interval rows: symbol, start, end) or the static ``symbols``. ``manifest`` says
    what the snapshot should be; with ``require_hash`` a file that is another is an error. ``borrow`` are raw locate rows.
    Whether the data are ready is derived from these, never a setting of its own.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        config: ResearchConfig,
        start: str,
        end: str,
        source: str = "csv_snapshot",
        file_format: str = "csv",
        membership: DataFrame | None = None,
        symbols: DataFrame | None = None,
        manifest: dict[str, object] | None = None,
        expected_symbols: DataFrame | None = None,
        require_hash: bool = False,
        borrow: DataFrame | None = None,
    ) -> None:
        if (membership is None) == (symbols is None):
            raise ValueError("give either membership intervals or a static list of symbols")
        self.spark, self.path, self.config, self.source, self.manifest = spark, path, config, source, manifest
        self.expected_symbols, self.require_hash, self.raw_borrow = expected_symbols, require_hash, borrow
        static = universe.static_membership(symbols, start, end) if membership is None else None
        self.membership = static if membership is None else universe.normalize_membership(membership, start, end)
        self._scan = read_snapshot(spark, path, None, start, end, file_format)

    @cached_property
    def panel(self) -> DataFrame:
        """Rows of the universe with calendar positions; written, because integrity and research both read it."""
        rows = universe.apply_membership(self._scan, self.membership)
        return stage(with_date_index(rows, calendar(rows)), "snapshot-panel")

    @cached_property
    def provenance(self) -> DataFrame | None:
        if self.manifest is None:
            return None
        pattern = self.path if "*" in self.path or self.path.rsplit("/", 1)[-1].count(".") else f"{self.path}/*"
        files = provenance.content_hash(self.spark, pattern)
        return provenance.snapshot_provenance(self.panel, self.manifest, self.expected_symbols, files, self.require_hash)

    @cached_property
    def readiness(self) -> DataFrame:
        return quality.data_readiness(claimed_flags(self.spark, self.config), self.membership, self.provenance)

    @cached_property
    def integrity(self) -> tuple[DataFrame, DataFrame]:
        """Overview and warnings of the data."""
        return quality.integrity_report(self.panel, universe.universe_symbols(self.membership), self.source, self.readiness, self.provenance)

    @cached_property
    def research(self) -> Research:
        found = None if self.raw_borrow is None else locates.normalize_borrow(self.raw_borrow, calendar(self.panel.select("date")))
        allowed = self.config.shortable_symbols
        may_short = None if allowed is None else F.col("symbol").isin([s.upper() for s in allowed])
        return Research(self.panel, self.config, found, may_short, readiness=self.readiness)

    @cached_property
    def verdict(self) -> DataFrame:
        """The verdict with its reasons and the data's flags, one row."""
        return self.research.verdict.join(self.readiness, F.lit(True), "left")
