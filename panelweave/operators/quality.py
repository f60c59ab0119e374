"""Data-quality report of a panel (rows may repeat here; the report counts the repeats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.sources.panel import PRICE_COLUMNS

EXTREME_RETURN = 0.50
STALE_ROWS = 5
MINIMUM_COVERAGE = 0.95


def panel_overview(panel: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: rows, dates, repeated keys, observed and missing symbol counts.

    Repeats come from counting per key first, so the distinct count of keys never sits in one task.
    """
    keys = panel.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n"))
    facts = keys.agg(
        F.sum("n").alias("row_count"),
        F.count_distinct("date").alias("date_count"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
        F.count_distinct("symbol").alias("observed_symbols"),
    )
    absent = missing_symbols(panel, requested).agg(F.count(F.lit(1)).alias("n"))
    return facts.withColumn("missing_symbols", absent.scalar())


def missing_symbols(panel: DataFrame, requested: DataFrame) -> DataFrame:
    wanted = requested.select(F.upper("symbol").alias("symbol")).distinct()
    return wanted.join(panel.select("symbol").distinct(), "symbol", "left_anti")


def with_row_checks(panel: DataFrame) -> DataFrame:
    """Add is_extreme and is_stale per row; lags run over the symbol's own rows, not the calendar."""
    own = Window.partitionBy("symbol").orderBy("date")
    previous = F.lag("adj_close").over(own)
    step = F.col("adj_close") / F.nullif(previous, F.lit(0.0)) - 1.0
    # Against a zero price pandas-style growth is infinite (extreme) unless the price stays zero.
    infinite = (previous == 0.0) & (F.col("adj_close") != 0.0)
    unchanged = F.coalesce(F.col("adj_close") - previous == 0.0, F.lit(False)).cast("int")
    flagged = panel.withColumns(
        {
            "is_extreme": F.coalesce((F.abs(step) > EXTREME_RETURN) | infinite, F.lit(False)),
            "__same": unchanged,
        }
    )
    run = F.sum("__same").over(own.rowsBetween(-(STALE_ROWS - 1), 0))
    return flagged.withColumn("is_stale", run >= STALE_ROWS).drop("__same")


def symbol_coverage(panel: DataFrame) -> DataFrame:
    """(symbol, observations, expected, coverage, missing_rows) against the dates of the whole panel."""
    expected = panel.agg(F.count_distinct("date").alias("n")).scalar()
    counted = panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("observations"))
    return counted.withColumn("expected_observations", expected).select(
        "symbol",
        "observations",
        "expected_observations",
        (F.col("observations") / F.nullif(F.col("expected_observations"), F.lit(0))).alias("coverage"),
        (F.col("expected_observations") - F.col("observations")).alias("missing_rows"),
    )


def symbol_quality(panel: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Coverage plus counts of bad prices, empty volume, extreme returns and stale rows per symbol.

    ``dates`` is the panel's calendar when it is at hand (saves deriving the panel a second time).
    """
    expected = (panel if dates is None else dates).agg(F.count_distinct("date").alias("n")).scalar()
    lowest = F.least(*PRICE_COLUMNS)
    counted = with_row_checks(panel).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("volume") <= 0).alias("zero_volume_rows"),
        F.count_if(lowest <= 0).alias("non_positive_price_rows"),
        F.count_if(F.col("is_stale")).alias("stale_price_rows"),
        F.count_if(F.col("is_extreme")).alias("extreme_return_rows"),
    )
    return counted.withColumn("expected_observations", expected).withColumns(
        {
            "coverage": F.col("observations") / F.nullif(F.col("expected_observations"), F.lit(0)),
            "missing_rows": F.col("expected_observations") - F.col("observations"),
        }
    )


def quality_warnings(quality: DataFrame) -> DataFrame:
    """(symbol, rule, message): one row per rule a symbol breaks."""
    count = lambda c, text: F.when(
        F.col(c) > 0, F.struct(F.lit(c).alias("rule"), F.format_string(f"%s has %d {text}", F.col("symbol"), F.col(c)).alias("message"))
    )
    low = F.when(
        F.col("coverage") < MINIMUM_COVERAGE,
        F.struct(
            F.lit("coverage").alias("rule"),
            F.format_string(
                "%s coverage is %.2f%%; inspect missing rows before trusting results.",
                F.col("symbol"),
                F.col("coverage") * 100,
            ).alias("message"),
        ),
    )
    found = F.array(
        low,
        count("non_positive_price_rows", "rows with non-positive OHLC prices."),
        count("zero_volume_rows", "rows with non-positive volume."),
        count("extreme_return_rows", "rows with absolute adjusted return above 50%%."),
        count("stale_price_rows", "stale adjusted-close rows."),
    )
    return quality.select("symbol", F.explode(F.array_compact(found)).alias("w")).select("symbol", "w.*")


def panel_warnings(panel: DataFrame, requested: DataFrame) -> DataFrame:
    """(rule, message) rows: requested symbols without data and repeated date-symbol rows."""
    absent = missing_symbols(panel, requested).select(
        F.lit("missing_symbol").alias("rule"), F.format_string("Missing requested symbols: %s.", F.col("symbol")).alias("message")
    )
    repeats = panel.groupBy("date", "symbol").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("n"))
    repeated = repeats.where(F.col("n") > 0).select(
        F.lit("duplicate_rows").alias("rule"),
        F.format_string("Market data contains %d duplicate date-symbol rows.", F.col("n")).alias("message"),
    )
    return absent.unionByName(repeated)


def source_warnings(
    source: Column, point_in_time: Column, survivorship_free: Column, adjusted: Column, has_provenance: Column
) -> Column:
    """Array of source and readiness warnings for one data set."""
    kind = F.lower(source)
    # The warnings' sentences.
    return F.array_compact(
        F.array(
            F.when(kind == "synthetic", "Synthetic data validates mechanics but is not investment evidence."),
            F.when(
                kind == "yahoo",
                "Yahoo Finance is a demo source and does not provide an institutional point-in-time research dataset.",
            ),
            F.when(
                kind.isin("csv_snapshot", "vendor_snapshot") & ~has_provenance,
                "CSV snapshot source is configured without a manifest; provenance and golden validation are incomplete.",
            ),
            F.when(
                kind == "vendor_snapshot",
                "Vendor snapshot data requires entitlement, survivorship, and corporate-action review before production use.",
            ),
            F.when(
                ~point_in_time,
                "Universe membership is not marked point-in-time; survivorship or lookahead bias may remain.",
            ),
            F.when(~survivorship_free, "Universe is not marked survivorship-bias-free."),
            F.when(~adjusted, "Corporate-action handling is not marked institutional-grade."),
        )
    )


READINESS = ["point_in_time_universe", "survivorship_bias_free", "corporate_actions_adjusted"]


def data_readiness(claimed: DataFrame, membership: DataFrame | None = None, provenance: DataFrame | None = None) -> DataFrame:
    """One row: the three flags of ``READINESS`` and ``data_ready``, which needs them all.

    A flag holds if the settings claim it (``claimed``, rows with the flags), the provenance does, or, for the two about
    the universe, if membership comes from intervals rather than a static list.
    """
    rows = claimed.select(*READINESS)
    if provenance is not None:
        rows = rows.unionByName(provenance.select(*READINESS))
    if membership is not None:
        listed = "point_in_time" in membership.columns  # a static list says itself what it is not
        first, second = (F.bool_and(c) if listed else F.count(F.lit(1)) > 0 for c in ("point_in_time", "survivorship_free"))
        rows = rows.unionByName(membership.agg(first.alias(READINESS[0]), second.alias(READINESS[1]), F.lit(False).alias(READINESS[2])))
    flags = rows.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in READINESS])
    return flags.withColumn("data_ready", F.col(READINESS[0]) & F.col(READINESS[1]) & F.col(READINESS[2]))


def integrity_report(
    panel: DataFrame, requested: DataFrame, source: str, readiness: DataFrame, provenance: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(overview, warnings): one row of counts and flags, and every warning as a row (rule, subject, message)."""
    overview = panel_overview(panel, requested).join(readiness, F.lit(True), "left").withColumn("source", F.lit(source))
    told = source_warnings(F.lit(source), *[F.col(c) for c in READINESS], F.lit(provenance is not None))
    rows = readiness.select(F.lit("source").alias("rule"), F.lit(None).cast("string").alias("subject"), F.explode(told).alias("message"))
    if provenance is not None:
        rows = rows.unionByName(provenance.select(F.lit("provenance").alias("rule"), F.lit(None).cast("string").alias("subject"), F.explode("warnings").alias("message")))
    rows = rows.unionByName(panel_warnings(panel, requested).select("rule", F.lit(None).cast("string").alias("subject"), "message"))
    own = quality_warnings(symbol_quality(panel)).select("rule", F.col("symbol").alias("subject"), "message")
    return overview, rows.unionByName(own)
