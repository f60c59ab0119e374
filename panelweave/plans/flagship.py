"""The smallest complete query: factor -> rank signal -> rebalance -> legs -> portfolio return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import factors, portfolio, signals
from panelweave.plans.catalog import fixtures as fx


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """(date, n_long, n_short, raw_return) of a momentum_20d long/short portfolio."""
    panel = fx.panel(spark, sf)
    rows = factors.with_forward_returns(factors.with_factors(panel, ["momentum_20d"]), [fx.HOLD])
    signal = signals.composite_signal(rows, ["momentum_20d"], [])
    aligned = signal.where(F.col(f"fwd_{fx.HOLD}").isNotNull()).select(
        F.lit("momentum").alias("variant"),
        "date",
        "symbol",
        "signal",
        F.col(f"fwd_{fx.HOLD}").alias("fwd"),
        F.lit(fx.QUANTILE).alias("quantile"),
    )
    held = portfolio.build_positions(portfolio.at_rebalance(aligned, fx.REBALANCE), [fx.QUANTILE])
    return held.groupBy("date").agg(
        F.max("n_long").alias("n_long"),
        F.max("n_short").alias("n_short"),
        fx.r6(F.sum(F.col("weight") * F.col("fwd"))).alias("raw_return"),
    )
