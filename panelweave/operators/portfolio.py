"""Long/short portfolios: rebalance calendar, quantile legs, trades, costs, returns and IC.

A *variant* is a column value, not a run: every function keeps ``variant`` among its keys and
treats all variants in the same job.  Tables with one row per (variant, date) are bounded by the
configured variants times the calendar; they are the only ones broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions import rank_correlation
from panelweave.operators.groupwise import (
    needs_split,
    with_average_rank,
    with_group_totals,
    with_quantiles,
)
from panelweave.operators.signals import TIE_DECIMALS

MINIMUM_NAMES = 5
KEYS = ["variant", "date"]


def rebalance_dates(aligned: DataFrame, every: int | Column) -> DataFrame:
    """(variant, date) of every k-th date, starting with the first, among dates that have rows."""
    step = F.lit(every) if isinstance(every, int) else every
    order = Window.partitionBy("variant").orderBy("date")
    dates = aligned.groupBy(*KEYS).agg(F.max(step).alias("__step"))
    return dates.where(F.col("__step") > 0).select(
        *KEYS, "__step", (F.row_number().over(order) - 1).alias("__i")
    ).where(F.col("__i") % F.col("__step") == 0).select(*KEYS)


def at_rebalance(aligned: DataFrame, every: int | Column) -> DataFrame:
    return aligned.join(rebalance_dates(aligned, every), KEYS, "left_semi")


def with_legs(
    df: DataFrame,
    quantiles: list[float],
    keys: list[str] | None = None,
    shortable: Column | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Mark long and short legs per group.

    ``quantiles`` lists the distinct values of the ``quantile`` column.  Adds n_values, is_long,
    is_short, n_long and n_short.  ``shortable`` is a boolean Column; null counts as false.
    """
    keys = keys or KEYS
    split = needs_split(df, split, keys)
    values = sorted(set(quantiles))
    cuts = {}
    for i, q in enumerate(values):
        cuts[f"__lo{i}"] = q
        cuts[f"__hi{i}"] = 1.0 - q
    cut = with_quantiles(df.withColumn("__s", F.round("signal", TIE_DECIMALS)), keys, "__s", cuts, split)

    def pick(side: str) -> Column:
        chosen = F.lit(None).cast("double")
        for i, q in enumerate(values):
            chosen = F.when(F.col("quantile") == F.lit(q), F.col(f"__{side}{i}")).otherwise(chosen)
        return F.round(chosen, TIE_DECIMALS)

    may_short = F.lit(True) if shortable is None else F.coalesce(shortable, F.lit(False))
    legs = cut.withColumns(
        {
            "is_long": F.col("__s") >= pick("hi"),
            "is_short": (F.col("__s") <= pick("lo")) & may_short,
        }
    )
    return with_group_totals(
        legs,
        keys,
        {
            "n_long": F.sum(F.col("is_long").cast("long")),
            "n_short": F.sum(F.col("is_short").cast("long")),
        },
        split,
    ).drop("__s", *cuts)


def leg_weight() -> Column:
    """Equal weights inside each leg; a name in both legs is short; other names get 0."""
    return (
        F.when(F.col("is_short"), F.lit(-1.0) / F.col("n_short"))
        .when(F.col("is_long"), F.lit(1.0) / F.col("n_long"))
        .otherwise(F.lit(0.0))
    )


def build_positions(
    df: DataFrame,
    quantiles: list[float],
    shortable: Column | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Positions for every (variant, date) with at least five names and two non-empty legs."""
    legs = with_legs(df, quantiles, shortable=shortable, split=split)
    tradable = (F.col("n_values") >= MINIMUM_NAMES) & (F.col("n_long") > 0) & (F.col("n_short") > 0)
    return legs.where(tradable).withColumn("weight", leg_weight())


# Warnings of a portfolio of one date.
WEIGHT_WARNINGS = {
    "too_few": "Fewer than five assets were available for portfolio construction.",
    "no_longs": "No long candidates passed the configured quantile.",
    "no_shorts": "No short candidates passed configured shortability constraints.",
}


def target_weights(
    df: DataFrame, quantile: float, shortable: Column | None = None, split: bool | None = None, keys: list[str] | None = None
) -> DataFrame:
    """As-of weights per group of ``keys`` (the date): one empty leg is allowed, fewer than five names gives zeros.

    Adds target_weight, risk_status, the warning flags too_few, no_longs, no_shorts and their texts as ``warnings``.
    """
    legs = with_legs(df.withColumn("quantile", F.lit(float(quantile))), [quantile], keys or ["date"], shortable, split)
    few = F.col("n_values") < MINIMUM_NAMES
    flagged = legs.withColumns(
        {
            "target_weight": F.when(few, F.lit(0.0)).otherwise(leg_weight()),
            "too_few": few,
            "no_longs": ~few & (F.col("n_long") == 0),
            "no_shorts": ~few & (F.col("n_short") == 0),
        }
    )
    texts = F.array_compact(F.array(*[F.when(F.col(c), F.lit(text)) for c, text in WEIGHT_WARNINGS.items()]))
    return flagged.withColumns({"risk_status": F.when(F.col("target_weight") != 0.0, "pass").otherwise("watch"), "warnings": texts})


def with_trades(positions: DataFrame) -> DataFrame:
    """Add ``trade`` = |weight - weight on the previous position date|.

    A name without a row on the previous position date counts as 0 there; a name without a row now
    has no trade.  The window holds one symbol of one variant, so the calendar bounds it.
    """
    order = Window.partitionBy("variant").orderBy("date")
    dates = positions.select(*KEYS).distinct().select(*KEYS, F.lag("date").over(order).alias("__prev_date"))
    held = Window.partitionBy("variant", "symbol").orderBy("date")
    previous = F.when(F.lag("date").over(held) == F.col("__prev_date"), F.lag("weight").over(held))
    return (
        positions.join(dates, KEYS)
        .withColumn("trade", F.abs(F.col("weight") - F.coalesce(previous, F.lit(0.0))))
        .drop("__prev_date")
    )


def daily_book(trades: DataFrame, borrow_fee_bps: float | Column = 0.0, extra: list[str] | None = None) -> DataFrame:
    """One row per (variant, date): raw return, turnover and the cost drivers.

    Impact and participation are linear in the notional, and fees in the multiplier, so the drivers
    are kept per unit; every cost or capacity variant reuses them without touching positions again.
    """
    fee = F.lit(borrow_fee_bps) if isinstance(borrow_fee_bps, (int, float)) else borrow_fee_bps
    per_unit = F.col("trade") / F.nullif(F.col("adv"), F.lit(0.0))
    return trades.groupBy(*KEYS, *(extra or [])).agg(
        F.sum(F.col("weight") * F.col("fwd")).alias("raw_return"),
        F.sum("trade").alias("turnover"),
        F.sum(F.col("trade") * F.coalesce(per_unit, F.lit(0.0))).alias("impact_unit"),
        F.coalesce(F.max(per_unit), F.lit(0.0)).alias("participation_unit"),
        F.sum(F.greatest(-F.col("weight"), F.lit(0.0)) * fee / 10_000.0).alias("borrow_unit"),
    )


def with_costs(book: DataFrame) -> DataFrame:
    """Add the seven cost columns and the net return.

    Needs columns base_bps, spread_bps, impact_coefficient, notional, cost_multiplier and
    holding_period next to the drivers of ``daily_book``.
    """
    m, notional = F.col("cost_multiplier"), F.col("notional")
    scaled = notional * F.col("impact_unit")
    costs = {
        "base_cost": F.col("turnover") * F.col("base_bps") * m / 10_000.0,
        "spread_cost": F.col("turnover") * F.col("spread_bps") * m / 10_000.0,
        "impact_cost": scaled * F.col("impact_coefficient") * m,
        "borrow_cost": F.col("borrow_unit") * m * F.col("holding_period") / 252.0,
        "average_trade_participation": scaled / F.nullif(F.col("turnover"), F.lit(0.0)),
        "max_trade_participation": notional * F.col("participation_unit"),
    }
    filled = book.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in costs.items()})
    total = F.col("base_cost") + F.col("spread_cost") + F.col("impact_cost") + F.col("borrow_cost")
    return filled.withColumn("total_cost", total).withColumn("net_return", F.col("raw_return") - F.col("total_cost"))


def information_coefficient(
    df: DataFrame, keys: list[str] | None = None, split: bool | None = None, extra: list[str] | None = None
) -> DataFrame:
    """Spearman correlation of signal and forward return per group; degenerate groups are dropped."""
    keys = keys or KEYS
    rounded = df.select(
        *keys,
        *(extra or []),
        F.round("signal", TIE_DECIMALS).alias("__s"),
        F.round("fwd", TIE_DECIMALS).alias("__f"),
    )
    ranked = with_average_rank(rounded, keys, {"__rs": "__s", "__rf": "__f"}, split=split)
    return (
        ranked.groupBy(*keys, *(extra or []))
        .agg(
            rank_correlation("__rs", "__rf").alias("ic"),
            (F.min("__s") != F.max("__s")).alias("__vs"),
            (F.min("__f") != F.max("__f")).alias("__vf"),
        )
        .where(F.col("__vs") & F.col("__vf") & F.col("ic").isNotNull() & ~F.isnan("ic"))
        .drop("__vs", "__vf")
    )


def concentration_by_date(positions: DataFrame) -> DataFrame:
    """(variant, date, max_weight, gross_exposure, effective_positions)."""
    size = F.abs("weight")
    by_date = positions.groupBy(*KEYS).agg(
        F.max(size).alias("max_weight"),
        F.sum(size).alias("gross_exposure"),
        F.sum(size * size).alias("__sq"),
    )
    effective = F.col("gross_exposure") * F.col("gross_exposure") / F.nullif(F.col("__sq"), F.lit(0.0))
    return by_date.withColumn("effective_positions", effective).drop("__sq")


def concentration_summary(positions: DataFrame, max_position_weight: float) -> DataFrame:
    return (
        concentration_by_date(positions)
        .groupBy("variant")
        .agg(
            F.max("max_weight").alias("max_single_name_weight"),
            F.avg("max_weight").alias("average_single_name_weight"),
            F.coalesce(F.avg("effective_positions"), F.lit(0.0)).alias("average_effective_positions"),
            F.coalesce(F.min("effective_positions"), F.lit(0.0)).alias("min_effective_positions"),
            F.avg("gross_exposure").alias("average_gross_exposure"),
            F.max("gross_exposure").alias("max_gross_exposure"),
            F.sum((F.col("max_weight") > max_position_weight).cast("long")).alias("position_weight_breach_count"),
        )
    )


