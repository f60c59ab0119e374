"""Cross-sectional signals: percentile ranks, composites, neutralisation, liquidity, as-of ranking."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions import keyed_normal
from panelweave.operators.factors import check_factor_names
from panelweave.operators.groupwise import with_average_rank, with_group_totals, with_position

# Ranks, cutoffs and ties are decided on values rounded to this many decimals, so they do not
# depend on the order in which a cluster happens to add floating point numbers.
TIE_DECIMALS = 12


def with_percent_ranks(
    df: DataFrame, columns: dict[str, str], keys: list[str] | None = None, split: bool | None = None
) -> DataFrame:
    """Add tie-averaged percentile ranks among the non-null values of each date.

    ``columns`` maps output name -> value column.  All ranks of one call share one exchange.
    """
    keys = keys or ["date"]
    kept = df.columns
    rounded = df.withColumns({f"__x_{o}": F.round(F.col(v), TIE_DECIMALS) for o, v in columns.items()})
    ranked = with_average_rank(
        rounded,
        keys,
        {f"__rank_{o}": f"__x_{o}" for o in columns},
        {f"__n_{o}": f"__x_{o}" for o in columns},
        split,
    )
    return ranked.select(*kept, *[(F.col(f"__rank_{o}") / F.col(f"__n_{o}")).alias(o) for o in columns])


def composite(positive: list[str], negative: list[str], prefix: str = "pct_") -> Column:
    """Sum of positive percentile ranks minus sum of negative ones; null if any part is null."""
    if not positive and not negative:
        raise ValueError("at least one factor is required")
    plus = reduce(add, [F.col(prefix + n) for n in positive], F.lit(0.0))
    minus = reduce(add, [F.col(prefix + n) for n in negative], F.lit(0.0))
    return F.round(plus - minus, TIE_DECIMALS)


def composite_signal(
    df: DataFrame, positive: list[str], negative: list[str], split: bool | None = None
) -> DataFrame:
    """Add ``signal`` from factor columns and drop rows where it is null."""
    names = list(dict.fromkeys([*positive, *negative]))
    check_factor_names(names)
    ranked = with_percent_ranks(df, {f"pct_{n}": n for n in names}, split=split)
    return ranked.select(*df.columns, composite(positive, negative).alias("signal")).where(
        F.col("signal").isNotNull()
    )


def holds(positive: list[str], negative: list[str]) -> Column:
    """Whether ``composite`` of these factors has a value, told by the factors: a rank is null where its value is, and only there."""
    return reduce(and_, [F.col(n).isNotNull() for n in [*positive, *negative]], F.lit(True))


def dates_held(rows: DataFrame, held: dict[str, tuple[Column, float | None]], liquidity: str = "dollar_volume_20d") -> DataFrame:
    """(variant, date) of the dates on which some row of a variant fulfils its condition, from counts per date.

    With a least rank the row's percentile rank of ``liquidity`` must reach it too. Ranks grow with values, so some row's
    does where that of the highest value among the variant's rows does; two counts per date tell it, no order is needed.
    """
    x, limited = F.round(F.col(liquidity), TIE_DECIMALS) if liquidity in rows.columns else None, {}
    for p, (condition, least) in held.items():
        if least is not None:
            limited[p] = (F.max(F.when(condition, x)), least)
    at = {p: i for i, p in enumerate(held)}
    tops = [top.alias(f"__top_{at[p]}") for p, (top, _) in limited.items()]
    found = rows.groupBy("date").agg(*[F.count_if(c).alias(f"__n_{at[p]}") for p, (c, _) in held.items()], *tops)
    if limited:
        # One row per date: the calendar bounds what is broadcast.
        known = rows.select("date", x.alias("__x")).where("__x is not null").join(F.broadcast(found), "date")
        spots = [f(F.col("__x"), F.col(f"__top_{at[p]}")).alias(f"__{n}_{at[p]}") for p in limited for n, f in (("below", _below), ("same", _same))]
        found = found.join(F.broadcast(known.groupBy("date").agg(F.count("*").alias("__all"), *spots)), "date", "left")

    def present(p: str) -> Column:
        some = F.col(f"__n_{at[p]}") > 0
        if p not in limited:
            return some
        below, same = F.col(f"__below_{at[p]}"), F.col(f"__same_{at[p]}")
        return some & F.coalesce((same > 0) & ((2 * below + 1 + same) / 2.0 / F.col("__all") >= limited[p][1]), F.lit(False))

    variants = F.array_compact(F.array(*[F.when(present(p), F.lit(p)) for p in held]))
    return found.select(F.explode(variants).alias("variant"), "date")


def _below(x: Column, top: Column) -> Column:
    return F.count_if(x < top)


def _same(x: Column, top: Column) -> Column:
    return F.count_if(x == top)


def restrict_to_keys(signal: DataFrame, reference: DataFrame) -> DataFrame:
    """Keep signal rows whose (date, symbol) also occurs in the reference signal."""
    return signal.join(reference.select("date", "symbol"), ["date", "symbol"], "left_semi")


def random_signal(seed: int = 12345) -> Column:
    """Repeatable standard normal per (date, symbol), the same on every cluster layout."""
    return F.round(keyed_normal(F.lit(seed), F.col("date"), F.col("symbol")), TIE_DECIMALS)


def with_known_group(df: DataFrame, group: str, needed: Column) -> DataFrame:
    """A missing group is an error in rows that need one."""
    missing = F.raise_error(F.concat(F.lit("sector missing for symbol "), F.col("symbol")))
    return df.withColumn(group, F.when(F.col(group).isNotNull() | ~needed, F.col(group)).otherwise(missing))


def neutralize(
    df: DataFrame, group: str = "sector", value: str = "signal", split: bool | None = None
) -> DataFrame:
    """Subtract the mean of ``value`` in each (date, group); a missing group is an error."""
    checked = with_known_group(df, group, F.col(value).isNotNull())
    centred = with_group_totals(checked, ["date", group], {"__mean": F.avg(value)}, split)
    return centred.withColumn(value, F.round(F.col(value) - F.col("__mean"), TIE_DECIMALS)).drop("__mean")


def liquidity_filter(
    df: DataFrame, min_rank: float, dollar_volume: str = "dollar_volume_20d", split: bool | None = None
) -> DataFrame:
    """Keep rows with a signal whose dollar-volume percentile rank reaches ``min_rank``.

    The rank is over every symbol of the date with a dollar volume, with or without a signal, so
    the input must still hold the rows without a signal.
    """
    ranked = with_percent_ranks(df, {"__liquidity": dollar_volume}, split=split)
    return ranked.where((F.col("__liquidity") >= min_rank) & F.col("signal").isNotNull()).drop("__liquidity")


def liquidity_name(min_rank: float) -> str:
    return f"liquidity_top_{int(round((1.0 - min_rank) * 100))}pct"


def latest_signal(df: DataFrame, as_of: str) -> DataFrame:
    """Rows of the last signal date on or before ``as_of``."""
    eligible = df.where(F.col("date") <= F.lit(as_of).cast("date"))
    last = eligible.agg(F.max("date").alias("date"))
    return eligible.join(F.broadcast(last), "date", "left_semi")  # one row


def rank_as_of(df: DataFrame, split: bool | None = None) -> DataFrame:
    """Order one date's signal: best score is rank 1, symbol breaks ties."""
    return with_position(df, ["signal", "symbol"], descending=True, name="rank", split=split)


def size_orders(df: DataFrame, notional: float, max_participation: float) -> DataFrame:
    """Target weights -> order rows with a participation gate; zero weights give no order."""
    if not 0.0 < max_participation <= 1.0:
        raise ValueError("max_participation must be between 0 and 1")
    weight = F.col("target_weight")
    share = F.least(F.abs(weight), F.lit(1.0))
    passes = share <= max_participation
    return df.where(weight != 0.0).select(
        "symbol",
        F.when(weight > 0, "buy").otherwise("sell_short").alias("side"),
        weight.alias("target_weight"),
        (weight * notional).alias("target_notional"),
        F.when(passes, weight * notional).otherwise(0.0).alias("scheduled_notional"),
        share.alias("estimated_participation"),
        F.when(passes, "scheduled").otherwise("blocked").alias("status"),
        F.when(passes, "within participation limit").otherwise("participation limit breached").alias("reason"),
    )


def prune_history(df: DataFrame, as_of: str, rows: int, dates: DataFrame | None = None) -> DataFrame:
    """Keep the last ``rows`` calendar rows up to ``as_of``: what the factors of the last date reach (``history_rows``).

    ``dates`` is the panel's calendar when it is at hand (saves a scan of the panel).
    """
    day = F.lit(as_of).cast("date")
    eligible = df.where(F.col("date") <= day)
    known = eligible if dates is None else dates.where(F.col("date") <= day)
    recent = known.select("date").distinct().orderBy(F.desc("date")).limit(rows)
    return eligible.where(F.col("date") >= recent.agg(F.min("date")).scalar())
