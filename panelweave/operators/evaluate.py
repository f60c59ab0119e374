"""Chronological splits, purging, walk-forward windows and metric summaries.

Input is the daily table of a back-test, at most (variants x calendar) rows:
variant, date, date_idx, net_return (null when the date has no portfolio), ic (null when the date
has none), turnover, the cost columns and holding_period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COST_COLUMNS = ["total_cost", "base_cost", "spread_cost", "impact_cost", "borrow_cost"]
PARTICIPATION = ["average_trade_participation", "max_trade_participation"]

PERFORMANCE_METRICS = [
    "observations",
    "ic_mean",
    "ic_std",
    "ic_tstat",
    "ic_hit_rate",
    "sharpe",
    "max_drawdown",
    "average_turnover",
    "total_return",
    "mean_period_return",
]
COST_METRICS = [
    "average_total_cost",
    "average_base_cost",
    "average_spread_cost",
    "average_impact_cost",
    "average_borrow_cost",
    "cumulative_total_cost",
    *PARTICIPATION,
]


def split_boundaries(daily: DataFrame, train_fraction: float | Column, holdout_fraction: float | Column) -> DataFrame:
    """One row per variant: n, split_idx, validation_idx, holdout_idx (null when disabled) and their dates.

    A fraction may be a column that is the same in all rows of a variant; a holdout of 0 disables it. Variants without
    enough dates keep a row with ``splittable`` false and null boundaries.
    """
    # A window per variant over its rebalance dates: bounded by the calendar.
    order = Window.partitionBy("variant").orderBy("date_idx")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    rows = daily.where(F.col("net_return").isNotNull()).select(
        "variant",
        "date",
        "date_idx",
        (F.row_number().over(order) - 1).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy("variant")).alias("n"),
        as_column(train_fraction).alias("tf"),
        as_column(holdout_fraction).alias("hf"),
    )
    n, two = F.col("n"), F.col("hf") <= 0.0
    placed = rows.withColumn("holdout_pos", F.when(~two, n - F.greatest(F.lit(1), F.ceil(n * F.col("hf")))))
    wanted = F.floor(n * F.col("tf"))
    train = F.when(two, F.least(F.greatest(wanted, F.lit(1)), n - 2)).otherwise(F.least(F.greatest(wanted, F.lit(0)), F.col("holdout_pos") - 2))
    placed = placed.withColumn("train_pos", train)
    enough = F.when(two, n >= 4).otherwise(F.col("holdout_pos") - 2 >= 0)

    def at(position: Column, column: str, name: str) -> Column:
        return F.max(F.when(enough & (F.col("pos") == position), F.col(column))).alias(name)

    marks = [("split", F.col("train_pos")), ("validation", F.col("train_pos") + 1), ("holdout", F.col("holdout_pos"))]
    columns = [at(p, c, f"{m}_{s}") for m, p in marks for c, s in (("date_idx", "idx"), ("date", "date"))]
    return placed.groupBy("variant").agg(F.max("n").alias("n"), F.bool_and(enough).alias("splittable"), *columns)


def assert_splittable(boundaries: DataFrame) -> DataFrame:
    """Turn an unsplittable variant into an error when the table is evaluated."""
    message = F.lit("not enough backtest observations for train, validation, and holdout")
    return boundaries.where(F.when(F.col("splittable"), True).otherwise(F.raise_error(message)))


def with_boundaries(daily: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Daily rows of splittable variants with the boundary columns (one row per variant, broadcast)."""
    return daily.join(F.broadcast(boundaries.where("splittable")), "variant")


def realized_before_holdout() -> Column:
    """Decision before the holdout and label realised before it too (dates are calendar positions)."""
    return F.col("holdout_idx").isNull() | (
        (F.col("date_idx") < F.col("holdout_idx"))
        & (F.col("date_idx") + F.col("holding_period") < F.col("holdout_idx"))
    )


def explode_splits(bounded: DataFrame) -> DataFrame:
    """Repeat each daily row once per split it belongs to: train, validation, test, holdout, full.

    IC dates without a portfolio count in train and full only; test repeats validation.
    """
    traded = F.col("net_return").isNotNull()
    validation = traded & (F.col("date_idx") >= F.col("validation_idx")) & realized_before_holdout()
    member = {
        "train": F.col("date_idx") <= F.col("split_idx"),
        "validation": validation,
        "test": validation,
        "holdout": traded & F.coalesce(F.col("date_idx") >= F.col("holdout_idx"), F.lit(False)),
        "full": F.lit(True),
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in member.items()]))
    return bounded.withColumn("split", F.explode(names))


def split_names() -> list[str]:
    return ["train", "validation", "test", "holdout", "full"]


def summarize(rows: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """The ten performance and eight cost metrics per ``keys``; empty series give 0."""
    traded = F.col("net_return").isNotNull()
    order = Window.partitionBy(*keys).orderBy("date_idx")
    equity = F.product(F.when(traded, 1.0 + F.col("net_return"))).over(order)
    curve = rows.withColumn("__equity", equity)
    peak = F.max("__equity").over(order)
    curve = curve.withColumn("__dd", F.when(traded, F.col("__equity") / F.nullif(peak, F.lit(0.0)) - 1.0))

    ret, ic = F.col("net_return"), F.col("ic")
    only_traded = lambda c: F.when(traded, F.col(c))
    base = curve.groupBy(*keys).agg(
        F.count(ret).alias("__n"),
        F.count(ic).alias("__k"),
        F.avg(ic).alias("__ic"),
        F.stddev_samp(ic).alias("__ic_sd"),
        F.avg((ic > 0).cast("double")).alias("__hit"),
        F.avg(ret).alias("__mean"),
        F.stddev_samp(ret).alias("__sd"),
        F.min("__dd").alias("__mdd"),
        F.avg(only_traded("turnover")).alias("__turn"),
        F.product(1.0 + ret).alias("__growth"),
        F.max("holding_period").alias("__h"),
        *[F.avg(only_traded(c)).alias(f"average_{c}") for c in COST_COLUMNS],
        F.sum(only_traded("total_cost")).alias("cumulative_total_cost"),
        F.avg(only_traded(PARTICIPATION[0])).alias(PARTICIPATION[0]),
        F.max(only_traded(PARTICIPATION[1])).alias(PARTICIPATION[1]),
        *(extra or []),
    )
    n, k = F.col("__n"), F.col("__k")
    per_year = F.sqrt(F.lit(252.0) / F.greatest(F.col("__h"), F.lit(1)))
    usable_ic = (k > 1) & (F.col("__ic_sd") > 0)
    usable = (n > 1) & (F.col("__sd") > 0)
    zero = F.lit(0.0)
    metrics = {
        "observations": n,
        "ic_mean": F.coalesce(F.col("__ic"), zero),
        "ic_std": F.when(k > 1, F.col("__ic_sd")).otherwise(zero),
        "ic_tstat": F.when(usable_ic, F.col("__ic") / (F.nullif(F.col("__ic_sd"), zero) / F.sqrt(k))).otherwise(zero),
        "ic_hit_rate": F.coalesce(F.col("__hit"), zero),
        "sharpe": F.when(usable, F.col("__mean") / F.nullif(F.col("__sd"), zero) * per_year).otherwise(zero),
        "max_drawdown": F.coalesce(F.col("__mdd"), zero),
        "average_turnover": F.coalesce(F.col("__turn"), zero),
        "total_return": F.when(n > 0, F.col("__growth") - 1.0).otherwise(zero),
        "mean_period_return": F.coalesce(F.col("__mean"), zero),
        **{c: F.coalesce(F.col(c), zero) for c in COST_METRICS},
    }
    named = [c.alias(m) for m, c in metrics.items()]
    others = [c for c in base.columns if not c.startswith("__") and c not in metrics and c not in keys]
    return base.select(*keys, *others, *named)


def split_metrics(
    daily: DataFrame, train_fraction: float | Column, holdout_fraction: float | Column, boundaries: DataFrame | None = None
) -> DataFrame:
    """(variant, split, metrics) for every split of every variant; an empty split gives a row of zeros."""
    boundaries = split_boundaries(daily, train_fraction, holdout_fraction) if boundaries is None else boundaries
    rows = explode_splits(with_boundaries(daily, boundaries))
    found = summarize(rows, ["variant", "split"])
    names = F.explode(F.array(*[F.lit(s) for s in split_names()])).alias("split")
    every = boundaries.where("splittable").select("variant", names)
    return every.join(found, ["variant", "split"], "left").fillna(
        0, subset=[c for c in found.columns if c not in ("variant", "split")]
    )


def walk_forward_rows(bounded: DataFrame, windows: int, min_train_fraction: float) -> DataFrame:
    """Purged pre-holdout dates with their test window number and the date before each window."""
    order = Window.partitionBy("variant").orderBy("date_idx")
    whole = Window.partitionBy("variant")
    rows = bounded.where(F.col("net_return").isNotNull() & realized_before_holdout()).withColumns(
        {
            "__pos": F.row_number().over(order) - 1,
            "__n": F.count(F.lit(1)).over(whole),
            "__train_start": F.min("date").over(whole),
            "__previous": F.lag("date").over(order),
        }
    )
    n = F.col("__n")
    first = F.least(F.greatest(F.floor(n * min_train_fraction), F.lit(1)), n - 1)
    sized = rows.where(n >= 4).withColumn("__first", first)
    count = F.least(F.lit(windows), n - F.col("__first"))
    size = F.greatest(F.lit(1), F.floor((n - F.col("__first")) / count))
    number = F.least(F.floor((F.col("__pos") - F.col("__first")) / size), count - 1)
    return (
        sized.where(F.col("__pos") >= F.col("__first"))
        .withColumn("window", F.format_string("wf_%02d", (number + 1).cast("int")))
    )


def walk_forward_metrics(
    daily: DataFrame, train_fraction: float, holdout_fraction: float, windows: int, min_train_fraction: float
) -> DataFrame:
    """(variant, window, four dates, metrics): expanding train, the last window takes the remainder."""
    bounded = with_boundaries(daily, split_boundaries(daily, train_fraction, holdout_fraction))
    if windows <= 0:
        bounded = bounded.where(F.lit(False))
    rows = walk_forward_rows(bounded, max(windows, 1), min_train_fraction)
    return summarize(
        rows,
        ["variant", "window"],
        [
            F.min("__train_start").alias("train_start"),
            F.min_by("__previous", "date").alias("train_end"),
            F.min("date").alias("test_start"),
            F.max("date").alias("test_end"),
        ],
    )


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    """Per variant over its windows: counts, means, share of positive IC and median total return."""
    return windows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg("ic_mean").alias("mean_ic"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.avg("average_total_cost").alias("mean_cost"),
        F.avg((F.col("ic_mean") > 0).cast("double")).alias("positive_ic_share"),
        F.percentile("total_return", F.lit(0.5)).alias("median_total_return"),
    )
