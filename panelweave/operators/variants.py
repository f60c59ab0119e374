"""Bootstrap, capacity and sensitivity views over the metrics of a variant grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions import keyed_integer


def validation_rows(bounded: DataFrame) -> DataFrame:
    """Daily rows with a return from validation start up to the holdout; deliberately not purged."""
    before = F.col("holdout_idx").isNull() | (F.col("date_idx") < F.col("holdout_idx"))
    return bounded.where(F.col("net_return").isNotNull() & (F.col("date_idx") >= F.col("validation_idx")) & before)


def bootstrap(bounded: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Resample validation returns and IC with replacement, independently, per variant.

    Draws are keyed by (seed, stream, iteration, draw), so any layout gives the same samples.  The
    number of draws is iterations (configured) x validation dates (calendar), spread over tasks by
    (variant, iteration).
    """
    order = Window.partitionBy("variant").orderBy("date_idx")
    rows = validation_rows(bounded)
    returns = rows.select("variant", "holding_period", F.col("net_return").alias("x"), (F.row_number().over(order) - 1).alias("pos"))
    ics = rows.where(F.col("ic").isNotNull()).select(
        "variant", "holding_period", F.col("ic").alias("x"), (F.row_number().over(order) - 1).alias("pos")
    )

    def samples(values: DataFrame, stream: str) -> DataFrame:
        sizes = values.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
        draws = (
            sizes.select("variant", "n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("b"))
            .select("variant", "n", "b", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
            .select(
                "variant",
                "b",
                (keyed_integer(F.lit(seed), F.lit(stream), F.col("b"), F.col("i")) % F.col("n")).cast("int").alias("pos"),
            )
        )
        return draws.join(values, ["variant", "pos"])

    drawn = samples(returns, "return").groupBy("variant", "b").agg(
        F.avg("x").alias("__m"), F.stddev_samp("x").alias("__s"), F.max("holding_period").alias("__h")
    )
    sharpe = F.when(F.col("__s") > 0, F.col("__m") / F.col("__s") * F.sqrt(F.lit(252.0) / F.col("__h"))).otherwise(F.lit(0.0))
    sharpes = drawn.select("variant", "b", sharpe.alias("sharpe"))
    means = samples(ics, "ic").groupBy("variant", "b").agg(F.avg("x").alias("ic"))

    def band(values: DataFrame, column: str) -> DataFrame:
        return values.groupBy("variant").agg(
            F.count(F.lit(1)).alias(f"{column}_iterations"),
            F.avg(column).alias(f"{column}_mean"),
            F.percentile(column, F.lit(0.025)).alias(f"{column}_ci_low"),
            F.percentile(column, F.lit(0.975)).alias(f"{column}_ci_high"),
            F.avg((F.col(column) > 0).cast("double")).alias(f"positive_{column}_probability"),
        )

    both = band(sharpes, "sharpe").join(band(means, "ic"), "variant")
    return both.withColumn("iterations", F.col("sharpe_iterations")).drop("sharpe_iterations", "ic_iterations")


def capacity_curve(bounded: DataFrame, test_metrics: DataFrame, limit: float) -> DataFrame:
    """Per notional: test metrics, unpurged validation dates over the participation limit and two gates."""
    breaches = validation_rows(bounded).groupBy("variant").agg(
        F.count_if(F.col("max_trade_participation") > limit).alias("participation_breach_count")
    )
    return (
        test_metrics.join(breaches, "variant", "left")
        .withColumn("participation_breach_count", F.coalesce(F.col("participation_breach_count"), F.lit(0)))
        .withColumns(
            {
                "passes_participation_limit": F.col("participation_breach_count") == 0,
                "passes_positive_sharpe": F.col("sharpe") > 0.0,
            }
        )
    )


def max_capacity(curve: DataFrame) -> DataFrame:
    passing = F.col("passes_participation_limit") & F.col("passes_positive_sharpe")
    return curve.agg(F.max(F.when(passing, F.col("notional"))).alias("max_capacity_notional"))


def capacity_warnings(curve: DataFrame, concentration: DataFrame, weight_limit: float, limit: float) -> DataFrame:
    """(rule, message) rows: weight breaches, no passing notional, first breached notional."""
    passing = F.col("passes_participation_limit") & F.col("passes_positive_sharpe")
    facts = curve.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(passing).alias("passed"),
        F.min(F.when(~F.col("passes_participation_limit"), F.col("notional"))).alias("first_breach"),
    ).withColumn("breaches", concentration.agg(F.sum("position_weight_breach_count").alias("n")).scalar())

    def warn(rule: str, condition, message):
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), message.alias("message")))

    found = F.array(
        warn(
            "concentration",
            F.col("breaches") > 0,
            F.format_string(
                f"Position concentration breached {weight_limit * 100:.0f}%% on %d rebalance dates.",
                F.col("breaches"),
            ),
        ),
        warn(
            "no_capacity",
            (F.col("points") > 0) & (F.col("passed") == 0),
            F.lit("No configured notional passed both participation and positive-Sharpe capacity gates."),
        ),
        warn(
            "participation",
            F.col("first_breach").isNotNull(),
            F.format_string(
                f"Trade participation first breached {limit * 100:.0f}%% at notional %,.0f.", F.col("first_breach")
            ),
        ),
    )
    return facts.select(F.explode(F.array_compact(found)).alias("w")).select("w.*")
