"""p-values, Benjamini-Hochberg adjustment, candidate evidence, validity checks and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.config import ResearchConfig
from panelweave.functions import normal_upper_tail
from panelweave.operators.groupwise import attach, needs_split, value_positions
from panelweave.session import stage

CORE_CHECKS = ["positive_holdout_sharpe", "positive_holdout_ic", "fdr_significant", "positive_holdout_return"]


def benjamini_hochberg(
    df: DataFrame, keys: list[str], p: str = "p_value", q: str = "q_value", split: bool | None = None
) -> DataFrame:
    """Add the adjusted value per group: the smallest min(1, p_j * n / j) over j at or after the row.

    Equal p-values share one q, so each distinct p counts once with its last position; a p-value that
    many rows share (1.0 for missing evidence) is one row of the table that is ordered.
    """
    split = needs_split(df, split, keys)
    spots = _ordered_pvalues(df, keys, p, split)
    raw = F.least(F.lit(1.0), F.col(p) * F.col("__n") / F.col("__upto"))
    table = _suffix_minimum(spots.withColumn("__raw", raw), keys, p, split)
    return attach(df, table.select(*keys, p, F.col("__min").alias(q)), [*keys, p], "left")


def _ordered_pvalues(df: DataFrame, keys: list[str], p: str, split: bool) -> DataFrame:
    if split:
        return value_positions(df, keys, p)
    counted = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counted.withColumns(
        {"__upto": F.sum("__c").over(group.orderBy(p)), "__n": F.sum("__c").over(group)}
    )


def _suffix_minimum(spots: DataFrame, keys: list[str], p: str, split: bool) -> DataFrame:
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    if not split:
        onward = group.orderBy(p).rowsBetween(0, Window.unboundedFollowing)
        return spots.withColumn("__min", F.min("__raw").over(onward))
    parts = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        spots.repartitionByRange(parts, *keys, p).withColumn("__part", F.spark_partition_id()), "suffix"
    )
    # One row per (group, range partition).
    lows = ranged.groupBy(*keys, "__part").agg(F.min("__raw").alias("__low"))
    after = group.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    later = lows.select(*keys, "__part", F.min("__low").over(after).alias("__later"))
    inside = Window.partitionBy("__part", *keys).orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    here = ranged.withColumn("__here", F.min("__raw").over(inside))
    return attach(here, later, [*keys, "__part"]).withColumn("__min", F.least("__here", "__later"))


def candidate_evidence(metrics: DataFrame) -> DataFrame:
    """Holdout metrics of every candidate with its one-sided p-value (1 below two observations).

    ``metrics`` has name, family, variant and one row per split; capacity rows are no candidates.
    """
    few = F.col("observations") < 2
    return metrics.where((F.col("split") == "holdout") & (F.col("family") != "capacity")).select(
        "variant",
        "name",
        "family",
        F.col("observations").alias("holdout_observations"),
        F.col("sharpe").alias("holdout_sharpe"),
        F.col("ic_mean").alias("holdout_ic_mean"),
        F.col("ic_tstat").alias("holdout_ic_tstat"),
        F.col("total_return").alias("holdout_total_return"),
        F.when(few, F.lit(1.0)).otherwise(normal_upper_tail(F.col("ic_tstat"))).alias("p_value"),
    )


def with_candidate_q(evidence: DataFrame, order: str = "position_in_grid") -> DataFrame:
    """Adjusted q per candidate name; of several candidates with one name the last p-value counts."""
    last = evidence.groupBy("name").agg(F.max_by("p_value", order).alias("p_value"))
    adjusted = benjamini_hochberg(last, [], split=False)  # one row per configured candidate name
    return evidence.join(adjusted.select("name", "q_value"), "name")


def validity_checks(
    agent: DataFrame, baselines: DataFrame, windows: DataFrame, config: ResearchConfig, readiness: DataFrame
) -> DataFrame:
    """(name, required, passed, observed, threshold): seven checks of the agent's evidence row.

    All inputs are configuration-sized tables; ``readiness`` is the row of ``data_readiness``.  ``passed`` is null for a check that is not required.
    """
    best = baselines.agg(F.max("holdout_sharpe").alias("best_sharpe"), F.count(F.lit(1)).alias("baseline_count"))
    stable = windows.agg(
        F.avg((F.col("sharpe") >= 0).cast("double")).alias("stable_share"), F.count(F.lit(1)).alias("window_count")
    )
    facts = agent.withColumns(
        {
            "best_sharpe": best.select("best_sharpe").scalar(),
            "baseline_count": best.select("baseline_count").scalar(),
            "stable_share": stable.select("stable_share").scalar(),
            "data_ready": readiness.select("data_ready").scalar(),
        }
    )
    c = F.col
    has_baseline = c("baseline_count") > 0

    def check(name: str, required: Column, ok: Column, observed: Column, threshold: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            required.alias("required"),
            F.when(required, ok).alias("passed"),
            observed.cast("double").alias("observed"),
            threshold.cast("double").alias("threshold"),
        )

    always = F.lit(True)
    rows = F.array(
        check(
            "positive_holdout_sharpe",
            always,
            c("holdout_sharpe") > config.min_holdout_sharpe,
            c("holdout_sharpe"),
            F.lit(config.min_holdout_sharpe),
        ),
        check(
            "positive_holdout_ic",
            always,
            c("holdout_ic_mean") > config.min_holdout_ic,
            c("holdout_ic_mean"),
            F.lit(config.min_holdout_ic),
        ),
        check("fdr_significant", always, c("q_value") <= config.fdr_alpha, c("q_value"), F.lit(config.fdr_alpha)),
        check(
            "positive_holdout_return",
            F.lit(config.require_positive_return),
            c("holdout_total_return") > 0.0,
            c("holdout_total_return"),
            F.lit(0.0),
        ),
        check(
            "beats_best_baseline",
            F.lit(config.require_baseline_outperformance) & has_baseline,
            c("holdout_sharpe") >= c("best_sharpe"),
            F.when(has_baseline, c("holdout_sharpe")),
            c("best_sharpe"),
        ),
        check(
            "walk_forward_stable",
            F.lit(config.require_walk_forward_stability),
            F.coalesce(c("stable_share") >= 0.5, F.lit(False)),
            c("stable_share"),
            F.lit(0.5),
        ),
        check(
            "data_ready",
            F.lit(config.require_data_readiness),
            c("data_ready"),
            c("data_ready").cast("double"),
            F.lit(1.0),
        ),
    )
    named = facts.select(*[k for k in ("run_id",) if k in facts.columns], F.explode(rows).alias("k"))
    return named.select(*[k for k in ("run_id",) if k in facts.columns], "k.*").withColumn("reason", check_reason())


def check_reason() -> Column:
    observed, threshold = F.col("observed"), F.col("threshold")
    # The reasons' sentences.
    texts = {
        "positive_holdout_sharpe": F.format_string("Holdout Sharpe %.4f must be greater than %.4f.", observed, threshold),
        "positive_holdout_ic": F.format_string("Holdout IC %.4f must be greater than %.4f.", observed, threshold),
        "fdr_significant": F.format_string("Agent FDR q-value %.4f must be at most %.4f.", observed, threshold),
        "positive_holdout_return": F.format_string("Holdout total return %.4f must be positive.", observed),
        "beats_best_baseline": F.when(
            threshold.isNull(), "No configured baselines are available for holdout comparison."
        ).otherwise(
            F.format_string("Agent holdout Sharpe %.4f must be at least best baseline %.4f.", observed, threshold)
        ),
        "walk_forward_stable": F.lit("At least half of walk-forward windows must have non-negative Sharpe."),
        "data_ready": F.lit("Data must be point-in-time, survivorship-bias-free, and corporate-action adjusted."),
    }
    reason = F.lit(None).cast("string")
    for name, text in texts.items():
        reason = F.when(F.col("name") == name, text).otherwise(reason)
    return reason


def verdicts(checks: DataFrame, keys: list[str], enabled: bool = True) -> DataFrame:
    """(keys, verdict, reasons): failed core check REJECT, other failed required check REVIEW, else PROMOTE."""
    failed = F.col("required") & ~F.coalesce(F.col("passed"), F.lit(True))
    core = F.col("name").isin(CORE_CHECKS)
    folded = checks.groupBy(*keys).agg(
        F.bool_or(failed & core).alias("__core"),
        F.bool_or(failed).alias("__any"),
        # At most one entry per check of the fixed list.
        F.array_sort(F.collect_set(F.when(failed, F.col("reason")))).alias("reasons"),
    )
    verdict = (
        F.when(F.lit(not enabled), "REVIEW").when(F.col("__core"), "REJECT").when(F.col("__any"), "REVIEW").otherwise("PROMOTE")
    )
    return folded.select(*keys, verdict.alias("verdict"), "reasons")
