"""Research ideas: extraction from texts, validation, batch checks and cost accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions import text as tx
from panelweave.operators.factors import FACTOR_NAMES

_HEURISTIC = "Template was extracted heuristically; review factor direction and holding period before running research."
_SHORT = "Input paper text is short; extraction confidence is limited."
_BIAS = (
    "Check for survivorship bias, lookahead bias, and data-snooping before treating the idea as research evidence."
)
_FUTURE = "Paper text references future-looking language; verify features are available at decision time."


def extract_ideas(
    texts: DataFrame, name: str, text: str = "text", keywords: dict[str, list[str]] | None = None
) -> DataFrame:
    """One idea per text: a pure projection, so a corpus of any size and skew streams through it."""
    cleaned = tx.clean(F.col(text))
    rows = texts.withColumn("__clean", cleaned).withColumn("__low", F.lower("__clean"))
    positive, negative = tx.factor_tags(F.col("__low"), keywords)
    rows = rows.withColumns(
        {"positive_factors": positive, "negative_factors": negative, "holding_period": tx.holding_period(F.col("__low"))}
    )
    raw_low = F.lower(F.col(text))
    warnings = F.array(F.lit(_HEURISTIC), F.when(F.length("__clean") < 200, F.lit(_SHORT)))
    bias = F.array(F.lit(_BIAS), F.when(tx.contains_any(raw_low, tx.LOOKAHEAD_PHRASES), F.lit(_FUTURE)))
    return rows.withColumns(
        {
            "name": tx.slug(F.col(name)),
            "hypothesis": tx.hypothesis(
                F.col("__clean"), F.col("positive_factors"), F.col("negative_factors"), F.col("holding_period")
            ),
            "quantile": F.lit(0.2),
            "confidence": tx.extraction_confidence(F.col(text)),
            "warnings": F.array_compact(warnings),
            "unsupported_concepts": tx.concept_hits(raw_low),
            "bias_warnings": F.array_compact(bias),
        }
    ).drop("__clean", "__low")


def validate_ideas(ideas: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Add errors, warnings_found and valid to an ideas table."""
    known = F.array(*[F.lit(n) for n in (FACTOR_NAMES if allowed is None else allowed)])
    used = F.array_union("positive_factors", "negative_factors")
    unknown = F.array_sort(F.array_except(used, known))
    c = F.col
    errors = F.array(
        F.when(~F.rlike("name", F.lit(r"\A[a-z0-9_]+\z")), "name must be lowercase snake_case"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown factors: ['"), F.array_join(unknown, "', '"), F.lit("']"))),
        F.when(
            F.size(F.array_intersect("positive_factors", "negative_factors")) > 0,
            "positive_factors and negative_factors must not overlap",
        ),
        F.when(F.size(used) == 0, "at least one factor is required"),
        F.when(~c("holding_period").between(1, 252), "holding_period must be between 1 and 252"),
        F.when(~((c("quantile") > 0.0) & (c("quantile") < 0.5)), "quantile must be between 0 and 0.5"),
    )
    low = F.when(c("confidence") < 0.5, "idea confidence is low; require human review before running")
    return ideas.withColumns(
        {"errors": F.array_compact(errors), "warnings_found": F.array_compact(F.array(low))}
    ).withColumn("valid", F.size("errors") == 0)


def batch_checks(ideas: DataFrame, requested: Column, allowed: list[str] | None = None) -> DataFrame:
    """Per batch_id: returned ideas against the six quality checks and the overall status.

    Unknown factors and names are counted through distinct aggregation, never collected per batch.
    """
    names = FACTOR_NAMES if allowed is None else allowed
    c = F.col
    required = ["name", "hypothesis", "positive_factors", "negative_factors", "holding_period", "quantile", "rationale", "confidence", "warnings"]
    complete = F.lit(True)
    for field in required:
        complete = complete & c(field).isNotNull()
    used = F.array_union(F.coalesce("positive_factors", F.array()), F.coalesce("negative_factors", F.array()))
    outside = F.size(F.array_except(used, F.array(*[F.lit(n) for n in names]))) > 0
    folded = ideas.groupBy("batch_id").agg(
        F.max(requested).alias("requested"),
        F.count(F.lit(1)).alias("returned"),
        F.count_distinct("name").alias("unique_names"),
        F.count("name").alias("named"),
        F.bool_and(complete).alias("schema_fields_present"),
        (~F.bool_or(outside)).alias("allowed_factor_boundary"),
        F.bool_and(F.coalesce(F.size("warnings") > 0, F.lit(False))).alias("warnings_present"),
        F.bool_and(F.coalesce(c("confidence").between(0.0, 1.0), F.lit(False))).alias("confidence_range"),
    )
    checks = folded.select(
        "batch_id",
        "requested",
        "returned",
        (c("returned") >= c("requested")).alias("requested_idea_count"),
        "schema_fields_present",
        "allowed_factor_boundary",
        (c("unique_names") == c("named")).alias("unique_names"),
        "warnings_present",
        "confidence_range",
    )
    flags = checks.columns[3:]
    passed = F.lit(True)
    for flag in flags:
        passed = passed & c(flag)
    return checks.withColumn("status", F.when(passed, "passed").otherwise("failed"))


def unknown_factors(ideas: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Distinct (batch_id, factor) outside the allowed list."""
    names = FACTOR_NAMES if allowed is None else allowed
    used = F.array_union(F.coalesce("positive_factors", F.array()), F.coalesce("negative_factors", F.array()))
    return ideas.select("batch_id", F.explode(used).alias("factor")).where(~F.col("factor").isin(names)).distinct()


def request_costs(
    turns: DataFrame,
    keys: list[str],
    input_rate: float,
    output_rate: float,
    max_requests: int | None,
    max_cost: float | None,
) -> DataFrame:
    """Token and cost estimate per request group with budget rejections (rates per 1000 tokens).

    ``role = 'assistant'`` is output, everything else input.
    """
    out = F.col("role") == "assistant"
    tokens = tx.token_estimate(F.col("text"))
    folded = turns.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~out, tokens)), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(out, tokens)), F.lit(0)).alias("output_tokens"),
        F.count_if(F.col("role") == "user").alias("planned_requests"),
    )
    cost = F.col("input_tokens") / 1000.0 * input_rate + F.col("output_tokens") / 1000.0 * output_rate
    priced = folded.withColumn("estimated_cost_usd", cost)
    limits = []
    if max_requests is not None:
        limits.append(
            F.when(
                F.col("planned_requests") > max_requests,
                F.format_string(f"planned_requests=%d exceeds max_requests={max_requests}", F.col("planned_requests")),
            )
        )
    if max_cost is not None:
        limits.append(
            F.when(
                F.col("estimated_cost_usd") > max_cost,
                F.format_string(
                    f"estimated_cost_usd=%.8f exceeds max_estimated_cost_usd={max_cost:.8f}", F.col("estimated_cost_usd")
                ),
            )
        )
    rejections = F.array_compact(F.array(*limits)) if limits else F.array().cast("array<string>")
    return priced.withColumn("rejections", rejections).withColumn(
        "status", F.when(F.size("rejections") > 0, "rejected").otherwise("passed")
    )
