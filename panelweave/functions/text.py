"""Text columns: cleaning, keyword tags, holding period, hypothesis, slugs and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which words stand for which factor.
FACTOR_KEYWORDS = {
    "momentum_20d": ["momentum", "trend", "relative strength"],
    "momentum_60d": ["medium-term momentum", "sixty day", "60-day"],
    "reversal_5d": ["reversal", "mean reversion", "short-term reversal"],
    "volatility_20d": ["volatility", "low risk", "realized risk"],
    "drawdown_20d": ["drawdown", "downside"],
    "dollar_volume_20d": ["liquidity", "volume", "turnover"],
}
# Factors that count against a signal when the text talks about low values or risk.
RISK_FACTORS = ["volatility_20d", "drawdown_20d"]
RISK_WORDS = ["low", "risk"]
# Concepts the factor library cannot express, and look-ahead phrases.
UNSUPPORTED_CONCEPTS = ["sentiment", "earnings", "options", "fundamental", "news", "analyst"]
LOOKAHEAD_PHRASES = ["future", "next quarter"]

WHITESPACE = r"(?U)\s+"


def clean(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def contains_any(lowered: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word))
    return found


def factor_tags(lowered: Column, keywords: dict[str, list[str]] | None = None) -> tuple[Column, Column]:
    """(positive, negative) sorted factor arrays of a lower-cased text.

    The keyword table is configuration, so it unfolds into ``contains`` tests inside one projection;
    no join and no row explosion.
    """
    table = FACTOR_KEYWORDS if keywords is None else keywords
    risky = contains_any(lowered, RISK_WORDS)
    positive, negative = [], []
    for factor, words in table.items():
        hit = contains_any(lowered, words)
        if factor in RISK_FACTORS:
            negative.append(F.when(hit & risky, F.lit(factor)))
            positive.append(F.when(hit & ~risky, F.lit(factor)))
        else:
            positive.append(F.when(hit, F.lit(factor)))
    plus = F.array_sort(F.array_compact(F.array(*positive)))
    minus = F.array_sort(F.array_compact(F.array(*negative))) if negative else F.array().cast("array<string>")
    plus = F.when(F.size(plus) > 0, plus).otherwise(F.array(F.lit("momentum_20d")))
    fallback = contains_any(lowered, ["risk", "volatility"])
    minus = F.when((F.size(minus) == 0) & fallback, F.array(F.lit("volatility_20d"))).otherwise(minus)
    return plus, minus


def holding_period(lowered: Column) -> Column:
    """First "<n> day" phrase when n is 1..252, else 21 for monthly, else 5."""
    digits = F.regexp_extract(lowered, r"(\d+)[-\s]*(day|trading day)", 1)
    value = F.when(F.length(F.ltrim(digits, F.lit("0"))).between(1, 3), digits.cast("int"))
    return (
        F.when(value.between(1, 252), value)
        .when(F.contains(lowered, F.lit("monthly")), F.lit(21))
        .otherwise(F.lit(5))
    )


def hypothesis(cleaned: Column, positive: Column, negative: Column, period: Column) -> Column:
    """First sentence (at most 280 characters) when it has 40 characters or more, else a template."""
    first = F.trim(F.substring_index(cleaned, ".", 1))
    weaker = F.when(F.size(negative) > 0, F.array_join(negative, ", ")).otherwise(F.lit("risk"))
    template = F.format_string(
        "Assets with stronger %s and weaker %s should outperform over the next %d trading days.",
        F.array_join(positive, ", "),
        weaker,
        period,
    )
    return F.when(F.length(first) >= 40, F.left(first, F.lit(280))).otherwise(template)


def slug(text: Column, default: str = "paper_alpha_template") -> Column:
    """Lower-case words joined by underscores; empty becomes ``default``."""
    joined = F.lower(F.trim(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def concept_hits(lowered: Column, words: list[str] | None = None) -> Column:
    """Array of the listed concepts that occur, in list order."""
    listed = UNSUPPORTED_CONCEPTS if words is None else words
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in listed]))


def extraction_confidence(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) < 500, 0.55).otherwise(0.70)


def token_estimate(text: Column) -> Column:
    """One token per four characters, rounded up; empty text has none."""
    return F.ceil(F.length(text) / 4.0).cast("long")
