"""Catalogue: factor library, diagnostics and signal construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import borrow as bor
from panelweave.operators import factors as fac
from panelweave.operators import signals as sig
from panelweave.operators.portfolio import target_weights
from panelweave.plans.as_of import signal_as_of, signals_as_of
from panelweave.plans.catalog import fixtures as fx
from panelweave.plans.catalog.data import sql_normal

ENTRIES: dict[str, tuple] = {}
MIN_LIQUIDITY = 0.2
AS_OF = "2000-10-20"
SELECTED = [*fx.POSITIVE, *fx.NEGATIVE, "reversal_5d", "reversal_20d", "moving_average_gap_20d"]


def entry(key: str, sql: str | None = None):
    def register(fn):
        ENTRIES[key] = (fn, sql)
        return fn

    return register


# ---------------------------------------------------------------- factors

for _name in fac.FACTOR_NAMES:
    ENTRIES[f"fac_{_name}"] = (
        lambda spark, sf, n=_name: fx.rounded(fac.with_factors(fx.panel(spark, sf), [n]), n).select("date", "symbol", n),
        # The engine's panel has no row for a missing cell, so the grid's empty cells are left out here too.
        f"WITH {fx.FACTORS} SELECT date, symbol, round({_name}, 6) AS {_name} FROM factors WHERE c IS NOT NULL",
    )


@entry(
    "fac_24_library",
    f"WITH {fx.FACTORS} SELECT date, symbol, {', '.join(f'round({n}, 6) AS {n}' for n in fac.FACTOR_NAMES)} FROM factors WHERE c IS NOT NULL",
)
def fac_24(spark, sf):
    return fx.rounded(fac.with_factors(fx.panel(spark, sf)), *fac.FACTOR_NAMES).select("date", "symbol", *fac.FACTOR_NAMES)


FALLING = """falling AS (
  SELECT c_custkey % 50 AS pos, concat('F', c_custkey // 50) AS symbol, 100.0 - (c_custkey % 50) * 1.5 - (c_custkey % 3) * 0.1 AS c FROM customer)"""


@entry(
    "fac_11_downside_falling",
    f"""WITH {FALLING}, r AS (SELECT *, c / lag(c) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS r FROM falling),
d AS (SELECT *, CASE WHEN r < 0 THEN r END AS down FROM r)
SELECT pos, symbol, round(CASE WHEN count(down) OVER w20 = 20 THEN stddev_samp(down) OVER w20 END, 6) AS downside_volatility_20d
FROM d WINDOW w20 AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING)""",
)
def fac_11_falling(spark, sf):
    """The same factor on price paths that only fall, where it has values."""
    k = F.col("c_custkey")
    rows = fx.table(spark, sf, "customer").select(
        (k % 50).cast("int").alias("date_idx"),
        F.concat(F.lit("F"), F.floor(k / 50).cast("string")).alias("symbol"),
        (100.0 - (k % 50) * 1.5 - (k % 3) * 0.1).alias("adj_close"),
        F.lit(1.0).alias("volume"),
    )
    out = fac.with_factors(rows, ["downside_volatility_20d"])
    return fx.rounded(out, "downside_volatility_20d").select(
        F.col("date_idx").cast("long").alias("pos"), "symbol", "downside_volatility_20d"
    )


@entry(
    "fac_26_coverage",
    "WITH " + fx.FACTORS + "\n" + "\nUNION ALL ".join(
        f"SELECT '{n}' AS factor, count({n}) AS observations, round(count({n}) / count(*), 6) AS coverage, "
        f"round(1 - count({n}) / count(*), 6) AS missing_rate FROM factors"
        for n in fac.FACTOR_NAMES
    ),
)
def fac_26(spark, sf):
    out = fac.factor_coverage(fac.with_factors(fx.panel(spark, sf)), fac.FACTOR_NAMES)
    return fx.rounded(out, "coverage", "missing_rate")




def pairs_sql(names: list[str]) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, round({a}, 12) AS x, round({b}, 12) AS y FROM factors WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    )
    return f"""WITH {fx.FACTORS}, pairs AS ({each}),
ranked AS (SELECT first, second,
    rank() OVER (PARTITION BY first, second ORDER BY x) + (count(*) OVER (PARTITION BY first, second, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY first, second ORDER BY y) + (count(*) OVER (PARTITION BY first, second, y) - 1) / 2.0 AS ry FROM pairs),
found AS (SELECT first, second, corr(rx, ry) AS correlation, count(*) AS n_rows FROM ranked GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT first, second, round(correlation, 6) AS correlation, n_rows FROM found WHERE abs(correlation) >= 0.75 AND NOT isnan(correlation)"""


@entry("fac_27_redundant_pairs", pairs_sql(SELECTED))
def fac_27(spark, sf):
    wide = fac.with_factors(fx.panel(spark, sf), SELECTED)
    return fx.rounded(fac.redundant_pairs(wide, SELECTED), "correlation")


@entry("fac_27_all_factors", pairs_sql(fac.FACTOR_NAMES))
def fac_27_all(spark, sf):
    wide = fac.with_factors(fx.panel(spark, sf), fac.FACTOR_NAMES)
    return fx.rounded(fac.redundant_pairs(wide, fac.FACTOR_NAMES), "correlation")


# ---------------------------------------------------------------- signals


def pct_sql(name: str, source: str = "factors") -> str:
    x = f"round({name}, 12)"
    return (
        f"CASE WHEN {name} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({name}) OVER (PARTITION BY date) END"
    )


_RANKED = ["momentum_20d", "momentum_60d", "volatility_20d", "drawdown_20d", "reversal_5d", "dollar_volume_20d"]
RANKS = f"""{fx.FACTORS},
ranks AS MATERIALIZED (SELECT *, {", ".join(f"{pct_sql(n)} AS pct_{n}" for n in _RANKED)} FROM factors WHERE c IS NOT NULL)"""

_AGENT = "round(pct_momentum_20d + pct_momentum_60d - (pct_volatility_20d + pct_drawdown_20d), 12)"
SIGNALS = f"""{RANKS},
base AS MATERIALIZED (SELECT *, {_AGENT} AS agent, CASE WHEN {_AGENT} IS NOT NULL THEN concat('G', symbol_no % 4) END AS sector FROM ranks),
neutral AS MATERIALIZED (SELECT *, CASE WHEN agent IS NOT NULL THEN round(agent - avg(agent) OVER (PARTITION BY date, sector), 12) END AS neutralized FROM base)"""


def panel_factors(spark, sf, names=None, holding=()):
    rows = fac.with_factors(fx.panel(spark, sf), names or [*fx.POSITIVE, *fx.NEGATIVE])
    return fac.with_forward_returns(rows, list(holding)) if holding else rows


@entry(
    "sig_1_percent_rank",
    f"WITH {RANKS} SELECT date, symbol, round(pct_drawdown_20d, 6) AS pct_drawdown_20d, round(pct_momentum_20d, 6) AS pct_momentum_20d FROM ranks",
)
def sig_1(spark, sf):
    names = ["drawdown_20d", "momentum_20d"]
    out = sig.with_percent_ranks(panel_factors(spark, sf, names), {f"pct_{n}": n for n in names})
    return fx.rounded(out, "pct_drawdown_20d", "pct_momentum_20d").select("date", "symbol", "pct_drawdown_20d", "pct_momentum_20d")


def agent(spark, sf, extra=(), holding=()):
    rows = panel_factors(spark, sf, [*fx.POSITIVE, *fx.NEGATIVE, *extra], holding)
    return sig.composite_signal(rows, fx.POSITIVE, fx.NEGATIVE)


@entry("sig_2_composite", f"WITH {SIGNALS} SELECT date, symbol, round(agent, 9) AS signal FROM base WHERE agent IS NOT NULL")
def sig_2(spark, sf):
    return fx.rounded(agent(spark, sf), "signal", digits=9).select("date", "symbol", "signal")


@entry(
    "sig_3_baseline_keys",
    f"WITH {SIGNALS} SELECT date, symbol, round(pct_reversal_5d, 9) AS signal FROM base WHERE agent IS NOT NULL AND pct_reversal_5d IS NOT NULL",
)
def sig_3(spark, sf):
    baseline = sig.composite_signal(panel_factors(spark, sf, ["reversal_5d"]), ["reversal_5d"], [])
    return fx.rounded(sig.restrict_to_keys(baseline, agent(spark, sf)), "signal", digits=9).select("date", "symbol", "signal")


_SEED, _DAY = "'12345'", "strftime(date, '%Y-%m-%d')"
RANDOM_SQL = f"round({sql_normal(_SEED, _DAY, 'symbol')}, 12)"


@entry(
    "sig_4_random_signal",
    f"WITH {SIGNALS} SELECT date, symbol, round({RANDOM_SQL}, 6) AS signal FROM base WHERE agent IS NOT NULL",
)
def sig_4(spark, sf):
    return agent(spark, sf).select("date", "symbol", fx.r6(sig.random_signal()).alias("signal"))


@entry("sig_5_sector_neutral", f"WITH {SIGNALS} SELECT date, symbol, round(neutralized, 9) AS signal FROM neutral WHERE agent IS NOT NULL")
def sig_5(spark, sf):
    rows = agent(spark, sf).withColumn("sector", fx.sector(F.col("symbol_no")))
    return fx.rounded(sig.neutralize(rows), "signal", digits=9).select("date", "symbol", "signal")


def with_agent_kept(spark, sf):
    """All panel rows with the agent signal (null where it has none), for filters that rank every symbol."""
    names = list(dict.fromkeys([*fx.POSITIVE, *fx.NEGATIVE]))
    rows = panel_factors(spark, sf, [*names, "dollar_volume_20d"])
    ranked = sig.with_percent_ranks(rows, {f"pct_{n}": n for n in names})
    return ranked.withColumn("signal", sig.composite(fx.POSITIVE, fx.NEGATIVE))


@entry(
    "sig_6_liquidity_filter",
    f"WITH {SIGNALS} SELECT date, symbol, round(agent, 9) AS signal FROM base WHERE agent IS NOT NULL AND pct_dollar_volume_20d >= {MIN_LIQUIDITY}",
)
def sig_6(spark, sf):
    return fx.rounded(sig.liquidity_filter(with_agent_kept(spark, sf), MIN_LIQUIDITY), "signal", digits=9).select("date", "symbol", "signal")


@entry(
    "sig_7_neutral_liquid",
    f"""WITH {SIGNALS} SELECT 'sector_neutral_liquidity_top_80pct' AS strategy, date, symbol, round(neutralized, 9) AS signal
FROM neutral WHERE agent IS NOT NULL AND pct_dollar_volume_20d >= {MIN_LIQUIDITY}""",
)
def sig_7(spark, sf):
    rows = with_agent_kept(spark, sf)
    sectors = F.when(F.col("signal").isNotNull(), fx.sector(F.col("symbol_no")))
    out = sig.liquidity_filter(sig.neutralize(rows.withColumn("sector", sectors)), MIN_LIQUIDITY)
    name = F.lit("sector_neutral_" + sig.liquidity_name(MIN_LIQUIDITY)).alias("strategy")
    return fx.rounded(out, "signal", digits=9).select(name, "date", "symbol", "signal")


AS_OF_SQL = f"""{SIGNALS}, {fx.BORROW},
as_of_day AS (SELECT b.date, b.symbol, b.symbol_no, agent AS signal, coalesce(w.shortable, false) AND b.symbol_no % 9 <> 8 AS can_short
  FROM base b LEFT JOIN borrow w ON w.date = b.date AND w.symbol = b.symbol
  WHERE agent IS NOT NULL AND b.date = (SELECT max(date) FROM base WHERE agent IS NOT NULL AND date <= DATE '{AS_OF}')),
acut AS (SELECT count(*) AS n, round(quantile_cont(signal, {fx.QUANTILE}), 12) AS lo, round(quantile_cont(signal, {1 - fx.QUANTILE}), 12) AS hi FROM as_of_day),
alegs AS (SELECT d.*, n, signal >= hi AS il, signal <= lo AND can_short AS ish FROM as_of_day d, acut),
aw AS (SELECT *, count(*) FILTER (WHERE il) OVER () AS nl, count(*) FILTER (WHERE ish) OVER () AS ns FROM alegs),
weights AS (SELECT *, CASE WHEN n < 5 THEN 0.0 WHEN ish THEN -1.0 / ns WHEN il THEN 1.0 / nl ELSE 0.0 END AS target_weight,
   row_number() OVER (ORDER BY signal DESC, symbol) AS rank FROM aw)"""


def as_of_rows(spark, sf):
    """Signal of the last date on or before AS_OF with the locates of that date; history is cut to what the factors can reach."""
    day = signal_as_of(fx.panel(spark, sf), AS_OF, fx.POSITIVE, fx.NEGATIVE, fx.dates(spark, sf))
    dates = day.select("date").distinct()
    own = fx.borrow(spark, sf).join(F.broadcast(dates.select(F.col("date").alias("day"))), F.col("date").cast("date") == F.col("day"), "left_semi")
    return bor.attach_borrow(day, bor.normalize_borrow(own, dates))


# Requested days: in the week of a date, on a date, the day before it, years apart, and before the first signal.
AS_OF_DAYS = ["1999-03-03", "1999-03-08", "1999-03-07", AS_OF, "2001-11-30", "1990-01-01"]


@entry(
    "sig_8_many_dates",
    f"""WITH {SIGNALS}, {fx.BORROW}, asked(as_of) AS (VALUES {', '.join(f"(DATE '{d}')" for d in AS_OF_DAYS)}),
days AS (SELECT as_of, (SELECT max(date) FROM base WHERE agent IS NOT NULL AND date <= as_of) AS date FROM asked),
picked AS (SELECT d.as_of, b.date, b.symbol, agent AS signal, coalesce(w.shortable, false) AND b.symbol_no % 9 <> 8 AS can_short
  FROM days d JOIN base b ON b.date = d.date AND b.agent IS NOT NULL LEFT JOIN borrow w ON w.date = b.date AND w.symbol = b.symbol),
pcut AS (SELECT as_of, count(*) AS n, round(quantile_cont(signal, {fx.QUANTILE}), 12) AS lo, round(quantile_cont(signal, {1 - fx.QUANTILE}), 12) AS hi FROM picked GROUP BY 1),
plegs AS (SELECT p.*, n, signal >= hi AS il, signal <= lo AND can_short AS ish FROM picked p JOIN pcut USING (as_of)),
pw AS (SELECT *, count(*) FILTER (WHERE il) OVER (PARTITION BY as_of) AS nl, count(*) FILTER (WHERE ish) OVER (PARTITION BY as_of) AS ns FROM plegs),
rows AS (SELECT *, CASE WHEN n < 5 THEN 0.0 WHEN ish THEN -1.0 / ns WHEN il THEN 1.0 / nl ELSE 0.0 END AS target_weight FROM pw)
SELECT as_of, date, symbol, round(signal, 9) AS signal, row_number() OVER (PARTITION BY as_of ORDER BY signal DESC, symbol) AS rank, round(target_weight, 6) AS target_weight,
  CASE WHEN target_weight <> 0 THEN 'pass' ELSE 'watch' END AS risk_status, 'positive={', '.join(fx.POSITIVE)}; negative={', '.join(fx.NEGATIVE)}' AS reason,
  concat_ws(' ', CASE WHEN n < 5 THEN 'Fewer than five assets were available for portfolio construction.' END,
    CASE WHEN n >= 5 AND nl = 0 THEN 'No long candidates passed the configured quantile.' END,
    CASE WHEN n >= 5 AND ns = 0 THEN 'No short candidates passed configured shortability constraints.' END) AS warnings FROM rows""",
)
def sig_8_many(spark, sf):
    asked = spark.createDataFrame([(d,) for d in AS_OF_DAYS], "as_of string").select(F.col("as_of").cast("date").alias("as_of"))
    out = signals_as_of(fx.panel(spark, sf), asked, fx.POSITIVE, fx.NEGATIVE, fx.QUANTILE, fx.dates(spark, sf), fx.borrow(spark, sf), F.col("symbol_no") % 9 != 8)
    out = out.withColumns({"signal": F.round("signal", 9), "target_weight": F.round("target_weight", 6), "warnings": F.concat_ws(" ", "warnings")})
    return out.select("as_of", "date", "symbol", "signal", "rank", "target_weight", "risk_status", "reason", "warnings")


@entry("sig_8_as_of_rank", f"WITH {AS_OF_SQL} SELECT date, symbol, round(signal, 9) AS signal, rank FROM weights")
def sig_8(spark, sf):
    return fx.rounded(sig.rank_as_of(as_of_rows(spark, sf)), "signal", digits=9).select("date", "symbol", "signal", "rank")


def as_of_weights(spark, sf):
    may_short = F.col("shortable") & (F.col("symbol_no") % 9 != 8)
    return target_weights(as_of_rows(spark, sf), fx.QUANTILE, may_short)


@entry(
    "sig_9_as_of_weights",
    f"""WITH {AS_OF_SQL} SELECT date, symbol, round(target_weight, 6) AS target_weight,
CASE WHEN target_weight <> 0 THEN 'pass' ELSE 'watch' END AS risk_status, n < 5 AS too_few, n >= 5 AND nl = 0 AS no_longs, n >= 5 AND ns = 0 AS no_shorts FROM weights""",
)
def sig_9(spark, sf):
    out = as_of_weights(spark, sf)
    return fx.rounded(out, "target_weight").select(
        "date", "symbol", "target_weight", "risk_status", "too_few", "no_longs", "no_shorts"
    )


@entry(
    "sig_10_order_sizing",
    f"""WITH {AS_OF_SQL} SELECT symbol, CASE WHEN target_weight > 0 THEN 'buy' ELSE 'sell_short' END AS side,
  round(target_weight, 6) AS target_weight, round(target_weight * 1000000, 6) AS target_notional,
  round(CASE WHEN least(abs(target_weight), 1) <= 0.25 THEN target_weight * 1000000 ELSE 0 END, 6) AS scheduled_notional,
  round(least(abs(target_weight), 1), 6) AS estimated_participation,
  CASE WHEN least(abs(target_weight), 1) <= 0.25 THEN 'scheduled' ELSE 'blocked' END AS status,
  CASE WHEN least(abs(target_weight), 1) <= 0.25 THEN 'within participation limit' ELSE 'participation limit breached' END AS reason
FROM weights WHERE target_weight <> 0""",
)
def sig_10(spark, sf):
    out = sig.size_orders(as_of_weights(spark, sf), 1_000_000.0, 0.25)
    return fx.rounded(out, "target_weight", "target_notional", "scheduled_notional", "estimated_participation")
