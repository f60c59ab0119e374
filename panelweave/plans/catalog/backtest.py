"""Catalogue: portfolios, costs, splits, metrics, variant grids and validity."""

from __future__ import annotations

import math
from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.config import RANDOM_BASELINE, ResearchConfig, Strategy
from panelweave.functions.numeric import ERF_SMALL, ERFC_LARGE, ERFC_MIDDLE, MIDDLE_UP_TO, SMALL_UP_TO
from panelweave.operators import borrow as bor
from panelweave.operators import evaluate, portfolio, variants
from panelweave.operators.provenance import snapshot_provenance
from panelweave.operators.quality import READINESS, data_readiness
from panelweave.operators.universe import normalize_membership, static_membership
from panelweave.plans.batch import COMPARED, TOO_SHORT, Batch, parse_settings
from panelweave.plans.catalog import fixtures as fx
from panelweave.plans.catalog.signals import MIN_LIQUIDITY, RANDOM_SQL, SIGNALS
from panelweave.plans.research import Research, claimed_flags
from panelweave.session import stage
from panelweave.sources.panel import calendar, with_date_index

ENTRIES: dict[str, tuple] = {}

FULL = ResearchConfig(
    signal=Strategy("agent_signal", fx.POSITIVE, fx.NEGATIVE),
    holding_period=fx.HOLD,
    rebalance_days=fx.REBALANCE,
    quantile=fx.QUANTILE,
    train_fraction=fx.TRAIN,
    holdout_fraction=fx.HOLDOUT,
    transaction_cost_bps=fx.BASE_BPS,
    spread_cost_bps=fx.SPREAD_BPS,
    market_impact_coefficient=fx.IMPACT,
    portfolio_notional=fx.NOTIONAL,
    borrow_fee_bps=fx.FEE_BPS,
    baselines=[
        Strategy("momentum_20d_only", ["momentum_20d"], []),
        Strategy("low_volatility_only", [], ["volatility_20d"]),
        Strategy("reversal_5d_only", ["reversal_5d"], []),
        Strategy(RANDOM_BASELINE),
    ],
    walk_forward_windows=fx.WINDOWS,
    walk_forward_min_train=fx.MIN_TRAIN,
    sector_neutral=True,
    liquidity_min_rank=MIN_LIQUIDITY,
    bootstrap_iterations=200,
    holding_grid=fx.HOLDING_GRID,
    quantile_grid=fx.QUANTILE_GRID,
    cost_multipliers=fx.MULTIPLIERS,
    notionals=fx.NOTIONALS,
    max_trade_participation=0.10,
    max_position_weight=0.35,
)
AGENT = replace(
    FULL, baselines=[], sector_neutral=False, liquidity_min_rank=None, holding_grid=[], quantile_grid=[],
    cost_multipliers=[], notionals=[],
)
PARAMETERS = replace(AGENT, holding_grid=fx.HOLDING_GRID, quantile_grid=fx.QUANTILE_GRID)
COSTS = replace(AGENT, cost_multipliers=fx.MULTIPLIERS)
CAPACITY = replace(AGENT, notionals=fx.NOTIONALS)
BASELINES = replace(AGENT, baselines=FULL.baselines)
STRESS = replace(AGENT, sector_neutral=True, liquidity_min_rank=MIN_LIQUIDITY)


ALL_METRICS = [*evaluate.PERFORMANCE_METRICS[1:], *evaluate.COST_METRICS]
_BARS: dict[tuple[str, str], DataFrame] = {}
_RUNS: dict[tuple[str, str], Research] = {}
_VIEWS: dict[tuple[str, str], list[Research]] = {}
_BATCHES: dict[tuple[str, str], Batch] = {}


def full_run(spark, sf) -> Research:
    """A fresh run of the whole grid. The bars are written once per session, for its panel, calendar and locates."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BARS:
        _BARS[key] = stage(fx.market(spark, sf).withColumn("sector", fx.sector(F.col("symbol_no"))), "bars")
    dates = calendar(_BARS[key])
    panel = with_date_index(_BARS[key], dates)
    may_short = F.substring("symbol", 2, 6).cast("int") % 9 != 8
    locates = bor.normalize_borrow(fx.borrow(spark, sf, panel), dates)
    return Research(panel, FULL, locates, may_short)


# Configurations of the batch: three that run, one whose dates do not suffice and two that are invalid.
_VALUES = {f.name: getattr(AGENT, f.name) for f in fields(AGENT)}
_REVERSAL = Strategy("agent_signal", ["reversal_5d"], [])
BATCH = {
    "base": _VALUES | {"baselines": FULL.baselines[:1]},
    "slow": _VALUES | {"holding_period": 10, "rebalance_days": 7, "quantile": 0.3, "transaction_cost_bps": 20.0, "train_fraction": 0.6, "holdout_fraction": 0.2},
    "too_wide": _VALUES | {"quantile": 0.6},
    "reversal": _VALUES | {"signal": {"name": "agent_signal", "positive": ["reversal_5d"]}, "holding_period": 3, "borrow_fee_bps": 10.0},
    "sparse": _VALUES | {"rebalance_days": 100_000},
    "unknown": _VALUES | {"signal": {"name": "agent_signal", "negative": ["no_such_factor"]}},
}
BATCH_INVALID = {"too_wide": "quantile must be between 0 and 0.5", "unknown": "unknown factors requested: ['no_such_factor']"}


def batch(spark, sf) -> Batch:
    """The session's batch over the same panel, locates and shorting rule as the full run; its tables are made once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BATCHES:
        full = full_run(spark, sf)
        _BATCHES[key] = Batch(full.panel, BATCH, full.borrow, full.may_short)
    return _BATCHES[key]


def batch_sql(tail: str) -> str:
    """Each configuration that can run as a run of its own; ``tail`` reads done (config, variants, name, family, split, metrics)."""
    parts = []
    for name, values in BATCH.items():
        if name not in BATCH_INVALID:
            config = parse_settings(values)
            own = {"agent_signal": "round(pct_reversal_5d, 12)"} if name == "reversal" else _SIGNAL_SQL
            columns = f"(SELECT count(*) FROM bounds) AS fitting, name, family, split, observations, {', '.join(ALL_METRICS)}"
            parts.append(f"SELECT '{name}' AS config, {len(config.variants())} AS wanted, * FROM ({run_sql(config, f'SELECT {columns} FROM metrics', own)}) m_{name}")
    errors = {name: "'" + error.replace("'", "''") + "'" for name, error in BATCH_INVALID.items()}
    asked = ", ".join(f"('{name}', {i}, {errors.get(name, 'NULL')})" for i, name in enumerate(BATCH))
    return f"""WITH every AS MATERIALIZED ({' UNION ALL '.join(parts)}),
done AS (SELECT * FROM every WHERE fitting = wanted),
asked(config, place, invalid) AS (VALUES {asked}),
outcomes AS (SELECT config, place, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error FROM (
  SELECT config, place, coalesce(invalid, CASE WHEN config NOT IN (SELECT config FROM done) THEN '{TOO_SHORT}' END) AS error FROM asked))
{tail}"""


def run(spark, sf, config: ResearchConfig) -> Research:
    """View of the session's full run for one configuration; the tables of run and views are made once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = full_run(spark, sf)
    full = _RUNS[key]
    if config is FULL:
        return full
    views = _VIEWS.setdefault(key, [])
    for view in views:
        if view.config is config:
            return view
    views.append(Research(full.panel, config, full.borrow, full.may_short).adopt(full))
    return views[-1]


def entry(key: str, sql: str | None = None):
    def register(fn):
        ENTRIES[key] = (fn, sql)
        return fn

    return register


# ---------------------------------------------------------------- the run as SQL

_SIGNAL_SQL = {
    "agent_signal": "agent",
    "momentum_20d_only": "CASE WHEN agent IS NOT NULL THEN round(pct_momentum_20d, 12) END",
    "low_volatility_only": "CASE WHEN agent IS NOT NULL THEN round(-pct_volatility_20d, 12) END",
    "reversal_5d_only": "CASE WHEN agent IS NOT NULL THEN round(pct_reversal_5d, 12) END",
    RANDOM_BASELINE: f"CASE WHEN agent IS NOT NULL THEN {RANDOM_SQL} END",
    "sector_neutral_signal": "neutralized",
    "liquidity_top_80pct": f"CASE WHEN pct_dollar_volume_20d >= {MIN_LIQUIDITY} THEN agent END",
    "sector_neutral_liquidity_top_80pct": f"CASE WHEN pct_dollar_volume_20d >= {MIN_LIQUIDITY} THEN neutralized END",
}
_CUTS = sorted({q for q in [fx.QUANTILE, *fx.QUANTILE_GRID]})
_COSTS_SQL = ["total_cost", "base_cost", "spread_cost", "impact_cost", "borrow_cost"]


def _pick(side: str) -> str:
    return "CASE " + " ".join(f"WHEN q = {q} THEN {side}{i}" for i, q in enumerate(_CUTS)) + " END"


def metrics_sql(rows: str, keys: str, extra: str = "") -> str:
    """CTE body: metric columns of ``rows`` per ``keys`` (columns net, ic, di, date, h and costs)."""
    averages = ", ".join(f"coalesce(avg({c}) FILTER (WHERE net IS NOT NULL), 0) AS average_{c}" for c in _COSTS_SQL)
    return f"""
  SELECT {keys}{extra}, count(net) AS observations, coalesce(avg(ic), 0) AS ic_mean,
    CASE WHEN count(ic) > 1 THEN stddev_samp(ic) ELSE 0 END AS ic_std,
    CASE WHEN count(ic) > 1 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) ELSE 0 END AS ic_tstat,
    coalesce(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END), 0) AS ic_hit_rate,
    CASE WHEN count(net) > 1 AND stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252.0 / max(h)) ELSE 0 END AS sharpe,
    coalesce(min(equity / peak - 1) FILTER (WHERE net IS NOT NULL), 0) AS max_drawdown,
    coalesce(avg(turnover) FILTER (WHERE net IS NOT NULL), 0) AS average_turnover,
    CASE WHEN count(net) > 0 THEN product(1 + net) - 1 ELSE 0 END AS total_return, coalesce(avg(net), 0) AS mean_period_return,
    {averages}, coalesce(sum(total_cost) FILTER (WHERE net IS NOT NULL), 0) AS cumulative_total_cost,
    coalesce(avg(average_trade_participation) FILTER (WHERE net IS NOT NULL), 0) AS average_trade_participation,
    coalesce(max(max_trade_participation) FILTER (WHERE net IS NOT NULL), 0) AS max_trade_participation
  FROM (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY di) AS peak FROM (
    SELECT *, product(1 + net) OVER (PARTITION BY {keys} ORDER BY di) AS equity FROM {rows}) e) p GROUP BY {keys}"""


def run_sql(config: ResearchConfig, tail: str, signal_sql: dict[str, str] = _SIGNAL_SQL) -> str:
    grid = config.variants()
    positions = list({v.position: v for v in grid}.values())
    aligned = "\n  UNION ALL ".join(
        f"SELECT '{v.position}' AS position, date, di, symbol, symbol_no, {signal_sql[v.strategy]} AS signal, fwd_{v.holding_period} AS fwd, adv, can_short, fee, "
        f"{v.quantile}::DOUBLE AS q, {v.holding_period} AS h FROM wide WHERE {signal_sql[v.strategy]} IS NOT NULL AND fwd_{v.holding_period} IS NOT NULL"
        for v in positions
    )
    names = ", ".join(
        f"('{v.variant}', '{v.name}', '{v.family}', '{v.position}', {float(v.cost_multiplier)}::DOUBLE, {float(v.notional)}::DOUBLE, {i}, {v.quantile}::DOUBLE)"
        for i, v in enumerate(grid)
    )
    cuts = ", ".join(
        f"round(quantile_cont(signal, {q}), 12) AS lo{i}, round(quantile_cont(signal, {1.0 - q}), 12) AS hi{i}"
        for i, q in enumerate(_CUTS)
    )
    hf = config.effective_holdout
    return f"""WITH {SIGNALS}, {fx.BORROW},
wide AS MATERIALIZED (
  SELECT n.*, coalesce(w.shortable, false) AND n.symbol_no % 9 <> 8 AS can_short, coalesce(w.borrow_fee_bps, {config.borrow_fee_bps}) AS fee
  FROM neutral n LEFT JOIN borrow w ON w.date = n.date AND w.symbol = n.symbol),
candidates AS MATERIALIZED ({aligned}),
rebalance AS (
  SELECT position, date FROM (SELECT position, date, row_number() OVER (PARTITION BY position ORDER BY date) - 1 AS i
    FROM (SELECT DISTINCT position, date FROM candidates) d) x WHERE i % {config.rebalance_days} = 0),
aligned AS MATERIALIZED (SELECT c.* FROM candidates c JOIN rebalance r ON r.position = c.position AND r.date = c.date),
cuts AS (SELECT position, date, count(*) AS n, {cuts} FROM aligned GROUP BY 1, 2),
legs AS (SELECT a.*, n, signal >= {_pick("hi")} AS il, signal <= {_pick("lo")} AND can_short AS ish
  FROM aligned a JOIN cuts c ON c.position = a.position AND c.date = a.date),
counted AS (SELECT *, count(*) FILTER (WHERE il) OVER w AS nl, count(*) FILTER (WHERE ish) OVER w AS ns FROM legs WINDOW w AS (PARTITION BY position, date)),
positions AS MATERIALIZED (
  SELECT *, CASE WHEN ish THEN -1.0::DOUBLE / ns WHEN il THEN 1.0::DOUBLE / nl ELSE 0.0 END AS weight FROM counted WHERE n >= 5 AND nl > 0 AND ns > 0),
held_dates AS (SELECT position, date, lag(date) OVER (PARTITION BY position ORDER BY date) AS prev FROM (SELECT DISTINCT position, date FROM positions) d),
trades AS MATERIALIZED (
  SELECT p.*, abs(p.weight - coalesce(b.weight, 0)) AS trade FROM positions p
  JOIN held_dates d ON d.position = p.position AND d.date = p.date
  LEFT JOIN positions b ON b.position = p.position AND b.symbol = p.symbol AND b.date = d.prev),
book AS MATERIALIZED (
  SELECT position, date, di, h, sum(weight * fwd) AS raw_return, sum(trade) AS turnover,
    sum(trade * coalesce(trade / nullif(adv, 0), 0)) AS impact_unit, coalesce(max(trade / nullif(adv, 0)), 0) AS part_unit,
    sum(greatest(-weight, 0) * fee / 10000.0) AS borrow_unit FROM trades GROUP BY 1, 2, 3, 4),
ic_ranks AS (
  SELECT position, date, di, h, round(signal, 12) AS s, round(fwd, 12) AS f,
    rank() OVER (PARTITION BY position, date ORDER BY round(signal, 12)) + (count(*) OVER (PARTITION BY position, date, round(signal, 12)) - 1) / 2.0 AS rs,
    rank() OVER (PARTITION BY position, date ORDER BY round(fwd, 12)) + (count(*) OVER (PARTITION BY position, date, round(fwd, 12)) - 1) / 2.0 AS rf
  FROM aligned),
ics AS MATERIALIZED (SELECT position, date, di, h, corr(rs, rf) AS ic FROM ic_ranks GROUP BY 1, 2, 3, 4
  HAVING count(DISTINCT s) >= 2 AND count(DISTINCT f) >= 2),
grid_rows(variant, name, family, position, m, notional, place, quantile) AS (VALUES {names}),
both_sides AS (SELECT coalesce(b.position, i.position) AS position, coalesce(b.date, i.date) AS date, coalesce(b.di, i.di) AS di,
    coalesce(b.h, i.h) AS h, raw_return, turnover, impact_unit, part_unit, borrow_unit, ic
  FROM book b FULL JOIN ics i ON b.position = i.position AND b.date = i.date),
priced AS (
  SELECT variant, name, family, place, g.quantile, notional, m, b.*,
    coalesce(turnover * {config.transaction_cost_bps} * m / 10000.0, 0) AS base_cost, coalesce(turnover * {config.spread_cost_bps} * m / 10000.0, 0) AS spread_cost,
    coalesce(notional * impact_unit * {config.market_impact_coefficient} * m, 0) AS impact_cost, coalesce(borrow_unit * m * h / 252.0, 0) AS borrow_cost,
    coalesce(notional * impact_unit / nullif(turnover, 0), 0) AS average_trade_participation, coalesce(notional * part_unit, 0) AS max_trade_participation
  FROM both_sides b JOIN grid_rows g ON g.position = b.position),
daily AS MATERIALIZED (SELECT *, base_cost + spread_cost + impact_cost + borrow_cost AS total_cost,
    raw_return - (base_cost + spread_cost + impact_cost + borrow_cost) AS net FROM priced),
numbered AS (SELECT variant, date, di, row_number() OVER (PARTITION BY variant ORDER BY di) - 1 AS pos, count(*) OVER (PARTITION BY variant) AS n
  FROM daily WHERE net IS NOT NULL),
placed AS (SELECT *, n - greatest(1, ceil(n * {hf})) AS hpos FROM numbered),
placed2 AS (SELECT *, least(greatest(floor(n * {config.train_fraction}), 0), hpos - 2) AS tpos FROM placed),
bounds AS MATERIALIZED (SELECT variant, max(n) AS n, max(di) FILTER (WHERE pos = tpos) AS split_di, max(di) FILTER (WHERE pos = tpos + 1) AS val_di,
    max(di) FILTER (WHERE pos = hpos) AS hold_di, max(date) FILTER (WHERE pos = tpos) AS split_date, max(date) FILTER (WHERE pos = tpos + 1) AS validation_date,
    max(date) FILTER (WHERE pos = hpos) AS holdout_date FROM placed2 GROUP BY variant HAVING max(hpos) >= 2),
bounded AS MATERIALIZED (SELECT d.*, split_di, val_di, hold_di, di < hold_di AND di + h < hold_di AS pre FROM daily d JOIN bounds b ON b.variant = d.variant),
member AS (
  SELECT *, 'train' AS split FROM bounded WHERE di <= split_di
  UNION ALL SELECT *, 'validation' FROM bounded WHERE net IS NOT NULL AND di >= val_di AND pre
  UNION ALL SELECT *, 'test' FROM bounded WHERE net IS NOT NULL AND di >= val_di AND pre
  UNION ALL SELECT *, 'holdout' FROM bounded WHERE net IS NOT NULL AND di >= hold_di
  UNION ALL SELECT *, 'full' FROM bounded),
metrics AS MATERIALIZED ({metrics_sql("member", "variant, name, family, place, quantile, notional, m, h, split")}),
wf_pos AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY di) - 1 AS pos, count(*) OVER (PARTITION BY variant) AS n,
    min(date) OVER (PARTITION BY variant) AS first_date, lag(date) OVER (PARTITION BY variant ORDER BY di) AS previous
  FROM bounded WHERE net IS NOT NULL AND pre AND family IN ('primary', 'baseline', 'stress_test')),
wf_size AS (SELECT *, least(greatest(floor(n * {config.walk_forward_min_train}), 1), n - 1) AS first_pos FROM wf_pos WHERE n >= 4),
wf_count AS (SELECT *, least({config.walk_forward_windows}, n - first_pos) AS windows FROM wf_size),
wf_rows AS (SELECT *, printf('wf_%02d', CAST(least(floor((pos - first_pos) / greatest(1, floor((n - first_pos) / windows))), windows - 1) + 1 AS INTEGER)) AS "window"
  FROM wf_count WHERE pos >= first_pos),
windows AS MATERIALIZED ({metrics_sql("wf_rows", 'variant, "window"', ", min(first_date) AS train_start, arg_min(previous, di) AS train_end, min(date) AS test_start, max(date) AS test_end")})
{tail}"""


def sql6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# ---------------------------------------------------------------- portfolio operators


@entry("pos_1_quantile_positions", run_sql(AGENT, "SELECT date, symbol, round(weight, 6) AS weight, nl AS n_long, ns AS n_short FROM positions"))
def pos_1(spark, sf):
    return fx.rounded(run(spark, sf, AGENT).positions, "weight").select("date", "symbol", "weight", "n_long", "n_short")


@entry("pos_2_rebalance_dates", run_sql(AGENT, "SELECT DISTINCT date FROM rebalance"))
def pos_2(spark, sf):
    return run(spark, sf, AGENT).aligned.select("date").distinct()


@entry(
    "pos_3_forward_returns",
    f"WITH {fx.FACTORS} SELECT date, symbol, {', '.join(f'round(fwd_{h}, 6) AS fwd_{h}' for h in fx.HOLDING_GRID)} FROM factors WHERE c IS NOT NULL",
)
def pos_3(spark, sf):
    from panelweave.operators.factors import with_forward_returns

    names = [f"fwd_{h}" for h in fx.HOLDING_GRID]
    return fx.rounded(with_forward_returns(fx.panel(spark, sf), fx.HOLDING_GRID), *names).select("date", "symbol", *names)


@entry("pos_4_portfolio_return", run_sql(AGENT, "SELECT date, round(raw_return, 6) AS raw_return FROM book"))
def pos_4(spark, sf):
    return fx.rounded(run(spark, sf, AGENT).book, "raw_return").select("date", "raw_return")


@entry("pos_5_turnover", run_sql(AGENT, "SELECT date, round(turnover, 6) AS turnover FROM book"))
def pos_5(spark, sf):
    return fx.rounded(run(spark, sf, AGENT).book, "turnover").select("date", "turnover")


@entry("pos_6_adv", f"WITH {fx.FACTORS} SELECT date, symbol, round(adv, 4) AS adv FROM factors WHERE c IS NOT NULL")
def pos_6(spark, sf):
    from panelweave.operators.factors import with_adv

    return fx.rounded(with_adv(fx.panel(spark, sf)), "adv", digits=4).select("date", "symbol", "adv")


_COST_KEYS = {
    "cst_1_base_cost": ["base_cost"],
    "cst_2_spread_cost": ["spread_cost"],
    "cst_3_impact_cost": ["impact_cost"],
    "cst_4_borrow_cost": ["borrow_cost"],
    "cst_5_participation": ["average_trade_participation", "max_trade_participation"],
    "cst_6_total_cost": ["total_cost"],
}
for _key, _cols in _COST_KEYS.items():
    ENTRIES[_key] = (
        lambda spark, sf, c=_cols: fx.rounded(
            run(spark, sf, AGENT).daily.where(F.col("raw_return").isNotNull()), *c, digits=9
        ).select("date", *c),
        run_sql(AGENT, f"SELECT date, {', '.join(f'round({c}, 9) AS {c}' for c in _cols)} FROM daily WHERE net IS NOT NULL"),
    )


@entry("ret_1_net_return", run_sql(AGENT, "SELECT date, round(net, 6) AS net_return FROM daily WHERE net IS NOT NULL"))
def ret_1(spark, sf):
    daily = run(spark, sf, AGENT).daily.where(F.col("net_return").isNotNull())
    return fx.rounded(daily, "net_return").select("date", "net_return")


@entry("ic_1_information_coefficient", run_sql(AGENT, "SELECT date, round(ic, 6) AS ic FROM ics"))
def ic_1(spark, sf):
    return fx.rounded(run(spark, sf, AGENT).ic, "ic").select("date", "ic")


# ---------------------------------------------------------------- splits and metrics


@entry(
    "spl_1_two_way_split",
    run_sql(
        replace(AGENT, validity_enabled=False),
        f""", two AS (SELECT *, least(greatest(floor(n * {fx.TRAIN}), 1), n - 2) AS t FROM numbered)
SELECT variant, max(n) AS n, max(date) FILTER (WHERE pos = t) AS split_date, max(date) FILTER (WHERE pos = t + 1) AS validation_date FROM two GROUP BY variant""",
    ),
)
def spl_1(spark, sf):
    found = run(spark, sf, replace(AGENT, validity_enabled=False)).boundaries
    return found.select("variant", "n", "split_date", "validation_date")


@entry("spl_2_three_way_split", run_sql(AGENT, "SELECT variant, n, split_date, validation_date, holdout_date FROM bounds"))
def spl_2(spark, sf):
    return run(spark, sf, AGENT).boundaries.select("variant", "n", "split_date", "validation_date", "holdout_date")


@entry(
    "spl_3_purge",
    run_sql(AGENT, "SELECT date, di + h AS realized_idx, pre FROM bounded WHERE net IS NOT NULL"),
)
def spl_3(spark, sf):
    rows = run(spark, sf, AGENT).bounded.where(F.col("net_return").isNotNull())
    return rows.select(
        "date",
        (F.col("date_idx") + F.col("holding_period")).cast("long").alias("realized_idx"),
        evaluate.realized_before_holdout().alias("pre"),
    )


@entry("spl_4_split_metrics", run_sql(AGENT, f"SELECT variant, split, observations, {sql6(*ALL_METRICS)} FROM metrics"))
def spl_4(spark, sf):
    return fx.rounded(run(spark, sf, AGENT).metrics, *ALL_METRICS).select("variant", "split", "observations", *ALL_METRICS)


@entry(
    "spl_5_walk_forward",
    run_sql(AGENT, f"""SELECT "window", train_start, train_end, test_start, test_end, observations, {sql6(*ALL_METRICS)} FROM windows"""),
)
def spl_5(spark, sf):
    return fx.rounded(run(spark, sf, AGENT).walk_forward, *ALL_METRICS).select(
        "window", "train_start", "train_end", "test_start", "test_end", "observations", *ALL_METRICS
    )


@entry(
    "spl_6_walk_forward_summary",
    run_sql(
        BASELINES,
        """SELECT variant, count(*) AS windows, round(avg(ic_mean), 6) AS mean_ic, round(avg(sharpe), 6) AS mean_sharpe,
round(avg(average_total_cost), 6) AS mean_cost, round(avg(CASE WHEN ic_mean > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_ic_share,
round(quantile_cont(total_return, 0.5), 6) AS median_total_return FROM windows GROUP BY variant""",
    ),
)
def spl_6(spark, sf):
    names = ["mean_ic", "mean_sharpe", "mean_cost", "positive_ic_share", "median_total_return"]
    return fx.rounded(evaluate.walk_forward_summary(run(spark, sf, BASELINES).walk_forward), *names)


_METRIC_KEYS = {
    "met_1_observations": ["observations"],
    "met_2_ic_moments": ["ic_mean", "ic_std"],
    "met_3_ic_tstat": ["ic_tstat"],
    "met_4_ic_hit_rate": ["ic_hit_rate"],
    "met_5_sharpe": ["sharpe"],
    "met_6_max_drawdown": ["max_drawdown"],
    "met_7_average_turnover": ["average_turnover"],
    "met_8_returns": ["total_return", "mean_period_return"],
    "met_9_cost_metrics": evaluate.COST_METRICS,
}
for _key, _cols in _METRIC_KEYS.items():
    ENTRIES[_key] = (
        lambda spark, sf, c=_cols: fx.rounded(run(spark, sf, AGENT).metrics, *c).select("split", *c),
        run_sql(AGENT, f"SELECT split, {sql6(*_cols)} FROM metrics"),
    )


# ---------------------------------------------------------------- variant grids

_SHOWN = ["ic_mean", "sharpe", "max_drawdown", "total_return", "average_total_cost", "average_turnover"]


def _grid_entry(key: str, config: ResearchConfig, family: str) -> None:
    ENTRIES[key] = (
        lambda spark, sf: fx.rounded(run(spark, sf, config).family(family), *_SHOWN).select("name", "observations", *_SHOWN),
        run_sql(config, f"SELECT name, observations, {sql6(*_SHOWN)} FROM metrics WHERE family = '{family}' AND split = 'test'"),
    )


_grid_entry("var_1_baselines", BASELINES, "baseline")
_grid_entry("var_2_stress_tests", STRESS, "stress_test")
_grid_entry("var_3_parameter_grid", PARAMETERS, "parameter_sensitivity")
_grid_entry("var_4_cost_grid", COSTS, "cost_sensitivity")


@entry(
    "var_full_grid",
    run_sql(FULL, f"SELECT variant, split, observations, {', '.join(f'round({m}, 8) AS {m}' for m in ALL_METRICS)} FROM metrics"),
)
def var_full(spark, sf):
    """Every variant of the configuration and every split in one job."""
    # Eight digits: a mean of a few costs in basis points often lies halfway between two numbers of six.
    out = fx.rounded(run(spark, sf, FULL).metrics, *ALL_METRICS, digits=8)
    return out.select("variant", "split", "observations", *ALL_METRICS)


def _draw_sql(stream: str) -> str:
    return (
        f"CAST(concat('0x', substr(md5(concat_ws('|', '{FULL.bootstrap_seed}', '{stream}', CAST(b AS VARCHAR), CAST(i AS VARCHAR))), 1, 8)) AS BIGINT)"
    )


_BOOT = f""",
vals AS (SELECT * FROM bounded WHERE net IS NOT NULL AND di >= val_di AND di < hold_di),
rets AS (SELECT net AS x, h, row_number() OVER (ORDER BY di) - 1 AS pos FROM vals),
vics AS (SELECT ic AS x, row_number() OVER (ORDER BY di) - 1 AS pos FROM vals WHERE ic IS NOT NULL),
rdraw AS (SELECT b, {_draw_sql("return")} % (SELECT count(*) FROM rets) AS pos FROM range({FULL.bootstrap_iterations}) t(b), range((SELECT count(*) FROM rets)) u(i)),
idraw AS (SELECT b, {_draw_sql("ic")} % (SELECT count(*) FROM vics) AS pos FROM range({FULL.bootstrap_iterations}) t(b), range((SELECT count(*) FROM vics)) u(i)),
sh AS (SELECT b, CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252.0 / max(h)) ELSE 0 END AS sharpe FROM rdraw JOIN rets USING (pos) GROUP BY b),
im AS (SELECT b, avg(x) AS ic FROM idraw JOIN vics USING (pos) GROUP BY b)
SELECT (SELECT count(*) FROM sh) AS iterations,
  (SELECT round(avg(sharpe), 6) FROM sh) AS sharpe_mean, (SELECT round(quantile_cont(sharpe, 0.025), 6) FROM sh) AS sharpe_ci_low,
  (SELECT round(quantile_cont(sharpe, 0.975), 6) FROM sh) AS sharpe_ci_high, (SELECT round(avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END), 6) FROM sh) AS positive_sharpe_probability,
  (SELECT round(avg(ic), 6) FROM im) AS ic_mean, (SELECT round(quantile_cont(ic, 0.025), 6) FROM im) AS ic_ci_low,
  (SELECT round(quantile_cont(ic, 0.975), 6) FROM im) AS ic_ci_high, (SELECT round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) FROM im) AS positive_ic_probability"""


@entry("var_5_bootstrap", run_sql(AGENT, _BOOT))
def var_5(spark, sf):
    out = run(spark, sf, AGENT).bootstrap
    names = [n for n in out.columns if n not in ("variant", "iterations")]
    return fx.rounded(out, *names).select("iterations", *names)


_CONC_SQL = """, by_date AS (SELECT date, max(abs(weight)) AS mw, sum(abs(weight)) AS gross, sum(abs(weight)) * sum(abs(weight)) / nullif(sum(weight * weight), 0) AS eff
  FROM positions GROUP BY date),
conc AS (SELECT max(mw) AS max_single_name_weight, avg(mw) AS average_single_name_weight, coalesce(avg(eff), 0) AS average_effective_positions,
  coalesce(min(eff), 0) AS min_effective_positions, avg(gross) AS average_gross_exposure, max(gross) AS max_gross_exposure,
  count(*) FILTER (WHERE mw > 0.35) AS position_weight_breach_count FROM by_date)"""
_CONC = [
    "max_single_name_weight",
    "average_single_name_weight",
    "average_effective_positions",
    "min_effective_positions",
    "average_gross_exposure",
    "max_gross_exposure",
]


@entry("cap_1_concentration", run_sql(AGENT, f"{_CONC_SQL} SELECT {sql6(*_CONC)}, position_weight_breach_count FROM conc"))
def cap_1(spark, sf):
    return fx.rounded(run(spark, sf, AGENT).concentration, *_CONC).select(*_CONC, "position_weight_breach_count")


_CURVE_SQL = """, breaches AS (SELECT variant, count(*) FILTER (WHERE max_trade_participation > 0.10) AS participation_breach_count
  FROM bounded WHERE net IS NOT NULL AND di >= val_di AND di < hold_di GROUP BY variant),
curve AS (SELECT m.*, participation_breach_count, participation_breach_count = 0 AS passes_participation_limit, sharpe > 0 AS passes_positive_sharpe
  FROM metrics m JOIN breaches b ON b.variant = m.variant WHERE family = 'capacity' AND split = 'test')"""
_CURVE = ["sharpe", "total_return", "average_total_cost", "average_impact_cost", "average_trade_participation", "max_trade_participation"]
_GATES = ["participation_breach_count", "passes_participation_limit", "passes_positive_sharpe"]


@entry("cap_2_capacity_curve", run_sql(CAPACITY, f"{_CURVE_SQL} SELECT notional, {sql6(*_CURVE)}, {', '.join(_GATES)} FROM curve"))
def cap_2(spark, sf):
    return fx.rounded(run(spark, sf, CAPACITY).capacity_curve, *_CURVE).select("notional", *_CURVE, *_GATES)


@entry(
    "cap_3_max_capacity",
    run_sql(CAPACITY, f"{_CURVE_SQL} SELECT max(notional) FILTER (WHERE passes_participation_limit AND passes_positive_sharpe) AS max_capacity_notional FROM curve"),
)
def cap_3(spark, sf):
    return variants.max_capacity(run(spark, sf, CAPACITY).capacity_curve)


@entry(
    "cap_4_capacity_warnings",
    run_sql(
        CAPACITY,
        f"""{_CURVE_SQL}{_CONC_SQL}
SELECT 'concentration' AS rule, printf('Position concentration breached 35%% on %d rebalance dates.', position_weight_breach_count) AS message FROM conc WHERE position_weight_breach_count > 0
UNION ALL SELECT 'no_capacity', 'No configured notional passed both participation and positive-Sharpe capacity gates.' FROM curve
  HAVING count(*) > 0 AND count(*) FILTER (WHERE passes_participation_limit AND passes_positive_sharpe) = 0
UNION ALL SELECT 'participation', concat('Trade participation first breached 10% at notional ', format('{{:,}}', CAST(min(notional) AS BIGINT)), '.')
  FROM curve WHERE NOT passes_participation_limit HAVING count(*) > 0""",
    ),
)
def cap_4(spark, sf):
    r = run(spark, sf, CAPACITY)
    return variants.capacity_warnings(r.capacity_curve, r.concentration, 0.35, 0.10)


# ---------------------------------------------------------------- validity

def _rational_sql(tables, x: str) -> str:
    (*top, lead), bottom = tables
    above, below = f"{lead!r}::DOUBLE", "1.0::DOUBLE"
    for c in top:
        above = f"({above} * {x} + {c!r}::DOUBLE)"
    for c in bottom:
        below = f"({below} * {x} + {c!r}::DOUBLE)"
    return f"({above} / {below})"


def upper_tail_sql(t: str) -> str:
    """P(Z > t) from the same published tables."""
    x = f"({t} / 1.4142135623730951::DOUBLE)"
    z = f"abs({x})"
    fall, inverse = f"exp(-{z} * {z})", f"(1.0::DOUBLE / ({z} * {z}))"
    far = f"((0.5641895835477563::DOUBLE - {inverse} * {_rational_sql(ERFC_LARGE, inverse)}) / {z} * {fall})"
    beyond = f"(CASE WHEN {z} <= {MIDDLE_UP_TO} THEN {_rational_sql(ERFC_MIDDLE, z)} * {fall} ELSE {far} END)"
    small = f"1.0::DOUBLE - {x} * {_rational_sql(ERF_SMALL, f'({x} * {x})')}"
    return f"(0.5::DOUBLE * CASE WHEN {z} <= {SMALL_UP_TO} THEN {small} WHEN {x} >= 0 THEN {beyond} ELSE 2.0::DOUBLE - {beyond} END)"


def bh_sql(source: str, keys: str, p: str = "p_value", name: str = "name") -> str:
    """Select list item source: q per row of ``source`` by sorted suffix minimum."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""(SELECT *, min(least(1.0, {p} * n / rk)) OVER ({part} ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q_value
  FROM (SELECT *, row_number() OVER ({part} ORDER BY {p}, {name}) AS rk, count(*) OVER ({part}) AS n FROM {source}) z)"""


@entry(
    "val_1_p_values",
    f"""WITH {fx.RUNS}, exact(k, p) AS (VALUES {", ".join(f"({k}, {math.erfc((k - 10) / 5 / math.sqrt(2)) / 2!r}::DOUBLE)" for k in range(21))})
SELECT run_id, round(p, 6) AS p_value FROM runs JOIN exact ON k = key % 21""",
)
def val_1(spark, sf):
    from panelweave.functions import normal_upper_tail

    return fx.run_rows(spark, sf).select("run_id", fx.r6(normal_upper_tail((F.col("key") % 21 - 10) / 200.0 * 40)).alias("p_value"))


@entry(
    "val_2_benjamini_hochberg",
    f"""WITH {fx.RUNS}, f AS (SELECT run_id, family_id, p_value FROM runs)
SELECT run_id, family_id, round(q_value, 6) AS q_value FROM {bh_sql("f", "family_id", name="run_id")} y""",
)
def val_2(spark, sf):
    from panelweave.operators.inference import benjamini_hochberg

    rows = fx.run_rows(spark, sf).select("run_id", "family_id", "p_value")
    return fx.rounded(benjamini_hochberg(rows, ["family_id"]), "q_value").select("run_id", "family_id", "q_value")


_EVIDENCE_SQL = f""", evidence0 AS (SELECT variant, name, family, place, observations AS holdout_observations, sharpe AS holdout_sharpe, ic_mean AS holdout_ic_mean,
    ic_tstat AS holdout_ic_tstat, total_return AS holdout_total_return, CASE WHEN observations < 2 THEN 1.0 ELSE {upper_tail_sql("ic_tstat")} END AS p_value
  FROM metrics WHERE split = 'holdout' AND family <> 'capacity'),
last_p AS (SELECT name, arg_max(p_value, place) AS p_value FROM evidence0 GROUP BY name),
adjusted AS (SELECT name, q_value FROM {bh_sql("last_p", "")} y),
evidence AS MATERIALIZED (SELECT e.*, q_value FROM evidence0 e JOIN adjusted a ON a.name = e.name)"""
_EVIDENCE = ["holdout_sharpe", "holdout_ic_mean", "holdout_ic_tstat", "holdout_total_return", "p_value", "q_value"]


@entry("val_3_candidate_evidence", run_sql(FULL, f"{_EVIDENCE_SQL} SELECT name, family, holdout_observations, {sql6(*_EVIDENCE)} FROM evidence"))
def val_3(spark, sf):
    return fx.rounded(run(spark, sf, FULL).evidence, *_EVIDENCE).select("name", "family", "holdout_observations", *_EVIDENCE)


_CHECKS_SQL = f"""{_EVIDENCE_SQL},
agent AS (SELECT e.*, (SELECT max(holdout_sharpe) FROM evidence WHERE family = 'baseline') AS best,
    (SELECT avg(CASE WHEN sharpe >= 0 THEN 1.0 ELSE 0.0 END) FROM windows WHERE variant = 'primary/agent_signal') AS stable
  FROM evidence e WHERE family = 'primary'),
checks AS MATERIALIZED (
  SELECT 'positive_holdout_sharpe' AS name, true AS required, holdout_sharpe > 0 AS passed, holdout_sharpe AS observed, 0.0::DOUBLE AS threshold,
    printf('Holdout Sharpe %.4f must be greater than %.4f.', holdout_sharpe, 0.0::DOUBLE) AS reason FROM agent
  UNION ALL SELECT 'positive_holdout_ic', true, holdout_ic_mean > 0, holdout_ic_mean, 0.0, printf('Holdout IC %.4f must be greater than %.4f.', holdout_ic_mean, 0.0::DOUBLE) FROM agent
  UNION ALL SELECT 'fdr_significant', true, q_value <= 0.1, q_value, 0.1, printf('Agent FDR q-value %.4f must be at most %.4f.', q_value, 0.1::DOUBLE) FROM agent
  UNION ALL SELECT 'positive_holdout_return', true, holdout_total_return > 0, holdout_total_return, 0.0, printf('Holdout total return %.4f must be positive.', holdout_total_return) FROM agent
  UNION ALL SELECT 'beats_best_baseline', true, holdout_sharpe >= best, holdout_sharpe, best,
    printf('Agent holdout Sharpe %.4f must be at least best baseline %.4f.', holdout_sharpe, best) FROM agent
  UNION ALL SELECT 'walk_forward_stable', true, stable >= 0.5, stable, 0.5, 'At least half of walk-forward windows must have non-negative Sharpe.' FROM agent
  UNION ALL SELECT 'data_ready', true, false, 0.0, 1.0, 'Data must be point-in-time, survivorship-bias-free, and corporate-action adjusted.' FROM agent)"""


@entry("val_4_5_checks", run_sql(FULL, f"{_CHECKS_SQL} SELECT name, required, passed, round(observed, 6) AS observed, round(threshold, 6) AS threshold, reason FROM checks"))
def val_4(spark, sf):
    return fx.rounded(run(spark, sf, FULL).checks, "observed", "threshold").select(
        "name", "required", "passed", "observed", "threshold", "reason"
    )


@entry(
    "val_6_verdict",
    run_sql(
        FULL,
        f"""{_CHECKS_SQL} SELECT CASE WHEN bool_or(required AND NOT passed AND name IN ('positive_holdout_sharpe', 'positive_holdout_ic', 'fdr_significant', 'positive_holdout_return')) THEN 'REJECT'
  WHEN bool_or(required AND NOT passed) THEN 'REVIEW' ELSE 'PROMOTE' END AS verdict, string_agg(reason, ' ' ORDER BY reason) FILTER (WHERE NOT passed) AS reasons FROM checks""",
    ),
)
def val_6(spark, sf):
    return run(spark, sf, FULL).verdict.withColumn("reasons", F.concat_ws(" ", "reasons"))


# Branches of the data's readiness: flags that settings and manifest claim, and whether membership is by intervals.
_BRANCHES = {
    "static_unclaimed": ([False, False, False], None, False),
    "static_claimed": ([True, True, True], None, False),
    "intervals_only": ([False, False, False], None, True),
    "intervals_and_manifest": ([False, False, False], [False, False, True], True),
    "manifest_without_history": ([False, True, False], [False, True, True], False),
}


def ready_run(spark, sf, branch: str) -> Research:
    claims, manifest, intervals = _BRANCHES[branch]
    full = run(spark, sf, FULL)
    settings = replace(FULL, **dict(zip(READINESS, claims, strict=True)))
    raw = fx.membership(spark, sf)
    members = normalize_membership(raw, fx.START, fx.END) if intervals else static_membership(raw.select("symbol").distinct(), fx.START, fx.END)
    told = None if manifest is None else snapshot_provenance(full.panel, dict(zip(READINESS, manifest, strict=True)))
    readiness = data_readiness(claimed_flags(spark, settings), members, told)
    return Research(full.panel, settings, full.borrow, full.may_short, readiness=readiness).adopt(full)


def _ready_sql(branch: str) -> str:
    claims, manifest, intervals = _BRANCHES[branch]
    own = "EXISTS (SELECT 1 FROM membership)" if intervals else "false"
    flags = [f"({c} OR {m} OR {own if i < 2 else 'false'})" for i, (c, m) in enumerate(zip(claims, manifest or [False] * 3, strict=True))]
    return f"SELECT '{branch}' AS branch, {', '.join(f'{f} AS {n}' for f, n in zip(flags, READINESS, strict=True))}"


@entry("val_5_readiness", f"WITH {fx.MARKET}, {fx.MEMBERSHIP}, r AS ({' UNION ALL '.join(_ready_sql(b) for b in _BRANCHES)})\nSELECT *, {' AND '.join(READINESS)} AS data_ready FROM r")
def val_5(spark, sf):
    rows = [ready_run(spark, sf, b).readiness.withColumn("branch", F.lit(b)) for b in _BRANCHES]
    return reduce(DataFrame.unionByName, rows)


@entry(
    "val_5_ready_checks",
    run_sql(
        FULL,
        f"""{_CHECKS_SQL}, r(branch, ready) AS (VALUES {', '.join(f"('{b}', {b in ('static_claimed', 'intervals_and_manifest')})" for b in _BRANCHES)})
SELECT branch, name, required, CASE WHEN name = 'data_ready' THEN ready ELSE passed END AS passed,
  round(CASE WHEN name = 'data_ready' THEN CAST(ready AS INTEGER) ELSE observed END, 6) AS observed FROM checks, r""",
    ),
)
def val_5_checks(spark, sf):
    """The checks of the same run in each branch."""
    rows = [ready_run(spark, sf, b).checks.withColumn("branch", F.lit(b)) for b in _BRANCHES]
    return fx.rounded(reduce(DataFrame.unionByName, rows), "observed").select("branch", "name", "required", "passed", "observed")


@entry(
    "val_6_verdict_table",
    f"""WITH {fx.RUNS}, c AS (
  SELECT run_id, 'positive_holdout_sharpe' AS name, true AS required, key % 5 <> 0 AS passed, 'sharpe' AS reason FROM runs
  UNION ALL SELECT run_id, 'positive_holdout_return', key % 2 = 0, CASE WHEN key % 2 = 0 THEN key % 3 <> 0 END, 'return' FROM runs
  UNION ALL SELECT run_id, 'data_ready', true, key % 7 <> 0, 'data' FROM runs)
SELECT run_id, CASE WHEN bool_or(required AND NOT coalesce(passed, true) AND name <> 'data_ready') THEN 'REJECT'
  WHEN bool_or(required AND NOT coalesce(passed, true)) THEN 'REVIEW' ELSE 'PROMOTE' END AS verdict,
  coalesce(string_agg(reason, ' ' ORDER BY reason) FILTER (WHERE required AND NOT coalesce(passed, true)), '') AS reasons FROM c GROUP BY run_id""",
)
def val_6_table(spark, sf):
    """Verdicts of every stored run at once from a check table."""
    from panelweave.operators.inference import verdicts

    k = F.col("key")

    def check(name, required, passed, reason):
        return F.struct(
            F.lit(name).alias("name"), required.alias("required"), passed.alias("passed"), F.lit(reason).alias("reason")
        )

    rows = F.array(
        check("positive_holdout_sharpe", F.lit(True), k % 5 != 0, "sharpe"),
        check("positive_holdout_return", k % 2 == 0, F.when(k % 2 == 0, k % 3 != 0), "return"),
        check("data_ready", F.lit(True), k % 7 != 0, "data"),
    )
    checks = fx.run_rows(spark, sf).select("run_id", F.explode(rows).alias("c")).select("run_id", "c.*")
    return verdicts(checks, ["run_id"]).withColumn("reasons", F.concat_ws(" ", "reasons"))


# ---------------------------------------------------------------- batches


@entry(
    "snk_4_batch_summary",
    batch_sql(
        """SELECT CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS status, string_agg(config, ',' ORDER BY place) AS requested_configs,
count(*) FILTER (WHERE status = 'completed') AS successful_runs, count(*) FILTER (WHERE status = 'failed') AS failed_runs,
string_agg(config, ',' ORDER BY place) FILTER (WHERE status = 'completed') AS run_ids,
string_agg(concat(config, ': ', error), '; ' ORDER BY place) FILTER (WHERE status = 'failed') AS failures FROM outcomes"""
    ),
)
def snk_4(spark, sf):
    out = batch(spark, sf).summary()
    failures = F.array_join(F.transform("failures", lambda x: F.concat(x["config"], F.lit(": "), x["error"])), "; ")
    counts = [F.col(c).cast("long").alias(c) for c in ("successful_runs", "failed_runs")]
    return out.select("status", F.array_join("requested_configs", ",").alias("requested_configs"), *counts, F.array_join("run_ids", ",").alias("run_ids"), failures.alias("failures"))


@entry("snk_4_batch_metrics", batch_sql(f"SELECT config, name, family, split, observations, {sql6(*ALL_METRICS)} FROM done"))
def snk_4_metrics(spark, sf):
    return fx.rounded(batch(spark, sf).metrics, *ALL_METRICS).select("config", "name", "family", "split", "observations", *ALL_METRICS)


@entry(
    "snk_4_batch_comparison",
    batch_sql(
        f"""SELECT config AS run_id, {', '.join(f'round({c}, 6) AS test_{c}' for c in COMPARED)}, row_number() OVER (ORDER BY sharpe DESC, config) AS rank
FROM done WHERE family = 'primary' AND split = 'test'"""
    ),
)
def snk_4_comparison(spark, sf):
    return fx.rounded(batch(spark, sf).comparison("sharpe"), *[f"test_{c}" for c in COMPARED])
