"""A batch of configurations in one job against the same configurations one by one."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelweave.config import ResearchConfig, Strategy
from panelweave.plans.batch import TOO_SHORT, Batch, parse_settings
from panelweave.plans.research import Research
from tests.test_backtest import make_panel

BASE = dict(
    signal={"name": "agent_signal", "positive": ["momentum_5d"]},
    holding_period=2,
    rebalance_days=1,
    quantile=0.34,
    train_fraction=0.5,
    holdout_fraction=0.2,
    transaction_cost_bps=5.0,
)
SETTINGS = {
    "plain": BASE,
    "same_signal_dearer": BASE | {"transaction_cost_bps": 50.0, "cost_multipliers": [1.0, 2.0], "notionals": [10.0]},
    "broken": BASE | {"quantile": 0.7},
    "other": BASE | {"signal": {"name": "agent_signal", "negative": ["reversal_5d"]}, "holding_period": 3, "rebalance_days": 2, "quantile": 0.2, "holding_grid": [1, 2], "quantile_grid": [0.3]},
    "two_way": BASE | {"validity_enabled": False, "train_fraction": 0.7, "baselines": [{"name": "momentum_5d_only", "positive": ["momentum_5d"]}, {"name": "random_cross_section"}]},
    "neutral": BASE | {"sector_neutral": True, "liquidity_min_rank": 0.2, "borrow_fee_bps": 300.0},
    "few_shorts": BASE | {"shortable_symbols": ["AAA", "BBB", "CCC", "DDD"], "borrow_fee_bps": 80.0},
    "too_short": BASE | {"rebalance_days": 500},
    "no_such": BASE | {"signal": {"name": "agent_signal", "positive": ["nothing"]}},
    "misspelt": BASE | {"quantil": 0.3},
    "empty": {},
}


@pytest.fixture(scope="module")
def panel(spark):
    return make_panel(spark, 45).withColumn("sector", F.when(F.col("symbol") < "DDD", "x").otherwise("y"))


@pytest.fixture(scope="module")
def batch(panel):
    return Batch(panel, SETTINGS)


def rows(df):
    return {(r["family"], r["name"], r["split"]): {k: v for k, v in r.asDict().items() if isinstance(v, (int, float)) and k not in ("position_in_grid", "quantile", "notional", "cost_multiplier", "holding_period")} for r in df.collect()}


def may_short(config):
    return None if config.shortable_symbols is None else F.col("symbol").isin(config.shortable_symbols)


@pytest.mark.parametrize("name", ["plain", "same_signal_dearer", "other", "two_way", "neutral", "few_shorts"])
def test_rows_equal_a_run_alone(batch, panel, name):
    config = parse_settings(SETTINGS[name])
    alone = rows(Research(panel, config, may_short=may_short(config), staged=False).metrics)
    together = rows(batch.metrics.where(F.col("config") == name))
    assert alone.keys() == together.keys() and alone
    for key in alone:
        assert together[key] == pytest.approx(alone[key], abs=1e-12)


def test_failures_are_rows(batch):
    found = {r.config: (r.status, r.error) for r in batch.outcomes.collect()}
    assert list(found) and set(found) == set(SETTINGS)
    assert found["broken"] == ("failed", "quantile must be between 0 and 0.5")
    assert found["too_short"] == ("failed", TOO_SHORT)
    assert found["no_such"][0] == "failed" and "nothing" in found["no_such"][1]
    assert found["misspelt"][0] == "failed" and "quantil" in found["misspelt"][1]
    assert found["empty"] == ("failed", "missing setting signal")
    assert {n for n, (s, _) in found.items() if s == "completed"} == {"plain", "same_signal_dearer", "other", "two_way", "neutral", "few_shorts"}


def test_shared_work_is_done_once(batch):
    """Equal portfolios are one set of positions whatever their costs; the panel is ranked once for all."""
    assert len(batch._positions) < len(batch.grid)
    assert batch._position("plain", batch.configs["plain"].variants()[0]) == batch._position("same_signal_dearer", batch.configs["same_signal_dearer"].variants()[0])
    assert batch.aligned.select("variant").distinct().count() == len(batch._positions)


def test_documents(batch, tmp_path):
    batch.write(str(tmp_path), "sharpe", limit=3)
    file = next(f for f in os.listdir(tmp_path / "batch_summary") if f.endswith(".json"))
    summary = json.loads((tmp_path / "batch_summary" / file).read_text())
    assert summary["status"] == "failed" and summary["requested_configs"] == list(SETTINGS)
    assert summary["successful_runs"] == len(summary["run_ids"]) == 6 and summary["failed_runs"] == len(summary["failures"]) == 5
    assert summary["failures"][0] == {"config": "broken", "error": "quantile must be between 0 and 0.5"}
    ranked = batch.panel.sparkSession.read.parquet(f"{tmp_path}/run_comparison").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3]
    assert [r.test_sharpe for r in ranked] == sorted((r.test_sharpe for r in batch.comparison().collect()), reverse=True)[:3]


def test_bad_requests(panel):
    with pytest.raises(ValueError):
        Batch(panel, {})
    none = Batch(panel, {"a": BASE | {"quantile": 2.0}})
    assert [(r.status, r.failed_runs) for r in none.summary().collect()] == [("failed", 1)]
    assert none.metrics.count() == 0
    ready = Batch(panel, {"a": ResearchConfig(signal=Strategy("agent_signal", ["momentum_5d"]), **{k: v for k, v in BASE.items() if k != "signal"})})
    assert ready.summary().first().status == "completed"


def test_only_rebalance_dates_are_ranked(panel):
    batch = Batch(panel, {"a": BASE | {"rebalance_days": 4}, "b": BASE | {"rebalance_days": 6}})
    days = lambda table: {r.date for r in table.select("date").distinct().collect()}
    assert days(batch.strategies) == days(batch.dates) and len(days(batch.dates)) < 45 / 2
