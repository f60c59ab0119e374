"""From a written snapshot to a verdict; the data's readiness is derived."""

import hashlib
import math
import random

import pandas as pd
import pytest

from panelweave.config import ResearchConfig, Strategy
from panelweave.operators.quality import data_readiness
from panelweave.operators.universe import static_membership
from panelweave.plans.snapshot_run import SnapshotRun

SYMBOLS = [f"S{i}" for i in range(8)]
START, END = "2023-01-02", "2024-12-31"
CONFIG = ResearchConfig(
    signal=Strategy("agent_signal", ["momentum_20d"], []),
    holding_period=1,
    rebalance_days=1,
    quantile=0.3,
    train_fraction=0.5,
    holdout_fraction=0.2,
    walk_forward_windows=2,
)


@pytest.fixture(scope="module")
def snapshot(tmp_path_factory):
    """Prices with steady drifts, so that momentum works in every split; two symbols leave and join."""
    draw, rows = random.Random(3), []
    days = pd.bdate_range(START, periods=260)
    for k, symbol in enumerate(SYMBOLS):
        price = 100.0
        for day in days:
            price *= math.exp(0.002 * (k - 3.5) + draw.gauss(0, 0.004))
            rows.append((day.date().isoformat(), symbol, price, price * 1.01, price * 0.99, price, price, 1e6))
    path = tmp_path_factory.mktemp("snapshot") / "prices.csv"
    pd.DataFrame(rows, columns=["date", "symbol", "open", "high", "low", "close", "adj_close", "volume"]).to_csv(path, index=False)
    return path


def members(spark):
    rows = [(s.lower(), START, None) for s in SYMBOLS[:-1]] + [(SYMBOLS[-1], "2023-03-01", None)]
    return spark.createDataFrame(rows, "symbol string, start string, end string")


def manifest(path, **changes):
    return {"dataset_id": "d", "content_sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "corporate_actions_adjusted": True, **changes}


def test_ready_data_promote(spark, snapshot):
    run = SnapshotRun(spark, str(snapshot), CONFIG, START, END, membership=members(spark), manifest=manifest(snapshot), require_hash=True)
    row = run.verdict.first()
    assert (row.verdict, row.data_ready, row.reasons) == ("PROMOTE", True, [])
    overview, warnings = run.integrity
    seen = overview.first()
    assert seen.observed_symbols == 8 and seen.missing_symbols == 0 and seen.duplicate_rows == 0 and seen.point_in_time_universe
    assert seen.row_count == 8 * 260 - sum(d < pd.Timestamp("2023-03-01") for d in pd.bdate_range(START, periods=260))
    found = {(r.rule, r.subject) for r in warnings.collect()}
    assert found == {("coverage", "S7")}
    assert run.provenance.first().hash_matches


def test_good_results_on_unready_data_are_for_review(spark, snapshot):
    symbols = spark.createDataFrame([(s,) for s in [*SYMBOLS, "GONE"]], "symbol string")
    run = SnapshotRun(spark, str(snapshot), CONFIG, START, END, symbols=symbols)
    row = run.verdict.first()
    assert (row.verdict, row.data_ready) == ("REVIEW", False)
    assert row.reasons == ["Data must be point-in-time, survivorship-bias-free, and corporate-action adjusted."]
    rules = [r.rule for r in run.integrity[1].collect()]
    assert rules.count("source") == 4 and rules.count("missing_symbol") == 1
    unneeded = SnapshotRun(spark, str(snapshot), ResearchConfig(**{**CONFIG.__dict__, "require_data_readiness": False}), START, END, symbols=symbols)
    assert unneeded.verdict.first().verdict == "PROMOTE"


def test_manifest_mismatches(spark, snapshot):
    wrong = manifest(snapshot, content_sha256="0" * 64, row_count=5)
    run = SnapshotRun(spark, str(snapshot), CONFIG, START, END, membership=members(spark), manifest=wrong)
    told = [r.message for r in run.integrity[1].where("rule = 'provenance'").collect()]
    assert told == ["Snapshot manifest hash does not match the data file.", "Snapshot manifest row count does not match loaded data."]
    with pytest.raises(Exception, match="snapshot content hash mismatch"):
        SnapshotRun(spark, str(snapshot), CONFIG, START, END, membership=members(spark), manifest=wrong, require_hash=True).provenance.collect()
    with pytest.raises(ValueError):
        SnapshotRun(spark, str(snapshot), CONFIG, START, END)


def test_flags_fold(spark):
    flags = lambda *x: spark.createDataFrame([x], "point_in_time_universe boolean, survivorship_bias_free boolean, corporate_actions_adjusted boolean")
    none = flags(False, False, False)
    assert not data_readiness(none).first().data_ready
    assert data_readiness(flags(True, True, True)).first().data_ready
    history = members(spark)
    assert tuple(data_readiness(none, history).first()) == (True, True, False, False)
    assert tuple(data_readiness(none, history.limit(0)).first()) == (False, False, False, False)
    assert tuple(data_readiness(none, static_membership(history, START, END), flags(True, None, True)).first()) == (True, False, True, False)
    assert data_readiness(none, history, flags(False, False, True)).first().data_ready
