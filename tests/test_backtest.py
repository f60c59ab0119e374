"""Trap micro-frames and the leakage tests: changing holdout prices never moves earlier results."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.config import ResearchConfig, Strategy
from panelweave.operators import evaluate, portfolio
from panelweave.operators.factors import with_factors, with_forward_returns
from panelweave.plans.as_of import latest_before, signal_as_of, signals_as_of
from panelweave.plans.research import Research
from panelweave.sources.panel import with_date_index

SYMBOLS = {"AAA": -1.5, "BBB": -0.9, "CCC": -0.3, "DDD": 0.3, "EEE": 0.9, "FFF": 1.5}


def weekdays(n, start="2024-01-02"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def make_panel(spark, n, bump_from=None, up=1.03, down=0.97):
    days = weekdays(n)
    rows = []
    for k, (symbol, loading) in enumerate(SYMBOLS.items()):
        price = 100.0
        for i, day in enumerate(days):
            price *= 1 + 0.002 * loading + 0.01 * math.sin(i * (k + 1) * 1.7)
            p = price
            if bump_from is not None and i >= bump_from:
                steps = i - bump_from + 1
                p *= up**steps if symbol in ("EEE", "FFF") else down**steps if symbol in ("AAA", "BBB") else 1.0
            rows.append((day, symbol, float(p), 1e6))
    return with_date_index(spark.createDataFrame(rows, "date date, symbol string, adj_close double, volume double"))


def run(spark, panel, **changes):
    settings = dict(
        signal=Strategy("agent_signal", ["momentum_5d"], []),
        holding_period=2,
        rebalance_days=1,
        quantile=0.34,
        train_fraction=0.5,
        holdout_fraction=0.2,
        transaction_cost_bps=5.0,
        walk_forward_windows=2,
    )
    return Research(panel, ResearchConfig(**{**settings, **changes}))


def as_dict(df, key):
    return {r[key]: {k: v for k, v in r.asDict().items() if not isinstance(v, str)} for r in df.collect()}


def test_holdout_prices_do_not_leak(spark):
    n = 45
    base = run(spark, make_panel(spark, n))
    edge = base.boundaries.collect()[0].holdout_idx
    changed = run(spark, make_panel(spark, n, bump_from=edge + 1))
    a, b = as_dict(base.metrics, "split"), as_dict(changed.metrics, "split")
    for split in ("train", "validation"):
        assert a[split] == pytest.approx(b[split])
    assert a["holdout"]["total_return"] != pytest.approx(b["holdout"]["total_return"])
    wa, wb = as_dict(base.walk_forward, "window"), as_dict(changed.walk_forward, "window")
    assert wa.keys() == wb.keys() and len(wa) == 2
    for name in wa:
        assert wa[name]["sharpe"] == pytest.approx(wb[name]["sharpe"])


def test_purge_shrinks_validation_only(spark):
    r = run(spark, make_panel(spark, 45))
    counts = {s: m["observations"] for s, m in as_dict(r.metrics, "split").items()}
    b = r.boundaries.collect()[0]
    unpurged = b.holdout_idx - b.validation_idx
    assert counts["validation"] == unpurged - 2
    assert counts["test"] == counts["validation"]
    assert counts["full"] == b.n


def test_disabled_holdout_uses_two_way_split(spark):
    r = run(spark, make_panel(spark, 30), validity_enabled=False)
    b = r.boundaries.collect()[0]
    assert b.holdout_idx is None and b.splittable
    counts = {s: m["observations"] for s, m in as_dict(r.metrics, "split").items()}
    assert counts["holdout"] == 0
    assert counts["train"] + counts["validation"] == counts["full"]


def test_too_few_observations_are_reported(spark):
    daily = spark.createDataFrame([("v", weekdays(1)[0], 0, 0.1)], "variant string, date date, date_idx int, net_return double")
    b = evaluate.split_boundaries(daily, 0.5, 0.2)
    assert not b.collect()[0].splittable
    with pytest.raises(Exception, match="not enough backtest observations"):
        evaluate.assert_splittable(b).collect()


def test_turnover_ignores_vanished_names(spark):
    d0, d1 = weekdays(2)
    rows = [("v", d0, "A", 0.5), ("v", d0, "B", -0.5), ("v", d1, "A", 0.5)]
    df = spark.createDataFrame(rows, "variant string, date date, symbol string, weight double")
    totals = {r.date: r.t for r in portfolio.with_trades(df).groupBy("date").agg(F.sum("trade").alias("t")).collect()}
    assert totals == {d0: 1.0, d1: 0.0}


def test_drawdown_peak_starts_at_first_equity(spark):
    rows = [("v", i, r, 2) for i, r in enumerate([-0.5, 0.1, 0.2])]
    df = spark.createDataFrame(rows, "variant string, date_idx int, net_return double, holding_period int")
    zero = {c: F.lit(0.0) for c in [*evaluate.COST_COLUMNS, *evaluate.PARTICIPATION, "ic", "turnover"]}
    got = evaluate.summarize(df.withColumns(zero), ["variant"]).collect()[0]
    assert got.max_drawdown == 0.0
    assert got.total_return == pytest.approx(0.5 * 1.1 * 1.2 - 1)


def test_holes_count_as_calendar_rows(spark):
    days = weekdays(30)
    rows = [(d, s, 100.0 + i + 3 * (s == "B"), 10.0 + i) for i, d in enumerate(days) for s in "AB" if not (s == "A" and i == 12)]
    panel = with_date_index(spark.createDataFrame(rows, "date date, symbol string, adj_close double, volume double"))
    names = ["momentum_5d", "volume_spike_5d", "volatility_10d"]
    out = with_forward_returns(with_factors(panel, names), [3]).toPandas()
    wide = pd.DataFrame(rows, columns=["date", "symbol", "c", "v"]).pivot(index="date", columns="symbol")
    c, v = wide["c"], wide["v"]
    r = c.pct_change(fill_method=None)
    expected = {
        "momentum_5d": c.pct_change(5, fill_method=None),
        "volume_spike_5d": v / v.rolling(5).mean() - 1,
        "volatility_10d": r.rolling(10).std(),
        "fwd_3": c.shift(-3) / c - 1,
    }
    for name, table in expected.items():
        got = out.pivot(index="date", columns="symbol", values=name).astype(float)
        pd.testing.assert_frame_equal(got, table, check_names=False, check_freq=False, check_index_type=False)


def test_positions_rules(spark):
    day = dt.date(2024, 1, 2)

    def weights(signals, ok=None):
        rows = [("v", day, f"S{i}", float(x), 0.2, (ok or [True] * 99)[i]) for i, x in enumerate(signals)]
        df = spark.createDataFrame(rows, "variant string, date date, symbol string, signal double, quantile double, ok boolean")
        return {r.symbol: r.weight for r in portfolio.build_positions(df, [0.2], F.col("ok")).collect()}

    assert weights([1, 2, 3, 4]) == {}  # fewer than five names
    assert weights([1, 2, 3, 4, 5]) == {"S0": -1.0, "S1": 0.0, "S2": 0.0, "S3": 0.0, "S4": 1.0}
    assert weights([1, 2, 3, 4, 5], [False, True, True, True, True]) == {}  # empty short leg skips the date
    assert set(weights([7] * 6).values()) == {-1 / 6}  # short overwrites long


def test_ic_of_unrelated_ranks_is_exactly_zero(spark):
    """An IC of 0 is no hit, whatever the order of the additions."""
    import itertools

    n = 7
    orders = [p for p in itertools.permutations(range(n)) if sum((i - x) ** 2 for i, x in enumerate(p)) == (n**3 - n) // 6]
    rows = [("v", day, float(i), float(x)) for day, p in enumerate(orders) for i, x in enumerate(p)]
    rows += [("v", -1, float(i), -2.0 * (i // 2)) for i in range(n)]
    found = {r.date: r.ic for r in portfolio.information_coefficient(spark.createDataFrame(rows, "variant string, date int, signal double, fwd double")).collect()}
    assert {found[day] for day in range(len(orders))} == {0.0}
    twin = pd.Series(range(n)).corr(pd.Series([-2.0 * (i // 2) for i in range(n)]).rank())
    assert found[-1] == pytest.approx(twin, abs=1e-12)


def test_readiness_of_an_adopting_run_makes_no_tables(spark, monkeypatch):
    """Only what is asked for is written: readiness needs neither ranks nor portfolios, nor a count of the panel."""
    from panelweave.plans import research

    def refuse(*_args, **_kwargs):
        raise AssertionError("made a table")

    monkeypatch.setattr(research, "stage", refuse)
    monkeypatch.setattr(research, "needs_split", refuse)
    panel = make_panel(spark, 90)
    config = ResearchConfig(signal=Strategy("agent_signal", ["momentum_5d"], []))
    view = Research(panel, config).adopt(Research(panel, config))
    assert view.readiness.first().data_ready is False
    with pytest.raises(AssertionError, match="made a table"):
        view.daily  # noqa: B018


def test_adopting_run_makes_portfolios_of_its_own_variants_only(spark):
    panel = make_panel(spark, 120)
    small = ResearchConfig(signal=Strategy("agent_signal", ["momentum_5d"], []), holdout_fraction=0.2)
    wide = ResearchConfig(signal=small.signal, holdout_fraction=0.2, holding_grid=[3, 5, 10])
    full = Research(panel, wide)
    view = Research(panel, small).adopt(full)
    rows = lambda r: sorted((x.variant, x.date, round(x.net_return, 12)) for x in r.daily.where("net_return IS NOT NULL").collect())
    own = rows(view)
    assert own and "strategies" in vars(full) and not {"aligned", "positions", "daily"} & set(vars(full))
    full.daily  # noqa: B018
    assert rows(Research(panel, small).adopt(full)) == own


def test_config_ranges():
    good = dict(signal=Strategy("a", ["momentum_5d"], []))
    for bad in (
        {"quantile": 0.5},
        {"train_fraction": 0.95},
        {"holdout_fraction": 0.5},
        {"fdr_alpha": 0.3},
        {"train_fraction": 0.8, "holdout_fraction": 0.2},
        {"validity_enabled": 1},
        {"holding_grid": [0]},
        {"notionals": [0.0]},
        {"max_trade_participation": 0.0},
        {"selection_policy": "other"},
        {"portfolio_notional": 0.0},
    ):
        with pytest.raises(ValueError):
            ResearchConfig(**{**good, **bad})


def test_split_plan_gives_the_same_run(spark):
    panel = make_panel(spark, 40).withColumn("sector", F.when(F.col("symbol") < "D", "x").otherwise("y"))
    extra = dict(sector_neutral=True, baselines=[Strategy("reversal_5d_only", ["reversal_5d"], [])])

    def metrics(split, staged):
        settings = dict(
            signal=Strategy("agent_signal", ["momentum_5d"], []),
            holding_period=2,
            rebalance_days=2,
            quantile=0.34,
            train_fraction=0.5,
            holdout_fraction=0.2,
            transaction_cost_bps=5.0,
        )
        r = Research(panel, ResearchConfig(**settings, **extra), split=split, staged=staged)
        return {(m.variant, m.split): (m.observations, round(m.ic_mean, 9), round(m.total_return, 9)) for m in r.metrics.collect()}

    one = metrics(False, True)
    assert one and one == metrics(True, True)


def test_as_of_signal_uses_no_later_rows_and_falls_back(spark):
    panel = make_panel(spark, 75)
    days = weekdays(75)
    last = str(days[70])
    got = {r.symbol: (r.date, r.signal) for r in signal_as_of(panel, last, ["momentum_60d"], ["volatility_20d"]).collect()}
    known = signal_as_of(panel.where(F.col("date") <= last), last, ["momentum_60d"], ["volatility_20d"])
    assert got == {r.symbol: (r.date, r.signal) for r in known.collect()} and {d for d, _ in got.values()} == {days[70]}
    gap = panel.where(~F.col("date_idx").isin(70) | (F.col("symbol") == "AAA")).withColumn(
        "adj_close", F.when(F.col("date_idx") == 70, F.lit(None)).otherwise(F.col("adj_close"))
    )
    older = signal_as_of(gap, last, ["momentum_60d"], []).collect()
    assert {r.date for r in older} == {days[69]}


def test_many_requested_days_equal_single_ones(spark):
    """Days on, between, before and after the dates of the panel, two with one date, and a last date without a signal."""
    panel = make_panel(spark, 90)
    days = [r.date for r in panel.select("date").distinct().orderBy("date").collect()]
    gap = panel.where(~((F.col("date") == days[80]) & (F.col("symbol") != "AAA"))).withColumn("adj_close", F.when(F.col("date") == days[80], None).otherwise(F.col("adj_close")))
    calendar = panel.select("date", "date_idx").distinct()
    asked = [days[70], days[70] + dt.timedelta(hours=12), days[75], days[80], days[89] + dt.timedelta(days=30), days[0] - dt.timedelta(days=3), days[10]]
    requests = spark.createDataFrame([(d,) for d in asked], "as_of date")
    found = signals_as_of(gap, requests, ["momentum_60d"], ["volatility_20d"], 0.34, calendar).collect()
    assert {r.as_of for r in found} == {days[70], days[75], days[80], days[89] + dt.timedelta(days=30)}
    for day in {r.as_of for r in found}:
        own = sorted((r for r in found if r.as_of == day), key=lambda r: r["rank"])
        known = gap.where(F.col("date") <= day)
        alone = {r.symbol: (r.date, r.signal) for r in signal_as_of(known, day.isoformat(), ["momentum_60d"], ["volatility_20d"]).collect()}
        assert {r.symbol: (r.date, r.signal) for r in own} == alone
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(-r.signal, r.symbol) for r in own] == sorted((-r.signal, r.symbol) for r in own)
        assert sum(r.target_weight for r in own) == pytest.approx(0.0) and own[0].target_weight > 0 and own[0].warnings == []
        assert {r.reason for r in own} == {"positive=momentum_60d; negative=volatility_20d"}
    assert {r.date for r in found if r.as_of == days[80]} == {days[79]}
    matched = {r.as_of: r.date for r in latest_before(requests, calendar).collect()}
    assert matched[days[75]] == days[75] and matched[days[0] - dt.timedelta(days=3)] is None


def test_many_days_with_locates(spark):
    panel = make_panel(spark, 70)
    days = [r.date for r in panel.select("date").distinct().orderBy("date").collect()]
    requests = spark.createDataFrame([(days[65],), (days[69],)], "as_of date")
    locates = spark.createDataFrame([(str(days[69]), s.lower(), "yes", 10.0) for s in SYMBOLS] + [(str(days[3]), "aaa", "perhaps", 1.0)], "date string, symbol string, shortable string, borrow_fee_bps double")
    found = signals_as_of(panel, requests, ["momentum_20d"], [], 0.34, panel.select("date", "date_idx").distinct(), locates).collect()
    first = [r for r in found if r.as_of == days[65]]
    assert min(r.target_weight for r in first) == 0.0 and first[0].warnings == ["No short candidates passed configured shortability constraints."]
    assert min(r.target_weight for r in found if r.as_of == days[69]) < 0


def test_only_rebalance_dates_are_ranked_and_liquid_dates_are_those_of_ranks(spark):
    """Dates are chosen before ranking; those of a liquidity variant equal what ranks of every date give."""
    from panelweave.operators import signals

    panel = make_panel(spark, 60).withColumn("sector", F.when(F.col("symbol") < "D", "x").otherwise("y"))
    config = ResearchConfig(signal=Strategy("agent_signal", ["momentum_5d"], []), rebalance_days=4, holdout_fraction=0.2, sector_neutral=True, liquidity_min_rank=0.95)
    run = Research(panel, config)
    chosen = {r.date for r in run.dates.select("date").distinct().collect()}
    assert {r.date for r in run.strategies.select("date").distinct().collect()} == chosen and len(chosen) < 60 / 2
    assert {(r.variant, r.date) for r in run.aligned.select("variant", "date").distinct().collect()} == {(r.variant, r.date) for r in run.dates.collect()}

    rows = [("d1", 1.0, True), ("d1", 2.0, False), ("d2", 2.0, True), ("d2", 2.0, False), ("d2", 1.0, True), ("d3", 3.0, True), ("d4", None, True), ("d5", 5.0, False)]
    table = spark.createDataFrame(rows, "date string, v double, has boolean")
    ranked = signals.with_percent_ranks(table, {"pct": "v"}, split=False)
    for least in (0.0, 0.5, 0.75, 0.8, 0.84, 1.0):
        found = signals.dates_held(table, {"a": (F.col("has"), None), "b": (F.col("has"), least)}, "v").collect()
        assert {r.date for r in found if r.variant == "a"} == {"d1", "d2", "d3", "d4"}
        assert {r.date for r in found if r.variant == "b"} == {r.date for r in ranked.where((F.col("pct") >= least) & F.col("has")).collect()}
