"""Rules on inputs that the given tables do not hold: repeated ids, early decisions, missing times, long lookbacks, unknown sizes."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelweave.operators import events as ev
from panelweave.operators import factors, runs, signals
from panelweave.operators import groupwise as gw
from panelweave.plans.as_of import signal_as_of


@pytest.fixture(scope="module")
def long_panel(spark):
    """Three symbols over 150 days; the highest price lies 100 days back."""
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), f"S{s}", i, (300.0 + s if i == 50 else 100.0 + s * (i % 7)), 1e6) for i in range(150) for s in range(1, 4)]
    return spark.createDataFrame(rows, "date date, symbol string, date_idx long, adj_close double, volume double")


@pytest.mark.parametrize("lookback", [120, None])
def test_as_of_reads_what_a_registered_factor_needs(long_panel, lookback):
    def drawdown():
        return F.col("adj_close") / factors.full(120, "adj_close", F.max("adj_close"), min_periods=1) - 1.0

    name = f"drawdown_120d_{lookback}"
    factors.register_factor(name, drawdown, lookback)
    try:
        assert factors.history_rows([name, "momentum_60d"]) == lookback
        got = {r.symbol: r.signal for r in signal_as_of(long_panel, "2024-12-31", [name], []).collect()}
        whole = signals.latest_signal(signals.composite_signal(factors.with_factors(long_panel, [name]), [name], []), "2024-12-31")
        assert got == {r.symbol: r.signal for r in whole.collect()} and len(got) == 3
    finally:
        del factors.FACTORS[name], factors.LOOKBACK[name]


def test_every_factor_declares_its_lookback(long_panel):
    assert set(factors.LOOKBACK) == set(factors.FACTORS)
    last = long_panel.agg(F.max("date")).first()[0]
    whole = factors.with_factors(long_panel).where(F.col("date") == last)
    for name, rows in factors.LOOKBACK.items():
        cut = factors.with_factors(long_panel.where(F.col("date_idx") >= 150 - rows), [name]).where(F.col("date") == last)
        values = [{r.symbol: r[name] for r in t.select("symbol", name).collect()} for t in (cut, whole)]
        assert values[0] == pytest.approx(values[1], nan_ok=True) if None not in values[1].values() else values[0] == values[1], name


def test_counters_count_every_run(spark):
    registry = spark.range(1500).select(F.col("id").cast("string").alias("run_id"), F.lit("2024").alias("generated_at"))
    assert runs.service_counters(registry).first().run_count == 1500
    assert runs.service_counters(registry, 1000).first().run_count == 1000


def test_unknown_size_leads_to_a_count(spark, monkeypatch):
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1, i) for i in range(20)]), "k int, v int")
    if gw.input_bytes(unknown) is not None:
        monkeypatch.setattr(gw, "_UNKNOWN_SIZE", 0)
    monkeypatch.setattr(gw, "GROUP_ROWS", 10)
    assert gw.input_bytes(unknown) is None
    assert gw.needs_split(unknown, keys=["k"]) and gw.needs_split(unknown) and not gw.needs_split(unknown, keys=["v"])


def test_upsert_keeps_the_newest_of_repeated_incoming_rows(spark):
    schema = "run_id string, generated_at string, score int"
    old = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-01", 2)], schema)
    new = spark.createDataFrame([("a", "2024-01-02", 3), ("a", "2024-01-03", 4), ("a", None, 5), ("c", None, 6)], schema)
    got = sorted((r.run_id, r.score) for r in runs.upsert_runs(old, new).collect())
    assert got == [("a", 4), ("b", 2), ("c", 6)]


def test_latest_per_run_with_missing_and_equal_times(spark):
    schema = "run_id string, generated_at string, manifest_path string, score int"
    rows = spark.createDataFrame([("a", None, "p", 1), ("b", "2024", "p1", 2), ("b", "2024", "p2", 3), ("c", None, "p1", 4), ("c", "2023", "p0", 5)], schema)
    got = sorted((r.run_id, r.score) for r in runs.latest_per_run(rows).collect())
    assert got == [("a", 1), ("b", 3), ("c", 5)]


def event(seq, kind, path="p1", rec="r", actor=None, run="x"):
    first = kind == "recommended"
    return Row(
        seq=seq, event_type=kind, recommendation_id=rec, family_id="f", hypothesis_id="h", candidate_id="c", run_id=run, evidence_path=path, evidence_sha256="s",
        actor=actor or ("ann" if first else "bob"), role="researcher" if first else "operator", status="pending" if first else "approved",
    )


@pytest.mark.parametrize("block", [1, 65_536])
def test_ledger_decisions_meet_the_latest_earlier_recommendation(spark, monkeypatch, block):
    monkeypatch.setattr(ev, "BLOCK", block)
    early = [event(1, "decided"), event(2, "recommended"), event(3, "decided")]
    replaced = [event(11, "recommended", "p1", "q", run="y"), event(12, "recommended", "p2", "q", run="z"), event(13, "decided", "p2", "q", run="z"), event(14, "decided", "p2", "q", run="z")]
    got = sorted((r.seq, r.error) for r in ev.ledger_errors(spark.createDataFrame(early + replaced)).collect())
    assert got == [(1, "references missing recommendation"), (12, "duplicates recommendation id"), (14, "duplicates decision")]


def test_chain_heads_show_cut_repeated_and_lost_chains(spark):
    records = spark.createDataFrame([(c, i, f"p{c}{i}") for c in range(4) for i in range(5)], "chain long, index long, payload string")
    links = ev.build_chains(records)
    heads = ev.chain_heads(links)
    assert ev.verify_chains(links, records, heads=heads).count() == 0
    cut = (F.col("chain") == 0) & (F.col("index") == 4)
    lost = F.col("chain") == 1
    again = links.where("chain = 2 and index = 3")
    got = ev.verify_chains(links.where(~cut & ~lost).unionByName(again), records.where(~cut & ~lost), heads=heads.where("chain <> 3")).collect()
    assert sorted((r.chain, r["index"] if r["index"] is not None else -1, r.error) for r in got) == [
        (0, -1, "final hash mismatch"), (0, -1, "row count mismatch"), (1, -1, "chain is missing"), (2, -1, "row count mismatch"), (2, 3, "chain row is repeated"), (3, -1, "chain is not listed"),
    ]
