import hashlib

import pytest
from pyspark.sql import functions as F

from panelweave.functions import normal_upper_tail
from panelweave.functions import text as tx
from panelweave.operators import borrow as bor
from panelweave.operators import events as ev
from panelweave.operators import ideas, provenance, runs
from panelweave.operators import universe as uni
from panelweave.sources import manifests as mf
from panelweave.sources import panel as src
from panelweave.sources import sinks
from panelweave.streaming.events import read_audit_stream, read_status_table, start_status_table


def test_chain_round_trip_and_tampering(spark):
    rows = [(c, i, f"p{c}{i}") for c in range(2) for i in range(4)]
    records = spark.createDataFrame(rows, "chain long, index long, payload string")
    links = ev.build_chains(records)
    previous = ""
    for row in links.where("chain = 1").orderBy("index").collect():
        digest = hashlib.sha256(row.payload.encode()).hexdigest()
        previous = hashlib.sha256(f"{digest}|{previous}".encode()).hexdigest()
        assert row.chain_hash == previous
    assert ev.verify_chains(links, records).count() == 0
    forged = records.withColumn("payload", F.when((F.col("chain") == 0) & (F.col("index") == 2), "x").otherwise(F.col("payload")))
    assert [tuple(r) for r in ev.verify_chains(links, forged).collect()] == [(0, 2, "hash chain hash mismatch")]
    errors = {(r["index"], r.error) for r in ev.verify_chains(links.where("index != 1"), records).where("chain = 0").collect()}
    assert (1, "record has no chain row") in errors and (2, "hash chain previous hash mismatch") in errors


def test_status_stream_matches_batch(spark, tmp_path):
    schema = "entity string, seq long, created_at timestamp, to_status string"
    first = spark.sql("SELECT 'a' entity, 1L seq, timestamp'2024-01-02' created_at, 'approved' to_status UNION ALL SELECT 'b', 2L, timestamp'2024-01-01', 'draft'")
    late = spark.sql("SELECT 'a' entity, 3L seq, timestamp'2024-01-01' created_at, 'draft' to_status UNION ALL SELECT 'b', 4L, timestamp'2024-01-03', 'ran'")
    log, table, mark = (str(tmp_path / n) for n in ("log", "table", "mark"))
    for part in (first, late):
        part.coalesce(1).write.mode("append").json(log)
        query = start_status_table(read_audit_stream(spark, log), table, mark)
        query.awaitTermination()
    got = {r.entity: r.status for r in read_status_table(spark, table).collect()}
    assert got == {r.entity: r.status for r in ev.current_status(spark.read.schema(schema).json(log)).collect()}
    assert got == {"a": "approved", "b": "ran"}


def test_text_extraction(spark):
    texts = spark.createDataFrame(
        [
            (1, "A weekly momentum strategy with low volatility, held 10 trading days in future markets. More."),
            (2, "Short."),
            (3, "0 days monthly risk"),
        ],
        "id int, text string",
    )
    out = {r.id: r for r in ideas.validate_ideas(ideas.extract_ideas(texts.withColumn("title", F.lit(" My Paper! ")), "title")).collect()}
    assert out[1].positive_factors == ["momentum_20d"] and out[1].negative_factors == ["volatility_20d"]
    assert out[1].holding_period == 10 and out[1].name == "my_paper" and out[1].valid
    assert len(out[1].bias_warnings) == 2
    assert out[2].hypothesis.startswith("Assets with stronger momentum_20d and weaker risk") and out[2].holding_period == 5
    assert out[3].holding_period == 21 and out[3].negative_factors == ["volatility_20d"]


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("abcde",)], "t string")
    assert [r[0] for r in df.select(tx.token_estimate(F.col("t"))).collect()] == [0, 1, 2]


def test_upper_tail_against_exact(spark):
    from math import erfc, sqrt

    values = [-6.0, -1.5, -0.1, 0.0, 0.3, 1.645, 4.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("inf"),)], "t double")
    got = [r[0] for r in df.select(normal_upper_tail(F.col("t"))).collect()]
    assert got[:-2] == pytest.approx([0.5 * erfc(v / sqrt(2)) for v in values], rel=3e-7, abs=1e-12)
    assert got[-2:] == [1.0, 1.0]


def test_borrow_errors_and_defaults(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "aaa", "Y", "10", "0"), ("2024-01-03", "aaa", "no", "20", "5")],
        "date string, symbol string, shortable string, borrow_fee_bps string, available_quantity string",
    )
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-03')) AS date")
    rows = bor.normalize_borrow(raw, days)
    assert {(str(r.date), r.shortable) for r in rows.collect()} == {("2024-01-02", False), ("2024-01-03", False)}
    dense = bor.densify_borrow(rows, days, spark.createDataFrame([("AAA",), ("BBB",)], "symbol string"))
    assert dense.count() == 6 and dense.where("shortable").count() == 0
    with pytest.raises(Exception, match="duplicate"):
        bor.normalize_borrow(raw.union(raw), days).collect()
    with pytest.raises(Exception, match="invalid borrow"):
        bor.normalize_borrow(raw.withColumn("shortable", F.lit("maybe")).withColumn("available_quantity", F.lit("1")), days).collect()


def test_membership_clips_and_duplicates(spark):
    raw = spark.createDataFrame(
        [("aaa", "2019-01-01", None), ("bbb", "2020-06-01", "2020-06-30"), ("ccc", "2022-01-01", "2022-02-01"), ("bbb", "2020-06-15", "2021-12-31")],
        "symbol string, start string, end string",
    )
    spells = uni.normalize_membership(raw, "2020-01-01", "2020-12-31")
    assert {(r.symbol, str(r.start), str(r.end)) for r in spells.collect()} == {
        ("AAA", "2020-01-01", "2020-12-31"),
        ("BBB", "2020-06-01", "2020-06-30"),
        ("BBB", "2020-06-15", "2020-12-31"),
    }
    panel = spark.sql("SELECT date'2020-06-20' AS date, 'BBB' AS symbol UNION ALL SELECT date'2020-01-05', 'BBB'")
    assert uni.apply_membership(panel, spells).count() == 2
    assert [r.symbol for r in uni.unmatched_members(panel, spells).collect()] == ["AAA"]


def test_locked_holdout_fails_closed(spark):
    panel = spark.sql("SELECT date'2024-01-02' AS date, 'A' AS symbol UNION ALL SELECT date'2024-01-03', 'B'")
    symbols = panel.select("symbol")
    good = {"schema_version": provenance.HOLDOUT_SCHEMA_VERSION, "start": "2024-01-02", "end": "2024-01-03", "row_count": 2}
    assert provenance.locked_holdout(panel, "2024-01-02", good, symbols).count() == 1
    for change, message in (
        ({"end": "2024-01-04"}, "date range mismatch"),
        ({"row_count": 3}, "row count mismatch"),
        ({"minimum_row_count": 5}, "below minimum"),
    ):
        with pytest.raises(Exception, match=message):
            provenance.locked_holdout(panel, "2024-01-02", {**good, **change}, symbols).collect()
    with pytest.raises(Exception, match="symbol set mismatch"):
        provenance.locked_holdout(panel, "2024-01-02", good, symbols.where("symbol = 'A'")).collect()
    with pytest.raises(ValueError, match="schema_version"):
        provenance.locked_holdout(panel, "2024-01-02", {**good, "schema_version": "v0"}, symbols)


def test_manifest_files_and_experiment_sink(spark, tmp_path):
    import json

    for name in ("run-a", "run-b"):
        folder = tmp_path / "runs" / name
        folder.mkdir(parents=True)
        body = {"run_id": name, "experiment": "e", "generated_at": "2024-01-01", "config": {"sha256": "x"}, "metrics": {"test": {"sharpe": 0.5 if name == "run-b" else 0.1}}}
        (folder / "manifest.json").write_text(json.dumps(body, indent=2))
    found = mf.read_manifests(spark, str(tmp_path / "runs"))
    ranked = runs.rank_runs(runs.comparison_rows(found), "sharpe").orderBy("rank").collect()
    assert [r.run_id for r in ranked] == ["run-b", "run-a"]
    family = runs.compare_families(runs.family_rows(found)).collect()
    assert {r.family_verdict for r in family} == {"FAMILY_REVIEW"}
    with pytest.raises(Exception):
        mf.read_manifests(spark, str(tmp_path / "none")).count()
    with pytest.raises(ValueError, match="Unsupported comparison metric"):
        runs.rank_runs(runs.comparison_rows(found), "speed")

    path = str(tmp_path / "experiments")
    rows = spark.createDataFrame([("e1", "s", "a", 1.0), ("e1", "s", "b", 2.0)], "experiment string, source string, strategy string, x double")
    sinks.write_experiment_rows(rows, path)
    sinks.write_experiment_rows(rows.where("strategy = 'a'").withColumn("x", F.lit(9.0)), path)
    assert {(r.strategy, r.x) for r in spark.read.parquet(path).collect()} == {("a", 9.0), ("b", 2.0)}


def test_generator_is_repeatable_and_checks_length(spark):
    names = spark.createDataFrame([("aaa",), ("bbb",)], "symbol string")
    one = src.generate_panel(names, "2024-01-01", "2024-06-28")
    two = src.generate_panel(names.repartition(3), "2024-01-01", "2024-06-28")
    assert one.count() == two.count() == 2 * 130
    key = lambda df: df.agg(F.bit_xor(F.xxhash64("date", "symbol", F.round("close", 9)))).first()[0]
    assert key(one) == key(two)
    assert one.where("low > least(open, close) OR high < greatest(open, close) OR volume <= 0").count() == 0
    with pytest.raises(Exception, match="at least 80 business days"):
        src.generate_panel(names, "2024-01-01", "2024-02-01").collect()


def test_generator_deals_symbols_before_they_unfold(spark):
    """A small table of symbols is not one task's work: its rows move once, as symbols, and never as days."""
    names = spark.range(500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol")).coalesce(1)
    made = src.generate_panel(names, "2024-01-01", "2024-06-28")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(symbol" in plan and "REPARTITION_BY_NUM" in plan
    assert "ENSURE_REQUIREMENTS" not in plan
    assert made.count() == 500 * 130


def test_vendor_wide_file(spark):
    wide = spark.sql(
        "SELECT '2024-01-02' AS Date, 1.0D AS `AAA|Close`, 2.0D AS `AAA|Open`, CAST(NULL AS DOUBLE) AS `BBB|Close`"
    )
    long = src.vendor_wide_to_long(wide)
    assert {(r.Symbol, r.Close, r.Open) for r in long.collect()} == {("AAA", 1.0, 2.0), ("BBB", None, None)}
    requested = spark.createDataFrame([("AAA",), ("BBB",)], "symbol string")
    assert [r.symbol for r in src.vendor_missing_symbols(long, requested).collect()] == ["BBB"]
