"""Hash chains of any length, sealed ledgers, inventories and files of any size."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelweave.operators import events as ev
from panelweave.operators import provenance as prv


def test_a_chain_of_a_million_rows(spark):
    """One chain streams through its task; a neighbour with few rows is not disturbed."""
    n = 1_000_000
    records = spark.range(n).select(F.lit(1).alias("chain"), F.col("id").alias("index"), F.col("id").cast("string").alias("payload"))
    few = spark.createDataFrame([(2, i, f"p{i}") for i in range(3)], "chain int, index long, payload string")
    links = ev.build_chains(records.unionByName(few).repartition(7))
    heads = {r.chain: (r.row_count, r.final_hash) for r in ev.chain_heads(links).collect()}
    previous = ""
    for i in range(n):
        previous = hashlib.sha256(f"{hashlib.sha256(str(i).encode()).hexdigest()}|{previous}".encode()).hexdigest()
    assert heads[1] == (n, previous)
    assert heads[2][0] == 3


def records_of(spark, n=40):
    rows = [(i // 20, i % 20, f"run-{i}", f'{{"run":{i}}}', f"fam-{i % 3}", None if i % 4 == 0 else "h", "c", "exploratory", "PASS", i / 200, None) for i in range(n)]
    return spark.createDataFrame(
        rows,
        "chain long, index long, run_id string, record string, experiment_family_id string, hypothesis_id string, candidate_id string, "
        "selection_policy string, run_validity_verdict string, holdout_ic_p_value double, holdout_ic_q_value double",
    )


def test_registry_chain_rows_hash_their_json(spark):
    """A row's hash is that of the sorted JSON of its other fields, so another program can check it."""
    previous = None
    for row in ev.registry_chain(records_of(spark, 20)).orderBy("index").collect():
        evidence = json.loads(row.family_evidence)
        assert set(evidence) == set(ev.EVIDENCE)
        payload = {"index": row["index"], "run_id": row.run_id, "record_sha256": row.record_sha256, "previous_chain_hash": previous, "family_evidence": evidence}
        assert row.record_sha256 == hashlib.sha256(f'{{"run":{row["index"]}}}'.encode()).hexdigest()
        assert row.previous_chain_hash == previous
        previous = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert row.chain_hash == previous


@pytest.mark.parametrize(
    "change, error",
    [
        ({"run_id": "run-x"}, "hash chain run_id mismatch"),
        ({"record_sha256": "0"}, "hash chain record hash mismatch"),
        ({"family_evidence": "{}"}, "hash chain hash mismatch"),
        ({"previous_chain_hash": "0"}, "hash chain previous hash mismatch"),
        ({"chain_hash": "0"}, "hash chain hash mismatch"),
    ],
)
def test_registry_tampering_is_found(spark, change, error):
    records = records_of(spark)
    links = ev.registry_chain(records)
    heads = ev.chain_heads(links)
    assert ev.verify_registry_chain(links, records, heads).count() == 0
    at = (F.col("chain") == 1) & (F.col("index") == 7)
    forged = links.withColumns({c: F.when(at, v).otherwise(F.col(c)) for c, v in change.items()})
    found = {(r.chain, r["index"], r.error) for r in ev.verify_registry_chain(forged, records, heads).collect()}
    assert (1, 7, error) in found and all(c == 1 for c, _, _ in found)


def test_registry_records_lost_added_and_altered(spark):
    records = records_of(spark)
    links = ev.registry_chain(records)
    heads = ev.chain_heads(links)
    at = (F.col("chain") == 0) & (F.col("index") == 5)
    altered = records.withColumn("record", F.when(at, "{}").otherwise(F.col("record")))
    assert [tuple(r) for r in ev.verify_registry_chain(links, altered, heads).collect()] == [(0, 5, "hash chain record hash mismatch")]
    assert [tuple(r) for r in ev.verify_registry_chain(links, records.where(~at), heads).collect()] == [(0, 5, "chain row has no record")]
    cut = {(r.chain, r["index"], r.error) for r in ev.verify_registry_chain(links.where("index < 19 or chain = 1"), records, heads).collect()}
    assert cut == {(0, 19, "record has no chain row"), (0, None, "row count mismatch"), (0, None, "final hash mismatch")}
    twice = links.unionByName(links.where(at))
    assert (0, 5, "chain row is repeated") in {tuple(r) for r in ev.verify_registry_chain(twice, records, heads).collect()}


def event_rows(spark, n=30):
    rows = [(0, i, "recommended" if i % 2 == 0 else "decided", f"r{i // 2}", "a", ev.EVENT_SCHEMA, None if i % 5 == 0 else "note") for i in range(n)]
    return spark.createDataFrame(rows, "ledger long, seq long, event_type string, recommendation_id string, actor string, schema_version string, note string")


def test_sealed_events_hash_their_json(spark):
    previous = None
    for row in ev.seal_events(event_rows(spark)).orderBy("seq").collect():
        payload = {k: v for k, v in row.asDict().items() if k not in ("ledger", "seq", "event_hash")}
        assert payload["previous_hash"] == previous
        previous = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert row.event_hash == previous


def test_forged_rehashed_and_old_events_are_found(spark):
    good = ev.seal_events(event_rows(spark))
    assert ev.seal_errors(good).count() == 0
    at = F.col("seq") == 8
    forged = good.withColumn("actor", F.when(at, "mallory").otherwise(F.col("actor")))
    assert [tuple(r) for r in ev.seal_errors(forged).collect()] == [(0, 8, "event_hash mismatch")]
    # Hashing the forged event again breaks the next one, and so on to the end of the ledger.
    again = forged.where(at).first().asDict()
    payload = {k: v for k, v in again.items() if k not in ("ledger", "seq", "event_hash")}
    own = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    rehashed = forged.withColumn("event_hash", F.when(at, own).otherwise(F.col("event_hash")))
    assert [tuple(r) for r in ev.seal_errors(rehashed).collect()] == [(0, 9, "previous_hash mismatch")]
    old = ev.seal_events(event_rows(spark).withColumn("schema_version", F.when(at, "v0").otherwise(F.col("schema_version"))))
    assert [tuple(r) for r in ev.seal_errors(old).collect()] == [(0, 8, "has unsupported schema")]
    assert [tuple(r) for r in ev.seal_errors(good.where(~at)).collect()] == [(0, 9, "previous_hash mismatch")]


def test_evidence_files(spark):
    row = {"run_id": "r", "family_id": "f", "hypothesis_id": "h", "candidate_id": "c", "family_verdict": "FAMILY_PROMOTE"}
    texts = {
        "good": json.dumps({"rows": [row, row | {"run_id": "other"}]}),
        "bad_json": "{",
        "twice": json.dumps({"rows": [row, row]}),
        "rejected": json.dumps({"rows": [row | {"family_verdict": "FAMILY_REJECT"}]}),
        "no_rows": "{}",
        "other_family": json.dumps({"rows": [row | {"family_id": "g", "candidate_id": None}]}),
        "altered": json.dumps({"rows": [row]}),
    }
    names = [*texts, "absent"]
    events = [(i, "recommended", name, "altered" if name == "altered" else "sha", "r", "f", "h", "c") for i, name in enumerate(names)]
    events = spark.createDataFrame(events, "seq long, event_type string, evidence_path string, evidence_sha256 string, run_id string, family_id string, hypothesis_id string, candidate_id string")
    files = spark.createDataFrame([(k, "sha", v) for k, v in texts.items()], "path string, sha256 string, text string")
    found = {(names[r.seq], r.error) for r in ev.evidence_errors(events, files).collect()}
    unsupported = "evidence does not contain the selected FAMILY_PROMOTE row"
    assert found == {
        ("absent", "evidence file is missing"), ("altered", "evidence sha256 mismatch"), ("bad_json", "evidence is invalid JSON"), ("twice", unsupported),
        ("rejected", unsupported), ("no_rows", unsupported), ("other_family", "evidence family_id mismatch"), ("other_family", "evidence candidate_id mismatch"),
    }


def test_ledger_without_recommendation_ids(spark):
    """A missing id is the empty one: repeats of it are repeats."""
    base = dict(family_id="f", hypothesis_id="h", candidate_id="c", run_id="r", evidence_path="e", evidence_sha256="s", actor="a", role="researcher", status="pending", event_type="recommended")
    decision = base | dict(event_type="decided", role="operator", status="approved", actor="b")
    schema = "seq long, recommendation_id string, " + ", ".join(f"{k} string" for k in base)
    for missing in (None, ""):
        rows = [(0, missing, *base.values()), (1, missing, *(base | {"run_id": "q"}).values()), (2, missing, *(decision | {"run_id": "q"}).values()), (3, missing, *(decision | {"run_id": "q"}).values())]
        found = {(r.seq, r.error) for r in ev.ledger_errors(spark.createDataFrame(rows, schema)).collect()}
        assert {(1, "duplicates recommendation id"), (3, "duplicates decision")} <= found
        assert {(i, "recommendation_id must not be empty") for i in range(4)} <= found


def test_inventory_rows(spark):
    manifest = spark.createDataFrame([(i, f"p{i}", f"s{i}") for i in range(10)], "position long, path string, sha256 string")
    assert ev.inventory_row_differences(manifest, manifest).count() == 0
    at = F.col("position")
    inventory = manifest.where("position <> 2").withColumns({"sha256": F.when(at == 3, None).otherwise(F.col("sha256")), "position": F.when(at == 4, 40).otherwise(at)})
    inventory = inventory.unionByName(manifest.where("position = 5")).unionByName(spark.createDataFrame([(10, "new", "s")], manifest.schema))
    assert sorted(tuple(r) for r in ev.inventory_row_differences(inventory, manifest).collect()) == [("new", "not in manifest"), ("p2", "missing from inventory"), ("p3", "changed"), ("p4", "moved"), ("p5", "repeated")]
    assert ev.inventory_row_differences(manifest.limit(0), manifest).count() == 10


def test_inventory_query_drops_rows_by_their_own_position(spark, tmp_path):
    """Rows that move by 100,000 are kept or lost by the position they had."""
    from panelweave.plans.catalog import corpus

    pages = spark.range(100_000).select(F.col("id").alias("page_id"), F.col("id").cast("string").alias("url"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    left = {r.position for r in corpus.inventory_rows(spark, str(tmp_path)).where("path NOT LIKE 'extra/%'").select("position").collect()}
    lost = [p for p in range(7, 100_000) if p % 840 < 7 and p % 61 != 10]
    assert not [p for p in lost if (p + 100_000 if p % 89 == 20 else p) in left]
    kept = [p for p in range(100_000) if (p % 840 >= 7 or p < 7) and (p % 83 >= 14 or p % 7 != 0)]
    assert not [p for p in kept if (p + 100_000 if p % 89 == 20 else p) not in left]


def test_hashes_of_small_and_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prv, "WHOLE_BYTES", 5_000_000)
    contents = {"small.csv": b"a,b\n1,2\n", "large.csv": bytes(range(256)) * 30_000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.csv").touch()  # Spark's readers pass over empty files
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in prv.content_hash(spark, f"{tmp_path}/*.csv").collect()}
    assert found == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}


def test_provenance_joins_the_real_hash(spark, tmp_path):
    (tmp_path / "data.csv").write_text("x")
    files = prv.content_hash(spark, str(tmp_path / "data.csv"))
    panel = spark.createDataFrame([("2024-01-02", "AAA"), ("2024-01-03", "BBB")], "date string, symbol string").withColumn("date", F.to_date("date"))
    right = hashlib.sha256(b"x").hexdigest()
    manifest = {"content_sha256": right, "dataset_id": "d1", "row_count": 2, "point_in_time_universe": True}
    row = prv.snapshot_provenance(panel, manifest, files=files, require_hash=True).first()
    assert row.hash_matches and row.content_sha256 == right and row.warnings == [] and row.dataset_id == "d1" and row.point_in_time_universe
    wrong = prv.snapshot_provenance(panel, manifest | {"content_sha256": "0" * 64}, files=files)
    assert not wrong.first().hash_matches and wrong.first().warnings == ["Snapshot manifest hash does not match the data file."]
    with pytest.raises(Exception, match="snapshot content hash mismatch"):
        prv.snapshot_provenance(panel, manifest | {"content_sha256": "0" * 64}, files=files, require_hash=True).collect()
    with pytest.raises(Exception, match="<missing>"):
        prv.snapshot_provenance(panel, {}, files=files, require_hash=True).collect()
    (tmp_path / "more.csv").write_text("y")
    both = prv.snapshot_hash(prv.content_hash(spark, f"{tmp_path}/*.csv")).first()
    lines = sorted(f"{hashlib.sha256(t.encode()).hexdigest()}  {n}" for n, t in (("data.csv", "x"), ("more.csv", "y")))
    assert both.files == 2 and both.content_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
