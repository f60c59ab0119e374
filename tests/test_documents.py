"""Many one-document files in few tasks, damaged ones as rows."""

import json

import pytest

from panelweave.sources import manifests


def write(folder, n):
    for i in range(n):
        (folder / f"run-{i}").mkdir()
        document = {"run_id": f"run-{i}", "experiment": "e", "metrics": {"test": {"sharpe": i / 10}}, "unknown": [1]}
        (folder / f"run-{i}" / "manifest.json").write_text(json.dumps(document, indent=2))


def test_a_thousand_files_are_one_task(spark, tmp_path):
    write(tmp_path, 1000)
    (tmp_path / "run-7" / "manifest.json").write_text('{"run_id": "run-7", "metr')
    (tmp_path / "run-8" / "manifest.json").write_text('{"experiment": "e", "metrics": {"test": {}}}')
    (tmp_path / "run-9" / "manifest.json").write_text('{"run_id": "run-9", "metrics": {}}')
    (tmp_path / "run-10" / "manifest.json").write_text("[1, 2]")
    found = manifests.read_documents(spark, f"{tmp_path}/*/manifest.json")
    assert found.rdd.getNumPartitions() == 1
    rows = {r.manifest_path.split("/")[-2]: r for r in found.collect()}
    assert len(rows) == 1000
    assert {k: r.error for k, r in rows.items() if r.error} == {
        "run-7": "not valid JSON", "run-8": "run_id is missing", "run-9": "metrics.test is missing", "run-10": "run_id is missing",
    }
    assert all(r.document is None for r in rows.values() if r.error)
    assert rows["run-25"].document.run_id == "run-25" and rows["run-25"].document.metrics.test.sharpe == 2.5
    kept = manifests.read_manifests(spark, str(tmp_path))
    assert kept.count() == 996


def test_tasks_grow_with_the_bytes(spark, tmp_path, monkeypatch):
    write(tmp_path, 60)
    monkeypatch.setattr(manifests, "TASK_BYTES", 2000)
    monkeypatch.setattr(manifests, "OPEN_BYTES", 10)
    found = manifests.read_documents(spark, f"{tmp_path}/*/manifest.json")
    assert 2 <= found.rdd.getNumPartitions() <= 8 and found.count() == 60


def test_no_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "manifest.json").write_text("broken")
    with pytest.raises(ValueError, match="No manifest"):
        manifests.read_manifests(spark, str(tmp_path))


def test_documents_are_written_by_tasks_into_few_folders(spark, tmp_path, monkeypatch):
    """Folders are listed one by one, so their number must not grow with the documents."""
    monkeypatch.setattr(manifests, "TASK_FILES", 50)
    rows = [(f"run-{i}", f'{{"run_id": "run-{i}", "metrics": {{"test": {{}}}}}}' if i % 10 else "{") for i in range(400)]
    manifests.write_documents(spark.createDataFrame(rows, "run string, value string"), str(tmp_path / "out"), "run")
    assert len(list((tmp_path / "out").iterdir())) <= 8 and len(list((tmp_path / "out").rglob("*.txt"))) == 400
    found = manifests.read_documents(spark, str(tmp_path / "out"), "*.txt").collect()
    assert {r.manifest_path.rsplit("=")[-1] for r in found} == {f"{name}.txt" for name, _ in rows}
    assert sum(r.error is None for r in found) == 360


def odd_folder(folder):
    """Files at several depths, an empty one, hidden ones and names that a URI writes otherwise."""
    document = '{"run_id": "%s", "metrics": {"test": {}}}'
    names = ["top.txt", "a/one.txt", "a/b/c/deep.txt", "a b/50% #1 [x] é+=&;.txt", "part=1/_k=v.txt"]
    passed = ["a/other.json", ".hidden/x.txt", "_tmp/x.txt", "a/.x.txt", "a/_x.txt"]
    for name in names + passed:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(document % name)
    (folder / "a" / "empty.txt").write_text("")
    (folder / "a" / "bytes.txt").write_bytes(b'{"run_id": "\xff')
    return names


def test_the_driver_holds_no_names_of_documents(spark, tmp_path):
    names = odd_folder(tmp_path)
    found = manifests.read_documents(spark, str(tmp_path), "*.txt")
    assert not [file for file in found.inputFiles() if file.endswith(".txt")]
    rows = {r.manifest_path: r for r in found.collect()}
    indexed = spark.read.options(recursiveFileLookup="true", pathGlobFilter="*.txt").text(str(tmp_path), wholetext=True)
    own = {r.p: r.value for r in indexed.selectExpr("_metadata.file_path AS p", "value").collect()}
    assert set(rows) - set(own) == {f"file:{tmp_path}/a/empty.txt"} and not set(own) - set(rows)
    assert sorted(r.document.run_id for r in rows.values() if r.document) == sorted(names)
    assert {p.rsplit("/", 1)[1] for p, r in rows.items() if r.error == "not valid JSON"} == {"empty.txt", "bytes.txt"}


def test_documents_below_a_folder_in_tasks_by_their_bytes(spark, tmp_path, monkeypatch):
    write(tmp_path, 60)
    monkeypatch.setattr(manifests, "TASK_BYTES", 2000)
    monkeypatch.setattr(manifests, "OPEN_BYTES", 10)
    monkeypatch.setattr(manifests, "BATCH_ROWS", 7)
    monkeypatch.setattr(manifests, "BATCH_BYTES", 300)
    found = manifests.read_documents(spark, str(tmp_path), "manifest.json")
    assert 2 <= found.rdd.getNumPartitions() <= 8
    assert sorted(r.document.run_id for r in found.collect()) == sorted(f"run-{i}" for i in range(60))


def test_documents_below_a_folder_without_any(spark, tmp_path):
    assert manifests.read_documents(spark, str(tmp_path), "*.txt").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifests.read_documents(spark, str(tmp_path / "none"), "*.txt")


def test_a_store_that_only_spark_opens(spark, tmp_path):
    names = odd_folder(tmp_path)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.documents.link./in", tmp_path.as_uri())
    found = manifests.read_documents(spark, "viewfs://documents/in", "*.txt").collect()
    assert sorted(r.document.run_id for r in found if r.document) == sorted(names)
