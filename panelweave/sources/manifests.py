"""Run manifests: discovery on storage and the manifest sink."""

from __future__ import annotations

import re
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.groupwise import input_bytes
from panelweave.operators.runs import MANIFEST_SCHEMA
from panelweave.session import stage
from panelweave.sources.panel import require_rows

#: Bytes of small documents that a task reads, and those that opening a file counts as.
TASK_BYTES, OPEN_BYTES = 64 << 20, 64 << 10
#: Files that a task writes.
TASK_FILES = 5_000
#: Names, and bytes of texts, that a task hands on at once.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def read_documents(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(manifest_path, document, error): one row for each one-document file of a glob, damaged ones included.

    With ``name``, ``path`` is a folder and every file of that name (or pattern) at any depth below it is read: tasks list
    its folders and open its files, so the driver holds no names. A glob, and a store that only Spark opens, go through
    Spark's file index, which holds all names on the driver (some 700 bytes each) and passes over empty files.

    Documents are small and many: Spark counts megabytes for opening each file, which would make a task of a few dozen,
    so files are packed by what they hold and a small part for opening each. ``document`` is null where ``error`` says why.
    """
    folder = None if name is None else _store_uri(spark, path)
    texts = _indexed_texts(spark, path, name) if folder is None else _texts_below(spark, folder, name)
    return texts.select("manifest_path", F.from_json("text", MANIFEST_SCHEMA).alias("document"), _damage(F.col("text")).alias("error")).select(
        "manifest_path", F.when(F.col("error").isNull(), F.col("document")).alias("document"), "error"
    )


def _tasks(size: int, files: int) -> int:
    return max(1, -(-(size + OPEN_BYTES * files) // TASK_BYTES))


def _indexed_texts(spark: SparkSession, path: str, name: str | None) -> DataFrame:
    """(manifest_path, text) through Spark's file index."""
    below = {} if name is None else {"recursiveFileLookup": "true", "pathGlobFilter": name}
    files = spark.read.options(**below).text(path, wholetext=True)
    tasks = _tasks(input_bytes(files) or 0, len(files._jdf.inputFiles()))  # the names stay in the JVM
    return files.select(F.col("_metadata.file_path").alias("manifest_path"), F.col("value").alias("text")).coalesce(tasks)


def _store_uri(spark: SparkSession, path: str) -> str | None:
    """The folder as a URI that tasks open themselves; None where Spark has to: another kind of store, no folder."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop_path(path)
    hadoop = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not hadoop.exists(folder) or not hadoop.getFileStatus(folder).isDirectory():
        return None
    uri = hadoop_path(hadoop.makeQualified(folder), "-").getParent().toUri().toString().rstrip("/")  # as Spark writes those of its files
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return uri


def _files_below(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path, size) of the files of that name at any depth below ``folder``, with paths from there on; hidden ones left out as Spark does.

    Tasks list a level of folders and write what they find; the driver only counts the folders of the next. A task holds the
    names of one folder at a time.
    """
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(name).compiled().pattern()

    def listed(batches):
        store, root = fs.FileSystem.from_uri(folder)

        def entries():
            for batch in batches:
                for above in batch.column("path").to_pylist():
                    for found in store.get_file_info(fs.FileSelector(f"{root}{above}")):
                        last = found.base_name
                        if last.startswith(".") or (last.startswith("_") and "=" not in last) or last.endswith("._COPYING_"):
                            continue
                        if found.type == fs.FileType.Directory:
                            yield f"{above}/{last}", None
                        elif found.type == fs.FileType.File and re.fullmatch(pattern, last, re.DOTALL):
                            yield f"{above}/{last}", found.size

        for part in batched(entries(), BATCH_ROWS):
            paths, sizes = zip(*part)
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    level, n, levels = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        tasks = min(n, spark.sparkContext.defaultParallelism)
        found = stage(level.repartition(tasks, "path").mapInArrow(listed, "path string, size long"), "listing")
        levels.append(found.where("size IS NOT NULL"))
        level = found.where("size IS NULL").select("path")  # folders have no size
        n = level.count()
    return reduce(DataFrame.unionByName, levels)


def _texts_below(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(manifest_path, text) of the files of that name below ``folder``, opened by tasks."""
    files = _files_below(spark, folder, name)
    size, n = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)

        def record(paths, texts):
            # names as Spark writes them in _metadata.file_path
            quoted = [re.sub(r'[\x00-\x20\x7f"#%<>?\[\\\]^`{|}]', lambda c: f"%{ord(c[0]):02X}", path) for path in paths]
            return pa.record_batch([pa.array([f"{folder}{path}" for path in quoted], pa.string()), pa.array(texts, pa.binary())], names=["manifest_path", "text"])

        paths, texts, held = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{root}{path}") as stream:
                    texts.append(stream.read())
                paths.append(path)
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield record(paths, texts)
                    paths, texts, held = [], [], 0
        if paths:
            yield record(paths, texts)

    texts = files.select("path").repartition(_tasks(size, n), "path").mapInArrow(read, "manifest_path string, text binary")
    return texts.select("manifest_path", F.col("text").cast("string").alias("text"))


def write_documents(documents: DataFrame, folder: str, key: str) -> None:
    """One file for each row of (``key``, value): ``<folder>/<number>/<key>=<its value>.txt``, a numbered folder for each task.

    Spark's writer and committer take several calls of the store, and on a local disk child processes, for each file and
    folder, so tasks write the files themselves, cut by rows. A task that runs again writes the same files again.
    """
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, -(-documents.count() // TASK_FILES))

    def write(number, rows):
        store, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(f"{root}/{number}")
        for name, value in rows:
            with store.open_output_stream(f"{root}/{number}/{key}={name}.txt") as out:
                out.write(f"{value}\n".encode())
        return []

    documents.select(key, "value").repartition(tasks, key).rdd.mapPartitionsWithIndex(write).count()


def _damage(text: Column) -> Column:
    """What keeps a document from being a manifest, or null."""
    parsed = F.try_parse_json(text)
    run_id = F.try_variant_get(parsed, "$.run_id", "string")
    return (
        F.when(parsed.isNull(), "not valid JSON")
        .when(run_id.isNull() | (run_id == ""), "run_id is missing")
        .when(F.try_variant_get(parsed, "$.metrics.test", "variant").isNull(), "metrics.test is missing")
    )


def read_manifests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Manifests under ``path``: a file or glob, or ``*/manifest.json`` below a folder; adds manifest_path.

    ``multi_line`` is for one document per file, of which damaged ones are left out (``read_documents`` shows them);
    packed manifests are one document per line.
    """
    glob = path if path.endswith((".json", ".txt")) else f"{path.rstrip('/')}/*/manifest.json"
    if multi_line:
        found = read_documents(spark, glob).where("error IS NULL").select("document.*", "manifest_path")
    else:
        found = spark.read.schema(MANIFEST_SCHEMA).json(glob).select("*", F.col("_metadata.file_path").alias("manifest_path"))
    return require_rows(found, f"No manifest.json files found under {path}")


def write_manifests(manifests: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Packed manifests, one JSON document per line, at most ``per_file`` in a file.

    Every task writes what it has, so the number of writers grows with the table.
    """
    packed = manifests.select(F.to_json(F.struct(*MANIFEST_SCHEMA.fieldNames())).alias("value"))
    packed.write.option("compression", "none").option("maxRecordsPerFile", per_file).format("text").mode("overwrite").save(path)
