"""Snapshot provenance, locked holdout evidence and data fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.panel import PANEL_COLUMNS

HOLDOUT_SCHEMA_VERSION = "locked_holdout_v1"


#: Bytes that a running hash takes at once, and files up to this size that a task may hold whole.
BLOCK_BYTES, WHOLE_BYTES = 1 << 20, 64 << 20


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file below ``path`` (globs allowed), however large.

    A large file is read by its task in blocks that feed a running hash, so no task holds more than a block. Small files
    come through Spark's reader, which knows every store; so do large ones of a store that only Spark opens, up to 2 GB.
    Empty files, which Spark's readers pass over, have no row.
    """
    found = spark.read.format("binaryFile").load(path)  # the content is read only where it is asked for
    small = found.where(F.col("length") <= WHOLE_BYTES).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > WHOLE_BYTES).select("path", "length")
    paths = large.collect()  # names of files above 64 MB: one row for each
    if not paths:
        return small
    streamed = [tuple(r) for r in paths if _readable(r["path"])]
    rest = [r["path"] for r in paths if not _readable(r["path"])]
    names = spark.createDataFrame(streamed, large.schema).repartition(max(1, len(streamed)), "path")
    out = small.unionByName(names.mapInArrow(_hash_blocks, "path string, length long, sha256 string"))
    whole = found.where(F.col("path").isin(rest)) if rest else None
    return out if whole is None else out.unionByName(whole.select("path", "length", F.sha2("content", 256).alias("sha256")))


def _readable(path: str) -> bool:
    """Whether workers can open the file themselves."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for path in batch.column("path").to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            running = hashlib.sha256()
            with store.open_input_stream(name) as stream:
                while block := stream.read(BLOCK_BYTES):
                    running.update(block)
            hashes.append(running.hexdigest())
        yield pa.record_batch([batch.column("path"), batch.column("length"), pa.array(hashes, pa.string())], names=["path", "length", "sha256"])


def snapshot_hash(files: DataFrame) -> DataFrame:
    """One row (files, content_sha256): the hash of the file, or of the lines "hash  name" in order of several; null of none."""
    name = F.substring_index("path", "/", -1)
    lines = F.array_sort(F.collect_list(F.concat("sha256", F.lit("  "), name)))
    many = F.sha2(F.array_join(lines, "\n"), 256)
    n = F.count(F.lit(1))
    return files.agg(n.alias("files"), F.when(n == 1, F.max("sha256")).when(n > 1, many).alias("content_sha256"))


def row_digest(rows: DataFrame, text: Column) -> DataFrame:
    """One row (row_count, digest_sum, digest_xor) of a table's content, whatever the order, layout or size.

    ``text`` writes a row as a string.  32 bits of each row's MD5 are added and XORed with map-side combine; unlike a hash of
    whole files this has no size limit and equals for equal tables.
    """
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.sum(part).alias("digest_sum"), F.bit_xor(part).alias("digest_xor"))


def panel_facts(panel: DataFrame, expected_symbols: DataFrame | None = None) -> DataFrame:
    """One row: row_count, symbol_count, start, end and the differences to an expected symbol set.

    The sets meet in one join on symbol instead of as collected arrays, so they may be large.
    """
    seen = panel.groupBy(F.upper("symbol").alias("symbol")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    if expected_symbols is None:
        both = seen.withColumn("wanted", F.lit(None).cast("boolean"))
    else:
        wanted = expected_symbols.select(F.upper("symbol").alias("symbol")).distinct().withColumn("wanted", F.lit(True))
        both = seen.join(wanted, "symbol", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("n").alias("symbol_count"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
        F.count_if(F.col("wanted").isNull()).alias("unexpected_symbols"),
        F.count_if(F.col("n").isNull()).alias("absent_symbols"),
        F.count("wanted").alias("expected_symbols"),
    )


def snapshot_provenance(
    panel: DataFrame,
    manifest: dict[str, object],
    expected_symbols: DataFrame | None = None,
    files: DataFrame | None = None,
    require_hash: bool = False,
) -> DataFrame:
    """One row: what the manifest says, what the data and files are, match flags and warnings.

    ``files`` are the snapshot's (path, sha256), as from ``content_hash``. An expectation that the manifest lacks counts
    as met, but for the hash. With ``require_hash`` a hash that does not match raises an error when the row is made.
    """
    expected_hash = str(manifest.get("content_sha256") or "")
    rows, start, end = manifest.get("row_count"), manifest.get("start"), manifest.get("end")
    same = (F.col("unexpected_symbols") == 0) & (F.col("absent_symbols") == 0)
    symbols_match = (F.col("expected_symbols") == 0) | same
    actual = F.lit(None).cast("string") if files is None else snapshot_hash(files).select("content_sha256").scalar()
    out = panel_facts(panel, expected_symbols).withColumn("content_sha256", actual)
    matches = F.lit(bool(expected_hash)) & F.coalesce(F.col("content_sha256") == expected_hash, F.lit(False))
    if require_hash:
        text = F.concat(F.lit(f"snapshot content hash mismatch: expected {expected_hash or '<missing>'}, observed "), F.coalesce("content_sha256", F.lit("<missing>")))
        matches = F.when(matches, True).otherwise(F.raise_error(text).cast("boolean"))
    told = {k: F.lit(str(manifest.get(k) or "")) for k in ("dataset_id", "vendor", "as_of", "created_at")}
    claimed = {k: F.lit(bool(manifest.get(k, False))) for k in ("point_in_time_universe", "survivorship_bias_free", "corporate_actions_adjusted")}
    out = out.withColumns(
        {
            **told,
            "expected_sha256": F.lit(expected_hash),
            "expected_row_count": F.lit(None if rows is None else int(rows)).cast("long"),
            "expected_start": F.lit(str(start or "")),
            "expected_end": F.lit(str(end or "")),
            **claimed,
            "hash_matches": matches,
            "row_count_matches": F.lit(True) if rows is None else F.col("row_count") == F.lit(int(rows)),
            "symbol_set_matches": symbols_match,
            "date_range_matches": (F.lit(True) if not start else F.col("start") == F.lit(str(start)).cast("date"))
            & (F.lit(True) if not end else F.col("end") == F.lit(str(end)).cast("date")),
        }
    )
    return out.withColumn("warnings", provenance_warnings())


def provenance_warnings() -> Column:
    # The warnings' sentences.
    return F.array_compact(
        F.array(
            F.when(~F.col("hash_matches"), "Snapshot manifest hash does not match the data file."),
            F.when(~F.col("row_count_matches"), "Snapshot manifest row count does not match loaded data."),
            F.when(~F.col("symbol_set_matches"), "Snapshot manifest symbols do not match loaded data."),
            F.when(~F.col("date_range_matches"), "Snapshot manifest date range does not match loaded data."),
        )
    )


def locked_holdout(
    panel: DataFrame,
    holdout_start: str | Column,
    manifest: dict[str, object],
    expected_symbols: DataFrame,
    enforce: bool = True,
) -> DataFrame:
    """Evidence row for the rows from ``holdout_start`` on; with ``enforce`` any mismatch raises."""
    version = str(manifest.get("schema_version") or "")
    if version != HOLDOUT_SCHEMA_VERSION:
        raise ValueError(f"locked holdout manifest schema_version must be {HOLDOUT_SCHEMA_VERSION}")
    for key in ("start", "end"):
        if not str(manifest.get(key) or "").strip():
            raise ValueError(f"locked holdout manifest {key} is required")
    for key in ("row_count", "minimum_row_count"):
        value = manifest.get(key)
        if isinstance(value, bool):
            raise ValueError(f"locked holdout manifest {key} must be an integer")
        if value is not None and int(value) <= 0:
            raise ValueError(f"locked holdout manifest {key} must be positive")
    begin = F.lit(holdout_start).cast("date") if isinstance(holdout_start, str) else holdout_start
    rows = panel.where(F.col("date") >= begin)
    facts = panel_facts(rows, expected_symbols)
    expected, minimum = manifest.get("row_count"), manifest.get("minimum_row_count")
    n = F.col("row_count")
    checks = {
        "has_rows": n > 0,
        "date_range_matches": F.coalesce(
            (F.col("start") == F.lit(str(manifest["start"])).cast("date"))
            & (F.col("end") == F.lit(str(manifest["end"])).cast("date")),
            F.lit(False),
        ),
        "symbol_set_matches": (F.col("expected_symbols") > 0)
        & (F.col("unexpected_symbols") == 0)
        & (F.col("absent_symbols") == 0),
        "row_count_matches": F.lit(True) if expected is None else n == F.lit(int(expected)),
        "minimum_row_count_met": F.lit(True) if minimum is None else n >= F.lit(int(minimum)),
    }
    out = facts.withColumns(checks)
    if not enforce:
        return out
    messages = {
        "has_rows": "locked holdout slice has no market data rows",
        "date_range_matches": "locked holdout date range mismatch",
        "symbol_set_matches": "locked holdout symbol set mismatch",
        "row_count_matches": "locked holdout row count mismatch",
        "minimum_row_count_met": "locked holdout row count below minimum",
    }
    verdict = F.lit(True)
    for check, message in reversed(messages.items()):
        verdict = F.when(~F.col(check), F.raise_error(F.lit(message)).cast("boolean")).otherwise(verdict)
    return out.where(verdict)


def fingerprint(panel: DataFrame) -> DataFrame:
    """Counts plus a content hash that does not depend on row order or file layout."""
    keys = panel.select(*PANEL_COLUMNS).groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(*PANEL_COLUMNS)).alias("h"),
        F.sum(F.xxhash64(*PANEL_COLUMNS).bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"),
    )
    return keys.agg(
        F.sum("n").alias("row_count"),
        F.count_distinct("date").alias("date_count"),
        F.count_distinct("symbol").alias("symbol_count"),
        F.bit_xor("h").alias("content_xor"),
        F.sum("s").alias("content_sum"),
    )
