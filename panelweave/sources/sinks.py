"""Sinks: experiment rows replaced by key and registry export. Batches write themselves (``plans/batch.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.evaluate import COST_METRICS, PERFORMANCE_METRICS

EXPERIMENT_KEY = ["experiment", "source", "strategy"]
_METRICS = [*PERFORMANCE_METRICS, *COST_METRICS]


def experiment_rows(metrics: DataFrame, windows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One ``full_sample`` row (test_* and full_* metrics) and one row per walk-forward window per strategy."""
    fixed = [F.lit(v).alias(k) for k, v in labels.items()]
    kinds = metrics.where(F.col("family").isin("primary", "baseline", "stress_test"))
    whole = kinds.groupBy(F.col("name").alias("strategy")).agg(
        *[
            F.max(F.when(F.col("split") == split, F.col(m))).alias(f"{split}_{m}")
            for split in ("test", "full")
            for m in _METRICS
        ]
    )
    whole = whole.select(*fixed, "strategy", F.lit("full_sample").alias("window"), *[c for c in whole.columns if c != "strategy"])
    each = windows.select(
        *fixed,
        F.substring_index("variant", "/", -1).alias("strategy"),
        "window",
        *[F.col(d) for d in ("train_start", "train_end", "test_start", "test_end")],
        *[F.col(m).alias(f"test_{m}") for m in _METRICS],
    )
    return whole.unionByName(each, allowMissingColumns=True)


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop existing rows whose key occurs in the incoming rows, then append those."""
    keys = keys or EXPERIMENT_KEY
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def write_experiment_rows(rows: DataFrame, path: str) -> None:
    """Parquet partitioned by the replace key; only partitions present in ``rows`` are overwritten."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*EXPERIMENT_KEY)
        .parquet(path)
    )


def export_registry(registry: DataFrame, path: str, limit: int = 1000) -> None:
    """Newest runs first as NDJSON."""
    from panelweave.operators.runs import latest_runs

    latest_runs(registry, limit).write.mode("overwrite").json(path)
