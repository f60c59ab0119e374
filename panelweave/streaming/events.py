"""Streaming folds of append-only event logs (the same rules as the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelweave.operators.events import current_status

AUDIT_SCHEMA = "entity string, seq long, created_at timestamp, to_status string"


def read_audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Audit events appended to ``path`` as JSON lines."""
    return spark.readStream.schema(AUDIT_SCHEMA).json(path)


def current_status_stream(audit: DataFrame) -> DataFrame:
    """Running last status per entity.  State is one row per entity; late events are ordered by their own
    time, so they never overwrite a newer status."""
    return current_status(audit)


def start_status_table(audit: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table of status changes: each batch adds the entities whose status it changed.

    A batch writes as much as it changes, whatever the table holds; ``read_status_table`` takes the newest row of each
    entity, ``compact_status_table`` folds old versions into one.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        # Rerunning a batch after a failure rewrites the same version.
        batch.write.mode("overwrite").parquet(f"{table_path}/version={batch_id}")

    return (
        current_status_stream(audit)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def read_status_table(spark: SparkSession, table_path: str) -> DataFrame:
    """Current row of each entity: the one of its newest version."""
    rows = spark.read.parquet(table_path)
    packed = F.struct(*[c for c in rows.columns if c not in ("entity", "version")])
    return rows.groupBy("entity").agg(F.max_by(packed, "version").alias("r")).select("entity", "r.*")


def compact_status_table(spark: SparkSession, table_path: str, target_path: str) -> None:
    """Write the current rows as one version at ``target_path``."""
    read_status_table(spark, table_path).write.mode("overwrite").parquet(f"{target_path}/version=0")
