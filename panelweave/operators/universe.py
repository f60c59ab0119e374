"""Point-in-time universe: membership intervals and the interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBERSHIP_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("symbol", "start", "end")]
)
STATIC_WARNING = "Static universe is not point-in-time and may contain survivorship bias."


def static_membership(symbols: DataFrame, start: str, end: str) -> DataFrame:
    """One interval per symbol over the whole request; flagged as not point-in-time."""
    return symbols.select(
        F.upper("symbol").alias("symbol"),
        F.lit(start).cast("date").alias("start"),
        F.lit(end).cast("date").alias("end"),
        F.lit(False).alias("point_in_time"),
        F.lit(False).alias("survivorship_free"),
        F.lit(STATIC_WARNING).alias("warning"),
    )


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Membership CSV: symbol and start are required, a missing ``end`` column means open intervals."""
    names = spark.read.option("header", True).csv(path).columns  # header only
    missing = sorted({"symbol", "start"} - set(names))
    if missing:
        raise ValueError(f"universe membership CSV missing columns: {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    end = F.col("end") if "end" in names else F.lit(None).cast("string")
    return raw.select("symbol", "start", end.alias("end"))


def normalize_membership(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Upper-case, open ends closed at the request end, non-overlapping intervals dropped, both ends clipped."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    typed = raw.select(
        F.upper("symbol").alias("symbol"),
        F.col("start").cast("date").alias("start"),
        F.coalesce(F.col("end").cast("date"), last).alias("end"),
    )
    return typed.where((F.col("start") <= last) & (F.col("end") >= first)).select(
        "symbol", F.greatest("start", first).alias("start"), F.least("end", last).alias("end")
    )


def apply_membership(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Panel rows inside any interval of their symbol; overlapping intervals repeat rows.

    The symbol equality makes it a hash join with a residual date filter, never a nested loop.  The
    intervals are broadcast by Spark when their measured size allows it; otherwise both sides are
    shuffled on symbol and AQE splits a skewed one.
    """
    spells = membership.select(F.col("symbol").alias("__s"), F.col("start").alias("__from"), F.col("end").alias("__to"))
    inside = (F.col("symbol") == F.col("__s")) & F.col("date").between(F.col("__from"), F.col("__to"))
    return panel.join(spells, inside).drop("__s", "__from", "__to")


def unmatched_members(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Membership symbols without any panel row (an error in a research run)."""
    return membership.select("symbol").distinct().join(panel.select("symbol").distinct(), "symbol", "left_anti")


def universe_symbols(membership: DataFrame) -> DataFrame:
    return membership.select("symbol").distinct()
