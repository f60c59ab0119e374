"""Consecutive numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: str, order: list[Column], into: str, parts: int = 256) -> DataFrame:
    """Adds ``into``: 0, 1, ... inside each ``group``, in an order that depends on the rows alone.

    A group is dealt into ``parts`` by a hash of ``order``; rows are numbered inside their part and shifted by
    the sizes of the parts before, so no task needs a whole group. Rows equal in ``order`` are exchangeable.
    ``rows`` is read twice: pass a written table.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    joined = dealt.withColumn("_inside", inside).join(shift, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(into, F.col("_shift") + F.col("_inside")).drop("_part", "_inside", "_group", "_of", "_shift")
