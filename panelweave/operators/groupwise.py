"""Ranks, quantiles, totals and positions inside groups of any size.

Two plans exist for each primitive and both give the same rows:

* compact: the group fits in one task, so one exchange on the group key and a window is the
  cheapest plan;
* split: a single group (one date, one family, the whole table) may hold a large share of all
  rows.  Values are first compressed to (value, count) with map-side combine, range-partitioned
  on (group, value) so a hot group is cut across partitions, numbered within each partition and
  shifted by the totals of the partitions before it.

``split=None`` decides: a query that reads few bytes cannot have a large group (no job is run to see
that); beyond it, or where a source does not tell its size, one narrow count per group finds the largest group, and only a group above the limit
asks for the split plan.  Callers that know their groups pass a flag.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import stage

# A group can never be larger than the input, so below this size every group fits in one task.
COMPACT_INPUT_BYTES = 256 * 1024 * 1024
# Rows of one group a single window task handles comfortably (narrow rows, spill included).
GROUP_ROWS = 5_000_000
_UNKNOWN_SIZE = 1 << 62
_ADVISORY_BYTES = 64 * 1024 * 1024  # AQE merges shuffle partitions up to this size


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files behind ``df`` as the optimizer sees them (driver-made tables count 0); None if a source does not tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(size >= _UNKNOWN_SIZE for size in sizes) else sum(sizes)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group.  Only the key columns are read, and counts combine on the map side."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n"))
    return counted.first()[0] or 0


def needs_split(df: DataFrame, split: bool | None = None, keys: list[str] | None = None) -> bool:
    """Whether some group (the whole table without ``keys``) is too large for one task."""
    if split is not None:
        return split
    size = input_bytes(df)
    # Without keys the group is the table: a total order takes at least a byte a row, so few bytes are few rows.
    if size is not None and size <= (COMPACT_INPUT_BYTES if keys else GROUP_ROWS):
        return False
    return (largest_group(df, keys) if keys else df.count()) > GROUP_ROWS


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition on ``keys`` over all cores when the input is too small for AQE to do so.

    Windows cost far more CPU than bytes; coalescing by size would put a small panel on one core.  A
    larger input is left to the planner (shuffle partitions and AQE), so the exchange is never doubled:
    the window that follows needs this very partitioning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df)
    if size is not None and size < cores * _ADVISORY_BYTES:
        return df.repartition(cores, *keys)
    return df


def _range_partitions(df: DataFrame) -> int:
    """Ranges of about the advisory size each, at least the session's number of shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(input_bytes(df) or 0) // _ADVISORY_BYTES))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on ``keys`` (a null group key is a group of its own)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``table`` on ``keys`` null-safely and keep one copy of the keys."""
    renamed = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    return df.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def value_positions(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, value, __c, __upto, __n): rows per distinct value, rows up to and including it, group size.

    The staged write pins the range boundaries, so the totals and the rows agree even when a
    lost executor makes Spark run a stage again.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__c")
    )
    ranged = stage(
        counted.repartitionByRange(_range_partitions(df), *keys, value).withColumn("__part", F.spark_partition_id()),
        "positions",
    )
    totals = ranged.groupBy(*keys, "__part").agg(F.sum("__c").alias("__t"))
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # One row per (group, range partition): at most spark.sql.shuffle.partitions rows in a window.
    offsets = totals.select(
        *keys,
        "__part",
        (F.sum("__t").over(by_group.orderBy("__part")) - F.col("__t")).alias("__before"),
        F.sum("__t").over(by_group).alias("__n"),
    )
    inside = Window.partitionBy("__part", *keys).orderBy(value)
    running = ranged.withColumn("__upto", F.sum("__c").over(inside))
    return attach(running, offsets, [*keys, "__part"]).select(
        *keys, value, "__c", (F.col("__before") + F.col("__upto")).alias("__upto"), "__n"
    )


def with_average_rank(
    df: DataFrame,
    keys: list[str],
    ranks: dict[str, str],
    counts: dict[str, str] | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Add 1-based ranks with ties averaged; null values get null and are not counted.

    ``ranks`` maps output column -> value column, ``counts`` output column -> value column for the
    number of non-null values in the group.
    """
    counts = counts or {}
    if not needs_split(df, split, keys):
        group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        out = spread(df, keys) if keys else df
        for name, value in ranks.items():
            present = group.orderBy(F.col(value).asc_nulls_last())
            first = F.rank().over(present)
            last = F.count(value).over(present)  # range frame: counts the peers of the row too
            out = out.withColumn(name, F.when(F.col(value).isNotNull(), (first + last) / 2.0))
        for name, value in counts.items():
            out = out.withColumn(name, F.count(value).over(group))
        return out
    wanted: dict[str, list[tuple[str, str]]] = {}
    for name, value in ranks.items():
        wanted.setdefault(value, []).append((name, "rank"))
    for name, value in counts.items():
        wanted.setdefault(value, []).append((name, "count"))
    out = df
    for value, targets in wanted.items():
        table = value_positions(df, keys, value)
        rank_names = [n for n, kind in targets if kind == "rank"]
        count_names = [n for n, kind in targets if kind == "count"]
        if rank_names:
            rank = F.col("__upto") - (F.col("__c") - 1) / 2.0
            ranked = table.select(*keys, value, *[rank.alias(n) for n in rank_names])
            out = attach(out, ranked, [*keys, value], "left")
        if count_names:
            sizes = df.groupBy(*keys).agg(*[F.count(value).alias(n) for n in count_names])
            out = attach(out, sizes, keys, "left")
    return out


def with_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], split: bool | None = None
) -> DataFrame:
    """Add linearly interpolated quantiles of ``value`` per group, plus the group's non-null count ``n_values``."""
    if not needs_split(df, split, keys):
        group = Window.partitionBy(*keys)
        out = df.withColumn("n_values", F.count(value).over(group))
        for name, q in quantiles.items():
            out = out.withColumn(name, F.percentile(value, F.lit(float(q))).over(group))
        return out
    return attach(df, quantile_table(df, keys, value, quantiles), keys, "left")


def quantile_table(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, n_values, one column per quantile) from order statistics; no group sits in one task."""
    spots = value_positions(df, keys, value)
    aggs = [F.max("__n").alias("n_values")]
    for name, q in quantiles.items():
        at = (F.col("__n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        covers = lambda p: (F.col("__upto") - F.col("__c") <= p) & (p < F.col("__upto"))
        aggs += [
            F.max(F.when(covers(low), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(covers(high), F.col(value))).alias(f"__hi_{name}"),
        ]
    cut = spots.groupBy(*keys).agg(*aggs)
    for name, q in quantiles.items():
        at = (F.col("n_values") - 1) * F.lit(float(q))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        cut = cut.withColumn(name, low + (high - low) * (at - F.floor(at)))
    return cut.select(*keys, "n_values", *quantiles)


def with_group_totals(
    df: DataFrame, keys: list[str], totals: dict[str, Column], split: bool | None = None
) -> DataFrame:
    """Add per-group aggregates to each row: a window when groups are small, else aggregate and join."""
    if not needs_split(df, split, keys):
        group = Window.partitionBy(*keys)
        return df.select("*", *[agg.over(group).alias(name) for name, agg in totals.items()])
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in totals.items()])
    return attach(df, table, keys, "left")


def with_position(
    df: DataFrame, order: list[str], descending: bool = False, name: str = "rank", split: bool | None = None
) -> DataFrame:
    """1-based position of each row in a total order over the whole table (``order`` must be unique).

    ``descending`` applies to the first column only; the others break ties upwards.
    """
    first = F.col(order[0]).desc() if descending else F.col(order[0]).asc()
    keys = [first, *[F.col(c).asc() for c in order[1:]]]
    if not needs_split(df, split):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).cast("long"))
    ranged = stage(
        df.repartitionByRange(_range_partitions(df), *keys).withColumn("__part", F.spark_partition_id()), "order"
    )
    totals = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__t"))
    # At most one row per range partition, so this window and the broadcast are bounded.
    offsets = totals.select(
        "__part", (F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__t")).alias("__before")
    )
    numbered = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__before") + F.col("__rn")).cast("long"))
        .drop("__part", "__before", "__rn")
    )
