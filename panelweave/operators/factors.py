"""Rolling factor library: 22 factors from one exchange on ``symbol``.

Frames are RANGE frames over ``date_idx`` (position in the panel calendar), which gives the
calendar-row semantics (a missing date leaves a hole that empties every window touching it)
without materialising the missing cells.  A symbol has at most one row per date, so a symbol's
window partition is bounded by the calendar, whatever the size of the panel.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelweave.functions import ratio
from panelweave.operators.groupwise import spread
from panelweave.session import stage

# Ties are decided on values rounded to this many decimals, as everywhere (see ``signals``).
TIE_DECIMALS = 12


def _frame(first: int, last: int) -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date_idx").rangeBetween(first, last)


def at_offset(value: str | Column, rows: int) -> Column:
    """Value ``rows`` calendar rows ahead (negative: back); null when that cell is missing."""
    return F.max(value).over(_frame(rows, rows))


def trailing(agg: Column, rows: int) -> Column:
    return agg.over(_frame(-(rows - 1), 0))


def full(rows: int, value: str, agg: Column, min_periods: int | None = None) -> Column:
    """``agg`` over the trailing window when it holds enough non-null values (default: all of them)."""
    enough = trailing(F.count(value), rows) >= (rows if min_periods is None else min_periods)
    return F.when(enough, trailing(agg, rows))


# Helper columns every factor may use.  They are windows/projections over the same partitioning,
# and Catalyst removes the ones no requested factor needs.
def with_building_blocks(df: DataFrame) -> DataFrame:
    close, volume = F.col("adj_close"), F.col("volume")
    lags = {f"__c{n}": at_offset("adj_close", -n) for n in (1, 5, 10, 20, 60)}
    step1 = df.withColumns({**lags, "__v1": at_offset("volume", -1), "__dv": close * volume})
    step2 = step1.withColumns(
        {
            "__r": ratio(close, F.col("__c1")) - 1.0,
            "__vr": ratio(volume, F.col("__v1")) - 1.0,
            "__gain": F.when(F.col("__c1").isNotNull(), F.greatest(close - F.col("__c1"), F.lit(0.0))),
            "__loss": F.when(F.col("__c1").isNotNull(), F.greatest(F.col("__c1") - close, F.lit(0.0))),
        }
    )
    return step2.withColumns(
        {
            "__down": F.when(F.col("__r") < 0, F.col("__r")),
            "__pr": F.when(F.col("__vr").isNotNull(), F.col("__r")),
            "__pv": F.when(F.col("__r").isNotNull(), F.col("__vr")),
            "__illiq": F.abs("__r") / F.nullif(F.col("__dv"), F.lit(0.0)),
        }
    )


def _momentum(n: int) -> Column:
    return ratio(F.col("adj_close"), F.col(f"__c{n}")) - 1.0


def _gap(value: str, n: int) -> Column:
    return ratio(F.col(value), full(n, value, F.avg(value))) - 1.0


def _volatility(n: int) -> Column:
    return full(n, "__r", F.stddev_samp("__r"))


def _price_volume_corr() -> Column:
    """Null where returns or volume changes are constant over the window; both are null together."""
    spread = trailing(F.stddev_pop("__pr"), 20) * trailing(F.stddev_pop("__pv"), 20)
    return F.try_divide(full(20, "__pr", F.covar_pop("__pr", "__pv")), spread)


def _rsi(n: int) -> Column:
    strength = ratio(full(n, "__gain", F.avg("__gain")), full(n, "__loss", F.avg("__loss")))
    return 100.0 - 100.0 / (1.0 + strength)


FACTORS: dict[str, Callable[[], Column]] = {
    "momentum_5d": lambda: _momentum(5),
    "momentum_10d": lambda: _momentum(10),
    "momentum_20d": lambda: _momentum(20),
    "momentum_60d": lambda: _momentum(60),
    "reversal_5d": lambda: -_momentum(5),
    "reversal_10d": lambda: -_momentum(10),
    "reversal_20d": lambda: -_momentum(20),
    "volatility_10d": lambda: _volatility(10),
    "volatility_20d": lambda: _volatility(20),
    "volatility_60d": lambda: _volatility(60),
    # Needs 20 losses in a row by definition, so it is null almost everywhere.
    "downside_volatility_20d": lambda: full(20, "__down", F.stddev_samp("__down")),
    "volume_spike_5d": lambda: _gap("volume", 5),
    "volume_spike_20d": lambda: _gap("volume", 20),
    "dollar_volume_20d": lambda: F.log1p(full(20, "__dv", F.avg("__dv"))),
    "price_volume_corr_20d": _price_volume_corr,
    "rsi_14": lambda: _rsi(14),
    "moving_average_gap_20d": lambda: _gap("adj_close", 20),
    "moving_average_gap_50d": lambda: _gap("adj_close", 50),
    "return_zscore_20d": lambda: ratio(F.col("__r") - full(20, "__r", F.avg("__r")), _volatility(20)),
    "drawdown_20d": lambda: ratio(F.col("adj_close"), full(20, "adj_close", F.max("adj_close"))) - 1.0,
    "drawdown_60d": lambda: ratio(F.col("adj_close"), full(60, "adj_close", F.max("adj_close"))) - 1.0,
    "amihud_illiquidity_20d": lambda: full(20, "__illiq", F.avg("__illiq")),
}

FACTOR_NAMES = list(FACTORS)

# Calendar rows up to and including a date that its factor value depends on.  A factor on returns reaches one
# row further back than its window.  None: not declared, so no history may be cut.
LOOKBACK: dict[str, int | None] = {
    "momentum_5d": 6, "momentum_10d": 11, "momentum_20d": 21, "momentum_60d": 61,
    "reversal_5d": 6, "reversal_10d": 11, "reversal_20d": 21,
    "volatility_10d": 11, "volatility_20d": 21, "volatility_60d": 61, "downside_volatility_20d": 21,
    "volume_spike_5d": 5, "volume_spike_20d": 20, "dollar_volume_20d": 20, "price_volume_corr_20d": 21, "rsi_14": 15,
    "moving_average_gap_20d": 20, "moving_average_gap_50d": 50, "return_zscore_20d": 21,
    "drawdown_20d": 20, "drawdown_60d": 60, "amihud_illiquidity_20d": 21,
}


def history_rows(names: list[str]) -> int | None:
    """Calendar rows that the factors need for one date; None if one of them does not declare its own."""
    rows = [LOOKBACK.get(n) for n in names]
    return None if None in rows else max(rows, default=1)


def check_factor_names(names: list[str]) -> None:
    unknown = sorted(set(names) - set(FACTORS))
    if unknown:
        raise ValueError(f"unknown factors requested: {unknown}")


def register_factor(name: str, build: Callable[[], Column], lookback: int | None = None) -> None:
    """Add a user factor: a function returning a Column over the panel and the ``__`` helper columns.

    ``lookback``: calendar rows that a value depends on, its own included; without it, whole histories are read.
    """
    if name in FACTORS:
        raise ValueError(f"factor {name} already exists")
    FACTORS[name] = build
    LOOKBACK[name] = lookback


def with_factors(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add factor columns to a panel that has ``date_idx``; infinities and NaN become null."""
    wanted = FACTOR_NAMES if names is None else list(dict.fromkeys(names))
    check_factor_names(wanted)
    raw = with_building_blocks(spread(df, ["symbol"])).withColumns({n: FACTORS[n]() for n in wanted})
    finite = {
        n: F.when(~F.isnan(n) & (F.abs(F.col(n)) != F.lit(float("inf"))), F.col(n)) for n in wanted
    }
    return raw.select(*df.columns, *[c.alias(n) for n, c in finite.items()])


def with_forward_returns(df: DataFrame, holding_periods: list[int]) -> DataFrame:
    """Add ``fwd_<h>``: return from this date to ``h`` calendar rows later."""
    close = F.col("adj_close")
    return df.withColumns(
        {f"fwd_{h}": ratio(at_offset("adj_close", h), close) - 1.0 for h in dict.fromkeys(holding_periods)}
    )


def with_adv(df: DataFrame, rows: int = 20) -> DataFrame:
    """Add ``adv``: mean dollar volume over the trailing calendar rows that exist (at least one)."""
    dollars = F.col("adj_close") * F.col("volume")
    return df.withColumn("adv", trailing(F.avg(dollars), rows))


def factor_coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """(factor, observations, coverage, missing_rate) over all cells of the dates x symbols grid.

    The grid size is computed, not built; warm-up cells count as missing.
    """
    one = df.agg(
        (F.count_distinct("date") * F.count_distinct("symbol")).alias("cells"),
        *[F.count(n).alias(n) for n in names],
    )
    return one.unpivot(["cells"], names, "factor", "observations").select(
        "factor",
        "observations",
        (F.col("observations") / F.col("cells")).alias("coverage"),
        (1.0 - F.col("observations") / F.col("cells")).alias("missing_rate"),
    )


#: Null patterns among which factors with the same rows are looked for; beyond it each pair is ranked on its own.
MOST_PATTERNS = 1 << 20
#: Values of one task when they are ordered, and when they are brought back to their rows.
VALUES_PER_TASK = 500_000


def redundant_pairs(
    df: DataFrame, names: list[str], threshold: float = 0.75, min_rows: int = 30, split: bool | None = None
) -> DataFrame:
    """Factor pairs whose pairwise-complete Spearman correlation is at least ``threshold`` in size.

    Ranks of a pair run over the rows that have both factors, over the whole panel. Every value is ordered once, whatever
    the number of pairs: the ranks among the rows of each other factor are running counts along the same order, and
    others that the same rows of a factor have share one. All products of centred ranks are summed in one aggregate. A
    pair that does not vary, or has fewer than ``min_rows`` rows, is left out. No group is ever one task, so ``split``
    changes nothing.
    """
    row = F.monotonically_increasing_id().alias("__row")  # written, hence pinned
    values = df.select(row, *[F.round(F.col(n), TIE_DECIMALS).alias(n) for n in names])
    bits = reduce(lambda out, item: out + F.when(F.col(item[1]).isNull(), 0).otherwise(1 << item[0]), enumerate(names), F.lit(0).cast("long"))
    wide = stage(values.withColumn("__bits", bits), "factors")
    rows, classes = _rank_classes(wide, len(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if rows.get((i, j), 0) >= max(min_rows, 1)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "first string, second string, correlation double, n_rows long")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(n for (i, j), n in rows.items() if i == j) // VALUES_PER_TASK))
    ranked = _centred_ranks(wide, names, classes, tasks)

    place = {(i, j): k for i, groups in classes.items() for k, group in enumerate(groups) for j in group}
    used = sorted({(i, place[i, j]) for pair in pairs for i, j in (pair, pair[::-1])})
    wanted = {f"{i}_{k}": ((i, k), (i, k)) for i, k in used} | {f"{i}-{j}": ((i, place[i, j]), (j, place[j, i])) for i, j in pairs}
    parts = ranked.repartition(tasks, "__row").mapInArrow(_products(used, wanted), "name string, value double")
    named = parts.groupBy("name").agg(F.sum("value").alias("value"))
    sums = named.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("sums"))

    def found(i: int, j: int) -> Column:
        of = lambda name: F.element_at("sums", F.lit(name))
        size = F.sqrt(of(f"{i}_{place[i, j]}")) * F.sqrt(of(f"{j}_{place[j, i]}"))
        correlation = of(f"{i}-{j}") / F.nullif(size, F.lit(0.0))
        return F.struct(F.lit(names[i]).alias("first"), F.lit(names[j]).alias("second"), correlation.alias("correlation"), F.lit(rows[i, j]).cast("long").alias("n_rows"))

    return sums.select(F.explode(F.array(*[found(i, j) for i, j in pairs])).alias("p")).select("p.*").where(F.abs("correlation") >= threshold)


def _rank_classes(wide: DataFrame, n: int) -> tuple[dict[tuple[int, int], int], dict[int, list[list[int]]]]:
    """Rows that have both factors of each pair, and for each factor the others in classes that the same rows of it have."""
    patterns = stage(wide.groupBy("__bits").agg(F.count(F.lit(1)).alias("n")), "patterns")
    shared = patterns.limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS
    has = lambda i: F.call_function("getbit", F.col("__bits"), i) == 1
    factor = patterns.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).where(has(F.col("i")))
    pair = factor.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    unlike = F.bit_or(F.when(has(F.col("j")), F.bitwise_not(F.col("__bits"))).otherwise(F.col("__bits")))
    table = pair.groupBy("i", "j").agg(F.sum(F.when(has(F.col("j")), F.col("n"))).alias("n"), unlike.alias("unlike")).collect()
    rows = {(r["i"], r["j"]): r["n"] for r in table if r["n"]}
    classes: dict[int, list[list[int]]] = {}
    for r in sorted(table, key=lambda r: (r["i"], r["j"])):
        groups = classes.setdefault(r["i"], [])
        if (r["i"], r["j"]) in rows and r["i"] != r["j"]:
            same = [g for g in groups if shared and not r["unlike"] >> g[0] & 1]
            same[0].append(r["j"]) if same else groups.append([r["j"]])
    return rows, classes


def _centred_ranks(wide: DataFrame, names: list[str], classes: dict[int, list[list[int]]], tasks: int) -> DataFrame:
    """(__row, factor, u0, u1, ...): twice the centred average rank of a row's factor among the rows of its classes.

    Values are cut into ranges, numbered inside and shifted by the totals of the ranges before. Equal values may lie in
    several ranges, so a value that many rows have is not one task; the few that do get their ranks from the ranges' totals.
    """
    most = max(len(groups) for groups in classes.values())
    each = range(most)

    def entry(i: int) -> Column:
        held = [F.shiftleft(F.call_function("getbit", F.col("__bits"), F.lit(g[0])).cast("long"), k) for k, g in enumerate(classes[i])]
        held = reduce(Column.bitwiseOR, held, F.lit(0).cast("long")).alias("held")
        return F.when(F.col(names[i]).isNotNull(), F.struct(F.lit(i).alias("factor"), F.col(names[i]).alias("x"), held))

    long = wide.select("__row", F.explode(F.array_compact(F.array(*[entry(i) for i in classes if classes[i]]))).alias("e")).select("__row", "e.*")
    ranged = long.repartitionByRange(tasks, "factor", "x", "__row").withColumn("__part", F.spark_partition_id())
    counts = ", ".join(f"w{k} int" for k in each)
    numbered = stage(ranged.mapInArrow(_numbers(most), f"__row long, factor int, x double, __part int, {counts}, edge array<long>"), "ranges")

    # A row for the smallest and the largest value of each factor in a range: rows below them there, and rows with them.
    sides = [F.get("edge", F.lit(side * most + k)).alias(f"{'be'[side]}{k}") for side in (0, 1) for k in each]
    edges = stage(numbered.where("edge is not null").select("factor", "__part", "x", *sides), "edges")
    totals = edges.groupBy("factor", "__part").agg(*[F.max(F.col(f"b{k}") + F.col(f"e{k}")).alias(f"t{k}") for k in each])
    of_factor = Window.partitionBy("factor")
    shifts = totals.select(
        "factor", "__part",
        *[(F.sum(f"t{k}").over(of_factor.orderBy("__part")) - F.col(f"t{k}")).alias(f"s{k}") for k in each],
        *[F.sum(f"t{k}").over(of_factor).alias(f"n{k}") for k in each],
    )
    shifts = stage(shifts, "shifts")
    centre = [(2 * F.min(F.col(f"s{k}") + F.col(f"b{k}")) + F.sum(f"e{k}") - F.max(f"n{k}")).alias(f"v{k}") for k in each]
    several = edges.join(shifts, ["factor", "__part"]).groupBy("factor", "x").agg(F.count(F.lit(1)).alias("ranges"), *centre).where("ranges > 1").drop("ranges")
    several = stage(several, "several")
    placed = numbered.where("edge is null").join(F.broadcast(shifts), ["factor", "__part"]).join(F.broadcast(several), ["factor", "x"], "left")
    ranks = [F.col(f"w{k}") + 2 * F.col(f"s{k}") - F.col(f"n{k}") for k in each]
    return placed.select("__row", "factor", *[F.when(F.col(f"w{k}").isNotNull(), F.coalesce(f"v{k}", u)).alias(f"u{k}") for k, u in enumerate(ranks)])


def _numbers(most: int) -> Callable:
    """Task over one range (__row, factor, x, held, __part): its rows with w<k>, twice the average rank in class k of the
    factor less 1 (null outside the class), and a row per factor and edge with the counts of rows below it and at it."""

    def number(batches):
        import numpy as np
        import pyarrow as pa

        held_batches = [b for b in batches if b.num_rows]
        if not held_batches:
            return
        table = pa.Table.from_batches(held_batches)
        row, factor, x, held, part = (table[c].to_numpy() for c in ("__row", "factor", "x", "held", "__part"))
        order = np.lexsort((x, factor))
        row, factor, x, held = row[order], factor[order], x[order], held[order]
        new = np.r_[True, (factor[1:] != factor[:-1]) | ((x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])))]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        new_factor = np.flatnonzero(np.r_[True, factor[first][1:] != factor[first][:-1]])
        start = np.repeat(new_factor, np.diff(np.r_[new_factor, len(first)]))
        edges = np.unique(np.r_[new_factor, new_factor[1:] - 1, len(first) - 1])
        ranks, lower, equal = [], [], []
        for k in range(most):
            bit = (held >> k) & 1
            peers = np.add.reduceat(bit, first)
            before = np.cumsum(peers) - peers
            before -= before[start]
            rank = 2 * before + peers
            ranks.append(pa.array((rank if len(first) == len(row) else rank[group]).astype(np.int32), mask=bit == 0))
            lower.append(before[edges])
            equal.append(peers[edges])
        names = ["__row", "factor", "x", "__part", *[f"w{k}" for k in range(most)], "edge"]
        place = pa.array(np.full(len(row), part[0], np.int32))
        rows = [pa.array(row), pa.array(factor), pa.array(x), place, *ranks, pa.nulls(len(row), pa.list_(pa.int64()))]
        yield from pa.Table.from_arrays(rows, names).to_batches(max_chunksize=50_000)
        at, n = first[edges], len(edges)
        ends = pa.array(np.array([*lower, *equal]).T.tolist(), pa.list_(pa.int64()))
        rows = [pa.nulls(n, pa.int64()), pa.array(factor[at]), pa.array(x[at]), place[:n], *[pa.nulls(n, pa.int32())] * most, ends]
        yield pa.RecordBatch.from_arrays(rows, names)

    return number


def _products(used: list[tuple[int, int]], wanted: dict[str, tuple[tuple[int, int], tuple[int, int]]]) -> Callable:
    """Task over all values of some rows (__row, factor, u0, u1, ...): the sums of the wanted products."""

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        rows, at = np.unique(table["__row"].to_numpy(), return_inverse=True)
        factor = table["factor"].to_numpy()
        place = {i: np.flatnonzero(factor == i) for i in {i for i, _ in used}}
        columns = {}
        for i, k in used:
            columns[i, k] = np.zeros(len(rows))
            columns[i, k][at[place[i]]] = table[f"u{k}"].take(place[i]).fill_null(0).to_numpy()
        values = [float(columns[a] @ columns[b]) for a, b in wanted.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(wanted), pa.string()), pa.array(values, pa.float64())], ["name", "value"])

    return multiply
