"""Signals of the last dates on or before given days, from no more history than the factors reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.borrow import attach_borrow, normalize_borrow
from panelweave.operators.factors import history_rows, with_factors
from panelweave.operators.portfolio import target_weights
from panelweave.operators.signals import composite_signal, latest_signal, prune_history
from panelweave.session import stage


def signal_as_of(
    panel: DataFrame, as_of: str, positive: list[str], negative: list[str], dates: DataFrame | None = None
) -> DataFrame:
    """Rows of the latest signal date <= ``as_of`` with ``signal``.

    First only the calendar rows are read that the factors of the last date reach, and only that date's
    signal is taken from them: an earlier date would miss its oldest rows.  Without a signal on that date, or with a factor
    that does not declare its lookback, the whole history is used.
    """
    names = [*positive, *negative]
    rows = history_rows(names)
    if rows is not None:
        recent = prune_history(panel, as_of, rows, dates)
        last = recent.agg(F.max("date")).scalar()
        day = stage(composite_signal(with_factors(recent, names).where(F.col("date") == last), positive, negative), "as-of")
        if not day.isEmpty():
            return day
    whole = composite_signal(with_factors(panel, names), positive, negative)
    return latest_signal(stage(whole, "as-of"), as_of)


def latest_before(requests: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, date): the last of ``dates`` on or before each requested day, by one ordered pass over both.

    The window holds the calendar and the requests, no rows of the panel. A day before all dates has none.
    """
    known = dates.select("date").distinct().select(F.col("date").alias("at"), F.col("date").alias("known"), F.lit(None).cast("date").alias("as_of"))
    asked = requests.select("as_of").distinct().select(F.col("as_of").alias("at"), F.lit(None).cast("date").alias("known"), "as_of")
    # Of a date and a request on the same day the date comes first.
    order = Window.orderBy("at", F.col("known").asc_nulls_last())
    found = known.unionByName(asked).withColumn("date", F.last("known", ignorenulls=True).over(order))
    return found.where("as_of IS NOT NULL").select("as_of", "date")


def signals_as_of(
    panel: DataFrame,
    requests: DataFrame,
    positive: list[str],
    negative: list[str],
    quantile: float,
    dates: DataFrame,
    raw_borrow: DataFrame | None = None,
    may_short: Column | None = None,
) -> DataFrame:
    """One table for many requested days (``requests``: as_of), a row per day and symbol with a signal.

    Adds to the panel's columns: as_of, date (of the signal), signal, rank (best is 1, symbol breaks ties),
    target_weight, risk_status, reason and warnings. ``dates`` is the panel's calendar with ``date_idx``. Of the panel
    only the calendar rows are read that the factors of the dates asked for reach, of the locates only those dates. Days
    whose last date has no signal go back to the last date that has one, over the whole history; a day before the first
    signal has no rows. Days may share a date.
    """
    names = [*positive, *negative]
    rows = history_rows(names)
    calendar = dates.select("date", "date_idx")
    wanted = latest_before(requests, calendar).where("date IS NOT NULL")
    if rows is None:
        signal = stage(composite_signal(with_factors(panel, names), positive, negative), "as-of")
    else:
        last = calendar.join(wanted.select("date").distinct(), "date")
        reach = last.select(F.explode(F.sequence(F.greatest(F.col("date_idx") - rows + 1, F.lit(0)), F.col("date_idx"))).alias("date_idx")).distinct()
        # Part of the calendar, hence bounded by it.
        near = panel.join(F.broadcast(calendar.join(reach, "date_idx").select("date")), "date", "left_semi")
        known = with_factors(near, names).join(F.broadcast(wanted.select("date").distinct()), "date", "left_semi")
        signal = stage(composite_signal(known, positive, negative), "as-of")
        without = wanted.join(signal.select("date").distinct(), "date", "left_anti")
        if not without.isEmpty():
            whole = composite_signal(with_factors(panel, names), positive, negative)
            older = latest_before(without, stage(whole.select("date").distinct(), "as-of-dates")).where("date IS NOT NULL")
            wanted = wanted.join(without.select("as_of"), "as_of", "left_anti").unionByName(older)
            more = whole.join(F.broadcast(older.select("date").distinct()), "date", "left_semi")
            signal = signal.unionByName(stage(more.join(signal.select("date").distinct(), "date", "left_anti"), "as-of"))
    if rows is None:
        wanted = latest_before(requests, signal.select("date").distinct()).where("date IS NOT NULL")
    # One row per requested day.
    found = signal.join(F.broadcast(wanted), "date")
    if raw_borrow is not None:
        days = wanted.select("date").distinct()
        own = raw_borrow.join(F.broadcast(days.select(F.col("date").alias("__day"))), F.col("date").cast("date") == F.col("__day"), "left_semi")
        found = attach_borrow(found, normalize_borrow(own, days))
        may_short = F.col("shortable") if may_short is None else F.col("shortable") & may_short
    weighted = target_weights(found, quantile, may_short, keys=["as_of"])
    rank = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("signal"), "symbol"))
    told = f"positive={', '.join(positive) or 'none'}; negative={', '.join(negative) or 'none'}"
    return weighted.withColumns({"rank": rank.cast("long"), "reason": F.lit(told)})
