"""Several research configurations as one job: the configuration is a key, not a run.

Factors and ranks of all configurations are computed once. A signal that several configurations define alike is one
column, and a portfolio that they hold alike (signal, holding period, quantile, rebalance step, shorting rule) is one
set of positions. Costs, splits and metrics belong to a configuration and are columns of its rows. A configuration
that is invalid, or whose dates do not suffice, is a row of ``outcomes`` and does not stop the others.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.config import RANDOM_BASELINE, ResearchConfig, Strategy, Variant
from panelweave.operators import evaluate, factors, portfolio, runs, signals
from panelweave.operators.borrow import attach_borrow
from panelweave.operators.groupwise import needs_split
from panelweave.plans.research import LIQUIDITY
from panelweave.session import stage

# Fixed value: the error of a run without enough dates.
TOO_SHORT = "not enough backtest observations for train, validation, and holdout"
COMPARED = ["sharpe", "total_return", "ic_mean", "max_drawdown", "average_total_cost", "average_turnover"]


def parse_settings(settings: Mapping[str, object] | ResearchConfig) -> ResearchConfig:
    """A configuration from plain values; ValueError says what is wrong with them."""
    if isinstance(settings, ResearchConfig):
        config = settings
    else:

        def strategy(value: object) -> Strategy:
            return value if isinstance(value, Strategy) else Strategy(**value)

        values = dict(settings)
        try:
            values["signal"] = strategy(values["signal"])
            values["baselines"] = [strategy(b) for b in values.get("baselines", [])]
            config = ResearchConfig(**values)
        except KeyError as missing:
            raise ValueError(f"missing setting {missing.args[0]}") from missing
        except TypeError as wrong:
            raise ValueError(f"unusable settings: {wrong}") from wrong
    if not config.signal.positive and not config.signal.negative:
        raise ValueError("at least one factor is required")
    factors.check_factor_names(config.factor_names())
    return config


class Batch:
    """Tables of several runs.  ``settings`` maps a configuration's name to its values or to a ``ResearchConfig``.

    ``panel``, ``borrow``, ``may_short``, ``split`` and ``staged`` are as for ``Research`` and shared by all.
    """

    def __init__(
        self,
        panel: DataFrame,
        settings: Mapping[str, Mapping[str, object] | ResearchConfig],
        borrow: DataFrame | None = None,
        may_short: Column | None = None,
        split: bool | None = None,
        staged: bool = True,
    ) -> None:
        if not settings:
            raise ValueError("at least one configuration is required")
        self.panel, self.borrow, self.may_short, self.staged = panel, borrow, may_short, staged
        self.requested = list(settings)
        self.configs: dict[str, ResearchConfig] = {}
        self.invalid: dict[str, str] = {}
        for name, values in settings.items():
            try:
                self.configs[name] = parse_settings(values)
            except ValueError as wrong:
                self.invalid[name] = str(wrong)
        self.split = needs_split(panel, split, ["date"])
        self._signals: dict[tuple, str] = {}
        self._positions: dict[tuple, str] = {}
        self.grid = [(name, v) for name, c in self.configs.items() for v in c.variants()]
        self._held = [self._position(name, v) for name, v in self.grid]

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, label) if self.staged else df

    # ------------------------------------------------------------ what is shared

    def _signal(self, name: str, strategy: str) -> str:
        """Column of a strategy; equal definitions have one column, and what it is made of stands before it."""
        c = self.configs[name]
        agent = ("agent", tuple(c.signal.positive), tuple(c.signal.negative))
        neutral = ("neutral", agent)
        by_name = {b.name: b for b in c.baselines}
        liquid = signals.liquidity_name(c.liquidity_min_rank) if c.liquidity_min_rank is not None else None
        if strategy in by_name:
            b = by_name[strategy]
            made = (agent, ("baseline", agent, tuple(b.positive), tuple(b.negative), b.name == RANDOM_BASELINE))
        elif strategy == "agent_signal":
            made = (agent,)
        elif strategy == "sector_neutral_signal":
            made = (agent, neutral)
        elif strategy == liquid:
            made = (agent, ("liquid", agent, c.liquidity_min_rank))
        else:
            made = (agent, neutral, ("liquid", neutral, c.liquidity_min_rank))
        for definition in made:
            self._signals.setdefault(definition, f"s_{len(self._signals)}")
        return self._signals[made[-1]]

    def _position(self, name: str, v: Variant) -> str:
        c = self.configs[name]
        allowed = None if c.shortable_symbols is None else tuple(sorted(c.shortable_symbols))
        key = (self._signal(name, v.strategy), v.holding_period, v.quantile, c.rebalance_days, allowed, c.borrow_fee_bps)
        return self._positions.setdefault(key, f"p_{len(self._positions)}")

    def _factor_names(self) -> list[str]:
        names = list(dict.fromkeys(n for c in self.configs.values() for n in c.factor_names()))
        if any(c.liquidity_min_rank is not None for c in self.configs.values()):
            names = list(dict.fromkeys([*names, LIQUIDITY]))
        return names

    @cached_property
    def values(self) -> DataFrame:
        """Panel rows with the factors, forward returns, ADV and the sector if used: what needs the whole history of a symbol."""
        names, ahead = self._factor_names(), sorted({v.holding_period for _, v in self.grid})
        rows = factors.with_adv(factors.with_forward_returns(factors.with_factors(self.panel, names), ahead))
        neutral = [made[0] for kind, *made in self._signals if kind == "neutral"]
        if neutral:
            needed = reduce(or_, [signals.holds(list(positive), list(negative)) for _, positive, negative in neutral])
            rows = signals.with_known_group(rows, "sector", needed)
        kept = ["date", "date_idx", "symbol", "adv", *names, *[f"fwd_{h}" for h in ahead], *(["sector"] if neutral else [])]
        return self._keep(rows.select(*kept), "batch-values")

    def _has(self, definition: tuple) -> tuple[Column, float | None]:
        """When a signal has a value, told before anything is ranked, and the least liquidity rank of its rows."""
        kind, *made = definition
        if kind == "agent":
            return signals.holds(list(made[0]), list(made[1])), None
        base, _ = self._has(made[0])
        if kind == "baseline":
            _, positive, negative, random = made
            return (base if random else base & signals.holds(list(positive), list(negative))), None
        return base, made[1] if kind == "liquid" else None

    @cached_property
    def dates(self) -> DataFrame:
        """(variant, date): rebalance dates of every distinct portfolio, bounded by the calendar."""
        definition = {column: d for d, column in self._signals.items()}
        held, every = {}, F.lit(None)
        for k, p in self._positions.items():
            condition, least = self._has(definition[k[0]])
            held[p] = (condition & F.col(f"fwd_{k[1]}").isNotNull(), least)
            every = F.when(F.col("variant") == p, F.lit(k[3])).otherwise(every)
        return self._keep(portfolio.rebalance_dates(signals.dates_held(self.values, held, LIQUIDITY), every), "batch-dates")

    @cached_property
    def strategies(self) -> DataFrame:
        """Rows of the rebalance dates with one column per distinct signal, the forward returns and ADV; other dates are not ranked."""
        rows = self.values.join(F.broadcast(self.dates.select("date").distinct()), "date", "left_semi")
        out = signals.with_percent_ranks(rows, {f"pct_{n}": n for n in self._factor_names()}, split=self.split)
        for (kind, *made), column in self._signals.items():
            if kind == "agent":
                out = out.withColumn(column, signals.composite(list(made[0]), list(made[1])))
            elif kind == "baseline":
                agent, positive, negative, random = made
                value = signals.random_signal() if random else signals.composite(list(positive), list(negative))
                out = out.withColumn(column, F.when(F.col(self._signals[agent]).isNotNull(), value))
            elif kind == "neutral":
                out = signals.neutralize(out.withColumn(column, F.col(self._signals[made[0]])), value=column, split=self.split)
            else:
                liquid = F.col(f"pct_{LIQUIDITY}") >= made[1]
                out = out.withColumn(column, F.when(liquid, F.col(self._signals[made[0]])))
        kept = [c for c in out.columns if c.startswith("fwd_") or c in self._signals.values()]
        return out.select("date", "date_idx", "symbol", "adv", *kept)

    @cached_property
    def aligned(self) -> DataFrame:
        """Rows with a signal and a forward return, per distinct portfolio, on its rebalance dates."""
        held = {p: F.col(k[0]).isNotNull() & F.col(f"fwd_{k[1]}").isNotNull() for k, p in self._positions.items()}
        admitted = self.dates.groupBy("date").agg(F.collect_set("variant").alias("admitted"))

        def row(key: tuple, p: str) -> Column:
            column, holding, quantile, _, allowed, fee = key
            short = F.col("can_short") if allowed is None else F.col("can_short") & F.col("symbol").isin(*allowed)
            return F.struct(
                F.lit(p).alias("variant"),
                F.col(column).alias("signal"),
                F.col(f"fwd_{holding}").alias("fwd"),
                F.lit(float(quantile)).alias("quantile"),
                F.lit(holding).alias("holding_period"),
                short.alias("may_short"),
                F.coalesce("borrow_fee_bps", F.lit(float(fee))).alias("fee"),
            )

        rows = F.array(*[F.when(F.array_contains("admitted", p) & held[p], row(k, p)) for k, p in self._positions.items()])
        dated = self.strategies.join(F.broadcast(admitted), "date")
        if self.borrow is not None:
            dated = attach_borrow(dated, self.borrow.join(F.broadcast(admitted.select("date")), "date", "left_semi"))
        else:
            dated = dated.withColumns({"shortable": F.lit(True), "borrow_fee_bps": F.lit(None).cast("double")})
        dated = dated.withColumn("can_short", F.col("shortable") if self.may_short is None else F.col("shortable") & self.may_short)
        long = dated.select("date", "date_idx", "symbol", "adv", F.explode(F.array_compact(rows)).alias("r"))
        return self._keep(long.select("r.*", "date", "date_idx", "symbol", "adv"), "batch-aligned")

    @cached_property
    def positions(self) -> DataFrame:
        found = portfolio.build_positions(self.aligned, [k[2] for k in self._positions], F.col("may_short"), self.split)
        return self._keep(found, "batch-positions")

    # ------------------------------------------------------------ what belongs to a configuration

    @cached_property
    def daily(self) -> DataFrame:
        """One row per (configuration, variant, date), with its costs and split fractions."""

        def row(name: str, v: Variant, place: int) -> Column:
            c = self.configs[name]
            values = {
                "variant": f"{name}/{v.variant}",
                "config": name,
                "name": v.name,
                "family": v.family,
                "position_in_grid": place,
                "cost_multiplier": float(v.cost_multiplier),
                "notional": float(v.notional),
                "base_bps": float(c.transaction_cost_bps),
                "spread_bps": float(c.spread_cost_bps),
                "impact_coefficient": float(c.market_impact_coefficient),
                "train_fraction": float(c.train_fraction),
                "holdout_fraction": float(c.effective_holdout),
            }
            return F.struct(*[F.lit(x).alias(k) for k, x in values.items()])

        users: dict[str, list[Column]] = {}
        for place, ((name, v), p) in enumerate(zip(self.grid, self._held, strict=True)):
            users.setdefault(p, []).append(row(name, v, place))
        choices = F.lit(None)
        for p, rows in users.items():
            choices = F.when(F.col("position") == p, F.array(*rows)).otherwise(choices)
        keys = ["variant", "date", "date_idx", "holding_period"]
        book = portfolio.daily_book(portfolio.with_trades(self.positions), F.col("fee"), keys[2:])
        ic = portfolio.information_coefficient(self.aligned, split=self.split, extra=keys[2:])
        both = book.join(ic, keys, "full").withColumnRenamed("variant", "position")
        spread = both.withColumn("v", F.explode(choices)).select("*", "v.*").drop("v")
        return self._keep(portfolio.with_costs(spread), "batch-daily")

    @cached_property
    def grid_table(self) -> DataFrame:
        """(variant, config, name, family, position_in_grid) of every requested variant; configuration-sized."""
        rows = [(f"{name}/{v.variant}", name, v.name, v.family, i) for i, (name, v) in enumerate(self.grid)]
        kind = "variant string, config string, name string, family string, position_in_grid int"
        return self.panel.sparkSession.createDataFrame(rows, kind)

    @cached_property
    def boundaries(self) -> DataFrame:
        return self._keep(evaluate.split_boundaries(self.daily, F.col("train_fraction"), F.col("holdout_fraction")), "batch-boundaries")

    @cached_property
    def outcomes(self) -> DataFrame:
        """(config, status, error) of every requested configuration, in the order of request (``place``).

        A configuration completes if all its variants have enough dates.
        """
        spark = self.panel.sparkSession
        fits = spark.createDataFrame([], "config string, fits boolean")
        if self.grid:
            known = self.grid_table.join(self.boundaries.select("variant", "splittable"), "variant", "left")
            fits = known.groupBy("config").agg(F.bool_and(F.coalesce("splittable", F.lit(False))).alias("fits"))
        asked = spark.createDataFrame([(n, i, self.invalid.get(n)) for i, n in enumerate(self.requested)], "config string, place int, invalid string")
        error = F.coalesce("invalid", F.when(~F.col("fits"), F.lit(TOO_SHORT)))
        return asked.join(fits, "config", "left").select("config", "place", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"))

    @cached_property
    def metrics(self) -> DataFrame:
        """Metrics of every variant and split of the configurations that completed."""
        if not self.grid:
            numbers = [*evaluate.PERFORMANCE_METRICS, *evaluate.COST_METRICS]
            kinds = ", ".join(f"{m} {'long' if m == 'observations' else 'double'}" for m in numbers)
            return self.panel.sparkSession.createDataFrame([], f"variant string, split string, {kinds}, config string, name string, family string, position_in_grid int")
        found = evaluate.split_metrics(self.daily, F.col("train_fraction"), F.col("holdout_fraction"), self.boundaries)
        done = self.grid_table.join(self.outcomes.where("status = 'completed'").select("config"), "config", "left_semi")
        return found.join(done, "variant")

    def summary(self) -> DataFrame:
        """One row: status, requested, successful and failed configurations, their names and failures."""
        listed = F.sort_array(F.collect_list(F.struct("place", "config", "status", "error")))
        only = lambda c: F.filter("all", lambda x: x["status"] == c)
        rows = self.outcomes.agg(listed.alias("all"))
        return rows.select(
            F.when(F.size(only("failed")) > 0, "failed").otherwise("completed").alias("status"),
            F.transform("all", lambda x: x["config"]).alias("requested_configs"),
            F.size(only("completed")).alias("successful_runs"),
            F.size(only("failed")).alias("failed_runs"),
            F.transform(only("completed"), lambda x: x["config"]).alias("run_ids"),
            F.transform(only("failed"), lambda x: F.struct(x["config"].alias("config"), x["error"].alias("error"))).alias("failures"),
        )

    def comparison(self, metric: str = "sharpe", limit: int | None = None) -> DataFrame:
        """Completed configurations ranked by a test metric of their own signal."""
        agent = self.metrics.where((F.col("family") == "primary") & (F.col("split") == "test"))
        rows = agent.select(F.col("config").alias("run_id"), *[F.col(m).alias(f"test_{m}") for m in COMPARED])
        return runs.rank_runs(rows, metric, limit)

    def write(self, folder: str, metric: str = "sharpe", limit: int | None = None) -> None:
        """The batch's documents: one summary as JSON, the comparison and the metrics as Parquet."""
        self.summary().coalesce(1).write.mode("overwrite").json(f"{folder}/batch_summary")
        self.comparison(metric, limit).write.mode("overwrite").parquet(f"{folder}/run_comparison")
        self.metrics.write.mode("overwrite").partitionBy("config").parquet(f"{folder}/metrics")
