"""The whole research run as one set of lazily built tables.

panel -> factors, forward returns, ADV      one exchange on symbol
      -> rebalance dates of every variant   counts per date, no order
      -> percentile ranks, all strategies   one exchange on date (or the split plan), rows of those dates only
      -> rows per position variant          one explode, no join
      -> legs, trades, book, IC             exchanges on (variant, date) and (variant, symbol)
      -> splits, metrics, evidence, verdict tables of variants x calendar size

Cost, spread, borrow and notional variants are applied to the daily book, so they add no work on
positions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.config import RANDOM_BASELINE, ResearchConfig, Strategy, Variant
from panelweave.operators import evaluate, factors, inference, portfolio, signals, variants
from panelweave.operators.borrow import attach_borrow
from panelweave.operators.groupwise import needs_split
from panelweave.operators.quality import READINESS, data_readiness
from panelweave.session import stage

LIQUIDITY = "dollar_volume_20d"


def claimed_flags(spark: SparkSession, config: ResearchConfig) -> DataFrame:
    """The readiness flags of a configuration as a row."""
    return spark.range(1).select(*[F.lit(getattr(config, c)).alias(c) for c in READINESS])


class Research:
    """Tables of one run.  ``panel`` needs date, date_idx, symbol, adj_close, volume (and sector if used).

    ``staged`` writes the factor values, rebalance dates, signals, rebalance rows and the daily book once to the shared
    folder, because each has several consumers; without it every consumer recomputes them. ``readiness`` is the row of
    ``data_readiness``; without it the flags are those that the configuration claims.
    """

    def __init__(
        self,
        panel: DataFrame,
        config: ResearchConfig,
        borrow: DataFrame | None = None,
        may_short: Column | None = None,
        split: bool | None = None,
        staged: bool = True,
        readiness: DataFrame | None = None,
    ) -> None:
        self.panel, self.config, self.borrow, self.may_short = panel, config, borrow, may_short
        self._readiness = readiness
        self._made: Research | None = None
        self._split = split
        self.staged = staged
        self.grid = config.variants()
        self.positions_grid = list({v.position: v for v in self.grid}.values())

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, label) if self.staged else df

    @cached_property
    def split(self) -> bool:
        return needs_split(self.panel, self._split, ["date"]) if self._made is None else self._made.split

    def adopt(self, other: Research) -> Research:
        """Read the tables another run has written, when its grid contains this one's variants.

        Nothing is made before something asks for it. Signals are the other run's in any case; portfolios that it has not
        made yet are made here, for the variants of this run only.
        """
        if not {v.variant for v in self.grid} <= {v.variant for v in other.grid}:
            raise ValueError("the other run lacks some variants of this one")
        self._made = other
        return self

    def _has_made(self, table: str) -> bool:
        return self._made is not None and table in vars(self._made)

    @staticmethod
    def _own(rows: DataFrame, names: list[str]) -> DataFrame:
        return rows.where(F.col("variant").isin(names))

    # ------------------------------------------------------------ signals

    @property
    def _shares_dates(self) -> bool:
        return self._made is not None and self._made.config.rebalance_days == self.config.rebalance_days

    def _factor_names(self) -> list[str]:
        c = self.config
        return list(dict.fromkeys([*c.factor_names(), *([LIQUIDITY] if c.liquidity_min_rank is not None else [])]))

    @cached_property
    def values(self) -> DataFrame:
        """Panel rows with factors, ``fwd_<h>``, ``adv`` and the sector if used: what needs the whole history of a symbol."""
        if self._made is not None:
            return self._made.values
        c = self.config
        names = self._factor_names()
        rows = factors.with_factors(self.panel, names)
        rows = factors.with_adv(factors.with_forward_returns(rows, [v.holding_period for v in self.grid]))
        if c.sector_neutral:
            rows = signals.with_known_group(rows, "sector", signals.holds(c.signal.positive, c.signal.negative))
        ahead = dict.fromkeys(f"fwd_{v.holding_period}" for v in self.grid)
        kept = ["date", "date_idx", "symbol", "adv", *names, *ahead, *(["sector"] if c.sector_neutral else [])]
        return self._keep(rows.select(*kept), "values")

    def _held(self, v: Variant) -> tuple[Column, float | None]:
        """When a variant has a row with signal and forward return, told before anything is ranked, and the least liquidity rank of its rows."""
        c = self.config
        agent = signals.holds(c.signal.positive, c.signal.negative) & F.col(f"fwd_{v.holding_period}").isNotNull()
        by_name = {b.name: b for b in c.baselines}
        if v.strategy in by_name:
            b = by_name[v.strategy]
            return (agent if b.name == RANDOM_BASELINE else agent & signals.holds(b.positive, b.negative)), None
        return agent, None if v.strategy in ("agent_signal", "sector_neutral_signal") else c.liquidity_min_rank

    @cached_property
    def dates(self) -> DataFrame:
        """(variant, date): rebalance dates of every position variant, bounded by the calendar."""
        if self._shares_dates:
            return self._own(self._made.dates, [v.position for v in self.positions_grid])
        present = signals.dates_held(self.values, {v.position: self._held(v) for v in self.positions_grid}, LIQUIDITY)
        return self._keep(portfolio.rebalance_dates(present, self.config.rebalance_days), "dates")

    @cached_property
    def strategies(self) -> DataFrame:
        """Rows of the run's rebalance dates with one ``s_<strategy>`` column per strategy, ``fwd_<h>`` and ``adv``.

        Ranks compare the rows of one date, so other dates are not ranked.
        """
        if self._shares_dates:
            return self._made.strategies
        c = self.config
        names = self._factor_names()
        rows = self.values.join(F.broadcast(self.dates.select("date").distinct()), "date", "left_semi")
        ranked = signals.with_percent_ranks(rows, {f"pct_{n}": n for n in names}, split=self.split)
        agent = signals.composite(c.signal.positive, c.signal.negative)
        out = ranked.withColumn("s_agent_signal", agent)
        has_agent = F.col("s_agent_signal").isNotNull()
        baselines = {f"s_{b.name}": F.when(has_agent, self._baseline(b)) for b in c.baselines}
        out = out.withColumns(baselines) if baselines else out
        if c.sector_neutral:
            out = out.withColumn("s_sector_neutral_signal", F.col("s_agent_signal"))
            out = signals.neutralize(out, value="s_sector_neutral_signal", split=self.split)
        if c.liquidity_min_rank is not None:
            liquid = F.col(f"pct_{LIQUIDITY}") >= c.liquidity_min_rank
            name = signals.liquidity_name(c.liquidity_min_rank)
            out = out.withColumn(f"s_{name}", F.when(liquid, F.col("s_agent_signal")))
            if c.sector_neutral:
                out = out.withColumn(f"s_sector_neutral_{name}", F.when(liquid, F.col("s_sector_neutral_signal")))
        kept = [n for n in out.columns if n.startswith(("s_", "fwd_"))]
        return self._keep(out.select("date", "date_idx", "symbol", "adv", *kept), "strategies")

    def _with_locates(self, rows: DataFrame, dates: DataFrame) -> DataFrame:
        """Adds ``can_short`` and ``fee`` to (date, symbol) rows of ``dates``."""
        if self.borrow is not None:
            rows = attach_borrow(rows, self.borrow.join(F.broadcast(dates.select("date")), "date", "left_semi"))
        else:
            rows = rows.withColumns({"shortable": F.lit(True), "borrow_fee_bps": F.lit(None).cast("double")})
        can_short = F.col("shortable") if self.may_short is None else F.col("shortable") & self.may_short
        fee = F.coalesce(F.col("borrow_fee_bps"), F.lit(self.config.borrow_fee_bps))
        return rows.withColumns({"can_short": can_short, "fee": fee}).drop("shortable", "borrow_fee_bps")

    @staticmethod
    def _baseline(b: Strategy) -> Column:
        return signals.random_signal() if b.name == RANDOM_BASELINE else signals.composite(b.positive, b.negative)

    @cached_property
    def aligned(self) -> DataFrame:
        """Rows with a signal and a forward return, per position variant, on rebalance dates.

        Only rows of a variant's own dates meet the locates and unfold.
        """
        if self._has_made("aligned"):
            return self._own(self._made.aligned, [v.position for v in self.positions_grid])
        held = {
            v.position: F.col(f"s_{v.strategy}").isNotNull() & F.col(f"fwd_{v.holding_period}").isNotNull()
            for v in self.positions_grid
        }
        admitted = self.dates.groupBy("date").agg(F.collect_set("variant").alias("admitted"))
        rows = F.array(
            *[
                F.when(
                    F.array_contains("admitted", v.position) & held[v.position],
                    F.struct(
                        F.lit(v.position).alias("variant"),
                        F.col(f"s_{v.strategy}").alias("signal"),
                        F.col(f"fwd_{v.holding_period}").alias("fwd"),
                        F.lit(v.quantile).alias("quantile"),
                        F.lit(v.holding_period).alias("holding_period"),
                    ),
                )
                for v in self.positions_grid
            ]
        )
        common = ["date", "date_idx", "symbol", "adv", "can_short", "fee"]
        long = self._with_locates(self.strategies.join(F.broadcast(admitted), "date"), admitted).select(*common, F.explode(F.array_compact(rows)).alias("r"))
        return self._keep(long.select("r.*", *common), "aligned")

    # ------------------------------------------------------------ portfolios

    @cached_property
    def positions(self) -> DataFrame:
        """Written, because trades read it twice and concentration once more."""
        if self._has_made("positions"):
            return self._own(self._made.positions, [v.position for v in self.positions_grid])
        quantiles = [v.quantile for v in self.positions_grid]
        return self._keep(portfolio.build_positions(self.aligned, quantiles, F.col("can_short"), self.split), "positions")

    @cached_property
    def trades(self) -> DataFrame:
        return portfolio.with_trades(self.positions)

    @cached_property
    def book(self) -> DataFrame:
        return portfolio.daily_book(self.trades, F.col("fee"), ["date_idx", "holding_period"])

    @cached_property
    def ic(self) -> DataFrame:
        return portfolio.information_coefficient(self.aligned, split=self.split, extra=["date_idx", "holding_period"])

    @cached_property
    def daily(self) -> DataFrame:
        """One row per (variant, date) with a portfolio or an IC: returns, costs, turnover, ic."""
        if self._has_made("daily"):
            return self._own(self._made.daily, [v.variant for v in self.grid])
        c = self.config
        by_position: dict[str, list] = {}
        for v in self.grid:
            by_position.setdefault(v.position, []).append(v)
        choices = F.lit(None)
        for position, members in by_position.items():
            rows = F.array(
                *[
                    F.struct(
                        F.lit(v.variant).alias("variant"),
                        F.lit(v.name).alias("name"),
                        F.lit(v.family).alias("family"),
                        F.lit(self.grid.index(v)).alias("position_in_grid"),
                        F.lit(float(v.cost_multiplier)).alias("cost_multiplier"),
                        F.lit(float(v.notional)).alias("notional"),
                    )
                    for v in members
                ]
            )
            choices = F.when(F.col("position") == position, rows).otherwise(choices)
        keys = ["variant", "date", "date_idx", "holding_period"]
        both = self.book.join(self.ic, keys, "full").withColumnRenamed("variant", "position")
        spread = both.withColumn("v", F.explode(choices)).select("*", "v.*").drop("v")
        priced = spread.withColumns(
            {
                "base_bps": F.lit(c.transaction_cost_bps),
                "spread_bps": F.lit(c.spread_cost_bps),
                "impact_coefficient": F.lit(c.market_impact_coefficient),
            }
        )
        return self._keep(portfolio.with_costs(priced), "daily")

    # ------------------------------------------------------------ evaluation

    @cached_property
    def grid_table(self) -> DataFrame:
        """(variant, name, family, ...) as literals; configuration-sized."""
        rows = F.array(
            *[
                F.struct(
                    F.lit(v.variant).alias("variant"),
                    F.lit(v.name).alias("name"),
                    F.lit(v.family).alias("family"),
                    F.lit(i).alias("position_in_grid"),
                    F.lit(v.holding_period).alias("holding_period"),
                    F.lit(float(v.quantile)).alias("quantile"),
                    F.lit(float(v.cost_multiplier)).alias("cost_multiplier"),
                    F.lit(float(v.notional)).alias("notional"),
                )
                for i, v in enumerate(self.grid)
            ]
        )
        return self.panel.sparkSession.range(1).select(F.explode(rows).alias("v")).select("v.*")

    @cached_property
    def boundaries(self) -> DataFrame:
        return evaluate.split_boundaries(self.daily, self.config.train_fraction, self.config.effective_holdout)

    @cached_property
    def bounded(self) -> DataFrame:
        return evaluate.with_boundaries(self.daily, self.boundaries)

    @cached_property
    def metrics(self) -> DataFrame:
        found = evaluate.split_metrics(self.daily, self.config.train_fraction, self.config.effective_holdout)
        return found.join(F.broadcast(self.grid_table), "variant")

    @cached_property
    def walk_forward(self) -> DataFrame:
        """Windows of agent, baselines and stress tests (the other families have none)."""
        c = self.config
        chosen = self.daily.where(F.col("family").isin("primary", "baseline", "stress_test"))
        return evaluate.walk_forward_metrics(
            chosen, c.train_fraction, c.effective_holdout, c.walk_forward_windows, c.walk_forward_min_train
        )

    @cached_property
    def bootstrap(self) -> DataFrame:
        c = self.config
        agent = self.bounded.where(F.col("family") == "primary")
        return variants.bootstrap(agent, c.bootstrap_iterations, c.bootstrap_seed)

    def family(self, name: str, split: str = "test") -> DataFrame:
        return self.metrics.where((F.col("family") == name) & (F.col("split") == split))

    @cached_property
    def concentration(self) -> DataFrame:
        agent = self.positions.where(F.col("variant") == self.grid[0].position)
        return portfolio.concentration_summary(agent, self.config.max_position_weight)

    @cached_property
    def capacity_curve(self) -> DataFrame:
        rows = self.bounded.where(F.col("family") == "capacity")
        return variants.capacity_curve(rows, self.family("capacity"), self.config.max_trade_participation)

    @cached_property
    def evidence(self) -> DataFrame:
        found = inference.candidate_evidence(self.metrics).join(
            F.broadcast(self.grid_table.select("variant", "position_in_grid")), "variant"
        )
        return inference.with_candidate_q(found)

    @cached_property
    def readiness(self) -> DataFrame:
        return data_readiness(claimed_flags(self.panel.sparkSession, self.config)) if self._readiness is None else self._readiness

    @cached_property
    def checks(self) -> DataFrame:
        kinds = F.col("family")
        agent_windows = self.walk_forward.where(F.col("variant") == self.grid[0].variant)
        return inference.validity_checks(
            self.evidence.where(kinds == "primary"), self.evidence.where(kinds == "baseline"), agent_windows, self.config, self.readiness
        )

    @cached_property
    def verdict(self) -> DataFrame:
        return inference.verdicts(
            self.checks.withColumn("run", F.lit("run")), ["run"], self.config.validity_enabled
        ).drop("run")
