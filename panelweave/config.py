"""Run settings as one frozen object with range checks; it becomes literals and variant rows, not data."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isfinite

SELECTION_POLICIES = ["exploratory", "generated", "manual_selection", "pre_registered"]
RANDOM_BASELINE = "random_cross_section"


@dataclass(frozen=True)
class Strategy:
    name: str
    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Variant:
    """One row of the evaluation grid.  Variants that share ``position`` share portfolios."""

    name: str
    family: str
    strategy: str
    holding_period: int
    quantile: float
    cost_multiplier: float
    notional: float

    @property
    def variant(self) -> str:
        return f"{self.family}/{self.name}"

    @property
    def position(self) -> str:
        return f"{self.strategy}|h{self.holding_period}|q{self.quantile:g}"


@dataclass(frozen=True)
class ResearchConfig:
    signal: Strategy
    holding_period: int = 5
    rebalance_days: int = 5
    quantile: float = 0.2
    train_fraction: float = 0.7
    transaction_cost_bps: float = 0.0
    spread_cost_bps: float = 0.0
    market_impact_coefficient: float = 0.0
    portfolio_notional: float = 1_000_000.0
    borrow_fee_bps: float = 0.0
    shortable_symbols: list[str] | None = None
    baselines: list[Strategy] = field(default_factory=list)
    walk_forward_windows: int = 0
    walk_forward_min_train: float = 0.4
    validity_enabled: bool = True
    holdout_fraction: float = 0.15
    fdr_alpha: float = 0.10
    min_holdout_sharpe: float = 0.0
    min_holdout_ic: float = 0.0
    require_positive_return: bool = True
    require_baseline_outperformance: bool = True
    require_walk_forward_stability: bool = True
    require_data_readiness: bool = True
    point_in_time_universe: bool = False
    survivorship_bias_free: bool = False
    corporate_actions_adjusted: bool = False
    sector_neutral: bool = False
    liquidity_min_rank: float | None = None
    bootstrap_iterations: int = 0
    bootstrap_seed: int = 123
    holding_grid: list[int] = field(default_factory=list)
    quantile_grid: list[float] = field(default_factory=list)
    cost_multipliers: list[float] = field(default_factory=list)
    notionals: list[float] = field(default_factory=list)
    max_trade_participation: float = 0.10
    max_position_weight: float = 0.10
    selection_policy: str | None = None

    def __post_init__(self) -> None:
        def need(ok: bool, text: str) -> None:
            if not ok:
                raise ValueError(text)

        for name in (
            "validity_enabled",
            "require_positive_return",
            "require_baseline_outperformance",
            "require_walk_forward_stability",
            "require_data_readiness",
            "point_in_time_universe",
            "survivorship_bias_free",
            "corporate_actions_adjusted",
        ):
            need(type(getattr(self, name)) is bool, f"{name} must be a boolean")
        for name in ("holdout_fraction", "fdr_alpha", "min_holdout_sharpe", "min_holdout_ic"):
            need(not isinstance(getattr(self, name), bool), f"{name} must be a number, not a boolean")
        need(0.1 <= self.train_fraction <= 0.9, "train_fraction must be between 0.1 and 0.9")
        need(0.0 < self.quantile < 0.5, "quantile must be between 0 and 0.5")
        need(self.holding_period > 0, "holding_period must be positive")
        need(self.rebalance_days > 0, "rebalance_days must be positive")
        for name in ("transaction_cost_bps", "spread_cost_bps", "market_impact_coefficient", "borrow_fee_bps"):
            need(getattr(self, name) >= 0.0, f"{name} must be non-negative")
        need(self.portfolio_notional > 0.0, "portfolio_notional must be positive")
        need(self.walk_forward_windows >= 0, "walk_forward_windows must be non-negative")
        need(0.1 <= self.walk_forward_min_train <= 0.9, "walk_forward_min_train must be between 0.1 and 0.9")
        need(0.05 <= self.holdout_fraction <= 0.40, "holdout_fraction must be between 0.05 and 0.40")
        need(0.0 < self.fdr_alpha <= 0.25, "fdr_alpha must be greater than 0 and at most 0.25")
        need(isfinite(self.min_holdout_sharpe), "min_holdout_sharpe must be finite")
        need(isfinite(self.min_holdout_ic), "min_holdout_ic must be finite")
        if self.validity_enabled:
            total = self.train_fraction + self.holdout_fraction
            need(total <= 0.90, "train_fraction plus holdout_fraction must be at most 0.90")
        if self.liquidity_min_rank is not None:
            need(0.0 <= self.liquidity_min_rank < 1.0, "liquidity_min_rank must be between 0 and 1")
        need(self.bootstrap_iterations >= 0, "bootstrap_iterations must be non-negative")
        need(all(h > 0 for h in self.holding_grid), "holding_grid must contain positive integers")
        need(all(0.0 < q < 0.5 for q in self.quantile_grid), "quantile_grid must be between 0 and 0.5")
        need(all(m >= 0.0 for m in self.cost_multipliers), "cost_multipliers must be non-negative")
        need(all(n > 0.0 for n in self.notionals), "notionals must contain positive values")
        need(0.0 < self.max_trade_participation <= 1.0, "max_trade_participation must be between 0 and 1")
        need(0.0 < self.max_position_weight <= 1.0, "max_position_weight must be between 0 and 1")
        if self.selection_policy is not None:
            allowed = ", ".join(SELECTION_POLICIES)
            need(self.selection_policy in SELECTION_POLICIES, f"selection_policy must be one of {allowed}")

    @property
    def effective_holdout(self) -> float:
        return self.holdout_fraction if self.validity_enabled else 0.0

    def factor_names(self) -> list[str]:
        used = [self.signal, *self.baselines]
        return list(dict.fromkeys(n for s in used for n in [*s.positive, *s.negative]))

    def stress_names(self) -> list[str]:
        from panelweave.operators.signals import liquidity_name

        names = ["sector_neutral_signal"] if self.sector_neutral else []
        if self.liquidity_min_rank is not None:
            liquid = liquidity_name(self.liquidity_min_rank)
            names.append(liquid)
            if self.sector_neutral:
                names.append(f"sector_neutral_{liquid}")
        return names

    def variants(self) -> list[Variant]:
        """The whole evaluation grid: agent, baselines, stress, parameter, cost and capacity rows."""

        def row(name, family, strategy="agent_signal", h=None, q=None, m=1.0, notional=None) -> Variant:
            return Variant(
                name,
                family,
                strategy,
                self.holding_period if h is None else h,
                self.quantile if q is None else q,
                m,
                self.portfolio_notional if notional is None else notional,
            )

        grid = [row("agent_signal", "primary")]
        grid += [row(b.name, "baseline", b.name) for b in self.baselines]
        grid += [row(n, "stress_test", n) for n in self.stress_names()]
        grid += [
            row(f"h{h}_q{int(q * 100)}", "parameter_sensitivity", h=h, q=q)
            for h in self.holding_grid
            for q in self.quantile_grid
        ]
        grid += [row(f"cost_{m:g}x", "cost_sensitivity", m=m) for m in self.cost_multipliers]
        grid += [row(f"notional_{n:g}", "capacity", notional=n) for n in self.notionals]
        return grid
