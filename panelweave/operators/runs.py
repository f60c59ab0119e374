"""Stored runs: manifest schema, comparison, registry, families, memory, critique and interpretation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.groupwise import attach, needs_split, with_position
from panelweave.operators.inference import benjamini_hochberg


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


_TEST = ["sharpe", "total_return", "ic_mean", "max_drawdown", "average_total_cost", "average_turnover"]
_CANDIDATE = T.StructType(
    _fields(["name", "family"], T.StringType())
    + _fields(["holdout_ic_mean", "holdout_sharpe", "holdout_total_return", "p_value", "q_value"], T.DoubleType())
)
_VALIDITY = T.StructType(
    [T.StructField("verdict", T.StringType()), T.StructField("candidates", T.ArrayType(_CANDIDATE))]
)
MANIFEST_SCHEMA = T.StructType(
    _fields(["run_id", "experiment", "generated_at"], T.StringType())
    + [
        T.StructField(
            "experiment_family",
            T.StructType(_fields(["family_id", "hypothesis_id", "candidate_id", "selection_policy"], T.StringType())),
        ),
        T.StructField("config", T.StructType(_fields(["sha256"], T.StringType()))),
        T.StructField(
            "code",
            T.StructType(_fields(["commit", "branch"], T.StringType()) + _fields(["dirty"], T.BooleanType())),
        ),
        T.StructField(
            "data",
            T.StructType(
                _fields(["source", "snapshot_dataset_id"], T.StringType())
                + [T.StructField("observed_symbols", T.ArrayType(T.StringType()))]
            ),
        ),
        T.StructField(
            "artifacts", T.StructType(_fields(["report_path", "experiments_path", "manifest_path"], T.StringType()))
        ),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("test", T.StructType(_fields(_TEST, T.DoubleType()))),
                    T.StructField(
                        "holdout", T.StructType(_fields(["sharpe", "total_return", "ic_mean"], T.DoubleType()))
                    ),
                    T.StructField("full", T.StructType(_fields(["sharpe", "total_return"], T.DoubleType()))),
                    T.StructField("research_validity", _VALIDITY),
                ]
            ),
        ),
        T.StructField("research_validity", _VALIDITY),
    ]
)

# Ascending when ranked.  max_drawdown is negative, so ascending lists the deepest one first.
ASCENDING_METRICS = ["max_drawdown", "average_total_cost", "average_turnover"]


def _or(path: str, default: object) -> Column:
    return F.coalesce(F.col(path), F.lit(default))


# ---------------------------------------------------------------- comparison


def comparison_rows(manifests: DataFrame) -> DataFrame:
    """Manifest -> one flat row with defaults for what is missing."""
    return manifests.select(
        "run_id",
        "experiment",
        "generated_at",
        _or("data.source", "unknown").alias("source"),
        F.col("data.snapshot_dataset_id").alias("dataset_id"),
        F.col("config.sha256").alias("config_sha256"),
        _or("code.commit", "unknown").alias("code_commit"),
        _or("code.dirty", False).alias("code_dirty"),
        *[_or(f"metrics.test.{m}", 0.0).alias(f"test_{m}") for m in _TEST],
        F.when(F.col("data.observed_symbols").isNull(), 0).otherwise(F.size("data.observed_symbols")).alias("observed_symbols"),
    )


def rank_runs(rows: DataFrame, metric: str = "sharpe", limit: int | None = None, split: bool | None = None) -> DataFrame:
    """Add ``rank`` by one test metric (run_id breaks ties); ``limit`` keeps the first ranks."""
    if metric not in _TEST:
        raise ValueError(f"Unsupported comparison metric {metric!r}; expected one of {', '.join(_TEST)}")
    column, descending = f"test_{metric}", metric not in ASCENDING_METRICS
    if limit is None:
        return with_position(rows, [column, "run_id"], descending, split=split)
    order = [F.col(column).desc() if descending else F.col(column).asc(), F.col("run_id")]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def _varies(column: str) -> Column:
    """More than one distinct value, null counting as a value; needs no distinct aggregation."""
    c = F.col(column)
    return (F.min(c) != F.max(c)) | (F.count(c).between(1, F.count(F.lit(1)) - 1))


def _flag(condition: Column, text: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))


def comparison_warnings(rows: DataFrame) -> DataFrame:
    """One row: array of mixed-provenance warnings over all compared runs."""
    # The warnings' sentences.
    found = F.array(
        _flag(_varies("config_sha256"), "Compared runs use different config hashes."),
        _flag(_varies("code_commit"), "Compared runs use different git commits."),
        _flag(F.bool_or("code_dirty"), "At least one compared run was generated from a dirty git worktree."),
        _flag(_varies("source"), "Compared runs use different data sources."),
        _flag(_varies("dataset_id"), "Compared runs use different snapshot dataset ids."),
    )
    return rows.agg(F.array_compact(found).alias("warnings"))


def comparison_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_distinct("experiment").alias("unique_experiments"),
        F.count_distinct("config_sha256").alias("unique_configs"),
        F.count_distinct("code_commit").alias("unique_code_commits"),
        F.count_distinct("source").alias("unique_sources"),
        F.round(F.avg("test_sharpe"), 6).alias("average_test_sharpe"),
        F.round(F.avg("test_total_return"), 6).alias("average_test_return"),
        F.round(F.avg("test_average_total_cost"), 8).alias("average_test_cost"),
    )


# ---------------------------------------------------------------- families


def family_rows(manifests: DataFrame) -> DataFrame:
    """Manifest -> family row; evidence falls back from the agent candidate to the holdout metrics."""
    validity = F.coalesce("research_validity", "metrics.research_validity")
    base = manifests.withColumn("__validity", validity)
    agents = F.filter(F.col("__validity.candidates"), lambda c: c["name"] == "agent_signal")
    base = base.withColumn("__agent", F.try_element_at(agents, F.lit(1)))

    def evidence(name: str) -> Column:
        holdout = F.col(f"metrics.holdout.{name}")
        return F.coalesce(F.col(f"__agent.holdout_{name}"), holdout, F.lit(0.0)).alias(f"holdout_{name}")

    return base.select(
        "run_id",
        "experiment",
        "generated_at",
        "experiment_family.family_id",
        "experiment_family.hypothesis_id",
        "experiment_family.candidate_id",
        "experiment_family.selection_policy",
        _or("config.sha256", "unknown").alias("config_sha256"),
        _or("code.commit", "unknown").alias("code_commit"),
        _or("code.dirty", False).alias("code_dirty"),
        _or("data.source", "unknown").alias("source"),
        F.col("data.snapshot_dataset_id").alias("dataset_id"),
        _or("__validity.verdict", "REVIEW").alias("run_validity_verdict"),
        evidence("ic_mean"),
        evidence("sharpe"),
        evidence("total_return"),
        _or("__agent.p_value", 1.0).alias("agent_p_value"),
        _or("__agent.q_value", 1.0).alias("agent_q_value"),
        F.col("__agent").isNull().alias("missing_agent_evidence"),
    )


def latest_per_run(rows: DataFrame) -> DataFrame:
    """One row per run_id: the last one generated wins, of equally old ones the last by manifest path and content.

    A missing generation time is the oldest, not a reason to lose the row.
    """
    return rows.groupBy("run_id").agg(_last_written(rows).alias("r")).select("run_id", "r.*")


def _last_written(rows: DataFrame) -> Column:
    """The columns but run_id of the newest row of a group, as a struct."""
    packed = F.struct(*[c for c in rows.columns if c != "run_id"])
    order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("generated_at", "created_at", "manifest_path") if c in rows.columns]
    return F.max_by(packed, F.struct(*order, F.to_json(packed)))


def family_facts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per family (null is a group): pre-registered count, provenance flags and the warnings array."""
    registered = F.count_if(F.col("selection_policy") == "pre_registered")
    mixed = F.coalesce(_varies("config_sha256") | _varies("source") | _varies("dataset_id"), F.lit(False))
    warnings = F.array(
        _flag(F.bool_or(F.col("family_id").isNull()), "At least one family row is missing experiment_family.family_id."),
        _flag(registered > 1, "Multiple pre-registered candidates exist in this family."),
        _flag(registered == 0, "No pre-registered candidate exists in this family."),
        _flag(_varies("config_sha256"), "Compared family rows use different config hashes."),
        _flag(_varies("code_commit"), "Compared family rows use different git commits."),
        _flag(F.bool_or("code_dirty"), "At least one family row was generated from a dirty git worktree."),
        _flag(_varies("source"), "Compared family rows use different data sources."),
        _flag(_varies("dataset_id"), "Compared family rows use different snapshot dataset ids."),
    )
    return rows.groupBy(*(keys or ["family_id"])).agg(
        F.count(F.lit(1)).alias("run_count"),
        registered.alias("pre_registered_count"),
        mixed.alias("mixed_provenance"),
        F.array_compact(warnings).alias("warnings"),
    )


def compare_families(
    rows: DataFrame, fdr_alpha: float = 0.10, per_family: bool = True, split: bool | None = None
) -> DataFrame:
    """Add family_q_value, family_verdict and reasons for every family at once.

    ``per_family=False`` compares all runs as one family, as an unfiltered comparison does.

    Facts are aggregated per family and joined back, so a family holding most runs is never one task.
    """
    if not 0.0 < fdr_alpha <= 0.25:
        raise ValueError("fdr_alpha must be greater than 0 and at most 0.25")
    split = needs_split(rows, split, ["family_id"] if per_family else None)
    scoped = rows.withColumn("__scope", F.col("family_id") if per_family else F.lit("all"))
    adjusted = benjamini_hochberg(scoped, ["__scope"], "agent_p_value", "family_q_value", split)
    facts = family_facts(scoped, ["__scope"]).drop("warnings", "run_count")
    joined = attach(adjusted, facts, ["__scope"], "left").drop("__scope")
    c = F.col
    policy = F.coalesce(c("selection_policy"), F.lit("missing"))
    not_registered = policy != "pre_registered"
    verdict = c("run_validity_verdict")
    over = c("family_q_value") > fdr_alpha
    review = (
        c("family_id").isNull()
        | not_registered
        | (verdict == "REVIEW")
        | c("code_dirty")
        | (c("pre_registered_count") != 1)
        | c("mixed_provenance")
    )
    decided = (
        F.when(verdict == "REJECT", "FAMILY_REJECT")
        .when(c("missing_agent_evidence"), "FAMILY_REVIEW")
        .when(over, "FAMILY_REJECT")
        .when(review | (verdict != "PROMOTE"), "FAMILY_REVIEW")
        .otherwise("FAMILY_PROMOTE")
    )
    reasons = F.array(
        F.when(c("family_id").isNull(), "family metadata is missing"),
        F.when(not_registered, F.format_string("selection policy %s is not pre_registered", policy)),
        F.when(verdict.isin("REJECT", "REVIEW"), F.format_string("run-level validity verdict is %s", verdict)),
        F.when(c("missing_agent_evidence"), "agent_signal p-value evidence is missing").when(
            over, F.format_string(f"family q-value %.4f must be at most {fdr_alpha:.4f}", c("family_q_value"))
        ),
        F.when(c("code_dirty"), "run was generated from a dirty git worktree"),
        F.when(c("pre_registered_count") > 1, "multiple pre-registered candidates exist in this family"),
        F.when(c("mixed_provenance"), "family provenance differs across compared rows"),
    )
    return joined.withColumns({"family_verdict": decided, "reasons": F.array_compact(reasons)})


def first_in_family_order(compared: DataFrame, limit: int) -> DataFrame:
    return compared.orderBy("family_q_value", "generated_at", "run_id").limit(limit)


def family_summary(compared: DataFrame) -> DataFrame:
    """One row of distinct counts (null counts as a value), verdict counts and averages."""

    def distinct(column: str) -> Column:
        return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))

    verdict = F.col("family_verdict")
    return compared.agg(
        distinct("family_id").alias("unique_families"),
        distinct("hypothesis_id").alias("unique_hypotheses"),
        F.count_distinct("config_sha256").alias("unique_configs"),
        F.count_distinct("source").alias("unique_sources"),
        F.count_if(F.col("selection_policy") == "pre_registered").alias("pre_registered_count"),
        F.count_if(verdict == "FAMILY_PROMOTE").alias("family_promote_count"),
        F.count_if(verdict == "FAMILY_REVIEW").alias("family_review_count"),
        F.count_if(verdict == "FAMILY_REJECT").alias("family_reject_count"),
        F.round(F.avg("agent_p_value"), 6).alias("average_agent_p_value"),
        F.round(F.avg("family_q_value"), 6).alias("average_family_q_value"),
    )


# ---------------------------------------------------------------- registry


def registry_records(manifests: DataFrame, created_at: Column) -> DataFrame:
    """Manifest -> the 28-column registry record; nested parts are kept as JSON text."""
    as_json = lambda path: F.to_json(F.col(path))
    return manifests.select(
        "run_id",
        "experiment",
        "generated_at",
        F.col("config.sha256").alias("config_sha256"),
        _or("data.source", "unknown").alias("data_source"),
        F.col("data.snapshot_dataset_id").alias("dataset_id"),
        _or("code.commit", "unknown").alias("code_commit"),
        _or("code.branch", "unknown").alias("code_branch"),
        _or("code.dirty", False).alias("code_dirty"),
        "artifacts.report_path",
        "artifacts.experiments_path",
        "artifacts.manifest_path",
        *[_or(f"metrics.test.{m}", 0.0).alias(f"test_{m}") for m in _TEST],
        _or("metrics.full.sharpe", 0.0).alias("full_sharpe"),
        _or("metrics.full.total_return", 0.0).alias("full_total_return"),
        as_json("metrics").alias("metrics_json"),
        as_json("data").alias("data_json"),
        as_json("artifacts").alias("artifacts_json"),
        F.col("experiment_family.family_id").alias("experiment_family_id"),
        "experiment_family.hypothesis_id",
        "experiment_family.candidate_id",
        "experiment_family.selection_policy",
        created_at.alias("created_at"),
    )


def upsert_runs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after an upsert by run_id: incoming rows replace existing ones, of several incoming rows the newest.

    Columns one side lacks (older tables without family columns) come out null.
    """
    incoming = incoming.groupBy("run_id").agg(_last_written(incoming).alias("r")).select("run_id", "r.*")
    kept = existing.join(incoming.select("run_id"), "run_id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def collapse_upserts(changes: DataFrame, sequence: str = "seq") -> DataFrame:
    """Last write per run_id from a change feed, by aggregation with map-side combine."""
    packed = F.struct(*[c for c in changes.columns if c not in ("run_id", sequence)])
    return changes.groupBy("run_id").agg(F.max_by(packed, sequence).alias("r")).select("run_id", "r.*")


def get_run(registry: DataFrame, run_id: str) -> DataFrame:
    return registry.where(F.col("run_id") == run_id)


def latest_runs(registry: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs first; run_id breaks ties.  Planned as a top-k, not a sort."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return registry.orderBy(F.desc("generated_at"), F.desc("run_id")).limit(limit)


def service_counters(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """Number of runs (reported up to ``limit`` if one is given) and the newest run id."""
    runs = F.count(F.lit(1))
    return registry.agg(
        (runs if limit is None else F.least(runs, F.lit(limit))).alias("run_count"),
        F.max_by("run_id", F.struct("generated_at", "run_id")).alias("latest_run_id"),
    )


def with_family_columns(registry: DataFrame) -> DataFrame:
    """Additive migration: the four family columns appear as null where an old table lacks them."""
    names = ["experiment_family_id", "hypothesis_id", "candidate_id", "selection_policy"]
    return registry.withColumns({n: F.lit(None).cast("string") for n in names if n not in registry.columns})


def research_memory(registry: DataFrame, limit: int = 50, edge: int = 3) -> DataFrame:
    """Best and weakest of the newest ``limit`` runs by test Sharpe, with the memory's warnings.

    The windows run over at most ``limit`` rows.
    """
    recent = latest_runs(registry, limit)
    all_rows = Window.partitionBy(F.lit(0))
    ranked = recent.select(
        "run_id",
        "test_sharpe",
        F.row_number().over(all_rows.orderBy(F.desc("test_sharpe"), "run_id")).alias("best_rank"),
        F.row_number().over(all_rows.orderBy("test_sharpe", "run_id")).alias("weak_rank"),
        F.bool_or("code_dirty").over(all_rows).alias("__dirty"),
        (F.min("config_sha256").over(all_rows) != F.max("config_sha256").over(all_rows)).alias("__mixed"),
    )
    warnings = F.array_compact(
        F.array(
            _flag(F.col("__dirty"), "Some prior runs came from dirty worktrees."),
            _flag(F.col("__mixed"), "Prior memory spans multiple config hashes; compare ideas cautiously."),
        )
    )
    kept = ranked.where((F.col("best_rank") <= edge) | (F.col("weak_rank") <= edge))
    return kept.select(
        "run_id",
        "test_sharpe",
        F.when(F.col("best_rank") <= edge, F.col("best_rank")).alias("best_rank"),
        F.when(F.col("weak_rank") <= edge, F.col("weak_rank")).alias("weak_rank"),
        warnings.alias("warnings"),
    )


def critique(rows: DataFrame) -> DataFrame:
    """Verdict and reasons for every stored run from its test metrics."""
    c = F.col
    strong = c("test_sharpe") >= 0.5
    reasons = F.array(
        F.when(c("test_sharpe") <= 0, "Reject: test Sharpe is non-positive.")
        .when(~strong, "Weak: test Sharpe is positive but below a strong research threshold.")
        .otherwise("Promising: test Sharpe clears the initial threshold."),
        F.when(c("test_total_return") <= 0, "Total return is non-positive in the test window."),
        F.when(c("test_ic_mean") <= 0, "Mean IC is non-positive; cross-sectional ranking quality is weak."),
        F.when(c("test_max_drawdown") < -0.20, "Max drawdown is severe for a research candidate."),
        F.when(c("test_average_total_cost") > 0.002, "Average total cost is high enough to threaten deployability."),
    )
    accept = strong & (c("test_total_return") > 0) & (c("test_ic_mean") > 0)
    return rows.select(
        "run_id", F.when(accept, "accept").otherwise("reject").alias("verdict"), F.array_compact(reasons).alias("reasons")
    )


# ---------------------------------------------------------------- interpretation of one research run


def interpretation(test: DataFrame, windows: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """One row of decision flags from the test metrics of the grid, the agent's windows and its bootstrap.

    The best strategy is the first in grid order among equals; inputs are configuration-sized.
    """
    family, sharpe = F.col("family"), F.col("sharpe")
    contest = family.isin("primary", "baseline")
    held = (family == "stress_test") & (sharpe > 0) & (F.col("ic_mean") > 0)
    cost = family == "cost_sensitivity"
    facts = test.agg(
        F.max_by(F.when(contest, F.col("name")), F.when(contest, F.struct(sharpe, -F.col("position_in_grid")))).alias(
            "best_strategy"
        ),
        F.count_if(held).alias("stress_passing"),
        F.count_if(family == "stress_test").alias("stress_count"),
        F.avg(F.when(family == "parameter_sensitivity", (sharpe > 0).cast("double"))).alias("positive_parameter_share"),
        F.max_by(F.when(cost, sharpe), F.when(cost, F.col("position_in_grid"))).alias("last_cost_sharpe"),
    )
    walk = windows.agg(
        F.avg((F.col("ic_mean") > 0).cast("double")).alias("share"), F.avg("sharpe").alias("mean")
    )
    boot = bootstrap.agg(
        F.max("positive_sharpe_probability").alias("ps"), F.max("positive_ic_probability").alias("pi")
    )
    joined = facts.withColumns(
        {
            "walk_forward_share": walk.select("share").scalar(),
            "walk_forward_sharpe": walk.select("mean").scalar(),
            "__ps": boot.select("ps").scalar(),
            "__pi": boot.select("pi").scalar(),
        }
    )
    weak = F.array(
        _flag(F.col("__ps") < 0.6, "bootstrap Sharpe confidence is weak"),
        _flag(F.col("__pi") < 0.6, "bootstrap IC confidence is weak"),
        _flag(F.col("positive_parameter_share") < 0.5, "parameter sensitivity is fragile"),
        _flag(F.col("last_cost_sharpe") <= 0, "high-cost sensitivity erases positive Sharpe"),
    )
    stable = F.coalesce((F.col("walk_forward_share") >= 0.67) & (F.col("walk_forward_sharpe") > 0), F.lit(False))
    return joined.select(
        "best_strategy",
        "stress_passing",
        "stress_count",
        F.array_compact(weak).alias("weak_points"),
        stable.alias("walk_forward_stable"),
    )
