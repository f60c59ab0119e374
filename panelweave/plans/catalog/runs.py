"""Catalogue: manifests, comparison, families, registry, memory, critique and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelweave.operators import runs as rn
from panelweave.plans.catalog import backtest as bt
from panelweave.plans.catalog import fixtures as fx
from panelweave.plans.catalog.backtest import bh_sql, run_sql
from panelweave.session import shared_folder
from panelweave.sources import sinks
from panelweave.sources.manifests import read_documents, read_manifests, write_documents, write_manifests

ENTRIES: dict[str, tuple] = {}


def entry(key: str, sql: str | None = None):
    def register(fn):
        ENTRIES[key] = (fn, sql)
        return fn

    return register


_TEST = ["test_sharpe", "test_total_return", "test_ic_mean", "test_max_drawdown", "test_average_total_cost", "test_average_turnover"]
COMPARED = f"""{fx.RUNS},
compared AS (SELECT *, coalesce(sharpe, 0) AS test_sharpe, total_return AS test_total_return, ic_mean AS test_ic_mean,
  max_drawdown AS test_max_drawdown, average_total_cost AS test_average_total_cost, average_turnover AS test_average_turnover FROM runs)"""


@entry(
    "src_8_manifest_scan",
    f"WITH {fx.RUNS} SELECT run_id, experiment, generated_at, family_id, verdict, source FROM runs",
)
def src_8(spark, sf):
    """Manifests written by the sink, discovered again by glob with the fixed nested schema."""
    path = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    write_manifests(fx.manifests(spark, sf), path)
    found = read_manifests(spark, f"{path}/*.txt", multi_line=False)
    return found.select(
        "run_id",
        "experiment",
        "generated_at",
        "experiment_family.family_id",
        F.coalesce("research_validity.verdict", "metrics.research_validity.verdict").alias("verdict"),
        "data.source",
    )


_STORES: dict[tuple[str, str], str] = {}


def parsed(spark, sf):
    """Manifests read back from the session's packed manifest folder (written once)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        path = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
        write_manifests(fx.manifests(spark, sf), path)
        _STORES[key] = path
    return read_manifests(spark, f"{_STORES[key]}/*.txt", multi_line=False)


_CANDIDATES = ["holdout_ic_mean", "holdout_sharpe", "holdout_total_return", "p_value", "q_value"]


@entry(
    "snk_2_manifest_documents",
    f"""WITH {fx.RUNS} SELECT run_id, experiment, generated_at, family_id, CASE WHEN family_id IS NOT NULL THEN hypothesis_id END AS hypothesis_id,
  CASE WHEN family_id IS NOT NULL THEN candidate_id END AS candidate_id, CASE WHEN family_id IS NOT NULL THEN selection_policy END AS selection_policy,
  config_sha256, code_commit, code_branch, code_dirty, source, dataset_id,
  (SELECT coalesce(string_agg(concat('S', i), ','), '') FROM range(symbol_count) t(i)) AS symbols, concat('reports/', run_id, '.md') AS report_path,
  'results/experiments.csv' AS experiments_path, concat('runs/', run_id, '/manifest.json') AS manifest_path,
  {', '.join(f'round({c}, 9) AS test_{c}' for c in ('sharpe', 'total_return', 'ic_mean', 'max_drawdown', 'average_total_cost', 'average_turnover'))},
  round(coalesce(sharpe, 0) / 3, 9) AS holdout_sharpe, round(total_return / 3, 9) AS holdout_total_return, round(ic_mean / 3, 9) AS holdout_ic_mean,
  round(sharpe * 2, 9) AS full_sharpe, round(total_return * 2, 9) AS full_total_return, verdict, key % 2 = 0 AS on_top,
  concat_ws(';', concat_ws(',', 'momentum_20d_only', 'baseline', {{0}}), CASE WHEN has_agent THEN concat_ws(',', 'agent_signal', 'primary', {{0}}) END) AS candidates FROM runs""".replace(
        "{0}",
        ", ".join(
            f"CAST(CAST(round(({v}) * 1000000) AS BIGINT) AS VARCHAR)"
            for v in ("ic_mean / 2", "coalesce(sharpe, 0) / 2", "total_return / 2", "CASE WHEN key % 23 <> 5 THEN p_value END", "0.5")
        ),
    ),
)
def snk_2(spark, sf):
    """Every field of the documents after they have been written and read again."""
    rows = parsed(spark, sf)
    test = [F.round(f"metrics.test.{c}", 9).alias(f"test_{c}") for c in ("sharpe", "total_return", "ic_mean", "max_drawdown", "average_total_cost", "average_turnover")]
    other = [F.round(f"metrics.{split}.{c}", 9).alias(f"{split}_{c}") for split, cs in (("holdout", ("sharpe", "total_return", "ic_mean")), ("full", ("sharpe", "total_return"))) for c in cs]
    on_top = F.col("research_validity").isNotNull()
    validity = F.coalesce("research_validity", "metrics.research_validity")
    number = lambda x: F.round(x * 1_000_000).cast("long").cast("string")
    candidate = lambda x: F.concat_ws(",", x["name"], x["family"], *[number(x[c]) for c in _CANDIDATES])
    return rows.select(
        "run_id",
        "experiment",
        "generated_at",
        *[f"experiment_family.{c}" for c in ("family_id", "hypothesis_id", "candidate_id", "selection_policy")],
        F.col("config.sha256").alias("config_sha256"),
        *[F.col(f"code.{c}").alias(f"code_{c}") for c in ("commit", "branch", "dirty")],
        "data.source",
        F.col("data.snapshot_dataset_id").alias("dataset_id"),
        F.array_join("data.observed_symbols", ",").alias("symbols"),
        *[f"artifacts.{c}" for c in ("report_path", "experiments_path", "manifest_path")],
        *test,
        *other,
        validity["verdict"].alias("verdict"),
        on_top.alias("on_top"),
        F.array_join(F.transform(validity["candidates"], candidate), ";").alias("candidates"),
    )


_FOLDERS: dict[tuple[str, str], str] = {}


def document_folder(spark, sf):
    """A folder with one file per run, one in 97 cut short, one without a run_id and one without test metrics. Written once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOLDERS:
        folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
        k = F.substring("run_id", 5, 20).cast("long")
        text = F.to_json(F.struct(*rn.MANIFEST_SCHEMA.fieldNames()))
        nameless = F.to_json(F.struct(*[c for c in rn.MANIFEST_SCHEMA.fieldNames() if c != "run_id"]))
        untested = F.to_json(F.struct("run_id", "experiment", F.struct("metrics.full").alias("metrics")))
        value = F.when(k % 97 == 5, F.substring(text, 1, 200)).when(k % 97 == 6, nameless).when(k % 97 == 7, untested).otherwise(text)
        documents = fx.manifests(spark, sf).select(F.col("run_id").alias("run"), value.alias("value"))
        write_documents(documents, folder, "run")
        _FOLDERS[key] = folder
    return _FOLDERS[key]


@entry(
    "src_8_small_documents",
    f"""WITH {fx.RUNS} SELECT run_id AS run, CASE key % 97 WHEN 5 THEN 'not valid JSON' WHEN 6 THEN 'run_id is missing' WHEN 7 THEN 'metrics.test is missing' END AS error,
  CASE WHEN key % 97 NOT IN (5, 6, 7) THEN run_id END AS run_id, CASE WHEN key % 97 NOT IN (5, 6, 7) THEN code_commit END AS code_commit,
  CASE WHEN key % 97 NOT IN (5, 6, 7) THEN round(total_return, 9) END AS total_return FROM runs""",
)
def src_8_documents(spark, sf):
    """One-document files, damaged ones as rows."""
    found = read_documents(spark, document_folder(spark, sf), "*.txt")
    run = F.regexp_extract("manifest_path", r"run=([^/]+)\.txt", 1)
    return found.select(run.alias("run"), "error", "document.run_id", F.col("document.code.commit").alias("code_commit"), F.round("document.metrics.test.total_return", 9).alias("total_return"))


@entry(
    "cmp_1_comparison_rows",
    f"""WITH {COMPARED} SELECT run_id, experiment, generated_at, source, dataset_id, config_sha256, code_commit, code_dirty,
{', '.join(f'round({c}, 6) AS {c}' for c in _TEST)}, symbol_count AS observed_symbols FROM compared""",
)
def cmp_1(spark, sf):
    out = fx.rounded(rn.comparison_rows(parsed(spark, sf)), *_TEST)
    return out.withColumn("observed_symbols", F.col("observed_symbols").cast("long"))


@entry(
    "cmp_2_rank_all",
    f"WITH {COMPARED} SELECT run_id, round(test_sharpe, 6) AS test_sharpe, row_number() OVER (ORDER BY test_sharpe DESC, run_id) AS rank FROM compared",
)
def cmp_2(spark, sf):
    out = rn.rank_runs(rn.comparison_rows(parsed(spark, sf)), "sharpe")
    return fx.rounded(out, "test_sharpe").select("run_id", "test_sharpe", "rank")


@entry(
    "cmp_2_rank_drawdown_top",
    f"""WITH {COMPARED} SELECT run_id, round(test_max_drawdown, 6) AS test_max_drawdown, row_number() OVER (ORDER BY test_max_drawdown, run_id) AS rank
FROM compared ORDER BY test_max_drawdown, run_id LIMIT 25""",
)
def cmp_2_top(spark, sf):
    out = rn.rank_runs(rn.comparison_rows(parsed(spark, sf)), "max_drawdown", limit=25)
    return fx.rounded(out, "test_max_drawdown").select("run_id", "test_max_drawdown", "rank")


@entry(
    "cmp_3_warnings",
    f"""WITH {fx.RUNS} SELECT concat_ws(' ', CASE WHEN count(DISTINCT config_sha256) > 1 THEN 'Compared runs use different config hashes.' END,
CASE WHEN count(DISTINCT code_commit) > 1 THEN 'Compared runs use different git commits.' END,
CASE WHEN bool_or(code_dirty) THEN 'At least one compared run was generated from a dirty git worktree.' END,
CASE WHEN count(DISTINCT source) > 1 THEN 'Compared runs use different data sources.' END,
CASE WHEN count(DISTINCT coalesce(dataset_id, '-')) > 1 THEN 'Compared runs use different snapshot dataset ids.' END) AS warnings FROM runs""",
)
def cmp_3(spark, sf):
    return rn.comparison_warnings(rn.comparison_rows(parsed(spark, sf))).select(F.concat_ws(" ", "warnings").alias("warnings"))


@entry(
    "cmp_4_summary",
    f"""WITH {COMPARED} SELECT count(DISTINCT experiment) AS unique_experiments, count(DISTINCT config_sha256) AS unique_configs,
count(DISTINCT code_commit) AS unique_code_commits, count(DISTINCT source) AS unique_sources, round(avg(test_sharpe), 6) AS average_test_sharpe,
round(avg(test_total_return), 6) AS average_test_return, round(avg(test_average_total_cost), 8) AS average_test_cost FROM compared""",
)
def cmp_4(spark, sf):
    return rn.comparison_summary(rn.comparison_rows(parsed(spark, sf)))


# ---------------------------------------------------------------- families

FAMILY = f"""{fx.RUNS},
family AS MATERIALIZED (
  SELECT run_id, key, experiment, generated_at, family_id, CASE WHEN family_id IS NOT NULL THEN hypothesis_id END AS hypothesis_id,
    CASE WHEN family_id IS NOT NULL THEN candidate_id END AS candidate_id, CASE WHEN family_id IS NOT NULL THEN selection_policy END AS selection_policy,
    config_sha256, code_commit, code_dirty, source, dataset_id, verdict AS run_validity_verdict,
    CASE WHEN has_agent THEN ic_mean / 2 ELSE ic_mean / 3 END AS holdout_ic_mean,
    CASE WHEN has_agent THEN coalesce(sharpe, 0) / 2 ELSE coalesce(sharpe, 0) / 3 END AS holdout_sharpe,
    CASE WHEN has_agent THEN total_return / 2 ELSE total_return / 3 END AS holdout_total_return,
    CASE WHEN has_agent AND key % 23 <> 5 THEN p_value ELSE 1.0 END AS agent_p_value, CASE WHEN has_agent THEN 0.5 ELSE 1.0 END::DOUBLE AS agent_q_value,
    NOT has_agent AS missing_agent_evidence FROM runs),
facts AS MATERIALIZED (
  SELECT family_id, count(*) AS run_count, count(*) FILTER (WHERE selection_policy = 'pre_registered') AS pre_registered_count,
    count(DISTINCT config_sha256) > 1 AS mc, count(DISTINCT code_commit) > 1 AS mm, bool_or(code_dirty) AS dirty, count(DISTINCT source) > 1 AS ms,
    count(DISTINCT coalesce(dataset_id, '-')) > 1 AS md FROM family GROUP BY family_id),
judged0 AS (SELECT f.*, q_value AS family_q_value, x.pre_registered_count, mc OR ms OR md AS mixed
  FROM {bh_sql("family", "family_id", "agent_p_value", "run_id")} f JOIN facts x ON x.family_id IS NOT DISTINCT FROM f.family_id),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN run_validity_verdict = 'REJECT' THEN 'FAMILY_REJECT' WHEN missing_agent_evidence THEN 'FAMILY_REVIEW' WHEN family_q_value > 0.1 THEN 'FAMILY_REJECT'
    WHEN family_id IS NULL OR coalesce(selection_policy, 'missing') <> 'pre_registered' OR run_validity_verdict <> 'PROMOTE' OR code_dirty OR pre_registered_count <> 1 OR mixed
      THEN 'FAMILY_REVIEW' ELSE 'FAMILY_PROMOTE' END AS family_verdict,
    concat_ws(' | ', CASE WHEN family_id IS NULL THEN 'family metadata is missing' END,
      CASE WHEN coalesce(selection_policy, 'missing') <> 'pre_registered' THEN printf('selection policy %s is not pre_registered', coalesce(selection_policy, 'missing')) END,
      CASE WHEN run_validity_verdict IN ('REJECT', 'REVIEW') THEN printf('run-level validity verdict is %s', run_validity_verdict) END,
      CASE WHEN missing_agent_evidence THEN 'agent_signal p-value evidence is missing' WHEN family_q_value > 0.1 THEN printf('family q-value %.4f must be at most 0.1000', family_q_value) END,
      CASE WHEN code_dirty THEN 'run was generated from a dirty git worktree' END,
      CASE WHEN pre_registered_count > 1 THEN 'multiple pre-registered candidates exist in this family' END,
      CASE WHEN mixed THEN 'family provenance differs across compared rows' END) AS reasons FROM judged0)"""

_FAMILY_COLUMNS = [
    "run_id", "experiment", "generated_at", "family_id", "hypothesis_id", "candidate_id", "selection_policy", "config_sha256",
    "code_commit", "code_dirty", "source", "dataset_id", "run_validity_verdict", "missing_agent_evidence",
]
_EVIDENCE = ["holdout_ic_mean", "holdout_sharpe", "holdout_total_return", "agent_p_value", "agent_q_value"]


@entry("fam_1_family_rows", f"WITH {FAMILY} SELECT {', '.join(_FAMILY_COLUMNS)}, {', '.join(f'round({c}, 9) AS {c}' for c in _EVIDENCE)} FROM family")
def fam_1(spark, sf):
    return fx.rounded(rn.family_rows(parsed(spark, sf)), *_EVIDENCE, digits=9).select(*_FAMILY_COLUMNS, *_EVIDENCE)


def families(spark, sf):
    return rn.compare_families(rn.latest_per_run(rn.family_rows(parsed(spark, sf))))


@entry("fam_2_family_q", f"WITH {FAMILY} SELECT run_id, round(family_q_value, 6) AS family_q_value FROM judged")
def fam_2(spark, sf):
    return fx.rounded(families(spark, sf), "family_q_value").select("run_id", "family_q_value")


@entry("fam_3_family_verdict", f"WITH {FAMILY} SELECT run_id, family_verdict FROM judged")
def fam_3(spark, sf):
    return families(spark, sf).select("run_id", "family_verdict")


@entry("fam_4_family_reasons", f"WITH {FAMILY} SELECT run_id, reasons FROM judged")
def fam_4(spark, sf):
    return families(spark, sf).select("run_id", F.concat_ws(" | ", "reasons").alias("reasons"))


@entry(
    "fam_5_family_warnings",
    f"""WITH {FAMILY} SELECT family_id, run_count, pre_registered_count, concat_ws(' ',
  CASE WHEN family_id IS NULL THEN 'At least one family row is missing experiment_family.family_id.' END,
  CASE WHEN pre_registered_count > 1 THEN 'Multiple pre-registered candidates exist in this family.' END,
  CASE WHEN pre_registered_count = 0 THEN 'No pre-registered candidate exists in this family.' END,
  CASE WHEN mc THEN 'Compared family rows use different config hashes.' END, CASE WHEN mm THEN 'Compared family rows use different git commits.' END,
  CASE WHEN dirty THEN 'At least one family row was generated from a dirty git worktree.' END,
  CASE WHEN ms THEN 'Compared family rows use different data sources.' END, CASE WHEN md THEN 'Compared family rows use different snapshot dataset ids.' END) AS warnings FROM facts""",
)
def fam_5(spark, sf):
    facts = rn.family_facts(rn.latest_per_run(rn.family_rows(parsed(spark, sf))))
    return facts.select("family_id", "run_count", "pre_registered_count", F.concat_ws(" ", "warnings").alias("warnings"))


@entry(
    "fam_6_first_rows",
    f"WITH {FAMILY} SELECT run_id, family_verdict, round(family_q_value, 6) AS family_q_value FROM judged ORDER BY judged.family_q_value, generated_at, run_id LIMIT 40",
)
def fam_6(spark, sf):
    out = rn.first_in_family_order(families(spark, sf), 40)
    return fx.rounded(out, "family_q_value").select("run_id", "family_verdict", "family_q_value")


@entry(
    "fam_6_summary",
    f"""WITH {FAMILY} SELECT count(DISTINCT coalesce(family_id, '-')) AS unique_families, count(DISTINCT coalesce(hypothesis_id, '-')) AS unique_hypotheses,
count(DISTINCT config_sha256) AS unique_configs, count(DISTINCT source) AS unique_sources, count(*) FILTER (WHERE selection_policy = 'pre_registered') AS pre_registered_count,
count(*) FILTER (WHERE family_verdict = 'FAMILY_PROMOTE') AS family_promote_count, count(*) FILTER (WHERE family_verdict = 'FAMILY_REVIEW') AS family_review_count,
count(*) FILTER (WHERE family_verdict = 'FAMILY_REJECT') AS family_reject_count, round(avg(agent_p_value), 6) AS average_agent_p_value,
round(avg(family_q_value), 6) AS average_family_q_value FROM judged""",
)
def fam_6_summary(spark, sf):
    return rn.family_summary(families(spark, sf))


# ---------------------------------------------------------------- registry

_STAMP = "2024-02-01T00:00:00Z"


def registry(spark, sf):
    return rn.registry_records(parsed(spark, sf), F.lit(_STAMP))


REGISTRY = f"""{COMPARED},
registry AS (SELECT key, run_id, experiment, generated_at, config_sha256, source AS data_source, dataset_id, code_commit, code_branch, code_dirty,
  concat('reports/', run_id, '.md') AS report_path, 'results/experiments.csv' AS experiments_path, concat('runs/', run_id, '/manifest.json') AS manifest_path,
  {', '.join(_TEST)}, coalesce(sharpe * 2, 0) AS full_sharpe, total_return * 2 AS full_total_return, family_id AS experiment_family_id,
  CASE WHEN family_id IS NOT NULL THEN hypothesis_id END AS hypothesis_id, CASE WHEN family_id IS NOT NULL THEN candidate_id END AS candidate_id,
  CASE WHEN family_id IS NOT NULL THEN selection_policy END AS selection_policy, '{_STAMP}' AS created_at FROM compared)"""
_NUMBERS = [*_TEST, "full_sharpe", "full_total_return"]
_TEXTS = [
    "run_id", "experiment", "generated_at", "config_sha256", "data_source", "dataset_id", "code_commit", "code_branch", "code_dirty",
    "report_path", "experiments_path", "manifest_path", "experiment_family_id", "hypothesis_id", "candidate_id", "selection_policy", "created_at",
]


@entry("reg_1_records", f"WITH {REGISTRY} SELECT {', '.join(_TEXTS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)} FROM registry")
def reg_1(spark, sf):
    return fx.rounded(registry(spark, sf), *_NUMBERS).select(*_TEXTS, *_NUMBERS)


@entry(
    "reg_2_upsert",
    f"""WITH {REGISTRY} SELECT run_id, CASE WHEN key % 3 = 0 THEN concat(experiment, '-v2') ELSE experiment END AS experiment,
  round(CASE WHEN key % 3 = 0 THEN test_sharpe + 1 ELSE test_sharpe END, 6) AS test_sharpe FROM registry
UNION ALL SELECT concat(run_id, '-new'), concat(experiment, '-v2'), round(test_sharpe + 1, 6) FROM registry WHERE key % 3 = 0 AND key % 2 = 0""",
)
def reg_2(spark, sf):
    columns = ["run_id", "experiment", "test_sharpe"]
    existing = registry(spark, sf).select(*columns)
    number = F.substring("run_id", 5, 9).cast("long")
    changed = existing.where(number % 3 == 0).withColumns(
        {"experiment": F.concat("experiment", F.lit("-v2")), "test_sharpe": F.col("test_sharpe") + 1}
    )
    fresh = changed.where(number % 2 == 0).withColumn("run_id", F.concat("run_id", F.lit("-new")))
    return fx.rounded(rn.upsert_runs(existing, changed.unionByName(fresh)), "test_sharpe")


@entry(
    "reg_2_last_write_wins",
    f"""WITH {REGISTRY}, c AS (SELECT run_id, experiment, test_sharpe, 0 AS seq FROM registry UNION ALL SELECT run_id, concat(experiment, '-w', i), test_sharpe + i, i FROM registry, range(1, 4) t(i) WHERE key % 4 >= i)
SELECT run_id, experiment, round(test_sharpe, 6) AS test_sharpe FROM c QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1""",
)
def reg_2_feed(spark, sf):
    number = F.substring("run_id", 5, 9).cast("long")
    feed = registry(spark, sf).select("run_id", "experiment", "test_sharpe", F.explode(F.sequence(F.lit(0), (number % 4).cast("int"))).alias("seq"))
    feed = feed.withColumns(
        {
            "experiment": F.when(F.col("seq") == 0, F.col("experiment")).otherwise(F.concat("experiment", F.lit("-w"), F.col("seq").cast("string"))),
            "test_sharpe": F.col("test_sharpe") + F.col("seq"),
        }
    )
    return fx.rounded(rn.collapse_upserts(feed), "test_sharpe")


@entry("reg_3_lookup", f"WITH {REGISTRY} SELECT run_id, experiment, round(test_sharpe, 6) AS test_sharpe FROM registry WHERE run_id = 'run-000000042'")
def reg_3(spark, sf):
    return fx.rounded(rn.get_run(registry(spark, sf), "run-000000042"), "test_sharpe").select("run_id", "experiment", "test_sharpe")


@entry("reg_4_latest", f"WITH {REGISTRY} SELECT run_id, generated_at FROM registry ORDER BY generated_at DESC, run_id DESC LIMIT 20")
def reg_4(spark, sf):
    return rn.latest_runs(registry(spark, sf), 20).select("run_id", "generated_at")


@entry(
    "reg_5_counters",
    f"WITH {REGISTRY} SELECT count(*) AS run_count, arg_max(run_id, concat(generated_at, run_id)) AS latest_run_id FROM registry",
)
def reg_5(spark, sf):
    return rn.service_counters(registry(spark, sf))


@entry(
    "reg_6_migration",
    f"""WITH {REGISTRY} SELECT run_id, NULL::VARCHAR AS experiment_family_id, NULL::VARCHAR AS selection_policy FROM registry WHERE key % 2 = 0
UNION ALL SELECT run_id, experiment_family_id, selection_policy FROM registry WHERE key % 2 = 1""",
)
def reg_6(spark, sf):
    """An old table without the family columns meets new rows that have them."""
    rows = registry(spark, sf)
    number = F.substring("run_id", 5, 9).cast("long")
    old = rn.with_family_columns(rows.where(number % 2 == 0).drop("experiment_family_id", "selection_policy"))
    both = rn.upsert_runs(old, rows.where(number % 2 == 1))
    return both.select("run_id", "experiment_family_id", "selection_policy")


@entry(
    "mem_1_research_memory",
    f"""WITH {REGISTRY}, r AS (SELECT * FROM registry ORDER BY generated_at DESC, run_id DESC LIMIT 50),
k AS (SELECT run_id, test_sharpe, row_number() OVER (ORDER BY test_sharpe DESC, run_id) AS b, row_number() OVER (ORDER BY test_sharpe, run_id) AS w FROM r)
SELECT run_id, round(test_sharpe, 6) AS test_sharpe, CASE WHEN b <= 3 THEN b END AS best_rank, CASE WHEN w <= 3 THEN w END AS weak_rank,
  concat_ws(' ', CASE WHEN (SELECT bool_or(code_dirty) FROM r) THEN 'Some prior runs came from dirty worktrees.' END,
  CASE WHEN (SELECT count(DISTINCT config_sha256) FROM r) > 1 THEN 'Prior memory spans multiple config hashes; compare ideas cautiously.' END) AS warnings
FROM k WHERE b <= 3 OR w <= 3""",
)
def mem_1(spark, sf):
    out = rn.research_memory(registry(spark, sf))
    return fx.rounded(out, "test_sharpe").withColumns(
        {
            "warnings": F.concat_ws(" ", "warnings"),
            "best_rank": F.col("best_rank").cast("long"),
            "weak_rank": F.col("weak_rank").cast("long"),
        }
    )


@entry(
    "crt_1_critique",
    f"""WITH {COMPARED} SELECT run_id, CASE WHEN test_sharpe >= 0.5 AND test_total_return > 0 AND test_ic_mean > 0 THEN 'accept' ELSE 'reject' END AS verdict,
concat_ws(' ', CASE WHEN test_sharpe <= 0 THEN 'Reject: test Sharpe is non-positive.' WHEN test_sharpe < 0.5 THEN 'Weak: test Sharpe is positive but below a strong research threshold.'
    ELSE 'Promising: test Sharpe clears the initial threshold.' END,
  CASE WHEN test_total_return <= 0 THEN 'Total return is non-positive in the test window.' END,
  CASE WHEN test_ic_mean <= 0 THEN 'Mean IC is non-positive; cross-sectional ranking quality is weak.' END,
  CASE WHEN test_max_drawdown < -0.20 THEN 'Max drawdown is severe for a research candidate.' END,
  CASE WHEN test_average_total_cost > 0.002 THEN 'Average total cost is high enough to threaten deployability.' END) AS reasons FROM compared""",
)
def crt_1(spark, sf):
    return rn.critique(rn.comparison_rows(parsed(spark, sf))).withColumn("reasons", F.concat_ws(" ", "reasons"))


_INT_TAIL = """, test AS (SELECT * FROM metrics WHERE split = 'test')
SELECT (SELECT name FROM test WHERE family IN ('primary', 'baseline') ORDER BY sharpe DESC, place LIMIT 1) AS best_strategy,
  count(*) FILTER (WHERE family = 'stress_test' AND sharpe > 0 AND ic_mean > 0) AS stress_passing, count(*) FILTER (WHERE family = 'stress_test') AS stress_count,
  concat_ws('; ', CASE WHEN avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE family = 'parameter_sensitivity') < 0.5 THEN 'parameter sensitivity is fragile' END,
    CASE WHEN (SELECT sharpe FROM test WHERE family = 'cost_sensitivity' ORDER BY place DESC LIMIT 1) <= 0 THEN 'high-cost sensitivity erases positive Sharpe' END) AS weak_points,
  (SELECT avg(CASE WHEN ic_mean > 0 THEN 1.0 ELSE 0.0 END) >= 0.67 AND avg(sharpe) > 0 FROM windows WHERE variant = 'primary/agent_signal') AS walk_forward_stable
FROM test"""


_BOOTSTRAP = run_sql(bt.AGENT, bt._BOOT)
_INT_TAIL = _INT_TAIL.replace(
    "concat_ws('; ', CASE",
    f"""concat_ws('; ', CASE WHEN (SELECT positive_sharpe_probability FROM ({_BOOTSTRAP}) b) < 0.6 THEN 'bootstrap Sharpe confidence is weak' END,
    CASE WHEN (SELECT positive_ic_probability FROM ({_BOOTSTRAP}) b) < 0.6 THEN 'bootstrap IC confidence is weak' END, CASE""",
)


@entry("int_1_interpretation", run_sql(bt.FULL, _INT_TAIL))
def int_1(spark, sf):
    r = bt.run(spark, sf, bt.FULL)
    windows = r.walk_forward.where(F.col("variant") == "primary/agent_signal")
    out = rn.interpretation(r.metrics.where(F.col("split") == "test"), windows, r.bootstrap)
    return out.withColumn("weak_points", F.concat_ws("; ", "weak_points"))


# ---------------------------------------------------------------- sinks


@entry(
    "snk_1_experiment_rows",
    run_sql(
        bt.BASELINES,
        """, rows AS (SELECT 'demo' AS experiment, 'market' AS source, name AS strategy, 'full_sample' AS "window",
    max(sharpe) FILTER (WHERE split = 'test') AS test_sharpe, max(total_return) FILTER (WHERE split = 'test') AS test_total_return, max(sharpe) FILTER (WHERE split = 'full') AS full_sharpe
  FROM metrics WHERE family IN ('primary', 'baseline') GROUP BY name
  UNION ALL SELECT 'demo', 'market', split_part(variant, '/', 2), "window", sharpe, total_return, NULL FROM windows)
SELECT experiment, source, strategy, "window", round(test_sharpe, 6) AS test_sharpe, round(test_total_return, 6) AS test_total_return, round(full_sharpe, 6) AS full_sharpe FROM rows
UNION ALL SELECT 'older', 'market', 'agent_signal', 'full_sample', 1.5, NULL, NULL""",
    ),
)
def snk_1(spark, sf):
    """Experiment table after replacing the rows of this experiment; older experiments stay."""
    r = bt.run(spark, sf, bt.BASELINES)
    rows = sinks.experiment_rows(r.metrics, r.walk_forward, {"experiment": "demo", "source": "market"})
    stale = rows.where(F.col("window") == "full_sample").select("experiment", "source", "strategy", "window", F.lit(9.0).alias("test_sharpe"))
    older = stale.where(F.col("strategy") == "agent_signal").withColumns(
        {"experiment": F.lit("older"), "test_sharpe": F.lit(1.5)}
    )
    out = sinks.replace_by_key(stale.unionByName(older), rows)
    names = ["test_sharpe", "test_total_return", "full_sharpe"]
    return fx.rounded(out, *names).select("experiment", "source", "strategy", "window", *names)


@entry(
    "snk_3_registry_export",
    f"WITH {REGISTRY} SELECT run_id, generated_at, round(test_sharpe, 6) AS test_sharpe FROM registry ORDER BY generated_at DESC, run_id DESC LIMIT 1000",
)
def snk_3(spark, sf):
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    sinks.export_registry(registry(spark, sf), path, 1000)
    back = spark.read.schema("run_id string, generated_at string, test_sharpe double").json(path)
    return fx.rounded(back, "test_sharpe")
