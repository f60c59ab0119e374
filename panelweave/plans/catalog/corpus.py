"""Catalogue: texts, ideas, event logs, ledgers and hash chains."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelweave.functions import text as tx
from panelweave.operators import events as ev
from panelweave.operators import ideas as idea
from panelweave.operators.factors import FACTOR_NAMES
from panelweave.operators.provenance import content_hash
from panelweave.plans.catalog import fixtures as fx
from panelweave.session import shared_folder, stage

ENTRIES: dict[str, tuple] = {}


def entry(key: str, sql: str | None = None):
    def register(fn):
        ENTRIES[key] = (fn, sql)
        return fn

    return register


# Keyword table of the catalogue: the fixed finance words plus words the corpus has.
KEYWORDS = {
    **{f: list(w) for f, w in tx.FACTOR_KEYWORDS.items()},
    "rsi_14": ["worthless", "ention"],
    "return_zscore_20d": ["tion", "ment"],
    "volatility_20d": [*tx.FACTOR_KEYWORDS["volatility_20d"], "heon"],
    "drawdown_20d": [*tx.FACTOR_KEYWORDS["drawdown_20d"], "queau"],
}


def texts(spark, sf):
    """Documents with one sentence appended that states a holding period (whole texts)."""
    doc = F.col("doc_id")
    tail = F.concat(F.lit(" Holding period is "), (doc % 300).cast("string"), F.lit(" trading days."))
    monthly = F.when(doc % 5 == 0, F.lit(" Rebalanced monthly."))
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.when(doc % 3 == 0, tail).otherwise(F.coalesce(monthly, F.lit("")))).alias("text"),
        F.concat(F.lit("  Paper #"), doc.cast("string"), F.lit(": "), F.col("lang"), F.lit("!")).alias("title"),
    )


_ASCII_SPACE = r"\s+"
TEXTS = r"""texts AS MATERIALIZED (
  SELECT doc_id, concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(' Holding period is ', doc_id % 300, ' trading days.')
    WHEN doc_id % 5 = 0 THEN ' Rebalanced monthly.' ELSE '' END) AS text, concat('  Paper #', doc_id, ': ', lang, '!') AS title FROM documents),
cleaned AS MATERIALIZED (SELECT *, trim(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS c FROM texts),
lowered AS MATERIALIZED (SELECT *, lower(c) AS l FROM cleaned)"""


def _any(words: list[str], column: str = "l") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _tags_sql() -> str:
    risky = _any(tx.RISK_WORDS)
    plus, minus = [], []
    for factor, words in KEYWORDS.items():
        hit = _any(words)
        if factor in tx.RISK_FACTORS:
            minus.append(f"CASE WHEN {hit} AND {risky} THEN '{factor}' END")
            plus.append(f"CASE WHEN {hit} AND NOT {risky} THEN '{factor}' END")
        else:
            plus.append(f"CASE WHEN {hit} THEN '{factor}' END")
    return f"""{TEXTS},
tags0 AS (SELECT *, list_sort([x FOR x IN [{', '.join(plus)}] IF x IS NOT NULL]) AS p0, list_sort([x FOR x IN [{', '.join(minus)}] IF x IS NOT NULL]) AS n0 FROM lowered),
tags AS MATERIALIZED (SELECT *, CASE WHEN len(p0) > 0 THEN p0 ELSE ['momentum_20d'] END AS p,
  CASE WHEN len(n0) = 0 AND {_any(["risk", "volatility"])} THEN ['volatility_20d'] ELSE n0 END AS n FROM tags0)"""


def tagged(spark, sf):
    return idea.extract_ideas(texts(spark, sf), "title", keywords=KEYWORDS)


@entry("txt_1_clean", f"WITH {TEXTS} SELECT doc_id, length(c) AS n, md5(c) AS digest FROM cleaned")
def txt_1(spark, sf):
    out = texts(spark, sf).select("doc_id", tx.clean(F.col("text")).alias("c"))
    return out.select("doc_id", F.length("c").cast("long").alias("n"), F.md5(F.col("c")).alias("digest"))


@entry("txt_2_factor_tags", f"WITH {_tags_sql()} SELECT doc_id, array_to_string(p, ',') AS positive, array_to_string(n, ',') AS negative FROM tags")
def txt_2(spark, sf):
    return tagged(spark, sf).select(
        "doc_id",
        F.array_join("positive_factors", ",").alias("positive"),
        F.array_join("negative_factors", ",").alias("negative"),
    )


_PERIOD = r"""period AS (SELECT doc_id, regexp_extract(l, '(\d+)[-\s]*(day|trading day)', 1) AS d, l FROM lowered),
periods AS MATERIALIZED (SELECT doc_id, CAST(CASE WHEN length(ltrim(d, '0')) BETWEEN 1 AND 3 AND CAST(ltrim(d, '0') AS INTEGER) BETWEEN 1 AND 252 THEN CAST(ltrim(d, '0') AS INTEGER)
  WHEN contains(l, 'monthly') THEN 21 ELSE 5 END AS BIGINT) AS holding_period FROM period)"""


@entry("txt_3_holding_period", f"WITH {TEXTS}, {_PERIOD} SELECT doc_id, holding_period FROM periods")
def txt_3(spark, sf):
    lowered = F.lower(tx.clean(F.col("text")))
    return texts(spark, sf).select("doc_id", tx.holding_period(lowered).cast("long").alias("holding_period"))


@entry(
    "txt_4_hypothesis",
    f"""WITH {_tags_sql()}, {_PERIOD}, s AS (SELECT t.*, holding_period, trim(split_part(c, '.', 1)) AS first FROM tags t JOIN periods USING (doc_id))
SELECT doc_id, CASE WHEN length(first) >= 40 THEN left(first, 280) ELSE concat('Assets with stronger ', array_to_string(p, ', '), ' and weaker ',
  CASE WHEN len(n) > 0 THEN array_to_string(n, ', ') ELSE 'risk' END, ' should outperform over the next ', holding_period, ' trading days.') END AS hypothesis FROM s""",
)
def txt_4(spark, sf):
    return tagged(spark, sf).select("doc_id", "hypothesis")


@entry(
    "txt_5_slug",
    f"""WITH {TEXTS} SELECT doc_id, coalesce(nullif(lower(trim(regexp_replace(title, '[^a-zA-Z0-9]+', '_', 'g'), '_')), ''), 'paper_alpha_template') AS slug FROM texts""",
)
def txt_5(spark, sf):
    return texts(spark, sf).select("doc_id", tx.slug(F.col("title")).alias("slug"))


_CONCEPTS = [*tx.UNSUPPORTED_CONCEPTS, "tion", "avec"]


@entry(
    "txt_6_concepts_and_bias",
    f"""WITH {TEXTS} SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in _CONCEPTS)}) AS concepts,
contains(lower(text), 'future') OR contains(lower(text), 'next quarter') AS lookahead, CASE WHEN length(trim(text)) < 500 THEN 0.55 ELSE 0.70 END::DOUBLE AS confidence,
length(c) < 200 AS short_text FROM cleaned""",
)
def txt_6(spark, sf):
    low = F.lower("text")
    return texts(spark, sf).select(
        "doc_id",
        F.array_join(tx.concept_hits(low, _CONCEPTS), ",").alias("concepts"),
        tx.contains_any(low, tx.LOOKAHEAD_PHRASES).alias("lookahead"),
        tx.extraction_confidence(F.col("text")).alias("confidence"),
        (F.length(tx.clean(F.col("text"))) < 200).alias("short_text"),
    )


# ---------------------------------------------------------------- ideas

_POOL = [*FACTOR_NAMES[:9], "made_up_factor"]


def ideas(spark, sf):
    k = F.col("p_partkey")
    pool = F.array(*[F.lit(n) for n in _POOL])
    at = lambda i: F.element_at(pool, (i % 10 + 1).cast("int"))
    none = F.array().cast("array<string>")
    return fx.table(spark, sf, "part").select(
        k.alias("idea_id"),
        (k % 100).alias("batch_id"),
        F.when(k % 11 == 0, F.col("p_name")).otherwise(F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("name"),
        F.when(k % 41 != 0, F.col("p_type")).alias("hypothesis"),
        F.when(k % 13 == 0, none).otherwise(F.array(at(k), at(k * 3 + 1))).alias("positive_factors"),
        F.when(k % 13 == 0, none).when(k % 7 == 0, F.array(at(k))).otherwise(F.array(at(k * 7 + 2))).alias("negative_factors"),
        (F.col("p_size") * 6).alias("holding_period"),
        ((k % 60) / 100.0).alias("quantile"),
        F.lit("because").alias("rationale"),
        F.when(k % 29 == 0, 1.5).otherwise((k % 10) / 10.0).alias("confidence"),
        F.when(k % 17 == 0, none).otherwise(F.array(F.lit("check"))).alias("warnings"),
    )


_LIST = "[" + ", ".join(f"'{n}'" for n in _POOL) + "]"
IDEAS = f"""ideas AS MATERIALIZED (
  SELECT p_partkey AS idea_id, p_partkey % 100 AS batch_id, CASE WHEN p_partkey % 11 = 0 THEN p_name ELSE lower(replace(p_name, ' ', '_')) END AS name,
    CASE WHEN p_partkey % 41 <> 0 THEN p_type END AS hypothesis,
    CASE WHEN p_partkey % 13 = 0 THEN []::VARCHAR[] ELSE [{_LIST}[p_partkey % 10 + 1], {_LIST}[(p_partkey * 3 + 1) % 10 + 1]] END AS pf,
    CASE WHEN p_partkey % 13 = 0 THEN []::VARCHAR[] WHEN p_partkey % 7 = 0 THEN [{_LIST}[p_partkey % 10 + 1]] ELSE [{_LIST}[(p_partkey * 7 + 2) % 10 + 1]] END AS nf,
    p_size * 6 AS holding_period, (p_partkey % 60) / 100.0 AS quantile, CASE WHEN p_partkey % 29 = 0 THEN 1.5 ELSE (p_partkey % 10) / 10.0 END AS confidence,
    p_partkey % 17 <> 0 AS has_warnings FROM part)"""


@entry(
    "ide_1_validate_ideas",
    f"""WITH {IDEAS}, e AS (SELECT idea_id, concat_ws(' | ', CASE WHEN NOT regexp_full_match(name, '[a-z0-9_]+') THEN 'name must be lowercase snake_case' END,
  CASE WHEN list_contains(pf, 'made_up_factor') OR list_contains(nf, 'made_up_factor') THEN 'unknown factors: [''made_up_factor'']' END,
  CASE WHEN list_has_any(pf, nf) THEN 'positive_factors and negative_factors must not overlap' END, CASE WHEN len(pf) + len(nf) = 0 THEN 'at least one factor is required' END,
  CASE WHEN holding_period NOT BETWEEN 1 AND 252 THEN 'holding_period must be between 1 and 252' END,
  CASE WHEN NOT (quantile > 0 AND quantile < 0.5) THEN 'quantile must be between 0 and 0.5' END) AS errors, confidence < 0.5 AS low FROM ideas)
SELECT idea_id, errors, errors = '' AS valid, CASE WHEN low THEN 'idea confidence is low; require human review before running' ELSE '' END AS warnings FROM e""",
)
def ide_1(spark, sf):
    out = idea.validate_ideas(ideas(spark, sf))
    return out.select(
        "idea_id", F.concat_ws(" | ", "errors").alias("errors"), "valid", F.concat_ws(" | ", "warnings_found").alias("warnings")
    )


@entry(
    "ide_3_batch_checks",
    f"""WITH {IDEAS}, b AS (SELECT batch_id, 20 AS requested, count(*) AS returned, bool_and(name IS NOT NULL AND hypothesis IS NOT NULL) AS schema_fields_present,
  NOT bool_or(list_contains(pf, 'made_up_factor') OR list_contains(nf, 'made_up_factor')) AS allowed_factor_boundary, count(DISTINCT name) = count(name) AS unique_names,
  bool_and(has_warnings) AS warnings_present, bool_and(confidence BETWEEN 0 AND 1) AS confidence_range FROM ideas GROUP BY batch_id)
SELECT batch_id, requested, returned, returned >= requested AS requested_idea_count, schema_fields_present, allowed_factor_boundary, unique_names, warnings_present, confidence_range,
  CASE WHEN returned >= requested AND schema_fields_present AND allowed_factor_boundary AND unique_names AND warnings_present AND confidence_range THEN 'passed' ELSE 'failed' END AS status FROM b""",
)
def ide_3(spark, sf):
    return idea.batch_checks(ideas(spark, sf), F.lit(20))


@entry(
    "ide_3_unknown_factors",
    f"WITH {IDEAS} SELECT DISTINCT batch_id, 'made_up_factor' AS factor FROM ideas WHERE list_contains(pf, 'made_up_factor') OR list_contains(nf, 'made_up_factor')",
)
def ide_3_unknown(spark, sf):
    return idea.unknown_factors(ideas(spark, sf))


@entry(
    "ide_4_request_costs",
    """WITH t AS (SELECT conv_id, coalesce(sum(ceil(length(text) / 4.0)) FILTER (WHERE role <> 'assistant'), 0)::BIGINT AS input_tokens,
  coalesce(sum(ceil(length(text) / 4.0)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS output_tokens, count(*) FILTER (WHERE role = 'user') AS planned_requests
  FROM conversations GROUP BY conv_id), c AS (SELECT *, input_tokens / 1000.0::DOUBLE * 0.5 + output_tokens / 1000.0::DOUBLE * 1.5 AS cost FROM t)
SELECT conv_id, input_tokens, output_tokens, planned_requests, round(cost, 8) AS estimated_cost_usd,
  concat_ws('; ', CASE WHEN planned_requests > 2 THEN concat('planned_requests=', planned_requests, ' exceeds max_requests=2') END,
    CASE WHEN cost > 0.2 THEN printf('estimated_cost_usd=%.8f exceeds max_estimated_cost_usd=0.20000000', cost) END) AS rejections,
  CASE WHEN planned_requests > 2 OR cost > 0.2 THEN 'rejected' ELSE 'passed' END AS status FROM c""",
)
def ide_4(spark, sf):
    out = idea.request_costs(fx.table(spark, sf, "conversations"), ["conv_id"], 0.5, 1.5, 2, 0.2)
    return fx.rounded(out, "estimated_cost_usd", digits=8).withColumn("rejections", F.concat_ws("; ", "rejections"))


# ---------------------------------------------------------------- event logs


def audit(spark, sf):
    """Review audit log from the event stream: entity, sequence and the status it moved to."""
    kinds = {"view": "draft", "click": "approved", "purchase": "ran", "error": "rejected", "signup": "approved"}
    mapping = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("entity"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("created_at"),
        mapping[F.col("event_type")].alias("to_status"),
    )


AUDIT = """audit AS (SELECT user_id AS entity, event_id AS seq, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'draft' WHEN 'purchase' THEN 'ran' WHEN 'error' THEN 'rejected' ELSE 'approved' END AS to_status FROM events),
now_status AS (SELECT entity, to_status AS status, created_at AS updated_at FROM audit QUALIFY row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, seq DESC) = 1)"""


@entry(
    "evt_1_status_counts",
    f"""WITH {AUDIT} SELECT s.status, count(n.entity) AS records FROM (VALUES ('approved'), ('archived'), ('draft'), ('ran'), ('rejected')) s(status)
LEFT JOIN now_status n ON n.status = s.status GROUP BY 1""",
)
def evt_1(spark, sf):
    return ev.status_counts(ev.current_status(audit(spark, sf)))


@entry("evt_2_current_status", f"WITH {AUDIT} SELECT entity, status, updated_at FROM now_status")
def evt_2(spark, sf):
    return ev.current_status(audit(spark, sf))


@entry(
    "evt_3_review_gate",
    f"""WITH {AUDIT} SELECT c_custkey AS entity FROM customer WHERE c_custkey NOT IN (SELECT entity FROM now_status WHERE status = 'approved')""",
)
def evt_3(spark, sf):
    wanted = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))
    return ev.blocked(wanted, ev.current_status(audit(spark, sf)))


@entry(
    "evt_4_job_history",
    f"WITH {fx.JOB_EVENTS} SELECT job_id, event_sequence, event_type, created_at FROM job_events WHERE job_id = 17",
)
def evt_4(spark, sf):
    return ev.job_history(fx.job_events(spark, sf), 17).select("job_id", "event_sequence", "event_type", "created_at")


_STALE = f"""stale AS (SELECT *, CASE WHEN lease_expires_at <= TIMESTAMP '{fx.NOW}' THEN 'lease_expired' WHEN last_heartbeat_at IS NULL THEN 'missing_heartbeat' ELSE 'heartbeat_stale' END AS stale_reason,
  epoch(TIMESTAMP '{fx.NOW}') - epoch(last_heartbeat_at) AS heartbeat_age_seconds FROM jobs WHERE status = 'running' AND (lease_expires_at <= TIMESTAMP '{fx.NOW}'
  OR last_heartbeat_at IS NULL OR last_heartbeat_at <= TIMESTAMP '{fx.NOW}' - INTERVAL 300 SECOND))"""


@entry("evt_5_stale_jobs", f"WITH {fx.JOBS}, {_STALE} SELECT job_id, stale_reason, heartbeat_age_seconds::DOUBLE AS heartbeat_age_seconds FROM stale")
def evt_5(spark, sf):
    return ev.stale_jobs(fx.jobs(spark, sf), fx.NOW, limit=None).select("job_id", "stale_reason", "heartbeat_age_seconds")


@entry(
    "evt_6_claimable_jobs",
    f"""WITH {fx.JOBS} SELECT job_id, status, attempts FROM jobs WHERE attempts < max_attempts AND ((status IN ('queued', 'retryable') AND available_at <= TIMESTAMP '{fx.NOW}')
OR (status = 'running' AND lease_expires_at <= TIMESTAMP '{fx.NOW}')) ORDER BY created_at, seq LIMIT 50""",
)
def evt_6(spark, sf):
    out = ev.claimable_jobs(fx.jobs(spark, sf), fx.NOW, 50)
    return out.select("job_id", "status", F.col("attempts").cast("long").alias("attempts"))


@entry(
    "evt_6_exhausted_jobs",
    f"WITH {fx.JOBS} SELECT job_id FROM jobs WHERE status = 'running' AND lease_expires_at <= TIMESTAMP '{fx.NOW}' AND attempts >= max_attempts",
)
def evt_6_exhausted(spark, sf):
    return ev.exhausted_jobs(fx.jobs(spark, sf), fx.NOW).select("job_id")


@entry("evt_7_newest_jobs", f"WITH {fx.JOBS} SELECT job_id, status, created_at FROM jobs ORDER BY created_at DESC, seq DESC LIMIT 100")
def evt_7(spark, sf):
    return ev.newest_jobs(fx.jobs(spark, sf), 100).select("job_id", "status", "created_at")


# ---------------------------------------------------------------- promotion ledger


def ledger(spark, sf):
    """Ledger events from the event stream: pairs of recommendation and decision with broken rules by rule."""
    e = F.col("event_id")
    pair = F.floor(e / 2)
    rec = F.when(e % 64 == 2, pair - 1).otherwise(pair)
    first = e % 2 == 0
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return fx.table(spark, sf, "events").select(
        e.alias("seq"),
        text("rec-", rec).alias("recommendation_id"),
        F.when(e % 101 == 7, "noted").when(first, "recommended").otherwise("decided").alias("event_type"),
        F.when(e % 92 == 3, F.lit("x")).otherwise(text("fam-", rec % 5)).alias("family_id"),
        F.when(e % 92 == 5, F.lit("x")).otherwise(text("hyp-", rec % 7)).alias("hypothesis_id"),
        F.when(e % 92 == 7, F.lit("x")).otherwise(text("cand-", rec % 9)).alias("candidate_id"),
        F.when(e % 92 == 9, F.lit("x")).otherwise(text("run-", rec)).alias("run_id"),
        F.when(e % 90 == 12, " ").when(first | (e % 20 == 1), text("r", rec % 3)).otherwise(text("o", rec % 3)).alias("actor"),
        F.when(e % 50 == 10, "viewer").when(first, "researcher").otherwise("operator").alias("role"),
        F.when(e % 30 == 0, "open").when(first, "pending").when(e % 28 == 1, "maybe").when(e % 4 == 1, "approved").otherwise("rejected").alias("status"),
        F.when((e % 92 == 11) | (e % 128 == 2), F.lit("x")).otherwise(text("evidence/", rec)).alias("evidence_path"),
        F.when(e % 44 == 1, F.lit("x")).otherwise(F.sha2(rec.cast("string"), 256)).alias("evidence_sha256"),
        F.col("ts").alias("created_at"),
    )


LEDGER = """ledger0 AS (SELECT *, CASE WHEN event_id % 64 = 2 THEN event_id // 2 - 1 ELSE event_id // 2 END AS r FROM events),
ledger AS MATERIALIZED (
  SELECT event_id AS seq, concat('rec-', r) AS recommendation_id, CASE WHEN event_id % 101 = 7 THEN 'noted' WHEN event_id % 2 = 0 THEN 'recommended' ELSE 'decided' END AS event_type,
    CASE WHEN event_id % 92 = 3 THEN 'x' ELSE concat('fam-', r % 5) END AS family_id, CASE WHEN event_id % 92 = 5 THEN 'x' ELSE concat('hyp-', r % 7) END AS hypothesis_id,
    CASE WHEN event_id % 92 = 7 THEN 'x' ELSE concat('cand-', r % 9) END AS candidate_id, CASE WHEN event_id % 92 = 9 THEN 'x' ELSE concat('run-', r) END AS run_id,
    CASE WHEN event_id % 90 = 12 THEN ' ' WHEN event_id % 2 = 0 OR event_id % 20 = 1 THEN concat('r', r % 3) ELSE concat('o', r % 3) END AS actor,
    CASE WHEN event_id % 50 = 10 THEN 'viewer' WHEN event_id % 2 = 0 THEN 'researcher' ELSE 'operator' END AS role,
    CASE WHEN event_id % 30 = 0 THEN 'open' WHEN event_id % 2 = 0 THEN 'pending' WHEN event_id % 28 = 1 THEN 'maybe' WHEN event_id % 4 = 1 THEN 'approved' ELSE 'rejected' END AS status,
    CASE WHEN event_id % 92 = 11 OR event_id % 128 = 2 THEN 'x' ELSE concat('evidence/', r) END AS evidence_path, CASE WHEN event_id % 44 = 1 THEN 'x' ELSE sha256(CAST(r AS VARCHAR)) END AS evidence_sha256, ts AS created_at FROM ledger0)"""


@entry(
    "evt_8_promotion_records",
    f"""WITH {LEDGER}, r AS (SELECT * FROM ledger WHERE event_type = 'recommended' QUALIFY row_number() OVER (PARTITION BY recommendation_id ORDER BY seq DESC) = 1),
d AS (SELECT * FROM ledger WHERE event_type = 'decided' QUALIFY row_number() OVER (PARTITION BY recommendation_id ORDER BY seq DESC) = 1)
SELECT r.recommendation_id, r.family_id, r.run_id, coalesce(d.status, 'pending') AS status, r.actor AS researcher_actor, d.actor AS operator_actor,
  r.created_at AS recommended_at, d.created_at AS decided_at FROM r LEFT JOIN d USING (recommendation_id)""",
)
def evt_8(spark, sf):
    return ev.fold_promotions(ledger(spark, sf)).select(
        "recommendation_id", "family_id", "run_id", "status", "researcher_actor", "operator_actor", "recommended_at", "decided_at"
    )


@entry(
    "evt_8_promotion_counts",
    f"""WITH {LEDGER}, r AS (SELECT DISTINCT recommendation_id FROM ledger WHERE event_type = 'recommended'),
d AS (SELECT * FROM ledger WHERE event_type = 'decided' QUALIFY row_number() OVER (PARTITION BY recommendation_id ORDER BY seq DESC) = 1),
s AS (SELECT coalesce(status, 'pending') AS status FROM r LEFT JOIN d USING (recommendation_id))
SELECT v.status, count(s.status) AS records FROM (VALUES ('approved'), ('pending'), ('rejected')) v(status) LEFT JOIN s ON s.status = v.status GROUP BY 1""",
)
def evt_8_counts(spark, sf):
    return ev.status_counts(ev.fold_promotions(ledger(spark, sf)), ["approved", "pending", "rejected"])


def _rule(condition: str, text: str) -> str:
    return f"SELECT seq, '{text}' AS error FROM x WHERE coalesce({condition}, false)"


_FIELDS = ["family_id", "hypothesis_id", "candidate_id", "run_id", "evidence_path", "evidence_sha256"]
_LEDGER_RULES = [
    ("trim(actor) = ''", "actor must not be empty"),
    ("rec AND recs_before > 0", "duplicates recommendation id"),
    ("rec AND pairs_before > 0", "duplicates family/run recommendation"),
    ("rec AND role <> 'researcher'", "recommendation requires researcher role"),
    ("rec AND status <> 'pending'", "recommendation status must be pending"),
    ("dec AND g IS NULL", "references missing recommendation"),
    ("dec AND g IS NOT NULL AND decs_before > 0", "duplicates decision"),
    ("dec AND g IS NOT NULL AND role <> 'operator'", "decision requires operator role"),
    ("dec AND actor = g.actor", "decision actor must differ from recommendation actor"),
    ("dec AND g IS NOT NULL AND status NOT IN ('approved', 'rejected')", "decision status is invalid"),
    *[(f"dec AND {f} <> g.{f}", f"{f} does not match recommendation") for f in _FIELDS],
    ("NOT rec AND NOT dec", "has unknown event_type"),
]


@entry(
    "evt_9_ledger_errors",
    f"""WITH {LEDGER}, l AS (SELECT *, event_type = 'recommended' AS rec, event_type = 'decided' AS dec,
  last_value(CASE WHEN event_type = 'recommended' THEN {{'actor': actor, {", ".join(f"'{f}': {f}" for f in _FIELDS)}}} END IGNORE NULLS) OVER w AS g,
  count(*) FILTER (WHERE event_type = 'recommended') OVER w AS recs_before,
  count(*) FILTER (WHERE event_type = 'recommended') OVER (PARTITION BY family_id, run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pairs_before
  FROM ledger WINDOW w AS (PARTITION BY recommendation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS MATERIALIZED (SELECT *, count(*) FILTER (WHERE dec AND g IS NOT NULL) OVER (PARTITION BY recommendation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decs_before FROM l)
"""
    + "\nUNION ALL ".join(_rule(c, t) for c, t in _LEDGER_RULES),
)
def evt_9(spark, sf):
    return ev.ledger_errors(ledger(spark, sf))


# ---------------------------------------------------------------- hash chains


def chain_records(spark, sf):
    """Export packs of 256 records: pack number, position in the pack and the payload text."""
    e = F.col("event_id")
    payload = F.concat_ws("|", e.cast("string"), "event_type", F.round(F.col("value") * 100).cast("long").cast("string"))
    return fx.table(spark, sf, "events").select(F.floor(e / 256).alias("chain"), (e % 256).alias("index"), payload.alias("payload"))


CHAIN_RECORDS = """records AS MATERIALIZED (SELECT event_id // 256 AS chain, event_id % 256 AS "index",
  concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS payload FROM events)"""

_CHAINS = f"""WITH RECURSIVE {CHAIN_RECORDS},
links AS (
  SELECT chain, "index", NULL::VARCHAR AS previous_hash, sha256(concat(sha256(payload), '|')) AS chain_hash FROM records WHERE "index" = 0
  UNION ALL
  SELECT r.chain, r."index", l.chain_hash, sha256(concat(sha256(r.payload), '|', l.chain_hash)) FROM links l JOIN records r ON r.chain = l.chain AND r."index" = l."index" + 1)"""


@entry("chn_2_build_chains", f"{_CHAINS} SELECT chain, \"index\", previous_hash, chain_hash FROM links")
def chn_2(spark, sf):
    return ev.build_chains(chain_records(spark, sf)).select("chain", "index", "previous_hash", "chain_hash")


@entry(
    "chn_1_verify_chains",
    f"""{_CHAINS}, stored AS (SELECT chain, "index", CASE WHEN (chain * 256 + "index") % 97 = 5 THEN 'forged' ELSE previous_hash END AS previous_hash, chain_hash FROM links
  WHERE (chain * 256 + "index") % 509 <> 8),
j AS (SELECT coalesce(s.chain, r.chain) AS chain, coalesce(s."index", r."index") AS "index", s.previous_hash, s.chain_hash, b.chain_hash AS before, b.chain IS NOT NULL AS has, r.payload
  FROM stored s FULL JOIN records r ON r.chain = s.chain AND r."index" = s."index" LEFT JOIN stored b ON b.chain = s.chain AND b."index" + 1 = s."index")
SELECT chain, "index", 'record has no chain row' AS error FROM j WHERE chain_hash IS NULL
UNION ALL SELECT chain, "index", 'hash chain index mismatch' FROM j WHERE chain_hash IS NOT NULL AND NOT has AND "index" <> 0
UNION ALL SELECT chain, "index", 'hash chain previous hash mismatch' FROM j WHERE chain_hash IS NOT NULL AND previous_hash IS DISTINCT FROM before
UNION ALL SELECT chain, "index", 'hash chain hash mismatch' FROM j WHERE chain_hash <> sha256(concat(sha256(payload), '|', coalesce(previous_hash, '')))""",
)
def chn_1(spark, sf):
    """Chains with forged and missing links, checked against their records."""
    place = F.col("chain") * 256 + F.col("index")
    links = stage(ev.build_chains(chain_records(spark, sf)), "chains").where(place % 509 != 8)
    forged = links.withColumn("previous_hash", F.when(place % 97 == 5, "forged").otherwise(F.col("previous_hash")))
    return ev.verify_chains(forged, chain_records(spark, sf))


# Names of the registry's evidence fields, as its documents have them.
_EVIDENCE_SQL = """concat('{"candidate_id":"', candidate_id, '","experiment_family_id":"', experiment_family_id, '","holdout_ic_p_value":', holdout_ic_p_value, ',"holdout_ic_q_value":', coalesce(CAST(holdout_ic_q_value AS VARCHAR), 'null'),
  ',"hypothesis_id":"', hypothesis_id, '","run_id":"', run_id, '","run_validity_verdict":"', run_validity_verdict, '","selection_policy":"', selection_policy, '"}')"""


def registry_records(spark, sf):
    """Export packs of 128 runs: place, run, its record's text and its evidence, from the event stream."""
    e = F.col("event_id")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return fx.table(spark, sf, "events").select(
        F.floor(e / 128).alias("chain"),
        (e % 128).alias("index"),
        text("run-", e).alias("run_id"),
        F.concat_ws("|", e.cast("string"), "event_type", F.round(F.col("value") * 100).cast("long").cast("string")).alias("record"),
        text("fam-", e % 11).alias("experiment_family_id"),
        text("hyp-", e % 7).alias("hypothesis_id"),
        text("cand-", e % 5).alias("candidate_id"),
        F.when(e % 3 == 0, "pre_registered").otherwise("exploratory").alias("selection_policy"),
        F.when(e % 4 == 1, "PASS").otherwise("REJECT").alias("run_validity_verdict"),
        ((e % 199 + 1) / 200.0).cast("double").alias("holdout_ic_p_value"),
        F.when(e % 6 != 2, 0.5).alias("holdout_ic_q_value"),
    )


_REGISTRY = f"""WITH RECURSIVE records AS MATERIALIZED (
  SELECT event_id // 128 AS chain, event_id % 128 AS "index", concat('run-', event_id) AS run_id,
    concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS record, concat('fam-', event_id % 11) AS experiment_family_id,
    concat('hyp-', event_id % 7) AS hypothesis_id, concat('cand-', event_id % 5) AS candidate_id, CASE WHEN event_id % 3 = 0 THEN 'pre_registered' ELSE 'exploratory' END AS selection_policy,
    CASE WHEN event_id % 4 = 1 THEN 'PASS' ELSE 'REJECT' END AS run_validity_verdict, CAST((event_id % 199 + 1) / 200.0 AS DOUBLE) AS holdout_ic_p_value,
    CASE WHEN event_id % 6 <> 2 THEN CAST(0.5 AS DOUBLE) END AS holdout_ic_q_value FROM events),
texts AS MATERIALIZED (SELECT chain, "index", run_id, sha256(record) AS record_sha256, {_EVIDENCE_SQL} AS family_evidence,
  concat('{{"family_evidence":', {_EVIDENCE_SQL}, ',"index":', "index", ',"previous_chain_hash":') AS before, concat(',"record_sha256":"', sha256(record), '","run_id":"', run_id, '"}}') AS after FROM records),
links AS (
  SELECT *, NULL::VARCHAR AS previous_chain_hash, sha256(concat(before, 'null', after)) AS chain_hash FROM texts WHERE "index" = 0
  UNION ALL
  SELECT t.*, l.chain_hash, sha256(concat(t.before, '"', l.chain_hash, '"', t.after)) FROM links l JOIN texts t ON t.chain = l.chain AND t."index" = l."index" + 1)"""


@entry("chn_2_registry_chain", f'{_REGISTRY} SELECT chain, "index", run_id, record_sha256, family_evidence, previous_chain_hash, chain_hash FROM links')
def chn_2_registry(spark, sf):
    return ev.registry_chain(registry_records(spark, sf))


def tampered_registry(spark, sf):
    """Chains, records and manifest with altered records, runs, evidence and hashes, cut ends, and lost and repeated rows."""
    links = stage(ev.registry_chain(registry_records(spark, sf)), "registry-chains")
    place = F.col("chain") * 128 + F.col("index")
    stored = links.where(place % 509 != 8).withColumns(
        {
            "run_id": F.when(place % 211 == 3, "run-x").otherwise(F.col("run_id")),
            "family_evidence": F.when(place % 307 == 4, "{}").otherwise(F.col("family_evidence")),
            "previous_chain_hash": F.when(place % 401 == 5, "forged").otherwise(F.col("previous_chain_hash")),
        }
    )
    stored = stored.unionByName(stored.where(place % 601 == 6))
    records = registry_records(spark, sf).where(place % 701 != 7)
    records = records.withColumn("record", F.when(place % 101 == 2, "altered").otherwise(F.col("record")))
    heads = ev.chain_heads(links).where("chain % 17 <> 3").withColumn("final_hash", F.when(F.col("chain") % 19 == 4, "forged").otherwise(F.col("final_hash")))
    return stored, records, heads


@entry(
    "chn_1_verify_registry",
    f"""{_REGISTRY}, stored0 AS (SELECT chain, "index", chain * 128 + "index" AS place, CASE WHEN (chain * 128 + "index") % 211 = 3 THEN 'run-x' ELSE run_id END AS run_id, record_sha256,
    CASE WHEN (chain * 128 + "index") % 307 = 4 THEN '{{}}' ELSE family_evidence END AS family_evidence,
    CASE WHEN (chain * 128 + "index") % 401 = 5 THEN 'forged' ELSE previous_chain_hash END AS previous_chain_hash, chain_hash FROM links WHERE (chain * 128 + "index") % 509 <> 8),
kept AS (SELECT chain, "index", run_id, CASE WHEN (chain * 128 + "index") % 101 = 2 THEN sha256('altered') ELSE sha256(record) END AS record_sha256 FROM records WHERE (chain * 128 + "index") % 701 <> 7),
j AS MATERIALIZED (SELECT coalesce(s.chain, k.chain) AS chain, coalesce(s."index", k."index") AS "index", s.place, s.chain IS NOT NULL AS linked, k.chain IS NOT NULL AS listed, s.run_id, k.run_id AS own_run, s.record_sha256, k.record_sha256 AS own_record,
    s.previous_chain_hash, s.chain_hash, b.chain_hash AS hash_before, b.chain IS NOT NULL AS has,
    sha256(concat('{{"family_evidence":', s.family_evidence, ',"index":', s."index", ',"previous_chain_hash":', CASE WHEN s.previous_chain_hash IS NULL THEN 'null' ELSE concat('"', s.previous_chain_hash, '"') END,
      ',"record_sha256":"', s.record_sha256, '","run_id":"', s.run_id, '"}}')) AS own_hash
  FROM stored0 s FULL JOIN kept k ON k.chain = s.chain AND k."index" = s."index" LEFT JOIN stored0 b ON b.chain = s.chain AND b."index" + 1 = s."index"),
counted AS (SELECT chain, count(*) + count(*) FILTER (WHERE place % 601 = 6) AS n, arg_max(chain_hash, "index") AS final FROM stored0 GROUP BY 1),
heads AS (SELECT chain, count(*) AS n, CASE WHEN chain % 19 = 4 THEN 'forged' ELSE arg_max(chain_hash, "index") END AS final FROM links WHERE chain % 17 <> 3 GROUP BY 1)
SELECT chain, "index", 'chain row is repeated' AS error FROM j WHERE place % 601 = 6
UNION ALL SELECT chain, "index", 'record has no chain row' FROM j WHERE NOT linked
UNION ALL SELECT chain, "index", 'chain row has no record' FROM j WHERE NOT listed
UNION ALL SELECT chain, "index", 'hash chain index mismatch' FROM j WHERE linked AND NOT has AND "index" <> 0
UNION ALL SELECT chain, "index", 'hash chain run_id mismatch' FROM j WHERE linked AND listed AND run_id <> own_run
UNION ALL SELECT chain, "index", 'hash chain record hash mismatch' FROM j WHERE linked AND listed AND record_sha256 <> own_record
UNION ALL SELECT chain, "index", 'hash chain previous hash mismatch' FROM j WHERE linked AND previous_chain_hash IS DISTINCT FROM hash_before
UNION ALL SELECT chain, "index", 'hash chain hash mismatch' FROM j WHERE linked AND chain_hash <> own_hash
UNION ALL SELECT c.chain, NULL, 'chain is not listed' FROM counted c ANTI JOIN heads USING (chain)
UNION ALL SELECT h.chain, NULL, 'chain is missing' FROM heads h ANTI JOIN counted USING (chain)
UNION ALL SELECT c.chain, NULL, 'row count mismatch' FROM counted c JOIN heads h USING (chain) WHERE c.n <> h.n
UNION ALL SELECT c.chain, NULL, 'final hash mismatch' FROM counted c JOIN heads h USING (chain) WHERE c.final <> h.final""",
)
def chn_1_registry(spark, sf):
    stored, records, heads = tampered_registry(spark, sf)
    return ev.verify_registry_chain(stored, records, heads)


@entry(
    "chn_3_inventory",
    """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)) AS line FROM nation),
files AS (SELECT k // 5 AS part, sha256(string_agg(concat(line, chr(10)), '' ORDER BY k)) AS sha FROM n GROUP BY 1)
SELECT part, CASE WHEN part = 1 THEN 'sha256 mismatch' WHEN part = 3 THEN 'unlisted object' WHEN part = 9 THEN 'missing object' END AS problem
FROM (SELECT part FROM files UNION ALL SELECT 9) WHERE problem IS NOT NULL""",
)
def chn_3(spark, sf):
    """Written files against an inventory of the hashes that their texts must have, with a wrong, an unlisted and an absent one."""
    key = F.col("n_nationkey").cast("long")
    line = F.concat_ws("|", key.cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    rows = fx.table(spark, sf, "nation").select(F.floor(key / 5).alias("part"), key.alias("k"), line.alias("value"))
    folder = f"{shared_folder(spark)}/objects-{uuid.uuid4().hex}"
    rows.repartition("part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(folder)
    part = F.regexp_extract("path", r"part=(\d+)/", 1)
    stored = content_hash(spark, f"{folder}/*/*.txt").select(part.alias("path"), "sha256")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: F.concat(x["value"], F.lit("\n"))), "")
    listed = rows.groupBy(F.col("part").cast("string").alias("path")).agg(F.sha2(text, 256).alias("sha256")).where("path <> '3'")
    listed = listed.withColumn("sha256", F.when(F.col("path") == "1", "0").otherwise(F.col("sha256")))
    listed = listed.unionByName(spark.range(1).select(F.lit("9").alias("path"), F.lit("0").alias("sha256")))
    return ev.inventory_differences(stored, listed).select(F.col("path").cast("long").alias("part"), "problem")


def object_rows(spark, sf):
    """The objects of a deployment: a row for each page, in order."""
    page = F.col("page_id").cast("long")
    return fx.table(spark, sf, "pages").select(page.alias("position"), F.concat(F.lit("objects/"), (page - page % 7).cast("string")).alias("path"), F.sha2("url", 256).alias("sha256"))


def inventory_rows(spark, sf):
    """The inventory of the same objects, with rows lost, added, repeated, changed and at other positions."""
    rows, at = object_rows(spark, sf), F.col("position")
    kept = rows.where(((at % 83 >= 14) | (at % 7 != 0)) & ((at % 840 >= 7) | (at < 7)))  # before positions change
    kept = kept.withColumn("sha256", F.when(at % 97 == 5, "0").otherwise(F.col("sha256"))).withColumn("position", F.when(at % 89 == 20, at + 100_000).otherwise(at))
    return kept.unionByName(rows.where(at % 61 == 10)).unionByName(rows.where(at % 211 == 1).withColumn("path", F.concat(F.lit("extra/"), at.cast("string"))))


@entry(
    "chn_3_inventory_rows",
    """WITH m AS (SELECT CAST(page_id AS BIGINT) AS position, concat('objects/', page_id - page_id % 7) AS path, sha256(url) AS sha FROM pages),
i AS (SELECT CASE WHEN position % 89 = 20 THEN position + 100000 ELSE position END AS position, path, CASE WHEN position % 97 = 5 THEN '0' ELSE sha END AS sha
    FROM m WHERE (position % 83 >= 14 OR position % 7 <> 0) AND (position % 840 >= 7 OR position < 7)
  UNION ALL SELECT * FROM m WHERE position % 61 = 10 UNION ALL SELECT position, concat('extra/', position), sha FROM m WHERE position % 211 = 1),
a AS (SELECT path, count(*) AS n, string_agg(sha, ',' ORDER BY sha) AS what, string_agg(concat(position, sha), ',' ORDER BY position, sha) AS places FROM i GROUP BY 1),
b AS (SELECT path, count(*) AS n, string_agg(sha, ',' ORDER BY sha) AS what, string_agg(concat(position, sha), ',' ORDER BY position, sha) AS places FROM m GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'missing from inventory' WHEN b.path IS NULL THEN 'not in manifest' WHEN a.n <> b.n THEN 'repeated'
  WHEN a.what <> b.what THEN 'changed' WHEN a.places <> b.places THEN 'moved' END AS problem FROM a FULL JOIN b ON a.path = b.path) WHERE problem IS NOT NULL""",
)
def chn_3_rows(spark, sf):
    return ev.inventory_row_differences(inventory_rows(spark, sf), object_rows(spark, sf))


# ---------------------------------------------------------------- sealed ledgers

_EVENT_FIELDS = ["actor", "candidate_id", "event_type", "evidence_path", "evidence_sha256", "family_id", "hypothesis_id", "recommendation_id", "role", "run_id", "schema_version", "status"]


def sealed(spark, sf):
    """Ledgers of 128 events, sealed, then forged: fields altered, forged events hashed again, another schema, lost events."""
    events = ledger(spark, sf).drop("created_at").withColumn("schema_version", F.when(F.col("seq") % 71 == 9, "v0").otherwise(ev.EVENT_SCHEMA))
    events = events.withColumns({"ledger": F.floor(F.col("seq") / 128), "place": F.col("seq") % 128}).drop("seq")
    good = stage(ev.seal_events(events, order="place"), "sealed")
    spot = F.col("ledger") * 128 + F.col("place")
    forged = good.where(spot % 509 != 17).withColumn("status", F.when(spot % 53 == 6, "approved!").otherwise(F.col("status")))
    again = ev._event_texts(forged, "ledger", "place").withColumn("event_hash", F.when((spot % 106 == 6) & (F.col("place") > 0), F.sha2(F.concat("__before", F.lit('"'), "previous_hash", F.lit('"'), "__after"), 256)).otherwise(F.col("event_hash")))
    return again.select(good.columns)


def _event_json(status: str) -> tuple[str, str]:
    quoted = lambda name: f"'\"{name}\":\"', " + (status if name == "status" else name) + ", '\"'"
    before = ", ',', ".join(quoted(n) for n in _EVENT_FIELDS if n < "previous_hash")
    after = ", ',', ".join(quoted(n) for n in _EVENT_FIELDS if n > "previous_hash")
    return f"concat('{{', {before}, ',\"previous_hash\":')", f"concat(',', {after}, '}}')"


_BEFORE, _AFTER = _event_json("status")


@entry(
    "evt_9_sealed_ledger",
    f"""WITH RECURSIVE {LEDGER}, versioned AS (SELECT *, CASE WHEN seq % 71 = 9 THEN 'v0' ELSE '{ev.EVENT_SCHEMA}' END AS schema_version FROM ledger),
texts AS MATERIALIZED (SELECT *, seq // 128 AS book, seq % 128 AS place, {_BEFORE} AS before, {_AFTER} AS after FROM versioned),
chain AS (SELECT book, place, NULL::VARCHAR AS previous_hash, sha256(concat(before, 'null', after)) AS event_hash FROM texts WHERE place = 0
  UNION ALL SELECT t.book, t.place, c.event_hash, sha256(concat(t.before, '"', c.event_hash, '"', t.after)) FROM chain c JOIN texts t ON t.book = c.book AND t.place = c.place + 1),
kept AS (SELECT t.* EXCLUDE (status, after), CASE WHEN seq % 53 = 6 THEN 'approved!' ELSE status END AS status, previous_hash, event_hash FROM texts t JOIN chain c ON c.book = t.book AND c.place = t.place WHERE seq % 509 <> 17),
own AS (SELECT *, sha256(concat(before, CASE WHEN previous_hash IS NULL THEN 'null' ELSE concat('"', previous_hash, '"') END, {_AFTER})) AS own_hash FROM kept),
stored AS MATERIALIZED (SELECT *, CASE WHEN seq % 106 = 6 AND place > 0 THEN own_hash ELSE event_hash END AS stored_hash FROM own)
SELECT book AS ledger, place, 'has unsupported schema' AS error FROM stored WHERE schema_version <> '{ev.EVENT_SCHEMA}'
UNION ALL SELECT s.book, s.place, 'previous_hash mismatch' FROM stored s LEFT JOIN stored b ON b.book = s.book AND b.place + 1 = s.place WHERE s.previous_hash IS DISTINCT FROM b.stored_hash
UNION ALL SELECT book, place, 'event_hash mismatch' FROM stored WHERE stored_hash <> own_hash""",
)
def evt_9_sealed(spark, sf):
    return ev.seal_errors(sealed(spark, sf), order="place")


def evidence_files(spark, sf):
    """Evidence documents of the recommendations: some absent, altered, unreadable, without the run, or of another family."""
    told = ledger(spark, sf).where("event_type = 'recommended'").dropDuplicates(["evidence_path"])
    e = F.col("seq")
    rows = F.array(
        F.struct(
            F.when(e % 26 == 4, "other").otherwise(F.col("run_id")).alias("run_id"),
            F.when(e % 34 == 6, "other").otherwise(F.col("family_id")).alias("family_id"),
            "hypothesis_id",
            "candidate_id",
            F.when(e % 38 == 8, "FAMILY_REJECT").otherwise("FAMILY_PROMOTE").alias("family_verdict"),
        )
    )
    text = F.when(e % 46 == 10, "{").otherwise(F.to_json(F.struct(rows.alias("rows"))))
    return told.where(e % 22 != 2).select(F.col("evidence_path").alias("path"), F.when(e % 58 == 12, "0").otherwise(F.col("evidence_sha256")).alias("sha256"), text.alias("text"))


@entry(
    "evt_9_evidence",
    f"""WITH {LEDGER}, told AS (SELECT * FROM ledger WHERE event_type = 'recommended'),
firsts AS (SELECT *, count(*) OVER (PARTITION BY evidence_path) AS times FROM told),
f AS (SELECT evidence_path AS path, CASE WHEN seq % 58 = 12 THEN '0' ELSE evidence_sha256 END AS sha, seq % 46 = 10 AS broken, CASE WHEN seq % 26 = 4 THEN 'other' ELSE run_id END AS run_id,
  CASE WHEN seq % 34 = 6 THEN 'other' ELSE family_id END AS family_id, seq % 38 <> 8 AS promoted, hypothesis_id, candidate_id FROM firsts WHERE times = 1 AND seq % 22 <> 2),
j AS (SELECT t.*, f.path, f.sha, f.broken, f.promoted, f.run_id = t.run_id AS found, f.family_id AS of_family FROM told t JOIN (SELECT DISTINCT seq FROM firsts WHERE times = 1) u USING (seq) LEFT JOIN f ON f.path = t.evidence_path)
SELECT seq, CASE WHEN path IS NULL THEN 'evidence file is missing' WHEN sha <> evidence_sha256 THEN 'evidence sha256 mismatch' WHEN broken THEN 'evidence is invalid JSON'
  WHEN NOT found OR NOT promoted THEN 'evidence does not contain the selected FAMILY_PROMOTE row' WHEN of_family <> family_id THEN 'evidence family_id mismatch' END AS error FROM j WHERE error IS NOT NULL""",
)
def evt_9_evidence(spark, sf):
    """Evidence of recommendations whose file is theirs alone."""
    events = ledger(spark, sf)
    alone = events.where("event_type = 'recommended'").groupBy("evidence_path").count().where("count = 1").select("evidence_path")
    return ev.evidence_errors(events.join(alone, "evidence_path"), evidence_files(spark, sf).join(alone.withColumnRenamed("evidence_path", "path"), "path"))
