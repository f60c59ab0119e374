"""Event logs and ledgers: folds, gates, stale jobs, promotion records and hash chains.

Folds use aggregates with map-side combine (max_by, conditional max), so an entity that produced a
large share of all events is still combined on every mapper.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Review statuses and ledger vocabulary.
REVIEW_STATUSES = ["approved", "archived", "draft", "ran", "rejected"]
DECISIONS = ["approved", "rejected"]
MATCHED_FIELDS = ["family_id", "hypothesis_id", "candidate_id", "run_id", "evidence_path", "evidence_sha256"]


def status_counts(current: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """(status, records) for every status, zero included."""
    listed = REVIEW_STATUSES if statuses is None else statuses
    every = current.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in listed])).alias("status"))
    counted = current.groupBy("status").agg(F.count(F.lit(1)).alias("records"))
    return every.join(counted, "status", "left").select("status", F.coalesce("records", F.lit(0)).alias("records"))


def current_status(audit: DataFrame) -> DataFrame:
    """Last to_status per entity by (created_at, seq)."""
    return audit.groupBy("entity").agg(
        F.max_by("to_status", F.struct("created_at", "seq")).alias("status"), F.max("created_at").alias("updated_at")
    )


def blocked(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requested entities whose current status is not approved (unknown ones are blocked too)."""
    return requests.join(current.where(F.col("status") == "approved"), "entity", "left_anti")


def job_history(events: DataFrame, job_id: object) -> DataFrame:
    return events.where(F.col("job_id") == F.lit(job_id)).orderBy("event_sequence")


def stale_jobs(jobs: DataFrame, now: str, stale_after_seconds: int = 300, limit: int | None = 100) -> DataFrame:
    """Running jobs with an expired lease or an old or missing heartbeat, oldest first."""
    if stale_after_seconds < 1:
        raise ValueError("stale_after_seconds must be positive")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    at = F.lit(now).cast("timestamp")
    lease, beat = F.col("lease_expires_at"), F.col("last_heartbeat_at")
    cutoff = at - F.expr(f"INTERVAL {stale_after_seconds} SECONDS")
    stale = (F.col("status") == "running") & ((lease <= at) | beat.isNull() | (beat <= cutoff))
    age = (F.unix_micros(at) - F.unix_micros(beat)) / 1e6
    found = jobs.where(stale).withColumns(
        {
            "stale_reason": F.when(lease <= at, "lease_expired")
            .when(beat.isNull(), "missing_heartbeat")
            .otherwise("heartbeat_stale"),
            "heartbeat_age_seconds": age,
        }
    )
    return found if limit is None else found.orderBy("created_at", "seq").limit(limit)


def claimable_jobs(jobs: DataFrame, now: str, limit: int = 1) -> DataFrame:
    """Next jobs a worker may take: due queued/retryable ones or expired running ones with attempts left."""
    at = F.lit(now).cast("timestamp")
    due = F.col("status").isin("queued", "retryable") & (F.col("available_at") <= at)
    expired = (F.col("status") == "running") & (F.col("lease_expires_at") <= at)
    return jobs.where((F.col("attempts") < F.col("max_attempts")) & (due | expired)).orderBy("created_at", "seq").limit(limit)


def exhausted_jobs(jobs: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return jobs.where(
        (F.col("status") == "running") & (F.col("lease_expires_at") <= at) & (F.col("attempts") >= F.col("max_attempts"))
    )


def newest_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("seq")).limit(limit)


# ---------------------------------------------------------------- promotion ledger


def fold_promotions(events: DataFrame) -> DataFrame:
    """One record per recommendation: fields of the recommended event, outcome of the decided one."""
    decided, recommended = F.col("event_type") == "decided", F.col("event_type") == "recommended"
    part = lambda kind, name: F.max_by(F.when(kind, F.col(name)), F.when(kind, F.col("seq")))
    fields = ["family_id", "hypothesis_id", "candidate_id", "run_id", "evidence_path", "evidence_sha256"]
    return (
        events.groupBy("recommendation_id")
        .agg(
            F.count_if(recommended).alias("__r"),
            *[part(recommended, f).alias(f) for f in fields],
            F.coalesce(part(decided, "status"), F.lit("pending")).alias("status"),
            part(recommended, "actor").alias("researcher_actor"),
            part(decided, "actor").alias("operator_actor"),
            part(recommended, "created_at").alias("recommended_at"),
            part(decided, "created_at").alias("decided_at"),
        )
        .where(F.col("__r") > 0)
        .drop("__r")
    )


# Sequence numbers of one ordered block of a key.
BLOCK = 65_536


def _latest_before(events: DataFrame, key: str, order: str, value: Column, into: str) -> DataFrame:
    """Add the latest non-null ``value`` of the rows of the same key with a smaller ``order``.

    Rows are ordered inside blocks of the sequence; what the blocks before leave is one row per block.
    """
    rows = events.withColumn("__value", value).withColumn("__block", F.floor(F.col(order) / BLOCK))
    latest = F.last("__value", ignorenulls=True)
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(key, "__block").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__value"))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("__key"), F.col("__block").alias("__of"), latest.over(earlier).alias("__carried"))
    near = rows.withColumn("__near", latest.over(inside))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of"))
    return near.join(carried, on).select(*events.columns, F.coalesce("__near", "__carried").alias(into))


def ledger_errors(events: DataFrame) -> DataFrame:
    """(seq, error) rows for every broken ledger rule.

    A decision is held against the latest recommendation of its id before it, and counts as the id's decision
    only if there is one.  "First of its kind" compares a row with the smallest sequence of its key, found by
    aggregation; the latest recommendation comes from windows over blocks of the sequence (``_latest_before``), so
    a key that is hot is ordered by many tasks.
    """
    c = F.col
    # A missing id is the empty one.
    events = events.withColumn("recommendation_id", F.coalesce("recommendation_id", F.lit("")))
    recommended, decided = c("event_type") == "recommended", c("event_type") == "decided"
    known = ["family_id", "hypothesis_id", "candidate_id", "run_id", "evidence_path", "evidence_sha256", "actor"]
    told = F.when(recommended, F.struct("seq", *[c(k).alias(f"__{k}") for k in known]))
    seen = _latest_before(events, "recommendation_id", "seq", told, "__rec")
    first = seen.groupBy("recommendation_id").agg(
        F.min(F.when(recommended, c("seq"))).alias("__first_rec"),
        F.min(F.when(decided & c("__rec").isNotNull(), c("seq"))).alias("__first_dec"),
    )
    pairs = events.where(recommended).groupBy("family_id", "run_id").agg(F.min("seq").alias("__first_pair"))
    joined = (
        seen.join(first, "recommendation_id", "left")
        .join(
            pairs.select(c("family_id").alias("__pf"), c("run_id").alias("__pr"), "__first_pair"),
            (F.coalesce(c("family_id"), F.lit("")) == F.coalesce(c("__pf"), F.lit("")))
            & (F.coalesce(c("run_id"), F.lit("")) == F.coalesce(c("__pr"), F.lit(""))),
            "left",
        )
    )
    has_earlier = c("__rec").isNotNull()
    # The errors' sentences.
    rules: list[tuple[Column, str]] = [
        (F.coalesce(F.trim("actor"), F.lit("")) == "", "actor must not be empty"),
        (F.coalesce(c("recommendation_id"), F.lit("")) == "", "recommendation_id must not be empty"),
        (recommended & (c("__first_rec") < c("seq")), "duplicates recommendation id"),
        (recommended & (c("__first_pair") < c("seq")), "duplicates family/run recommendation"),
        (recommended & ~c("role").eqNullSafe("researcher"), "recommendation requires researcher role"),
        (recommended & ~c("status").eqNullSafe("pending"), "recommendation status must be pending"),
        (decided & ~has_earlier, "references missing recommendation"),
        (decided & has_earlier & (c("__first_dec") < c("seq")), "duplicates decision"),
        (decided & has_earlier & ~c("role").eqNullSafe("operator"), "decision requires operator role"),
        (decided & has_earlier & c("actor").eqNullSafe(c("__rec.__actor")), "decision actor must differ from recommendation actor"),
        (decided & has_earlier & ~F.coalesce(c("status").isin(DECISIONS), F.lit(False)), "decision status is invalid"),
        *[
            (decided & has_earlier & ~c(f).eqNullSafe(c(f"__rec.__{f}")), f"{f} does not match recommendation")
            for f in MATCHED_FIELDS
        ],
        (~F.coalesce(recommended | decided, F.lit(False)), "has unknown event_type"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in rules]))
    return joined.select("seq", F.explode(found).alias("error"))


# ---------------------------------------------------------------- hash chains


def link_hash(payload: Column, previous: Column) -> Column:
    """SHA-256 of a record's payload digest and the hash before it ('' for the first)."""
    return F.sha2(F.concat_ws("|", F.sha2(payload, 256), F.coalesce(previous, F.lit(""))), 256)


def fold_hashes(rows: DataFrame, chain: str, order: str, before: str, after: str, into: tuple[str, str], quoted: bool = False) -> DataFrame:
    """Add the columns ``into``: the hash before a row in its chain, and its own: SHA-256 of ``before``, that hash and ``after``.

    ``before`` and ``after`` name text columns, which are dropped; null counts as empty. The hash before the first row
    is null and written '', or null where hashes are ``quoted`` as JSON. A chain is sequential by definition: the rows of
    a chain stream through one task in order, which keeps a single hash, so a chain may be of any length; different
    chains run side by side.
    """
    kept = [f for f in rows.schema.fields if f.name not in (before, after)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = object(), None
        for batch in batches:
            previous, own = [], []
            for key, head, tail in zip(*(batch.column(c).to_pylist() for c in (chain, before, after)), strict=True):
                if key != held:
                    held, last = key, None
                previous.append(last)
                link = (f'"{last}"' if last else "null") if quoted else last or ""
                last = hashlib.sha256(f"{head or ''}{link}{tail or ''}".encode()).hexdigest()
                own.append(last)
            columns = [batch.column(f.name) for f in kept]
            yield pa.record_batch([*columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], names=[*(f.name for f in kept), *into])

    schema = T.StructType([*kept, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.StringType())])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, chain).sortWithinPartitions(chain, order).mapInArrow(fold, schema)


def build_chains(records: DataFrame, chain: str = "chain", index: str = "index", payload: str = "payload") -> DataFrame:
    """Chain rows (chain, index, payload, previous_hash, chain_hash), as ``link_hash`` makes them one after another."""
    digest = F.coalesce(F.concat(F.sha2(F.col(payload), 256), F.lit("|")), F.lit(""))
    rows = records.select(chain, F.col(index).cast("long").alias(index), payload, digest.alias("__digest"), F.lit("").alias("__tail"))
    return fold_hashes(rows, chain, index, "__digest", "__tail", ("previous_hash", "chain_hash"))


def _canonical(columns: list[str], **renamed: Column) -> Column:
    """JSON text of columns in order of their names, nulls included, without spaces."""
    values = {c: F.col(c) for c in columns} | renamed
    return F.to_json(F.struct(*[values[c].alias(c) for c in sorted(values)]), {"ignoreNullFields": "false"})


# What a registry chain keeps of each record beside its hash.
EVIDENCE = ["run_id", "experiment_family_id", "hypothesis_id", "candidate_id", "selection_policy", "run_validity_verdict", "holdout_ic_p_value", "holdout_ic_q_value"]


def _registry_texts(rows: DataFrame, index: str) -> DataFrame:
    """Adds the text before and after the previous hash in a row's canonical JSON."""
    before = F.concat(F.lit('{"family_evidence":'), F.col("family_evidence"), F.lit(',"index":'), F.col(index).cast("string"), F.lit(',"previous_chain_hash":'))
    after = F.concat(F.lit(',"record_sha256":"'), F.coalesce("record_sha256", F.lit("")), F.lit('",'), F.substring(F.to_json(F.struct("run_id"), {"ignoreNullFields": "false"}), 2, 1 << 20))
    return rows.withColumns({"__before": before, "__after": after})


def registry_chain(records: DataFrame, chain: str = "chain", index: str = "index") -> DataFrame:
    """(chain, index, run_id, record_sha256, family_evidence, previous_chain_hash, chain_hash) of exported records.

    ``records`` have ``record``, the record's text, and the columns of ``EVIDENCE``. ``family_evidence`` is their JSON;
    a row's hash is that of its JSON with the hash before it.
    """
    rows = records.select(chain, F.col(index).cast("long").alias(index), "run_id", F.sha2("record", 256).alias("record_sha256"), _canonical(EVIDENCE).alias("family_evidence"))
    return fold_hashes(_registry_texts(rows, index), chain, index, "__before", "__after", ("previous_chain_hash", "chain_hash"), quoted=True)


def verify_registry_chain(links: DataFrame, records: DataFrame, heads: DataFrame, chain: str = "chain", index: str = "index") -> DataFrame:
    """(chain, index, error) of every row whose place, run, record, predecessor or hash does not fit, and of whole chains.

    ``heads`` are the (chain, row_count, final_hash) that the manifest keeps. Predecessors are found by an equality join,
    so one very long chain is checked by all tasks. Repeated rows are reported once and checked once.
    """
    keys = [chain, index]
    single = _single_rows(links, chain, index)
    before = single.select(chain, (F.col(index) + 1).alias(index), F.col("chain_hash").alias("__hash"), F.lit(True).alias("__has"))
    content = records.select(chain, F.col(index).cast("long").alias(index), F.col("run_id").alias("__run"), F.sha2("record", 256).alias("__record"), F.lit(True).alias("__kept"))
    joined = _registry_texts(single, index).join(before, keys, "left").join(content, keys, "full")
    linked, kept = F.col("chain_hash").isNotNull(), F.col("__kept").isNotNull()
    previous = F.when(F.col("previous_chain_hash").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), "previous_chain_hash", F.lit('"')))
    # The errors' sentences.
    rules = {
        "chain row is repeated": F.col("__times") > 1,
        "record has no chain row": ~linked,
        "chain row has no record": linked & ~kept,
        "hash chain index mismatch": linked & F.col("__has").isNull() & (F.col(index) != 0),
        "hash chain run_id mismatch": linked & kept & ~F.col("run_id").eqNullSafe(F.col("__run")),
        "hash chain record hash mismatch": linked & kept & ~F.col("record_sha256").eqNullSafe(F.col("__record")),
        "hash chain previous hash mismatch": linked & ~F.col("previous_chain_hash").eqNullSafe(F.col("__hash")),
        "hash chain hash mismatch": linked & ~F.col("chain_hash").eqNullSafe(F.sha2(F.concat("__before", previous, "__after"), 256)),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules.items()]))
    return joined.select(*keys, F.explode(found).alias("error")).unionByName(_head_errors(links, heads, chain, index))


def chain_heads(links: DataFrame, chain: str = "chain", index: str = "index") -> DataFrame:
    """(chain, row_count, final_hash): what a manifest keeps of each chain."""
    return links.groupBy(chain).agg(F.count(F.lit(1)).alias("row_count"), F.max_by("chain_hash", index).alias("final_hash"))


def verify_chains(
    links: DataFrame, records: DataFrame, chain: str = "chain", index: str = "index", heads: DataFrame | None = None
) -> DataFrame:
    """(chain, index, error) for every broken link, repeated row and, against ``heads``, cut or lengthened chain.

    The predecessor comes from an equality join on (chain, index - 1): no ordered window, so one very
    long chain is checked by all tasks.  Errors of a whole chain have a null index.
    """
    found = _link_errors(_single_rows(links, chain, index), records, chain, index)
    if heads is None:
        return found
    return found.unionByName(_head_errors(links, heads, chain, index))


def _head_errors(links: DataFrame, heads: DataFrame, chain: str, index: str) -> DataFrame:
    """Errors of whole chains against what the manifest keeps of them; their index is null."""
    kept = heads.select(F.col(chain), F.col("row_count").alias("__rows"), F.col("final_hash").alias("__final"), F.lit(True).alias("__listed"))
    both = chain_heads(links, chain, index).join(kept, chain, "full")
    errors = F.array(
        F.when(F.col("row_count").isNull(), "chain is missing"),
        F.when(F.col("__listed").isNull(), "chain is not listed"),
        F.when(F.col("row_count") != F.col("__rows"), "row count mismatch"),
        F.when(F.col("final_hash") != F.col("__final"), "final hash mismatch"),
    )
    return both.select(chain, F.lit(None).cast(links.schema[index].dataType).alias(index), F.explode(F.array_compact(errors)).alias("error"))


def _single_rows(links: DataFrame, chain: str, index: str) -> DataFrame:
    """One row for each place of a chain, with ``__times``: how often it occurs."""
    others = [c for c in links.columns if c not in (chain, index)]
    return links.groupBy(chain, index).agg(F.first(F.struct(*others)).alias("__row"), F.count(F.lit(1)).alias("__times")).select(chain, index, "__row.*", "__times")


def _link_errors(links: DataFrame, records: DataFrame, chain: str, index: str) -> DataFrame:
    keys = [chain, index]
    before = links.select(
        F.col(chain), (F.col(index) + 1).alias(index), F.col("chain_hash").alias("__before"), F.lit(True).alias("__has")
    )
    content = records.select(chain, index, F.col("payload").alias("__payload"))
    joined = links.join(before, keys, "left").join(content, keys, "full")
    is_link = F.col("chain_hash").isNotNull()
    errors = F.array(
        F.when(F.col("__times") > 1, "chain row is repeated"),
        F.when(~is_link, "record has no chain row"),
        F.when(is_link & F.col("__payload").isNull(), "chain row has no record"),
        F.when(is_link & F.col("__has").isNull() & (F.col(index) != 0), "hash chain index mismatch"),
        F.when(is_link & ~F.col("previous_hash").eqNullSafe(F.col("__before")), "hash chain previous hash mismatch"),
        F.when(
            is_link
            & F.col("__payload").isNotNull()
            & (F.col("chain_hash") != link_hash(F.col("__payload"), F.col("previous_hash"))),
            "hash chain hash mismatch",
        ),
    )
    return joined.select(chain, index, F.explode(F.array_compact(errors)).alias("error"))


def inventory_differences(objects: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, problem): stored objects against the listed hashes, in both directions."""
    stored = objects.select("path", F.col("sha256").alias("__actual"))
    both = inventory.select("path", F.col("sha256").alias("__listed")).join(stored, "path", "full")
    problem = (
        F.when(F.col("__actual").isNull(), "missing object")
        .when(F.col("__listed").isNull(), "unlisted object")
        .when(F.col("__actual") != F.col("__listed"), "sha256 mismatch")
    )
    return both.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def inventory_row_differences(inventory: DataFrame, manifest: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(path, problem): rows of an inventory against the rows of the manifest, as lists with positions.

    Both have ``position``, ``path`` and the ``fields`` that must agree (by default sha256). Per path: missing from the
    inventory, not in the manifest, listed another number of times, other content, or the same rows at other positions.
    Rows of a path are summed up by order-free digests with map-side combine, so a path may be repeated without limit.
    """
    fields = ["sha256"] if fields is None else fields
    content = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields])

    def side(rows: DataFrame, listed: bool) -> DataFrame:
        return rows.select("path", F.lit(listed).alias("listed"), F.xxhash64(content).alias("what"), F.xxhash64(content, F.col("position").cast("long")).alias("at"))

    low = lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    sums = [
        agg.alias(f"{name}_{who}")
        for who, own in (("a", F.col("listed")), ("b", ~F.col("listed")))
        for name, agg in (
            ("n", F.count_if(own)),
            *((f"{c}_sum", F.coalesce(F.sum(F.when(own, low(c))), F.lit(0))) for c in ("what", "at")),
            *((f"{c}_xor", F.coalesce(F.bit_xor(F.when(own, F.col(c))), F.lit(0))) for c in ("what", "at")),
        )
    ]
    both = side(inventory, True).unionByName(side(manifest, False)).groupBy("path").agg(*sums)
    differs = lambda c: (F.col(f"{c}_sum_a") != F.col(f"{c}_sum_b")) | (F.col(f"{c}_xor_a") != F.col(f"{c}_xor_b"))
    problem = (
        F.when(F.col("n_a") == 0, "missing from inventory")
        .when(F.col("n_b") == 0, "not in manifest")
        .when(F.col("n_a") != F.col("n_b"), "repeated")
        .when(differs("what"), "changed")
        .when(differs("at"), "moved")
    )
    return both.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


# ---------------------------------------------------------------- sealed ledgers

# Fixed value: the version that events bear.
EVENT_SCHEMA = "family_promotion_event_v1"
_SEALS = ["event_hash", "previous_hash"]


def _event_texts(events: DataFrame, ledger: str, order: str) -> DataFrame:
    """Adds the text before and after the previous hash in an event's canonical JSON, which its place is no part of."""
    names = [c for c in events.columns if c not in (ledger, order, *_SEALS)]
    before = _canonical([c for c in names if c < "previous_hash"])
    after = _canonical([c for c in names if c > "previous_hash"])
    cut = F.concat(F.substring(before, F.lit(1), F.char_length(before) - 1), F.lit(',"previous_hash":'))
    return events.withColumns({"__before": cut, "__after": F.concat(F.lit(","), F.substring(after, F.lit(2), F.char_length(after)))})


def seal_events(events: DataFrame, ledger: str = "ledger", order: str = "seq") -> DataFrame:
    """Events with ``previous_hash`` and ``event_hash``: the SHA-256 of the event's JSON, which holds the hash before it."""
    return fold_hashes(_event_texts(events, ledger, order), ledger, order, "__before", "__after", ("previous_hash", "event_hash"), quoted=True)


def seal_errors(events: DataFrame, ledger: str = "ledger", order: str = "seq") -> DataFrame:
    """(ledger, seq, error) of events with another schema version, a hash that is not theirs, or another one's before.

    ``order`` numbers the events of a ledger without gaps. An event forged and hashed again still breaks its successor;
    the predecessor comes from an equality join, so the log is never ordered as a whole.
    """
    before = events.select(F.col(ledger).alias("__ledger"), (F.col(order) + 1).alias("__at"), F.col("event_hash").alias("__hash"))
    on = (F.col(ledger) == F.col("__ledger")) & (F.col(order) == F.col("__at"))
    joined = _event_texts(events, ledger, order).join(before, on, "left")
    previous = F.when(F.col("previous_hash").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), "previous_hash", F.lit('"')))
    # The errors' sentences.
    rules = {
        "has unsupported schema": ~F.col("schema_version").eqNullSafe(F.lit(EVENT_SCHEMA)),
        "previous_hash mismatch": ~F.col("previous_hash").eqNullSafe(F.col("__hash")),
        "event_hash mismatch": ~F.col("event_hash").eqNullSafe(F.sha2(F.concat("__before", previous, "__after"), 256)),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules.items()]))
    return joined.select(ledger, order, F.explode(found).alias("error"))


_EVIDENCE_ROWS = "rows array<struct<run_id string, family_id string, hypothesis_id string, candidate_id string, family_verdict string>>"


def evidence_errors(events: DataFrame, files: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, error) of recommendations whose evidence file is absent, altered, unreadable or does not support them.

    ``files`` have path, sha256 and text, one row for each evidence file.
    """
    told = events.where("event_type = 'recommended'")
    known = files.select(F.col("path").alias("__path"), F.col("sha256").alias("__sha"), F.from_json("text", _EVIDENCE_ROWS).alias("__told"), F.try_parse_json("text").isNull().alias("__broken"))
    joined = told.join(known, F.col("evidence_path") == F.col("__path"), "left")
    own = F.filter(F.coalesce("__told.rows", F.array().cast(_EVIDENCE_ROWS.split(" ", 1)[1])), lambda x: x["run_id"] == F.col("run_id"))
    joined = joined.withColumn("__own", own).withColumn("__row", F.get("__own", 0))
    absent, altered = F.col("__path").isNull(), ~F.col("__sha").eqNullSafe(F.col("evidence_sha256"))
    broken = F.col("__broken")
    unsupported = (F.size("__own") != 1) | ~F.col("__row.family_verdict").eqNullSafe(F.lit("FAMILY_PROMOTE"))
    single = (
        F.when(absent, F.array(F.lit("evidence file is missing")))
        .when(altered, F.array(F.lit("evidence sha256 mismatch")))
        .when(broken, F.array(F.lit("evidence is invalid JSON")))
        .when(unsupported, F.array(F.lit("evidence does not contain the selected FAMILY_PROMOTE row")))
        .otherwise(
            F.array_compact(
                F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__row.{f}")), F.lit(f"evidence {f} mismatch")) for f in ("family_id", "hypothesis_id", "candidate_id", "run_id")])
            )
        )
    )
    return joined.select(order, F.explode(single).alias("error"))
