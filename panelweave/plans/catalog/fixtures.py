"""The engine's inputs as views over the driver's tables, in Spark and as SQL text.

Each view exists twice: a DataFrame function and a common table expression with the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.panel import calendar, with_date_index

# Fixed settings of the catalogue's research run.
POSITIVE = ["momentum_20d", "momentum_60d"]
NEGATIVE = ["volatility_20d", "drawdown_20d"]
HOLD = 5
REBALANCE = 5
QUANTILE = 0.2
HOLDING_GRID = [3, 5, 10]
QUANTILE_GRID = [0.15, 0.2, 0.3]
MULTIPLIERS = [0.5, 1.0, 2.0]
NOTIONALS = [10.0, 100.0, 1000.0, 10000.0]
NOTIONAL = 1000.0
BASE_BPS, SPREAD_BPS, IMPACT, FEE_BPS = 5.0, 2.0, 0.10, 75.0
TRAIN, HOLDOUT, WINDOWS, MIN_TRAIN = 0.7, 0.15, 3, 0.4
START, END = "1995-01-01", "2002-12-31"
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# ---------------------------------------------------------------- B1 / B2 market panel


def market(spark: SparkSession, sf: str, price: Column | None = None) -> DataFrame:
    """Weekly bars per supplier group; the number of symbols grows with the supplier table."""
    groups = table(spark, sf, "supplier").select(
        F.greatest(F.lit(10), F.floor(F.count(F.lit(1)) / 5)).cast("long").alias("k")
    )
    p = F.round(100.0 * (1.0 + F.col("l_discount") - F.col("l_tax")), 6) if price is None else price
    bars = (
        table(spark, sf, "lineitem")
        .select(
            F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
            (F.col("l_suppkey") % groups.scalar()).alias("symbol_no"),
            p.alias("p"),
            "l_quantity",
        )
        .groupBy("date", "symbol_no")
        .agg(
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.round(F.avg("p"), 6).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    return bars.select(
        "date",
        symbol_name(F.col("symbol_no")).alias("symbol"),
        "symbol_no",
        F.round((F.col("high") + F.col("low")) / 2.0, 6).alias("open"),
        "high",
        "low",
        "close",
        # A split in some symbols, so that raw and adjusted prices give different results.
        F.when((F.col("symbol_no") % 3 == 1) & (F.col("date") < F.lit("1998-06-01").cast("date")), F.col("close") / 2.0)
        .otherwise(F.col("close"))
        .alias("adj_close"),
        "volume",
    )


def symbol_name(number: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(number.cast("string"), 6, "0"))


def market_raw(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf, F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6))


def dates(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar straight from the ship dates (same dates as the bars, a one-column scan)."""
    weeks = table(spark, sf, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
    return calendar(weeks)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed market panel; its holes are those of the table."""
    return with_date_index(market(spark, sf), dates(spark, sf))


_BARS = """(SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         l_suppkey % (SELECT greatest(10, count(*) // 5) FROM supplier) AS symbol_no,
         max(p) AS high, min(p) AS low, round(avg(p), 6) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, {price} AS p FROM lineitem) t GROUP BY 1, 2)"""


def _market_cte(name: str, price: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT date, concat('S', lpad(CAST(symbol_no AS VARCHAR), 6, '0')) AS symbol, symbol_no,
         round((high + low) / 2.0, 6) AS open, high, low, close,
         CASE WHEN symbol_no % 3 = 1 AND date < DATE '1998-06-01' THEN close / 2.0 ELSE close END AS adj_close, volume
  FROM {_BARS.format(price=price)} b)"""


MARKET = _market_cte("market", "round(100.0 * (1.0 + l_discount - l_tax), 6)")
MARKET_RAW = _market_cte("market_raw", "round(l_extendedprice / l_quantity, 6)")
PANEL = f"""{MARKET},
dates AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS di FROM (SELECT DISTINCT date FROM market)),
panel AS MATERIALIZED (SELECT m.*, di FROM market m JOIN dates USING (date))"""

GRID = f"""{PANEL},
syms AS (SELECT DISTINCT symbol, symbol_no FROM panel),
grid AS MATERIALIZED (
  SELECT d.date, d.di, s.symbol, s.symbol_no, p.adj_close AS c, p.volume AS v
  FROM dates d CROSS JOIN syms s LEFT JOIN panel p ON p.date = d.date AND p.symbol = s.symbol)"""


def full_sql(n: int, value: str, agg: str) -> str:
    return f"CASE WHEN count({value}) OVER w{n} = {n} THEN {agg} OVER w{n} END"


_FACTOR_SQL = {
    **{f"momentum_{n}d": f"c / nullif(c{n}, 0) - 1" for n in (5, 10, 20, 60)},
    **{f"reversal_{n}d": f"-(c / nullif(c{n}, 0) - 1)" for n in (5, 10, 20)},
    **{f"volatility_{n}d": full_sql(n, "r", "stddev_samp(r)") for n in (10, 20, 60)},
    "downside_volatility_20d": full_sql(20, "down", "stddev_samp(down)"),
    **{f"volume_spike_{n}d": f"v / nullif({full_sql(n, 'v', 'avg(v)')}, 0) - 1" for n in (5, 20)},
    "dollar_volume_20d": f"ln(1 + {full_sql(20, 'dv', 'avg(dv)')})",
    "price_volume_corr_20d": full_sql(20, "pr", "corr(pr, pv)"),
    "rsi_14": (
        f"100 - 100 / (1 + ({full_sql(14, 'gain', 'avg(gain)')}) / "
        f"nullif({full_sql(14, 'loss', 'avg(loss)')}, 0))"
    ),
    **{f"moving_average_gap_{n}d": f"c / nullif({full_sql(n, 'c', 'avg(c)')}, 0) - 1" for n in (20, 50)},
    "return_zscore_20d": f"(r - {full_sql(20, 'r', 'avg(r)')}) / nullif({full_sql(20, 'r', 'stddev_samp(r)')}, 0)",
    **{f"drawdown_{n}d": f"c / nullif({full_sql(n, 'c', 'max(c)')}, 0) - 1" for n in (20, 60)},
    "amihud_illiquidity_20d": full_sql(20, "illiq", "avg(illiq)"),
}

FACTORS = f"""{GRID},
lagged AS (
  SELECT *, {", ".join(f"lag(c, {n}) OVER w AS c{n}" for n in (1, 5, 10, 20, 60))}, lag(v) OVER w AS v1, c * v AS dv
  FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY di)),
changes AS (
  SELECT *, c / nullif(c1, 0) - 1 AS r, v / nullif(v1, 0) - 1 AS vr,
         CASE WHEN c1 IS NOT NULL AND c IS NOT NULL THEN greatest(c - c1, 0) END AS gain,
         CASE WHEN c1 IS NOT NULL AND c IS NOT NULL THEN greatest(c1 - c, 0) END AS loss
  FROM lagged),
blocks AS MATERIALIZED (
  SELECT *, CASE WHEN r < 0 THEN r END AS down, CASE WHEN vr IS NOT NULL THEN r END AS pr,
         CASE WHEN r IS NOT NULL THEN vr END AS pv, abs(r) / nullif(dv, 0) AS illiq FROM changes),
factors AS MATERIALIZED (
  SELECT date, di, symbol, symbol_no, c,
         {", ".join(f"{e} AS {n}" for n, e in _FACTOR_SQL.items())},
         {", ".join(f"lead(c, {h}) OVER w / nullif(c, 0) - 1 AS fwd_{h}" for h in HOLDING_GRID)},
         avg(dv) OVER w20 AS adv
  FROM blocks
  WINDOW w AS (PARTITION BY symbol ORDER BY di),
         {", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY di ROWS {n - 1} PRECEDING)" for n in (5, 10, 14, 20, 50, 60))})"""


# ---------------------------------------------------------------- B3 sectors, B4 membership, B5 borrow


def sector(number: Column) -> Column:
    return F.concat(F.lit("G"), (number % 4).cast("string"))


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Raw interval rows as TEXT, like a membership file: null ends, late starts, a symbol with two spells."""
    symbols = market(spark, sf).groupBy("symbol", "symbol_no").agg(F.min("date").alias("first"))
    n = F.col("symbol_no")
    spells = F.array(
        F.struct(
            F.when(n % 7 == 3, F.lit("1997-01-01")).otherwise(F.col("first").cast("string")).alias("start"),
            F.when(n % 5 == 0, F.lit("1999-12-31")).alias("end"),
        ),
        F.when(n == 5, F.struct(F.lit("2000-07-01").alias("start"), F.lit("2001-03-31").alias("end"))),
    )
    return symbols.select(F.lower("symbol").alias("symbol"), F.explode(F.array_compact(spells)).alias("s")).select(
        "symbol", "s.start", "s.end"
    )


MEMBERSHIP = """firsts AS (SELECT symbol, symbol_no, min(date) AS first FROM market GROUP BY 1, 2),
membership AS (
  SELECT lower(symbol) AS symbol,
         CASE WHEN symbol_no % 7 = 3 THEN DATE '1997-01-01' ELSE first END AS "start",
         CASE WHEN symbol_no % 5 = 0 THEN DATE '1999-12-31' END AS "end"
  FROM firsts
  UNION ALL SELECT lower(symbol), DATE '2000-07-01', DATE '2001-03-31' FROM firsts WHERE symbol_no = 5)"""


def borrow(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Locate rows as TEXT, like a locate file, with mixed spellings of true and false; ``rows`` is the indexed panel if it is at hand."""
    if rows is None:
        rows = with_date_index(market(spark, sf).select("date", "symbol", "symbol_no"), dates(spark, sf))
    n, i = F.col("symbol_no"), F.col("date_idx")
    yes = F.when(i % 3 == 0, "true").when(i % 3 == 1, "Yes").otherwise("1")
    no = F.when(i % 3 == 0, "false").when(i % 3 == 1, "No").otherwise("0")
    return rows.select(
        F.col("date").cast("string").alias("date"),
        F.lower("symbol").alias("symbol"),
        F.when((n + i) % 11 == 0, no).otherwise(yes).alias("shortable"),
        F.when(n % 5 == 0, 850.0).otherwise(125.0).alias("borrow_fee_bps"),
        F.when((n + i) % 7 == 0, 0.0).otherwise(1e6).alias("available_quantity"),
    )


BORROW = """dates_all AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS di FROM (SELECT DISTINCT date FROM market)),
borrow AS MATERIALIZED (
  SELECT date, symbol, symbol_no, di,
         (symbol_no + di) % 11 <> 0 AND (symbol_no + di) % 7 <> 0 AS shortable,
         CASE WHEN symbol_no % 5 = 0 THEN 850.0 ELSE 125.0 END::DOUBLE AS borrow_fee_bps
  FROM market JOIN dates_all USING (date))"""


# ---------------------------------------------------------------- B6 runs


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("run-"), F.lpad(k.cast("string"), 9, "0")).alias("run_id"),
        k.alias("key"),
        F.col("c_mktsegment").alias("experiment"),
        F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")).cast("string"), F.lit("T00:00:00Z")).alias(
            "generated_at"
        ),
        F.when(k % 50 != 0, F.concat(F.lit("fam-"), F.col("c_nationkey").cast("string"))).alias("family_id"),
        F.concat(F.lit("hyp-"), (k % 7).cast("string")).alias("hypothesis_id"),
        F.concat(F.lit("cand-"), (k % 13).cast("string")).alias("candidate_id"),
        F.when(k % 4 == 0, "pre_registered").when(k % 4 == 1, "generated").when(k % 4 == 2, "exploratory").alias(
            "selection_policy"
        ),
        F.sha2(F.col("c_mktsegment"), 256).alias("config_sha256"),
        F.concat(F.lit("commit-"), (k % 6).cast("string")).alias("code_commit"),
        F.concat(F.lit("branch-"), (k % 2).cast("string")).alias("code_branch"),
        (k % 10 == 0).alias("code_dirty"),
        F.when(k % 3 == 0, "synthetic").when(k % 3 == 1, "vendor_snapshot").otherwise("csv_snapshot").alias("source"),
        F.when(k % 3 == 1, "vendor-1").when(k % 3 == 2, "csv-1").alias("dataset_id"),
        F.when(k % 5 == 0, "REJECT").when(k % 5 == 1, "REVIEW").otherwise("PROMOTE").alias("verdict"),
        F.when(k % 97 != 0, F.col("c_acctbal") / 5000.0).alias("sharpe"),
        (F.col("c_acctbal") / 50000.0).alias("total_return"),
        ((k % 21 - 10) / 200.0).alias("ic_mean"),
        (-(k % 40) / 100.0).alias("max_drawdown"),
        ((k % 9) / 2000.0).alias("average_total_cost"),
        ((k % 11) / 10.0).alias("average_turnover"),
        (((k * 7919) % 10007) / 10007.0).alias("p_value"),
        (k % 17 != 3).alias("has_agent"),
        (k % 8).alias("symbol_count"),
    )


RUNS = """runs AS MATERIALIZED (
  SELECT concat('run-', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS run_id, c_custkey AS key, c_mktsegment AS experiment,
         concat(strftime(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d'), 'T00:00:00Z') AS generated_at,
         CASE WHEN c_custkey % 50 <> 0 THEN concat('fam-', c_nationkey) END AS family_id,
         concat('hyp-', c_custkey % 7) AS hypothesis_id, concat('cand-', c_custkey % 13) AS candidate_id,
         CASE c_custkey % 4 WHEN 0 THEN 'pre_registered' WHEN 1 THEN 'generated' WHEN 2 THEN 'exploratory' END AS selection_policy,
         sha256(c_mktsegment) AS config_sha256, concat('commit-', c_custkey % 6) AS code_commit,
         concat('branch-', c_custkey % 2) AS code_branch, c_custkey % 10 = 0 AS code_dirty,
         CASE c_custkey % 3 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'vendor_snapshot' ELSE 'csv_snapshot' END AS source,
         CASE c_custkey % 3 WHEN 1 THEN 'vendor-1' WHEN 2 THEN 'csv-1' END AS dataset_id,
         CASE c_custkey % 5 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'REVIEW' ELSE 'PROMOTE' END AS verdict,
         CASE WHEN c_custkey % 97 <> 0 THEN c_acctbal / 5000.0 END AS sharpe, c_acctbal / 50000.0 AS total_return,
         (c_custkey % 21 - 10) / 200.0 AS ic_mean, -(c_custkey % 40) / 100.0 AS max_drawdown,
         (c_custkey % 9) / 2000.0 AS average_total_cost, (c_custkey % 11) / 10.0 AS average_turnover,
         ((c_custkey * 7919) % 10007) / 10007.0 AS p_value, c_custkey % 17 <> 3 AS has_agent, c_custkey % 8 AS symbol_count
  FROM customer)"""


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One nested manifest struct per run, with the optional parts missing by rule."""
    candidate = F.struct(
        F.lit("agent_signal").alias("name"),
        F.lit("primary").alias("family"),
        (F.col("ic_mean") / 2).alias("holdout_ic_mean"),
        (F.coalesce(F.col("sharpe"), F.lit(0.0)) / 2).alias("holdout_sharpe"),
        (F.col("total_return") / 2).alias("holdout_total_return"),
        F.when(F.col("key") % 23 != 5, F.col("p_value")).alias("p_value"),
        F.lit(0.5).alias("q_value"),
    )
    other = candidate.withField("name", F.lit("momentum_20d_only")).withField("family", F.lit("baseline"))
    validity = F.struct(
        F.col("verdict").alias("verdict"),
        F.when(F.col("has_agent"), F.array(other, candidate)).otherwise(F.array(other)).alias("candidates"),
    )
    test = ["sharpe", "total_return", "ic_mean", "max_drawdown", "average_total_cost", "average_turnover"]
    on_top = F.col("key") % 2 == 0
    return run_rows(spark, sf).select(
        "run_id",
        "experiment",
        "generated_at",
        F.when(F.col("family_id").isNotNull(), F.struct("family_id", "hypothesis_id", "candidate_id", "selection_policy")).alias(
            "experiment_family"
        ),
        F.struct(F.col("config_sha256").alias("sha256")).alias("config"),
        F.struct(F.col("code_commit").alias("commit"), F.col("code_branch").alias("branch"), F.col("code_dirty").alias("dirty")).alias(
            "code"
        ),
        F.struct(
            "source",
            F.col("dataset_id").alias("snapshot_dataset_id"),
            F.transform(
                F.filter(F.sequence(F.lit(0), F.col("symbol_count").cast("int")), lambda x: x < F.col("symbol_count")),
                lambda x: F.concat(F.lit("S"), x.cast("string")),
            ).alias("observed_symbols"),
        ).alias("data"),
        F.struct(
            F.concat(F.lit("reports/"), F.col("run_id"), F.lit(".md")).alias("report_path"),
            F.lit("results/experiments.csv").alias("experiments_path"),
            F.concat(F.lit("runs/"), F.col("run_id"), F.lit("/manifest.json")).alias("manifest_path"),
        ).alias("artifacts"),
        F.struct(
            F.struct(*test).alias("test"),
            F.struct(
                (F.coalesce(F.col("sharpe"), F.lit(0.0)) / 3).alias("sharpe"),
                (F.col("total_return") / 3).alias("total_return"),
                (F.col("ic_mean") / 3).alias("ic_mean"),
            ).alias("holdout"),
            F.struct((F.col("sharpe") * 2).alias("sharpe"), (F.col("total_return") * 2).alias("total_return")).alias("full"),
            F.when(~on_top, validity).alias("research_validity"),
        ).alias("metrics"),
        F.when(on_top, validity).alias("research_validity"),
    )


# ---------------------------------------------------------------- B7 events


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"view": "claimed", "click": "lease_renewed", "purchase": "completed", "error": "retry_scheduled", "signup": "enqueued"}
    mapping = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("event_sequence"),
        mapping[F.col("event_type")].alias("event_type"),
        F.col("ts").alias("created_at"),
        "value",
    )


JOB_EVENTS = """job_events AS (
  SELECT user_id AS job_id, event_id AS event_sequence,
         CASE event_type WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'lease_renewed' WHEN 'purchase' THEN 'completed'
              WHEN 'error' THEN 'retry_scheduled' WHEN 'signup' THEN 'enqueued' END AS event_type, ts AS created_at, value
  FROM events)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Job table from orders: one job per order with attempts, lease and heartbeat columns."""
    k = F.col("o_orderkey")
    base = F.timestamp_seconds(F.lit(1706659200) - (k % 100000) * 7)  # backwards from 2024-01-31 00:00:00 UTC
    at = lambda seconds: F.timestamp_seconds(F.lit(1706659200) + seconds)
    status = (
        F.when(k % 6 == 0, "queued")
        .when(k % 6 == 1, "retryable")
        .when(k % 6 == 2, "completed")
        .when(k % 6 == 3, "dead_letter")
        .otherwise("running")
    )
    running = k % 6 >= 4
    return table(spark, sf, "orders").select(
        F.concat(F.lit("job-"), F.lpad(k.cast("string"), 9, "0")).alias("job_id"),
        k.alias("seq"),
        status.alias("status"),
        base.alias("created_at"),
        at((k % 41) * 30 - 600).alias("available_at"),
        (k % 4).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.when(running, at((k % 37) * 60 - 600)).alias("lease_expires_at"),
        F.when(running & (k % 19 != 0), at(-(k % 53) * 20)).alias("last_heartbeat_at"),
    )


JOBS = """jobs AS (
  SELECT concat('job-', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS job_id, o_orderkey AS seq,
         CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'retryable' WHEN 2 THEN 'completed' WHEN 3 THEN 'dead_letter'
              ELSE 'running' END AS status,
         TIMESTAMP '2024-01-31 00:00:00' - to_seconds((o_orderkey % 100000) * 7) AS created_at,
         TIMESTAMP '2024-01-31 00:00:00' + to_seconds((o_orderkey % 41) * 30 - 600) AS available_at,
         o_orderkey % 4 AS attempts, 3 AS max_attempts,
         CASE WHEN o_orderkey % 6 >= 4 THEN TIMESTAMP '2024-01-31 00:00:00' + to_seconds((o_orderkey % 37) * 60 - 600) END AS lease_expires_at,
         CASE WHEN o_orderkey % 6 >= 4 AND o_orderkey % 19 <> 0
              THEN TIMESTAMP '2024-01-31 00:00:00' - to_seconds((o_orderkey % 53) * 20) END AS last_heartbeat_at
  FROM orders)"""
