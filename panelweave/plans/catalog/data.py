"""Catalogue: sources, universe, borrow, provenance and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import borrow as bor
from panelweave.operators import provenance as prv
from panelweave.operators import quality as dq
from panelweave.operators import universe as uni
from panelweave.plans.catalog import fixtures as fx
from panelweave.session import shared_folder
from panelweave.sources import panel as src

ENTRIES: dict[str, tuple] = {}
FROM, TO = "1996-01-01", "2000-12-31"
PANEL_OUT = ["date", "symbol", "open", "high", "low", "close", "adj_close", "volume"]


def entry(key: str, sql: str | None = None):
    def register(fn):
        ENTRIES[key] = (fn, sql)
        return fn

    return register


def requested(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols asked for: every symbol of the market plus some nobody trades."""
    symbols = fx.market(spark, sf).select("symbol").distinct()
    absent = fx.table(spark, sf, "region").select(F.concat(F.lit("MISSING-"), F.upper("r_name")).alias("symbol"))
    return symbols.union(absent)


REQUESTED = "requested AS (SELECT DISTINCT symbol FROM market UNION ALL SELECT concat('MISSING-', upper(r_name)) FROM region)"


# ---------------------------------------------------------------- sources


@entry(
    "src_2_snapshot_scan",
    f"""WITH {fx.MARKET}
SELECT date, symbol, round(open, 6) AS open, high, low, close, adj_close, volume FROM market
WHERE symbol_no % 3 <> 1 AND date BETWEEN DATE '{FROM}' AND DATE '{TO}'""",
)
def src_2(spark, sf):
    """Requested symbols (a table here, so the list may be long) inside the closed date range."""
    wanted = fx.market(spark, sf).where(F.col("symbol_no") % 3 != 1).select("symbol").distinct()
    lower = fx.market(spark, sf).withColumn("symbol", F.lower("symbol"))
    scan = src.select_panel(lower, None, FROM, TO).join(wanted, "symbol", "left_semi")
    return src.clean_panel(scan).select(*PANEL_OUT)


@entry(
    "src_2_csv_snapshot",
    f"""WITH {fx.MARKET}
SELECT date, symbol, open, high, low, close, adj_close, volume FROM market
WHERE symbol IN ('S000001', 'S000004', 'S000007') AND date BETWEEN DATE '{FROM}' AND DATE '{TO}'""",
)
def src_2_csv(spark, sf):
    """Round trip through a CSV snapshot written by Spark, scanned with the fixed schema."""
    import uuid

    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    fx.market(spark, sf).select(*PANEL_OUT).write.option("header", True).csv(path)
    return src.read_snapshot(spark, path, ["s000001", "S000004", "S000007"], FROM, TO)


def dirty(spark, sf):
    """Market panel with infinities and nulls injected by rule on the weekly index."""
    rows = src.with_date_index(fx.market(spark, sf), fx.dates(spark, sf))
    spot = F.col("symbol_no") * 31 + F.col("date_idx")
    return rows.withColumns(
        {
            "high": F.when(spot % 101 == 5, F.lit(float("inf"))).otherwise(F.col("high")),
            "low": F.when(spot % 103 == 6, F.lit(None)).otherwise(F.col("low")),
            "volume": F.when(spot % 107 == 7, F.lit(float("nan"))).otherwise(F.col("volume")),
        }
    )


@entry(
    "src_3_clean_panel",
    f"""WITH {fx.MARKET}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS di FROM (SELECT DISTINCT date FROM market))
SELECT date, symbol, open, high, low, close, adj_close, volume FROM market JOIN d USING (date)
WHERE (symbol_no * 31 + di) % 101 <> 5 AND (symbol_no * 31 + di) % 103 <> 6 AND (symbol_no * 31 + di) % 107 <> 7""",
)
def src_3(spark, sf):
    return src.clean_panel(dirty(spark, sf)).select(*PANEL_OUT)


def vendor(spark, sf):
    names = {v: k for k, v in src.VENDOR_COLUMNS.items()}
    gone = F.col("symbol_no") % 9 == 4
    rows = fx.market(spark, sf)
    return rows.select(
        F.col("date").alias("Date"),
        F.col("symbol").alias("Symbol"),
        *[F.when(~gone, F.col(c)).alias(names[c]) for c in src.VALUE_COLUMNS],
    )


@entry(
    "src_4_vendor_reshape",
    f"WITH {fx.MARKET} SELECT date, symbol, open, high, low, close, adj_close, volume FROM market WHERE symbol_no % 9 <> 4",
)
def src_4(spark, sf):
    return src.vendor_panel(vendor(spark, sf)).select(*PANEL_OUT)


@entry(
    "src_4_vendor_missing",
    f"WITH {fx.MARKET}, {REQUESTED} SELECT symbol FROM requested WHERE symbol NOT IN (SELECT symbol FROM market WHERE symbol_no % 9 <> 4)",
)
def src_4_missing(spark, sf):
    return src.vendor_missing_symbols(vendor(spark, sf), requested(spark, sf))


def _sql_int(*parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def _sql_uniform(*parts: str) -> str:
    return f"(({_sql_int(*parts)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_normal(*parts: str) -> str:
    u, v = _sql_uniform(*parts, "'u'"), _sql_uniform(*parts, "'v'")
    return f"(sqrt(-2.0 * ln({u})) * cos(2.0 * 3.141592653589793::DOUBLE * {v}))"


def _between(low: float, high: float, tag: str) -> str:
    seed, name = "'42'", f"'{tag}'"
    return f"({low}::DOUBLE + {high - low}::DOUBLE * {_sql_uniform(seed, 'symbol', name)})"


_K, _D = "'42'", "strftime(date, '%Y-%m-%d')"


@entry(
    "src_5_generate_panel",
    f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '2023-01-02', DATE '2023-12-29', INTERVAL 1 DAY)) AS DATE) AS date),
grid AS (SELECT upper(replace(s_name, '#', '_')) AS symbol, date FROM supplier, days WHERE isodow(date) < 6),
path AS (
  SELECT *, 100.0 * exp(sum(0.00015 + 0.00018 * {sql_normal(_K, "symbol", "'drift'")}
      + {_between(0.7, 1.3, "beta")} * (0.00025 + 0.009 * {sql_normal(_K, "'market'", _D)})
      + {_between(0.010, 0.024, "sigma")} * {sql_normal(_K, "symbol", _D, "'noise'")})
      OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close,
      abs(0.004 + 0.002 * {sql_normal(_K, "symbol", _D, "'band'")}) AS band
  FROM grid),
opened AS (SELECT *, close * (1 + 0.003 * {sql_normal(_K, "symbol", _D, "'open'")}) AS open FROM path)
SELECT date, symbol, round(open, 4) AS open, round(greatest(open, close) * (1 + band), 4) AS high,
       round(least(open, close) * (1 - band), 4) AS low, round(close, 4) AS close, round(close, 4) AS adj_close,
       floor({_between(2_000_000.0, 12_000_000.0, "volume")} * exp(0.25 * {sql_normal(_K, "symbol", _D, "'volume'")}))::DOUBLE AS volume
FROM opened""",
)
def src_5(spark, sf):
    names = fx.table(spark, sf, "supplier").select(F.replace("s_name", F.lit("#"), F.lit("_")).alias("symbol"))
    made = src.generate_panel(names, "2023-01-02", "2023-12-29", seed=42)
    return made.select("date", "symbol", *[F.round(c, 4).alias(c) for c in src.PRICE_COLUMNS], "volume")


# ---------------------------------------------------------------- universe


@entry(
    "uni_1_static_membership",
    f"""WITH {fx.MARKET} SELECT DISTINCT symbol, DATE '{FROM}' AS "start", DATE '{TO}' AS "end", false AS point_in_time,
false AS survivorship_free, 'Static universe is not point-in-time and may contain survivorship bias.' AS warning FROM market""",
)
def uni_1(spark, sf):
    symbols = fx.market(spark, sf).select(F.lower("symbol").alias("symbol")).distinct()
    return uni.static_membership(symbols, FROM, TO)


_NORMAL = f"""normal AS (
  SELECT upper(symbol) AS symbol, greatest("start", DATE '{FROM}') AS "start", least(coalesce("end", DATE '{TO}'), DATE '{TO}') AS "end"
  FROM membership WHERE "start" <= DATE '{TO}' AND coalesce("end", DATE '{TO}') >= DATE '{FROM}')"""


@entry("uni_2_normalize_membership", f"WITH {fx.MARKET}, {fx.MEMBERSHIP}, {_NORMAL} SELECT * FROM normal")
def uni_2(spark, sf):
    return uni.normalize_membership(fx.membership(spark, sf), FROM, TO)


@entry(
    "src_7_membership_scan",
    f"""WITH {fx.MARKET}, {fx.MEMBERSHIP} SELECT symbol, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end" FROM membership""",
)
def src_7(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/membership-{uuid.uuid4().hex}"
    fx.membership(spark, sf).write.option("header", True).csv(path)
    return uni.read_membership(spark, path)


@entry(
    "uni_3_interval_join",
    f"""WITH {fx.MARKET}, {fx.MEMBERSHIP}, {_NORMAL}
SELECT m.date, m.symbol, m.adj_close FROM market m JOIN normal n ON m.symbol = n.symbol AND m.date BETWEEN n."start" AND n."end" """,
)
def uni_3(spark, sf):
    spells = uni.normalize_membership(fx.membership(spark, sf), FROM, TO)
    return uni.apply_membership(fx.market(spark, sf), spells).select("date", "symbol", "adj_close")


@entry("uni_4_universe_symbols", f"WITH {fx.MARKET}, {fx.MEMBERSHIP}, {_NORMAL} SELECT DISTINCT symbol FROM normal")
def uni_4(spark, sf):
    return uni.universe_symbols(uni.normalize_membership(fx.membership(spark, sf), FROM, TO))


# ---------------------------------------------------------------- borrow


def locates(spark, sf):
    return bor.normalize_borrow(fx.borrow(spark, sf), fx.dates(spark, sf))


@entry("bor_1_normalize", f"WITH {fx.MARKET}, {fx.BORROW} SELECT date, symbol, shortable, borrow_fee_bps FROM borrow")
def bor_1(spark, sf):
    return locates(spark, sf)


@entry(
    "src_6_borrow_scan",
    f"""WITH {fx.MARKET}, {fx.BORROW}
SELECT date, symbol, shortable, borrow_fee_bps FROM borrow WHERE date BETWEEN DATE '{FROM}' AND DATE '{TO}'""",
)
def src_6(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/borrow-{uuid.uuid4().hex}"
    fx.borrow(spark, sf).write.option("header", True).csv(path)
    span = fx.dates(spark, sf).where(F.col("date").between(F.lit(FROM), F.lit(TO)))
    return bor.normalize_borrow(bor.read_borrow(spark, path), span)


_BORROW_GRID = """bgrid AS (
  SELECT d.date, s.symbol, coalesce(b.shortable, false) AS shortable, b.borrow_fee_bps
  FROM (SELECT DISTINCT date FROM market) d CROSS JOIN requested s LEFT JOIN borrow b ON b.date = d.date AND b.symbol = s.symbol)"""


@entry("bor_2_densify", f"WITH {fx.MARKET}, {fx.BORROW}, {REQUESTED}, {_BORROW_GRID} SELECT * FROM bgrid")
def bor_2(spark, sf):
    return bor.densify_borrow(locates(spark, sf), fx.dates(spark, sf), requested(spark, sf)).select(
        "date", "symbol", "shortable", "borrow_fee_bps"
    )


@entry(
    "bor_3_summary",
    f"""WITH {fx.MARKET}, {fx.BORROW}, {REQUESTED}, {_BORROW_GRID},
s AS (SELECT (SELECT count(*) FROM borrow) AS row_count, (SELECT count(DISTINCT symbol) FROM borrow) AS symbols, count(*) AS cells,
   count(borrow_fee_bps) / count(*) AS cov, count(*) FILTER (WHERE NOT shortable) AS unavailable_rows,
   count(*) FILTER (WHERE borrow_fee_bps >= 500) AS hard_to_borrow_rows, avg(borrow_fee_bps) AS a, max(borrow_fee_bps) AS max_borrow_fee_bps
   FROM bgrid)
SELECT row_count, symbols, cells, round(cov, 6) AS coverage, unavailable_rows, hard_to_borrow_rows,
  round(a, 6) AS average_borrow_fee_bps, max_borrow_fee_bps,
  concat_ws(' ', CASE WHEN cov < 0.95 THEN printf('Borrow availability coverage is %.2f%%; missing rows are treated as not shortable.', cov * 100) END,
    printf('Borrow availability marks %d date-symbol rows as not shortable.', unavailable_rows),
    printf('Borrow availability flags %d hard-to-borrow rows at or above 500 bps.', hard_to_borrow_rows)) AS warnings FROM s""",
)
def bor_3(spark, sf):
    out = bor.borrow_summary(locates(spark, sf), fx.dates(spark, sf), requested(spark, sf))
    return fx.rounded(out, "coverage", "average_borrow_fee_bps").withColumn("warnings", F.concat_ws(" ", "warnings"))


# ---------------------------------------------------------------- provenance


_LINE = """concat_ws(',', CAST(date AS VARCHAR), symbol, CAST(symbol_no AS VARCHAR), CAST(round(adj_close * 1000000) AS BIGINT))"""
_YEARS = f"""{fx.MARKET}, lines AS (SELECT year(date) AS year, date, symbol, {_LINE} AS line FROM market),
files AS (SELECT year, count(*) AS n_lines, sha256(string_agg(concat(line, chr(10)), '' ORDER BY date, symbol)) AS sha256 FROM lines GROUP BY 1)"""
_SNAPSHOTS: dict[tuple[str, str], str] = {}


def snapshot_lines(spark, sf):
    """The market as lines of a text snapshot, with the year that names the file."""
    line = F.concat_ws(",", F.col("date").cast("string"), "symbol", F.col("symbol_no").cast("string"), F.round(F.col("adj_close") * 1_000_000).cast("long").cast("string"))
    return fx.market(spark, sf).select(F.year("date").alias("year"), "date", "symbol", line.alias("value"))


def snapshot_files(spark, sf):
    """Folder of the written snapshot: a text file for each year, its lines in order. Written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SNAPSHOTS:
        folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
        ordered = snapshot_lines(spark, sf).repartition("year").sortWithinPartitions("year", "date", "symbol")
        ordered.select("year", "value").write.partitionBy("year").text(folder)
        _SNAPSHOTS[key] = folder
    return _SNAPSHOTS[key]


def year_of(path):
    return F.regexp_extract(path, r"year=(\d+)/", 1).cast("long")


@entry("prv_1_content_hash", f"WITH {_YEARS} SELECT year, sha256 FROM files")
def prv_1_hash(spark, sf):
    """Hashes of the files as they lie in the store; the SQL hashes the text they must hold."""
    return prv.content_hash(spark, f"{snapshot_files(spark, sf)}/*/*.txt").select(year_of("path").alias("year"), "sha256")


def _of_year(year: int) -> str:
    return f"(SELECT min(year) + {year} FROM lines)"


_MATCHES = ["hash_matches", "row_count_matches", "symbol_set_matches", "date_range_matches"]


def checked_snapshot(spark, sf, year: int, tamper: bool):
    """The snapshot of one year against a manifest written from the data: as it is, or of the year before."""
    lines = snapshot_lines(spark, sf)
    first = lines.agg(F.min("year")).first()[0] + year
    told = first - 1 if tamper else first
    own = lines.where(F.col("year") == told)
    facts = own.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    hashed = lambda year: prv.content_hash(spark, f"{snapshot_files(spark, sf)}/year={year}/*.txt")
    expected = hashed(told).first()["sha256"]
    manifest = {"dataset_id": f"market-{told}", "row_count": facts["n"], "start": facts["lo"].isoformat(), "end": facts["hi"].isoformat(), "content_sha256": expected}
    files = hashed(first)
    return prv.snapshot_provenance(lines.where(F.col("year") == first), manifest, own.select("symbol").distinct(), files)


def snapshot_sql(year: int, told: int) -> str:
    return f"""WITH {_YEARS}, own AS (SELECT * FROM lines WHERE year = {_of_year(year)}), other AS (SELECT * FROM lines WHERE year = {_of_year(told)}),
facts AS (SELECT count(*) AS row_count, count(DISTINCT symbol) AS symbol_count, min(date) AS "start", max(date) AS "end", (SELECT sha256 FROM files WHERE year = {_of_year(year)}) AS content_sha256,
  (SELECT sha256 FROM files WHERE year = {_of_year(year)}) = (SELECT sha256 FROM files WHERE year = {_of_year(told)}) AS hash_matches,
  count(*) = (SELECT count(*) FROM other) AS row_count_matches,
  NOT EXISTS (SELECT symbol FROM other EXCEPT SELECT symbol FROM own) AND NOT EXISTS (SELECT symbol FROM own EXCEPT SELECT symbol FROM other) AS symbol_set_matches,
  min(date) = (SELECT min(date) FROM other) AND max(date) = (SELECT max(date) FROM other) AS date_range_matches FROM own)
SELECT *, concat_ws(' ', CASE WHEN NOT hash_matches THEN 'Snapshot manifest hash does not match the data file.' END,
  CASE WHEN NOT row_count_matches THEN 'Snapshot manifest row count does not match loaded data.' END,
  CASE WHEN NOT symbol_set_matches THEN 'Snapshot manifest symbols do not match loaded data.' END,
  CASE WHEN NOT date_range_matches THEN 'Snapshot manifest date range does not match loaded data.' END) AS warnings FROM facts"""


def snapshot_row(out):
    return out.select("row_count", "symbol_count", "start", "end", "content_sha256", *_MATCHES, F.concat_ws(" ", "warnings").alias("warnings"))


@entry("prv_1_snapshot_provenance", snapshot_sql(2, 1))
def prv_1(spark, sf):
    """A manifest of another year: neither hash nor dates fit."""
    return snapshot_row(checked_snapshot(spark, sf, 2, True))


@entry("prv_1_matching_snapshot", snapshot_sql(1, 1))
def prv_1_matching(spark, sf):
    """A manifest that agrees with file and rows."""
    return snapshot_row(checked_snapshot(spark, sf, 1, False))


@entry(
    "prv_1_row_digest",
    """WITH d AS (SELECT CAST(concat('0x', substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag)), 1, 8)) AS BIGINT) AS part FROM lineitem)
SELECT count(*) AS row_count, CAST(sum(part) AS BIGINT) AS digest_sum, bit_xor(part) AS digest_xor FROM d""",
)
def prv_1_digest(spark, sf):
    names = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")]
    return prv.row_digest(fx.table(spark, sf, "lineitem"), F.concat_ws("|", *names))


@entry(
    "prv_2_locked_holdout",
    f"""WITH {fx.MARKET}, h AS (SELECT * FROM market WHERE date >= DATE '2000-06-05')
SELECT count(*) AS row_count, count(DISTINCT symbol) AS symbol_count, min(date) AS "start", max(date) AS "end", count(*) > 0 AS has_rows,
  coalesce(min(date) = DATE '2000-06-05' AND max(date) = DATE '2001-10-29', false) AS date_range_matches,
  (SELECT count(DISTINCT symbol) FROM market) = count(DISTINCT symbol) AS symbol_set_matches,
  true AS row_count_matches, count(*) >= 900 AS minimum_row_count_met FROM h""",
)
def prv_2(spark, sf):
    manifest = {
        "schema_version": prv.HOLDOUT_SCHEMA_VERSION,
        "start": "2000-06-05",
        "end": "2001-10-29",
        "minimum_row_count": 900,
    }
    panel = fx.market(spark, sf)
    out = prv.locked_holdout(panel, "2000-06-05", manifest, panel.select("symbol").distinct(), enforce=False)
    checks = ["has_rows", "date_range_matches", "symbol_set_matches", "row_count_matches", "minimum_row_count_met"]
    return out.select("row_count", "symbol_count", "start", "end", *checks)


@entry(
    "prv_3_fingerprint",
    f"WITH {fx.MARKET} SELECT count(*) AS row_count, count(DISTINCT date) AS date_count, count(DISTINCT symbol) AS symbol_count FROM market",
)
def prv_3(spark, sf):
    return prv.fingerprint(fx.market(spark, sf)).select("row_count", "date_count", "symbol_count")


# ---------------------------------------------------------------- data quality


def flawed(spark, sf):
    """Raw bars with repeated keys, bad prices, empty volume and stale stretches injected by rule."""
    rows = src.with_date_index(fx.market_raw(spark, sf), fx.dates(spark, sf))
    spot = F.col("symbol_no") * 31 + F.col("date_idx")
    bad = rows.withColumns(
        {
            "low": F.when(spot % 97 == 3, F.lit(-1.0)).otherwise(F.col("low")),
            "volume": F.when(spot % 89 == 2, F.lit(0.0)).otherwise(F.col("volume")),
            "adj_close": F.when((F.col("date_idx") % 50 < 8) & (F.col("symbol_no") % 3 == 0), F.lit(77.0)).otherwise(
                F.col("adj_close")
            ),
        }
    )
    return bad


FLAWED = f"""{fx.MARKET_RAW},
rdates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS di FROM (SELECT DISTINCT date FROM market_raw)),
flawed AS MATERIALIZED (
  SELECT date, di, symbol, symbol_no, open, high, close,
    CASE WHEN (symbol_no * 31 + di) % 97 = 3 THEN -1.0 ELSE low END AS low,
    CASE WHEN (symbol_no * 31 + di) % 89 = 2 THEN 0.0 ELSE volume END AS volume,
    CASE WHEN di % 50 < 8 AND symbol_no % 3 = 0 THEN 77.0 ELSE adj_close END AS adj_close
  FROM market_raw JOIN rdates USING (date))"""

_FLAGS = f"""{FLAWED},
stepped AS (SELECT *, adj_close / lag(adj_close) OVER w - 1 AS ret,
    CASE WHEN adj_close - lag(adj_close) OVER w = 0 THEN 1 ELSE 0 END AS same
  FROM flawed WINDOW w AS (PARTITION BY symbol ORDER BY date)),
flags AS (SELECT *, coalesce(abs(ret) > 0.5, false) AS extreme, sum(same) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) >= 5 AS stale FROM stepped),
quality AS MATERIALIZED (
  SELECT symbol, count(*) AS observations, (SELECT count(DISTINCT date) FROM flawed) AS expected_observations,
    count(*) FILTER (WHERE volume <= 0) AS zero_volume_rows,
    count(*) FILTER (WHERE least(open, high, low, close, adj_close) <= 0) AS non_positive_price_rows,
    count(*) FILTER (WHERE stale) AS stale_price_rows, count(*) FILTER (WHERE extreme) AS extreme_return_rows
  FROM flags GROUP BY symbol)"""


@entry(
    "dq_1_overview",
    f"""WITH {fx.MARKET}, {REQUESTED}, dup AS (SELECT date, symbol FROM market UNION ALL SELECT date, symbol FROM market WHERE symbol_no % 4 = 1)
SELECT count(*) AS row_count, count(DISTINCT date) AS date_count, count(*) - count(DISTINCT concat(date, symbol)) AS duplicate_rows,
  count(DISTINCT symbol) AS observed_symbols, (SELECT count(*) FROM requested WHERE symbol NOT IN (SELECT symbol FROM market)) AS missing_symbols
FROM dup""",
)
def dq_1(spark, sf):
    once = fx.market(spark, sf)
    return dq.panel_overview(once.unionByName(once.where(F.col("symbol_no") % 4 == 1)), requested(spark, sf))


@entry(
    "dq_2_symbol_coverage",
    f"""WITH {FLAWED} SELECT symbol, count(*) AS observations, (SELECT count(DISTINCT date) FROM flawed) AS expected_observations,
  round(count(*) / (SELECT count(DISTINCT date) FROM flawed), 6) AS coverage,
  (SELECT count(DISTINCT date) FROM flawed) - count(*) AS missing_rows FROM flawed GROUP BY symbol""",
)
def dq_2(spark, sf):
    return fx.rounded(dq.symbol_coverage(flawed(spark, sf)), "coverage")


for _key, _column in {
    "dq_3_non_positive_prices": "non_positive_price_rows",
    "dq_4_zero_volume": "zero_volume_rows",
    "dq_5_extreme_returns": "extreme_return_rows",
    "dq_6_stale_rows": "stale_price_rows",
}.items():
    ENTRIES[_key] = (
        lambda spark, sf, c=_column: dq.symbol_quality(flawed(spark, sf), fx.dates(spark, sf)).select("symbol", c),
        f"WITH {_FLAGS} SELECT symbol, {_column} FROM quality",
    )


def _warn(column: str, text: str) -> str:
    return f"SELECT symbol, '{column}' AS rule, printf('%s has %d {text}', symbol, {column}) AS message FROM quality WHERE {column} > 0"


@entry(
    "dq_7_warnings",
    f"""WITH {_FLAGS}
SELECT symbol, 'coverage' AS rule, printf('%s coverage is %.2f%%; inspect missing rows before trusting results.', symbol, 100.0 * (observations / expected_observations)) AS message
FROM quality WHERE observations / expected_observations < 0.95
UNION ALL {_warn("non_positive_price_rows", "rows with non-positive OHLC prices.")}
UNION ALL {_warn("zero_volume_rows", "rows with non-positive volume.")}
UNION ALL {_warn("extreme_return_rows", "rows with absolute adjusted return above 50%%.")}
UNION ALL {_warn("stale_price_rows", "stale adjusted-close rows.")}""",
)
def dq_7(spark, sf):
    return dq.quality_warnings(dq.symbol_quality(flawed(spark, sf), fx.dates(spark, sf)))


@entry(
    "dq_7_panel_warnings",
    f"""WITH {fx.MARKET}, {REQUESTED}
SELECT 'missing_symbol' AS rule, printf('Missing requested symbols: %s.', symbol) AS message FROM requested WHERE symbol NOT IN (SELECT symbol FROM market)
UNION ALL SELECT 'duplicate_rows', printf('Market data contains %d duplicate date-symbol rows.', count(*)) FROM market WHERE symbol_no % 4 = 1 HAVING count(*) > 0""",
)
def dq_7_panel(spark, sf):
    once = fx.market(spark, sf)
    return dq.panel_warnings(once.unionByName(once.where(F.col("symbol_no") % 4 == 1)), requested(spark, sf))


@entry(
    "dq_7_source_warnings",
    f"""WITH {fx.RUNS} SELECT run_id, concat_ws(' ',
  CASE WHEN source = 'synthetic' THEN 'Synthetic data validates mechanics but is not investment evidence.' END,
  CASE WHEN source IN ('csv_snapshot', 'vendor_snapshot') AND dataset_id IS NULL THEN 'CSV snapshot source is configured without a manifest; provenance and golden validation are incomplete.' END,
  CASE WHEN source = 'vendor_snapshot' THEN 'Vendor snapshot data requires entitlement, survivorship, and corporate-action review before production use.' END,
  CASE WHEN key % 2 <> 0 THEN 'Universe membership is not marked point-in-time; survivorship or lookahead bias may remain.' END,
  CASE WHEN key % 3 <> 0 THEN 'Universe is not marked survivorship-bias-free.' END,
  CASE WHEN key % 4 <> 0 THEN 'Corporate-action handling is not marked institutional-grade.' END) AS warnings FROM runs""",
)
def dq_7_source(spark, sf):
    k = F.col("key")
    found = dq.source_warnings(
        F.col("source"), k % 2 == 0, k % 3 == 0, k % 4 == 0, F.col("dataset_id").isNotNull()
    )
    return fx.run_rows(spark, sf).select("run_id", F.concat_ws(" ", found).alias("warnings"))
