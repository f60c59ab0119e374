"""Market panel: scan, cleaning, vendor reshape, calendar index and a keyed data generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions import keyed_normal, keyed_uniform

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]
VALUE_COLUMNS = [*PRICE_COLUMNS, "volume"]
PANEL_COLUMNS = ["date", "symbol", *VALUE_COLUMNS]

PANEL_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in VALUE_COLUMNS]
)

# Vendor column names and the panel names they become.
VENDOR_COLUMNS = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
}


def select_panel(df: DataFrame, symbols: list[str] | None, start: str, end: str) -> DataFrame:
    """Rows of the requested symbols inside the closed date range, in panel columns."""
    missing = sorted(set(PANEL_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"snapshot data missing columns: {missing}")
    typed = df.select(
        F.col("date").cast("date").alias("date"),
        F.upper(F.col("symbol").cast("string")).alias("symbol"),
        *[F.col(c).cast("double").alias(c) for c in VALUE_COLUMNS],
    )
    kept = typed.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if symbols is not None:
        kept = kept.where(F.col("symbol").isin([s.upper() for s in symbols]))
    return kept


def read_snapshot(
    spark: SparkSession, path: str, symbols: list[str] | None, start: str, end: str, file_format: str = "csv"
) -> DataFrame:
    """Scan a CSV or Parquet snapshot with a fixed schema, filter it and clean it."""
    reader = spark.read.schema(PANEL_SCHEMA)
    raw = reader.option("header", True).csv(path) if file_format == "csv" else reader.format(file_format).load(path)
    return clean_panel(select_panel(raw, symbols, start, end))


def clean_panel(df: DataFrame) -> DataFrame:
    """Infinite values become null; a row with any null value column is dropped."""
    finite = [
        F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), None).otherwise(F.col(c)).alias(c)
        for c in VALUE_COLUMNS
    ]
    return df.select("date", "symbol", *finite).dropna(subset=VALUE_COLUMNS)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Eager guard for callers that want an empty scan to be an error."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def vendor_panel(df: DataFrame) -> DataFrame:
    """Vendor columns (Date, Symbol, Open, ..., Adj Close, Volume) -> cleaned panel."""
    renamed = df.withColumnsRenamed({**VENDOR_COLUMNS, "Date": "date", "Symbol": "symbol"})
    return clean_panel(
        renamed.select(
            F.col("date").cast("date").alias("date"),
            "symbol",
            *[F.col(c).cast("double").alias(c) for c in VALUE_COLUMNS],
        )
    )


def vendor_missing_symbols(df: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested symbols for which the vendor delivered no row with any value."""
    usable = df.where(F.coalesce(*[F.col(c).cast("double") for c in VENDOR_COLUMNS]).isNotNull())
    return requested.join(usable.select(F.col("Symbol").alias("symbol")), "symbol", "left_anti")


def vendor_wide_to_long(df: DataFrame, separator: str = "|") -> DataFrame:
    """One file with ``SYMBOL|Field`` columns per date -> one row per (Date, Symbol)."""
    symbols: dict[str, list[str]] = {}
    for name in df.columns:
        if separator in name:
            symbol, field = name.split(separator, 1)
            symbols.setdefault(symbol, []).append(field)
    rows = [
        F.struct(
            F.lit(symbol).alias("Symbol"),
            *[
                (F.col(f"`{symbol}{separator}{f}`") if f in fields else F.lit(None)).cast("double").alias(f)
                for f in VENDOR_COLUMNS
            ],
        )
        for symbol, fields in symbols.items()
    ]
    return df.select("Date", F.explode(F.array(*rows)).alias("r")).select("Date", "r.*")


def calendar(df: DataFrame) -> DataFrame:
    """(date, date_idx): 0-based position of each distinct date.

    DATE bounds this table (at most 366 rows per calendar year), which is what makes the
    one-partition window and the broadcast in ``with_date_index`` safe for any panel size.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("date")
    return df.select("date").distinct().select("date", (F.row_number().over(order) - 1).alias("date_idx"))


def with_date_index(df: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Add ``date_idx``.  Window frames are RANGE frames over it, so a symbol's missing dates stay
    gaps and the dates x symbols grid is never built."""
    return df.join(F.broadcast(calendar(df) if dates is None else dates), "date")


#: Symbols that one task of the generator unfolds to days.
SYMBOLS_PER_TASK = 2_000


def generate_panel(
    symbols: DataFrame, start: str, end: str, seed: int = 42, minimum_days: int = 80
) -> DataFrame:
    """Synthetic panel: one common shock per business day, per-symbol beta, noise, drift and volume.

    Every draw is keyed by (seed, symbol, date), so rows do not depend on partitioning.
    ``symbols`` has one STRING column ``symbol``; prices are a running sum inside each symbol. Symbols are dealt to tasks
    before they unfold to days, and what a symbol or a day draws is drawn once.
    """
    k, s, d = F.lit(seed), F.col("symbol"), F.col("date")
    shock = F.lit(0.00025) + F.lit(0.009) * keyed_normal(k, F.lit("market"), d)
    every_day = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    days = symbols.sparkSession.range(1).select(every_day).where(F.weekday("date") < 5).withColumn("shock", shock)

    def spread(low: float, high: float, tag: str):
        return F.lit(low) + F.lit(high - low) * keyed_uniform(k, s, F.lit(tag))

    own = {
        "beta": spread(0.7, 1.3, "beta"),
        "sigma": spread(0.010, 0.024, "sigma"),
        "drift": F.lit(0.00015) + F.lit(0.00018) * keyed_normal(k, s, F.lit("drift")),
        "size": spread(2_000_000.0, 12_000_000.0, "volume"),
    }
    tasks = max(symbols.sparkSession.sparkContext.defaultParallelism, -(-symbols.count() // SYMBOLS_PER_TASK))
    dealt = symbols.select(F.upper("symbol").alias("symbol")).repartition(tasks, "symbol").withColumns(own)
    # The calendar bounds the days.
    grid = dealt.crossJoin(F.broadcast(days))
    noise = F.col("sigma") * keyed_normal(k, s, d, F.lit("noise"))
    by_symbol = Window.partitionBy("symbol").orderBy("date")
    day_count = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    path = (
        grid.withColumn("step", F.col("drift") + F.col("beta") * F.col("shock") + noise)
        .withColumn("close", F.lit(100.0) * F.exp(F.sum("step").over(by_symbol)))
        .withColumn("days", day_count)
        .where(
            F.when(F.col("days") >= minimum_days, True).otherwise(
                F.raise_error(F.lit(f"synthetic data needs at least {minimum_days} business days"))
            )
        )
    )
    opened = path.withColumn("open", F.col("close") * (1.0 + F.lit(0.003) * keyed_normal(k, s, d, F.lit("open"))))
    band = F.abs(F.lit(0.004) + F.lit(0.002) * keyed_normal(k, s, d, F.lit("band")))
    volume = F.col("size") * F.exp(F.lit(0.25) * keyed_normal(k, s, d, F.lit("volume")))
    return opened.select(
        "date",
        "symbol",
        "open",
        (F.greatest("open", "close") * (1.0 + band)).alias("high"),
        (F.least("open", "close") * (1.0 - band)).alias("low"),
        "close",
        F.col("close").alias("adj_close"),
        F.floor(volume).cast("double").alias("volume"),
    )
