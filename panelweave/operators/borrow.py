"""Borrow/locate history: normalisation, densification to panel dates and the summary row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HARD_TO_BORROW_BPS = 500.0
# Accepted spellings of the shortable flag.
TRUE_WORDS = ["1", "true", "yes", "y"]
FALSE_WORDS = ["0", "false", "no", "n"]


def read_borrow(spark: SparkSession, path: str) -> DataFrame:
    """Locate CSV; ``available_quantity`` is optional."""
    names = spark.read.option("header", True).csv(path).columns  # header only
    missing = sorted({"date", "symbol", "shortable", "borrow_fee_bps"} - set(names))
    if missing:
        raise ValueError(f"borrow availability missing columns: {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).csv(path)


def parse_flag(column: str) -> Column:
    word = F.lower(F.trim(F.col(column).cast("string")))
    return (
        F.when(word.isin(TRUE_WORDS), True)
        .when(word.isin(FALSE_WORDS), False)
        .otherwise(F.raise_error(F.concat(F.lit("invalid borrow shortable value: "), F.coalesce(word, F.lit("null")))))
    )


def normalize_borrow(raw: DataFrame, panel: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(date, symbol, shortable, borrow_fee_bps) inside the panel's date span and the requested symbols.

    No available quantity means not shortable.  A repeated (date, symbol) raises when evaluated.
    """
    quantity = (
        F.col("available_quantity").cast("double") if "available_quantity" in raw.columns else F.lit(None).cast("double")
    )
    typed = raw.select(
        F.col("date").cast("date").alias("date"),
        F.upper("symbol").alias("symbol"),
        F.when(quantity <= 0, False).otherwise(parse_flag("shortable")).alias("shortable"),
        F.col("borrow_fee_bps").cast("double").alias("borrow_fee_bps"),
    )
    span = panel.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()  # one pass
    kept = typed.where(F.col("date").between(span["first"], span["last"]))
    if symbols is not None:
        kept = kept.join(symbols.select(F.upper("symbol").alias("symbol")), "symbol", "left_semi")
    # Grouping on the key finds repeats with map-side combine and leaves one row per key.
    single = kept.groupBy("date", "symbol").agg(
        F.count(F.lit(1)).alias("__n"),
        F.bool_and("shortable").alias("shortable"),
        F.max("borrow_fee_bps").alias("borrow_fee_bps"),
    )
    message = F.lit("borrow availability contains duplicate date-symbol rows")
    return single.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(message))).drop("__n")


def attach_borrow(rows: DataFrame, borrow: DataFrame) -> DataFrame:
    """Add shortable (missing: false) and borrow_fee_bps (missing: null) to (date, symbol) rows."""
    return rows.join(borrow, ["date", "symbol"], "left").withColumn(
        "shortable", F.coalesce(F.col("shortable"), F.lit(False))
    )


def densify_borrow(borrow: DataFrame, dates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every panel date for every requested symbol, missing cells not shortable and without a fee.

    The calendar travels to each symbol as one array (bounded by DATE) and is exploded there, so no
    cross product is shuffled.
    """
    days = dates.agg(F.collect_set("date").alias("__days"))
    grid = symbols.select(F.upper("symbol").alias("symbol"), F.explode(days.scalar()).alias("date"))
    return attach_borrow(grid.select("date", "symbol"), borrow)


def borrow_summary(
    borrow: DataFrame, dates: DataFrame, symbols: DataFrame, hard_to_borrow_bps: float = HARD_TO_BORROW_BPS
) -> DataFrame:
    """One row of counts over the dates x symbols grid, computed from the rows that exist.

    Missing cells are unavailable by definition, so their number follows from the two counts.
    """
    facts = borrow.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("borrow_fee_bps").alias("__fees"),
        F.sum(F.col("shortable").cast("long")).alias("__open"),
        F.count_if(F.col("borrow_fee_bps") >= hard_to_borrow_bps).alias("hard_to_borrow_rows"),
        F.coalesce(F.avg("borrow_fee_bps"), F.lit(0.0)).alias("average_borrow_fee_bps"),
        F.coalesce(F.max("borrow_fee_bps"), F.lit(0.0)).alias("max_borrow_fee_bps"),
        F.count_distinct("symbol").alias("symbols"),
    )
    grid = dates.agg(F.count(F.lit(1)).alias("n")).scalar() * symbols.agg(F.count_distinct("symbol").alias("n")).scalar()
    filled = facts.withColumn("cells", grid)
    covered = F.col("__fees") / F.col("cells")
    out = filled.withColumns({"coverage": covered, "unavailable_rows": F.col("cells") - F.coalesce("__open", F.lit(0))})
    threshold = f"{hard_to_borrow_bps:.0f}"
    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("coverage") < 0.95,
                F.format_string(
                    "Borrow availability coverage is %.2f%%; missing rows are treated as not shortable.",
                    F.col("coverage") * 100,
                ),
            ),
            F.when(
                F.col("unavailable_rows") > 0,
                F.format_string(
                    "Borrow availability marks %d date-symbol rows as not shortable.", F.col("unavailable_rows")
                ),
            ),
            F.when(
                F.col("hard_to_borrow_rows") > 0,
                F.format_string(
                    f"Borrow availability flags %d hard-to-borrow rows at or above {threshold} bps.",
                    F.col("hard_to_borrow_rows"),
                ),
            ),
        )
    )
    return out.withColumn("warnings", warnings).drop("__fees", "__open")
