"""Reading the given tables and writing intermediates in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave import session
from panelweave.llm.words import slices
from panelweave.session import shared_folder

__all__ = ["attach_spread", "drop_staged", "fresh", "packed_texts", "prepare", "read", "shared_folder", "stage", "unpacked", "word_count"]

#: Rows of a batch that goes to Python. Texts are long: the usual ten thousand of them take tens of megabytes several times.
BATCH_ROWS = 1000
#: Makes Spark delete the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Of a join's rows, the share from which a key is hot: one in so many, hence there are so many hot keys at most.
HOT_SHARE = 1000

#: What every operator of this package takes as a word, as a regular expression of Java's.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """The session setting that these operators' memory counts on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back; its shuffle files go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return session.stage(df, label)
    finally:
        conf.set(CLEANUP, before)


def packed_texts(texts: DataFrame) -> DataFrame:
    """``texts`` with the last column, text, as compressed bytes for an exchange; null becomes empty."""
    *names, _ = texts.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        for batch in batches:
            for part in slices(batch):
                plain = pc.fill_null(part.column("text").cast(pa.large_string()), "").cast(pa.large_binary())
                packed = pa.array([squeeze.compress(x.as_buffer()) for x in plain], pa.binary())
                yield pa.record_batch([*(part.column(x) for x in names), packed], names=[*names, "packed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(pack, f"{kinds}, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of batches with a column of packed texts, and these texts."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in slices(batch, "packed", 1 << 19):
            yield part, pa.array([expand.decompress(x.as_py()) for x in part.column("packed")], pa.large_binary()).cast(pa.large_string())


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that a table with the columns ``taken`` does not have."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drop_staged(*tables: DataFrame) -> None:
    """Delete written intermediates that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach_spread(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``table`` (one row per key, with a column ``rows``: how many of ``rows`` have it) that spreads hot keys.

    Keys with more than one in HOT_SHARE of all rows are at most HOT_SHARE; they are broadcast, so rows with them are
    never sent to one task, nor are rows without a key. ``rows`` is read twice.
    """
    total = table.agg(F.sum("rows")).first()[0] or 0
    values = [c for c in table.columns if c not in (key, "rows")]
    hot = table.where(F.col("rows") * HOT_SHARE > total).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    rest = table.where(F.col("rows") * HOT_SHARE <= total).select(F.col(key).alias("_cold"), *values)
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    done = first.where(F.col("_hot").isNotNull() | F.col(key).isNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in values])
    other = first.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return done.unionByName(other.join(rest, F.col(key) == F.col("_cold"), "left").select(*rows.columns, *values))
