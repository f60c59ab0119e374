"""The corpus pipeline: quality, lines, near duplicates, mixture, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last
return the columns of ``documents``, n_chars following the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.jaccard_join import first_of_each
from panelweave.llm.line_dedup import dedup_lines
from panelweave.llm.mixing import mix_sources
from panelweave.llm.packing import pack_documents
from panelweave.llm.quality import keep_good, learn
from panelweave.llm.tables import fresh, prepare, read, shared_folder

TOKENIZER = "byte_bpe_50k.json"
#: Edits that two lines may differ by, from these lengths on.
LINE_EDITS = ((0, 1), (100, 2), (200, 3))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels`` outside the held-out third."""
    return keep_good(docs, learn(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and with them documents of which nothing but white space is left.

    Lines under 32 characters go where they are the same, longer ones within ``LINE_EDITS``.
    """
    prepare(spark)
    changed = dedup_lines(docs, tau=LINE_EDITS, exact=1).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with word shingles alike, the one with the smallest doc_id stays, and of equal rows one.

    Rows that share a doc_id, or have none, are documents by their text. Texts without words all stay.
    """
    prepare(spark)
    doc, version, copy = fresh(docs.columns, "_doc", "_version", "_copy")
    stay = first_of_each(docs, k=5, percent=80).toDF(doc, version)
    kept = docs.join(stay.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(version)), "left_semi")
    equal = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang", "n_chars")
    return kept.withColumn(copy, F.row_number().over(equal)).where(F.col(copy) == 1).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, copies as rows of their own."""
    doc, source, version, number, copy = fresh(docs.columns, "_doc", "_source", "_version", "_uses", "_copy")
    marked = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("version"))
    uses = mix_sources(marked, also=["version"]).groupBy("doc_id", "source", "version").agg(F.sum("uses").alias("uses"))
    uses = uses.where("uses > 0").toDF(doc, source, version, number)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(version))
    equal = Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy("lang", "n_chars")
    once = docs.join(uses.hint("merge"), same).withColumn(copy, F.row_number().over(equal)).where(F.col(copy) == 1)
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number)))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    prepare(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), window=1024, end_id=0)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

#: A fitted model, edit distances and tokens have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
