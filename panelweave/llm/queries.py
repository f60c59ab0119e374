"""The registered queries of this package: each applies its operator to the whole given table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.fingerprints import edited_fingerprints
from panelweave.llm.hash_forest import nearest
from panelweave.llm.jaccard_join import similarity_components
from panelweave.llm.line_dedup import dedup_lines
from panelweave.llm.mixing import mix_sources
from panelweave.llm.mixing import mix_sources
from panelweave.llm.near_vectors import link_near_vectors
from panelweave.llm.oracles import ORACLE
from panelweave.llm.packing import pack_documents
from panelweave.llm.prefix_trie import prefix_trie
from panelweave.llm.quality import learn, score_quality
from panelweave.llm.quotations import link_quotations
from panelweave.llm.substring_dedup import kept_digest
from panelweave.llm.tables import read
from panelweave.llm.token_counts import attribute_tokens
from panelweave.llm.whitening import whiten


def op1_hash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(read(spark, folder, "embeddings"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return score_quality(docs, learn(docs, read(spark, folder, "labels")))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(read(spark, folder, "documents")).drop("source", "routed")


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_components(read(spark, folder, "documents"), k=4, percent=85)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return attribute_tokens(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), ["source", "lang", "text"], by_line=["text"])


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return kept_digest(read(spark, folder, "documents"), span=35)


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(read(spark, folder, "documents"))


__all__ = ["ORACLE", "QUERIES"]

#: Vocabulary file that the token operators read; its folder is the installed package of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """The given conversations as mail: from the second turn on, each message quotes what it answers.

    The table has no quotes of its own. A turn quotes the one before, with its quote of the one before that a level
    deeper; every fifth turn quotes the second last instead.
    """
    said = conversations.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("first"))
    said = said.select("conv_id", "turn", F.coalesce("first.text", F.lit("")).alias("said"))

    def quoted(column: str, marks: str) -> Column:
        return F.concat(F.lit(marks), F.replace(F.col(column), F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))

    step = F.when(F.col("turn") % 5 == 4, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", "role", "text", (F.col("turn") - step).alias("near"), (F.col("turn") - step - 1).alias("far"))
    near = said.select("conv_id", F.col("turn").alias("near"), F.col("said").alias("near_said"))
    far = said.select("conv_id", F.col("turn").alias("far"), F.col("said").alias("far_said"))
    rows = rows.join(near, ["conv_id", "near"], "left").join(far, ["conv_id", "far"], "left")
    text = F.concat(F.coalesce(quoted("far_said", "> > "), F.lit("")), F.coalesce(quoted("near_said", "> "), F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


def op6_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return link_quotations(quoting_messages(read(spark, folder, "conversations")))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), window=1024, end_id=0)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(read(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(read(spark, folder, "embeddings"))


def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return link_near_vectors(read(spark, folder, "embeddings"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(read(spark, folder, "conversations")).drop("turn_conv_id", "turn_place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_forest": op1_hash_forest,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_fingerprints": op5_fingerprints,
    "op6_quotations": op6_quotations,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_near_vectors": op12_near_vectors,
    "op13_prefix_trie": op13_prefix_trie,
}
