"""From raw documents to token ids: quality rules, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.bpe_chunks import bpe_encode, vocabulary
from readloom.llm.mixing import mixed_documents
from readloom.llm.ngram_join import ngram_jaccard_components
from readloom.llm.quality_rules import good_documents
from readloom.llm.runtime import checkpointed, read_table
from readloom.plans.registry import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null and empty texts fail the base rules and go; rows without doc_id or lang are judged like
    others; repeated rows share their fate. An empty table gives an empty table.
    """
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id; of equal ids any one, and one without id only where no other has one.

    Groups are made by rows, so ids may be null or repeated. Documents without words stay. An empty
    table gives an empty table.
    """
    # written once, so that a row keeps its number; as Parquet, which is smaller than a checkpoint
    path = scratch(spark)
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    groups = ngram_jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stay = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return rows.join(checkpointed(stay, free=True), "_row", "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or up to three times.

    A null source is a source of its own; rows of equal id (or none) and text are taken alike; texts
    without words weigh nothing. An empty table gives an empty table.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and the digests of ids and decoded text, for each row.

    Null and empty texts have no tokens; doc_id may be null. write_training_order takes these rows as
    they are (ids="ids"). An empty table gives an empty table.
    """
    return bpe_encode(docs, vocabulary(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: BPE can't be expressed in SQL; tests hold the rows of run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written before the next begins."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
