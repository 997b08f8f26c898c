"""The corpus pipeline: toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm import jaccard, packing, suffixes, toxicity
from leafgraph.llm.store import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of ``REJECT`` or more go.  The model is fitted on the labelled rows of the input's training folds.

    Null and empty texts get the score of a text without hits and stay; repeated rows share their fate; a null doc_id is
    scored as any other; without labels of both kinds every score is the share of toxic ones, 0 if there are none; an empty
    table stays empty; columns beside those of documents, also one named ``toxicity``, are left out.
    """
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("toxicity") < REJECT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.8 or more of five-word shingles the smallest id stays.

    Documents without words, and rows with a null doc_id, link with nothing and stay.  Of rows that repeat both doc_id and text
    one stays; rows that repeat a doc_id with other texts share its fate.  An empty table stays empty; further columns are left out.
    """
    docs = docs.select(*COLUMNS)
    gone = jaccard.near_duplicates(docs, 5, 80, 100).where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeats")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 50-byte strings that a document of a smaller id has too go, with the characters that they are part of.

    A text that loses everything stays as an empty one.  Null and empty texts and rows with a null doc_id stay as they are;
    rows with equal ids don't repeat each other; an empty table stays empty; further columns are left out.
    """
    out = suffixes.remove_repeats(docs.select(*COLUMNS), characters=True)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    Null and empty texts are a piece of the end token alone; repeated rows and null ids are documents of their own; an empty table
    gives no rows; further columns are ignored.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("packing", pack_sequences)]
#: Neither the fitted model nor the packing can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
