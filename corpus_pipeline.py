"""A training-data pipeline over ``documents``: each stage works on what the one before it kept.

language (op 5) drops documents whose language can't be told; simhash keeps one document of each group of
near copies (op 1 over five-word shingles, verified); repeats (op 10) removes passages that stand in a document of smaller id; mixture (op 4) takes each
document as often as its source's target wants; packing (op 9) puts what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.language import UNKNOWN, identify
from traceloom.llm.mixture import mixture
from traceloom.llm.packing import pack_documents
from traceloom.llm.repeats import drop_repeats
from traceloom.llm.simhash import simhash_groups
from traceloom.llm.store import write_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or without a letter; of others some language is always the likeliest, and where no row
    has a language to learn from, all stay."""
    return identify(docs).where((F.col("lang_pred") != UNKNOWN) | F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group over links of 0.8 of five-word shingles, that of smallest id, once; texts that
    share an id are documents of their own; rows without an id belong to no group and stay."""
    marked = docs.withColumn("__h", F.xxhash64("text"))
    groups = simhash_groups(marked, words_each=5, least=0.8, keep=["__h"]).where("kept")
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "__h")).alias("x")).select("x.doc_id", "x.__h").distinct()
    kept = marked.join(first, ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document of which nothing but white space is left goes."""
    cut = drop_repeats(docs, as_text=True)
    left = (F.col("n_removed") == 0) | F.col("kept").rlike(r"\S")
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return cut.where(left).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each row as often as the mix takes it, 0 to 2 times. Rows that share an id share their mean; rows
    without an id stay once."""
    copies = mixture(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("copies")).cast("int").alias("__copies"))
    taken = docs.join(copies.where("__copies > 0"), "doc_id")
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
    return taken.unionByName(docs.where("doc_id IS NULL"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, with_ids=False)


STAGES = [("language", language), ("simhash", simhash), ("repeats", repeats), ("mixture", mix), ("packing", packing)]

#: SQL can't express EM, cube sampling or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_table(docs, f"stage-{name}")
    return docs
