"""A training-corpus pipeline of five operators; each stage works on all rows that the one before it kept.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame. All but the last return the columns of ``documents``:
language ID drops rejected texts (no letters, or too far from every language), the Jaccard join keeps the smallest id of
each near-duplicate group (five words, 0.8), decontamination drops texts that hold benchmark passages, the secret scan
replaces every secret by a mark, and packing returns one row per piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import op5_secrets, op6_jaccard, op7_decontaminate, op8_packing, op10_language
from textloom.llm.common import crc_mod, save, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op10_language.fit(docs.where(crc_mod("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))  # so that no column clashes with a verdict
    return op10_language.identify(whole, model, "__row").where("not rejected").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the smallest id stays, of several under that id the one whose text has the smallest digest. A document is an
    id with its text: rows that repeat whole go or stay together."""
    mark = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    groups = save(op6_jaccard.jaccard_components(docs.select("doc_id", "text", mark.alias("__mark")), k=5, num=80, den=100).where("group_id is not null"), "groups")
    heads = groups.where("doc_id = component_id").select("group_id", "doc_id", "__mark")
    least = heads.groupBy("group_id").agg(F.min("__mark").alias("least"))
    more = heads.join(least, "group_id").where(F.col("__mark") != F.col("least"))
    gone = groups.where("doc_id <> component_id").select("doc_id", "__mark").unionAll(more.select("doc_id", "__mark")).distinct()
    return docs.withColumn("__mark", mark).join(gone.hint("shuffle_hash"), ["doc_id", "__mark"], "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_secrets.redact_all(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None  # language ID and packing are beyond SQL; tests follow single rows through the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written before the next one reads it; the folder of the stage before is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
        before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return STAGES[-1][1](spark, docs, sf_dir)
