"""Sequences derived from the documents table, the same in Spark and in SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: Documents in an alignment.
GROUP = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _only(symbols: str):
    return F.upper(F.regexp_replace("text", f"[^{symbols}{symbols.lower()}]", ""))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", _only("ACGT").alias("seq"))


def rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).withColumn("seq", F.translate("seq", "T", "U"))


def protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", _only(AMINO).alias("seq"))


def aligned(seqs: DataFrame) -> DataFrame:
    """Alignments of GROUP neighbouring documents, padded with gaps to the longest: msa_id, pos, id, aligned."""
    got = seqs.select(F.floor(F.col("doc_id") / GROUP).cast("long").alias("msa_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "seq")
    width = got.groupBy("msa_id").agg(F.max(F.length("seq")).alias("w"))
    return got.join(width, "msa_id").select("msa_id", "pos", "id", F.rpad("seq", F.col("w"), F.lit("-")).alias("aligned"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset in a local one in local mode, an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "seqloom-shared")
    return f"{top.rstrip('/')}/seqloom-{name}-{uuid.uuid4().hex}"


DOCS_SQL = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
DNA_SQL = f"{DOCS_SQL}, s AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM d)"
RNA_SQL = f"{DOCS_SQL}, s AS (SELECT doc_id, replace(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 'T', 'U') AS seq FROM d)"
PROTEIN_SQL = f"{DOCS_SQL}, s AS (SELECT doc_id, upper(regexp_replace(text, '[^{AMINO}{AMINO.lower()}]', '', 'g')) AS seq FROM d)"
