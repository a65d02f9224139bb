"""A corpus pipeline of five stages: quality rules, near-dedup, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each
stage's result to the shared folder and reads it again. Columns of any other name pass through all
stages but the last. A null text counts as empty, a null doc_id as one that is no smaller than any;
an empty table stays empty; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, quality, repeats, shingles, simhash
from seqloom.llm.common import FILE_TEXTS, few, fresh, ref, stage
from seqloom.llm.vocabularies import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: each is judged alone, repeated rows alike. Null, empty and very short texts go."""
    name = fresh(docs, "quality")
    return quality.quality(docs, name=name).where(ref(name)["kept"]).select(*map(ref, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at least 0.8 alike (SimHash candidates, exact Jaccard), that of the smallest doc_id.

    Of rows alike in doc_id and text one stays; of rows with null ids only, any one. Texts without words are one group.
    """
    return few(simhash.keep_one(docs, groups=shingles.similar_texts), docs.count(), FILE_TEXTS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words, or of 400 bytes or more, that occur elsewhere too; a character cut through goes.

    Every place of a passage is cut, none is favoured; repeated rows are copies of one another. A null text becomes empty.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = repeats.remove_repeats(docs, carry=others, words=51, as_text=True).withColumnRenamed("kept", "text")
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[now.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def leak_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak nothing, an empty benchmark leaks nowhere; repeated rows are judged alike."""
    name = fresh(docs, "leaks")
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.where(F.size(ref(name)) == 0).select(*map(ref, docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents left, a row for each; an empty text has no tokens."""
    found = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("leak_removal", leak_removal),
    ("token_ids", token_ids),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
