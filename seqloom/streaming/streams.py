"""Sequence functions over streams of FASTA text; nothing that needs an order or a position is offered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import strings

HEADER = r"\A[ \t\n\f\x0B]*>?[ \t]*"


def read_fasta_stream(spark: SparkSession, folder: str, kind: str, max_files: int | None = None) -> DataFrame:
    """A stream of (id, description, seq, valid) of FASTA files that arrive in a folder.

    Files must be moved into the folder whole. Invalid sequences are marked, not errors: a stream goes on.
    """
    reader = spark.readStream.option("lineSep", "\n>")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = reader.text(folder).where(~F.col("value").rlike(r"\A\s*\z")).select(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), HEADER, "").alias("value"))
    head = F.regexp_extract("value", r"\A[^\n]*", 0)
    about = F.trim(F.regexp_extract(head, r"^\S+\s+(.*)$", 1))
    seq = strings.normalize(F.regexp_extract("value", r"(?s)\A[^\n]*\n?(.*)\z", 1))
    return text.select(F.regexp_extract(head, r"^\S+", 0).alias("id"), F.when(about != "", about).alias("description"), seq.alias("seq")).withColumn("valid", strings.is_valid(F.col("seq"), kind))


def with_function(stream: DataFrame, name: str, f: Callable[[Column], Column], seq: str = "seq") -> DataFrame:
    """The stream with a function of the sequence as a further column."""
    return stream.withColumn(name, f(F.col(seq)))


def counts_by_length(stream: DataFrame, width: int = 100) -> DataFrame:
    """Running numbers of sequences by length class; state has a row for each class."""
    return stream.groupBy((F.floor(F.length("seq") / width) * width).alias("length_from")).agg(F.count("*").alias("n"))
