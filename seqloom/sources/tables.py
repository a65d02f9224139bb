"""Records in CSV files, with a quarantine for rows whose sequence is invalid."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import SequenceError
from seqloom.functions import strings
from seqloom.operators.frames import RecordFrame, renumber
from seqloom.sources.fasta import records

SAMPLE_ROWS = 100
EXTRA = "_rest"


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names as the header has them, repeated ones too."""
    line = spark.read.text(path).first()
    return next(csv.reader([line.value])) if line else []


def _place(columns: list[str], wanted: str | int, what: str) -> int:
    if isinstance(wanted, bool) or not isinstance(wanted, (str, int)):
        raise TypeError(f"{what} column is a name or a number")
    if isinstance(wanted, str):
        if wanted not in columns:
            raise SequenceError(f"{what} column {wanted!r} is missing; there are {', '.join(columns)}")
        return columns.index(wanted)
    if not 0 <= wanted < len(columns):
        raise SequenceError(f"{what} column {wanted} is out of range; there are {len(columns)}")
    return wanted


def read_csv(spark: SparkSession, path: str, id_col: str | int, seq_col: str | int, desc_col: str | int | None = None, alphabet: str = "auto", on_error: str = "raise") -> RecordFrame:
    """Records of a CSV file with a header.

    Rows may be ragged; one that lacks a needed field is an error in either mode (for a lacking
    description: unless the row is skipped anyway). Fields are trimmed, white space inside
    sequences goes, an empty description is null. on_error "skip": rows with invalid
    sequences go to .skipped, with the number of the data row from 1; "raise": they are
    an error when the frame runs.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error is raise or skip")
    columns = csv_columns(spark, path)
    places = {"id": _place(columns, id_col, "id"), "seq": _place(columns, seq_col, "sequence")}
    if desc_col is not None:
        places["description"] = _place(columns, desc_col, "description")
    # the text of each row is kept: a short row tells from one with empty fields by its number of fields
    schema = ", ".join(f"`c{k}` string" for k in range(len(columns))) + ", _raw string"
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").option("enforceSchema", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    lacking = lambda k: F.col("_raw").isNotNull() & F.col(f"c{k}").isNull()

    def need(k: int, what: str):
        return F.when(lacking(k), F.raise_error(F.lit(f"missing field: {what}"))).otherwise(F.coalesce(F.col(f"c{k}"), F.lit("")))

    got = rows.select("_at", F.trim(need(places["id"], "id")).alias("id"), strings.normalize(need(places["seq"], "sequence")).alias("seq"), *([F.col(f"c{places['description']}").alias("_d"), lacking(places["description"]).alias("_no")] if desc_col is not None else [F.lit(None).cast("string").alias("_d"), F.lit(False).alias("_no")]))
    if alphabet == "auto":
        sample = "".join(r.seq for r in got.select("seq").limit(SAMPLE_ROWS).collect())
        kind = spark.range(1).select(strings.detect_kind(F.lit(sample))).first()[0]
    else:
        kind = alphabet
    described = F.when(F.col("_no"), F.raise_error(F.lit("missing field: description"))).otherwise(F.when(F.trim("_d") != "", F.trim("_d")))
    numbered = got.withColumnRenamed("_at", "pos")
    good = strings.is_valid(F.col("seq"), kind)
    skipped = None
    if on_error == "skip":
        at = strings.invalid_position(F.col("seq"), kind)
        said = F.concat(F.lit("invalid character '"), F.substring(F.col("seq"), (at + 1).cast("int"), F.lit(1)), F.lit("' at position "), at.cast("string"))
        counted = renumber(numbered)
        skipped = counted.where(~good).select((F.col("pos") + 1).alias("row"), F.when(F.col("id") != "", F.col("id")).alias("id"), F.lit(seq_col if isinstance(seq_col, str) else f"#{seq_col}").alias("column"), said.alias("message"))
        numbered = numbered.where(good)
    else:
        numbered = numbered.withColumn("seq", strings.validate(F.col("seq"), kind))
    return RecordFrame(records(numbered.select("pos", "id", described.alias("description"), "seq")), kind, False, skipped)


def skipped_rows(frame: RecordFrame) -> DataFrame:
    """(row, id, column, message) of the rows a reader left out."""
    return frame.skipped
