"""FASTA: a splittable text scan by record, and a writer."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.errors import FormatError
from seqloom.functions import strings
from seqloom.operators.frames import RECORD_SCHEMA, RecordFrame

SAMPLE_BASES = 1000
FEATURES = RECORD_SCHEMA.split("features ", 1)[1].split(", annotations")[0]


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str | None, str]]:
    """(id, description, seq) of each record of an open file, one at a time."""
    head, parts = None, []
    for number, line in enumerate(lines, 1):
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if head is not None:
                yield (*head, "".join(parts))
            head, parts = _header(line[1:], number), []
        elif head is not None:
            parts.append("".join(line.split()))
        elif line.strip():
            raise FormatError(f"line {number}: a record starts with >")
    if head is not None:
        yield (*head, "".join(parts))


def _header(text: str, number: int) -> tuple[str, str | None]:
    words = text.split(None, 1)
    if not words:
        raise FormatError(f"line {number}: empty header")
    return words[0], (words[1].strip() or None) if len(words) > 1 else None


def parse_bytes(data: bytes) -> Iterator[tuple[str, str | None, str]]:
    return parse(io.StringIO(data.decode("utf-8")))


def _chunks(spark: SparkSession, path) -> DataFrame:
    """One row for each record: text after its >, as one string; a file's first chunk keeps what comes before the first >."""
    text = spark.read.option("lineSep", "\n>").text(path)
    return text.select(F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def scan(spark: SparkSession, path) -> DataFrame:
    """(pos, id, description, seq) of FASTA files, read in parallel, a large file by splits.

    pos ascends in file order and is unique, but has gaps. A record is an error if its
    header is empty, or if a file has other text before its first record.
    """
    rows = _chunks(spark, path)
    v = F.col("value")
    # a first chunk starts with blank lines and >; later ones have lost theirs to the separator
    body = F.regexp_replace(v, r"\A[ \t\n\f\x0B]*>", "")
    rows = rows.where(~v.rlike(r"\A\s*\z")).select("pos", body.alias("value"))
    head = F.regexp_replace(F.regexp_extract("value", r"\A[^\n]*", 0), r"^\s+|\s+$", "")
    rest = F.regexp_extract("value", r"(?s)\A[^\n]*\n?(.*)\z", 1)
    name = F.regexp_extract(head, r"^\S+", 0)
    described = F.regexp_replace(F.regexp_extract(head, r"(?s)^\S+\s+(.*)$", 1), r"\s+$", "")
    return rows.select("pos", F.when(name == "", F.raise_error(F.lit("empty FASTA header"))).otherwise(name).alias("id"), F.when(described != "", described).alias("description"), strings.normalize(rest).alias("seq"))


def check_start(spark: SparkSession, path) -> None:
    """FormatError unless the first text of every file is a header and no header is empty; one scan, a row a file and task is shuffled."""
    lines = spark.read.text(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    files = lines.groupBy("f").agg(F.min_by(F.substring("raw", 1, 20), "k").alias("first"), F.bool_or(F.col("raw").rlike(r"^>\s*$")).alias("empty"))
    bad = files.where("empty or not startswith(first, '>')").limit(1).collect()
    if bad:
        raise FormatError("empty FASTA header" if bad[0].empty else f"a record starts with >, not {bad[0].first!r}")


def with_places(files: DataFrame) -> DataFrame:
    """Files with `_place`, their number in the order of paths; the paths are broadcast, not the contents."""
    numbered = files.select("path").select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("_place"))
    return files.join(F.broadcast(numbered), "path")


def scan_files(spark: SparkSession, path) -> DataFrame:
    """(pos, id, description, seq) by the record iterator: one task a file, from any store that Spark reads, every rule of parse() checked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        columns = ["pos", "id", "description", "seq"]
        for pdf in batches:
            for first, data in pdf[["_place", "content"]].itertuples(index=False):
                rows = []
                for k, r in enumerate(parse_bytes(bytes(data))):
                    rows.append((first * (1 << 33) + k, *r))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return with_places(files).select("_place", "content").mapInPandas(run, "pos long, id string, description string, seq string")


def records(df: DataFrame) -> DataFrame:
    """Columns of a RecordFrame for (pos, id, description, seq)."""
    return df.select("pos", "id", "description", "seq", F.array().cast(FEATURES).alias("features"), F.create_map().cast("map<string,array<string>>").alias("annotations"))


def sampled_kind(df: DataFrame) -> str:
    """Kind of a frame by the first record's sequence."""
    first = df.orderBy("pos").select(F.col("seq").alias("s")).first()
    if first is None:
        return "dna"
    return kind_of(df.sparkSession, first.s)


def first_sample(spark: SparkSession, path, bases: int = SAMPLE_BASES) -> str:
    """Lines of the first record's sequence, up to the line that makes them `bases` symbols."""
    out, size, inside = [], 0, False
    for r in spark.read.text(path).limit(4 * bases).toLocalIterator():
        if r.value.startswith(">"):
            if inside:
                break
            inside = True
        elif inside:
            out.append("".join(r.value.split()))
            size += len(out[-1])
            if size >= bases:
                break
    return "".join(out)


def kind_of(spark: SparkSession, sample: str) -> str:
    return spark.range(1).select(strings.detect_kind(F.lit(sample))).first()[0]


def read_fasta(spark: SparkSession, path, alphabet: str = "auto", check: bool = True) -> RecordFrame:
    """Records of FASTA files. alphabet "auto" looks at the first record; a symbol outside it is an error when the frame runs."""
    if check:
        check_start(spark, path)
    got = scan(spark, path)
    kind = kind_of(spark, first_sample(spark, path)) if alphabet == "auto" else alphabet
    return RecordFrame(records(got.withColumn("seq", strings.validate(F.col("seq"), kind))), kind)


def read_fasta_bytes(spark: SparkSession, data: bytes, alphabet: str = "auto") -> RecordFrame:
    """Records of FASTA text in memory."""
    rows = [(k, *r) for k, r in enumerate(parse_bytes(data))]
    got = spark.createDataFrame(rows, "pos long, id string, description string, seq string")
    kind = sampled_kind(got) if alphabet == "auto" else alphabet
    return RecordFrame(records(got.withColumn("seq", strings.validate(F.col("seq"), kind))), kind, True)


def clean_header() -> Column:
    """Header text after its mark: id, then the description if there is one; line ends become blanks."""
    text = F.concat(F.col("id"), F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit(" "), F.col("description"))).otherwise(""))
    return F.regexp_replace(text, "[\r\n]", " ")


def write_fasta(path: str, frame: RecordFrame | Iterable[dict], line_width: int = 60, single: bool = False, mode: str = "errorifexists") -> None:
    """A folder of FASTA files of a frame or of records, in order of pos (with single, one file); line_width 0: no wrapping. An empty sequence is a blank line."""
    frame = RecordFrame.written(frame)
    if line_width < 0:
        raise ValueError("line width is at least 0")
    seq = F.regexp_replace("seq", f"(.{{{line_width}}})(?!$)", "$1\n") if line_width else F.col("seq")
    text = F.concat(F.lit(">"), clean_header(), F.lit("\n"), seq)
    ordered = frame.df.coalesce(1).sortWithinPartitions("pos") if single else frame.df.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.select(text.alias("value")).write.mode(mode).text(path)
