"""FASTQ: strict four-line records, read by splits, and a writer. Qualities are checked and dropped."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.errors import FormatError
from seqloom.functions import strings
from seqloom.operators.frames import RecordFrame
from seqloom.sources.fasta import _header, clean_header, records, sampled_kind

SCHEMA = "pos long, id string, description string, seq string, quality string"


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str | None, str, str]]:
    """(id, description, seq, quality) of each record of an open file, one at a time. Blank lines may stand before a header only."""
    numbered = enumerate((x.rstrip("\n").rstrip("\r") for x in lines), 1)
    for number, head in numbered:
        if not head.strip():
            continue
        if not head.startswith("@"):
            raise FormatError(f"line {number}: a record starts with @")
        name, about = _header(head[1:], number)
        rest = [next(numbered, None) for _ in range(3)]
        if None in rest:
            raise FormatError(f"line {number}: the record is cut short")
        (_, seq), (at, plus), (end, quality) = rest
        if not plus.startswith("+"):
            raise FormatError(f"line {at}: the third line of a record starts with +")
        if len(seq.encode()) != len(quality.encode()):
            raise FormatError(f"line {end}: sequence and quality differ in length")
        yield name, about, seq, quality


def parse_bytes(data: bytes) -> Iterator[tuple[str, str | None, str, str]]:
    return parse(io.StringIO(data.decode("utf-8"), newline="\n"))


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(path)
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split("\n")

    def partitions(self):
        return [_File(k, p) for k, p in enumerate(self.paths)]

    def read(self, partition):
        with open(partition.path, encoding="utf-8", newline="\n") as f:
            for k, (name, about, seq, quality) in enumerate(parse(f)):
                yield (partition.number << 33) + k, name, about, seq, quality


class FastqSource(DataSource):
    """format("seqloom-fastq"): options paths, one file a line, that every executor can open."""

    @classmethod
    def name(cls):
        return "seqloom-fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of one split each: ((path, block, ...), lines). A split's lines come in order."""
    for b in batches:
        paths, blocks = b.column("path"), b.column("block").to_numpy()
        new = pc.not_equal(paths.slice(1), paths.slice(0, max(0, len(b) - 1))).to_numpy(zero_copy_only=False) | (blocks[1:] != blocks[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield (paths[lo].as_py(), int(blocks[lo])), b.slice(lo, hi - lo)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split and for each line of a record (0 to 3) that it may begin with: the line that it ends before, records begun, lines of the last one; and its first three lines."""
    now, ends, begun, tails, head = None, [], [], [], []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": now[0], "block": now[1], "ends": ends, "begun": begun, "tails": tails, "head": head}], schema=_ENDS)

    for key, piece in _runs(batches):
        if key != now:
            if now is not None:
                yield row()
            now, ends, begun, tails, head = key, [0, 1, 2, 3], [0] * 4, [[] for _ in range(4)], []
        lines, n = piece.column("value"), len(piece)
        head = head + lines.slice(0, 3 - len(head)).to_pylist() if len(head) < 3 else head
        blank = pc.any(pc.equal(pc.binary_length(pc.utf8_trim_whitespace(lines)), 0)).as_py()
        text = lines.to_pylist() if blank else lines.slice(max(0, n - 3)).to_pylist()
        for s in range(4):
            at, tail = ends[s], tails[s]
            if not blank:  # every line moves on by one
                first = -at % 4
                begun[s] += max(0, (n - first + 3) // 4)
                at = (at + n) % 4
                tail = (tail + text)[-at:] if at else []
            else:
                for x in text:
                    if at or x.strip():
                        begun[s] += not at
                        tail = [*tail, x]
                        at = (at + 1) % 4
                        tail = tail if at else []
            ends[s], tails[s] = at, tail
    if now is not None:
        yield row()


_ENDS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int32())), ("begun", pa.list_(pa.int64())), ("tails", pa.list_(pa.list_(pa.string()))), ("head", pa.list_(pa.string()))])


def _placed(table: pa.Table) -> pa.Table:
    """Of each split of a file the line that it begins with and the records begun before; and the record that ends in it, begun in an earlier one."""
    out, at, base, held = [], 0, 0, []
    for r in table.sort_by("block").to_pylist():
        row = {"path": r["path"], "block": r["block"], "start": at, "base": base, "over": None}
        if at:
            held = held + r["head"][: 4 - at]
            if len(held) == 4:
                row["over"] = held
                held = r["tails"][at]
        else:
            held = r["tails"][0]
        out.append(row)
        base += r["begun"][at]
        at = r["ends"][at]
    if held:
        raise FormatError(f"{out[-1]['path']}: the last record is cut short")
    return pa.Table.from_pylist(out, schema=_PLACED)


_PLACED = pa.schema([("path", pa.string()), ("block", pa.int64()), ("start", pa.int32()), ("base", pa.int64()), ("over", pa.list_(pa.string()))])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in one split as a whole."""
    now, held, k, skip = None, [], 0, 0
    for key, piece in _runs(batches):
        if key != now:
            now, held, skip = key, [], -piece.column("start")[0].as_py() % 4
            k = (piece.column("_place")[0].as_py() << 33) + piece.column("base")[0].as_py()
        lines = piece.column("value").to_pylist()
        lines, skip = held + lines[skip:], max(0, skip - len(lines))
        out, at = [], 0
        while True:
            while at < len(lines) and not lines[at].strip():
                at += 1
            if at + 4 > len(lines):
                break
            out.append((k, *next(parse(lines[at : at + 4]))))
            at, k = at + 4, k + 1
        held = lines[at:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 4))], ["pos", "id", "description", "seq", "quality"])


def _over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for place, base, lines in zip(b.column("_place").to_pylist(), b.column("base").to_pylist(), b.column("over").to_pylist()):
            row = next(parse(lines))
            yield pa.RecordBatch.from_arrays([pa.array([(place << 33) + base - 1], pa.int64()), *[pa.array([x], pa.string()) for x in row]], ["pos", "id", "description", "seq", "quality"])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, description, seq, quality) of FASTQ files, from any store that Spark reads, a large file by splits.

    A first pass finds with which of a record's four lines each split begins (for each of the
    four it might be, composed over the splits of a file). A row a split is broadcast, some 100
    bytes of it. The second pass reads the records inside splits; a record over an edge comes from
    the first pass's rows, whose shuffle both users share.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))
    ends = text.mapInArrow(_ends, "path string, block long, ends array<int>, begun array<long>, tails array<array<string>>, head array<string>")
    placed = ends.groupBy("path").applyInArrow(_placed, "path string, block long, start int, base long, over array<string>")
    placed = placed.withColumn("_place", (F.dense_rank().over(Window.orderBy("path")) - 1).cast("long"))
    inside = text.join(F.broadcast(placed.drop("over")), ["path", "block"]).mapInArrow(_whole, SCHEMA)
    return inside.unionByName(placed.where("over IS NOT NULL").mapInArrow(_over, SCHEMA))


def _frame(got: DataFrame, alphabet: str, quality: bool) -> RecordFrame:
    kind = sampled_kind(got) if alphabet == "auto" else alphabet
    got = got.withColumn("seq", strings.validate(F.col("seq"), kind))
    out = records(got)
    if quality:
        out = got.select("pos", "quality").join(out, "pos").select(*out.columns, "quality")
    return RecordFrame(out, kind)


def read_fastq(spark: SparkSession, path: str, alphabet: str = "auto") -> RecordFrame:
    """Records of FASTQ files; the quality is checked for length and dropped."""
    return _frame(scan(spark, path), alphabet, False)


def read_fastq_bytes(spark: SparkSession, data: bytes, alphabet: str = "auto") -> RecordFrame:
    return _frame(spark.createDataFrame([(k, *r) for k, r in enumerate(parse_bytes(data))], SCHEMA), alphabet, False)


def write_fastq(path: str, frame: RecordFrame | Iterable[dict], quality_char: str = "I", single: bool = False, mode: str = "errorifexists") -> None:
    """A folder of FASTQ files in order of pos, with one quality character throughout."""
    frame = RecordFrame.written(frame)
    if len(quality_char) != 1 or not quality_char.isascii() or quality_char in "\r\n":
        raise ValueError("the quality is one ASCII character and no line end")
    text = F.concat(F.lit("@"), clean_header(), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit(quality_char), F.length("seq")))
    ordered = frame.df.coalesce(1).sortWithinPartitions("pos") if single else frame.df.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.select(text.alias("value")).write.mode(mode).text(path)
