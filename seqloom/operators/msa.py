"""Multiple alignments: frames of gapped rows, column conservation, an external aligner."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import FormatError, SequenceError
from seqloom.functions.alphabets import KINDS, both_cases
from seqloom.operators.frames import RecordFrame

SCHEMA = "msa_id long, pos long, id string, aligned string"
#: Names the aligner's binary, before the search path.
BINARY_VARIABLE = "SEQLOOM_CLUSTALO"
FORBIDDEN = ("-i", "-o", "--force", "--outfmt", "--seqtype", "--threads")


class Alignment:
    """Rows of one width in a frame (msa_id, pos, id, aligned); one frame may hold many alignments."""

    def __init__(self, df: DataFrame, kind: str):
        if kind not in ("dna", "protein"):
            raise TypeError(f"DNA or protein, not {kind}")
        self.df, self.kind = df, kind

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple[str, str]], kind: str, msa_id: int = 0) -> Alignment:
        """From (id, gapped) pairs: at least one row, equal widths, valid symbols."""
        rows = list(rows)
        if not rows:
            raise SequenceError("an alignment has at least one row")
        if len({len(s) for _, s in rows}) > 1:
            raise SequenceError("rows of an alignment have equal widths")
        allowed = set(both_cases(KINDS[f"gapped_{kind}"]))
        for name, s in rows:
            if not set(s) <= allowed:
                raise SequenceError(f"row {name!r} has an invalid character")
        return cls(spark.createDataFrame([(msa_id, k, i, s) for k, (i, s) in enumerate(rows)], SCHEMA), kind)

    def widths(self) -> DataFrame:
        """(msa_id, rows, width); an error for rows of unequal width."""
        out = self.df.groupBy("msa_id").agg(F.count("*").alias("rows"), F.min(F.length("aligned")).alias("low"), F.max(F.length("aligned")).alias("high"))
        width = F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(F.raise_error(F.lit("rows of an alignment have equal widths")).cast("int"))
        return out.select("msa_id", "rows", width.cast("long").alias("width"))

    def width(self) -> int:
        got = self.widths().first()
        return got.width if got else 0

    def __len__(self) -> int:
        return self.df.count()

    def _column(self, name: str) -> list[str]:
        return [r[0] for r in self.df.orderBy("msa_id", "pos").select(name).toLocalIterator()]

    def ids(self) -> list[str]:
        return self._column("id")

    def aligned_strings(self) -> list[str]:
        return self._column("aligned")

    seqs = aligned_strings

    def __iter__(self):
        for r in self.df.orderBy("msa_id", "pos").select("id", "aligned").toLocalIterator():
            yield r.id, r.aligned

    def __getitem__(self, key):
        """(id, aligned) of a row, negative from the end; of a slice, the alignment of its rows. Rows are numbered over all alignments of the frame, and only those asked for leave the cluster."""
        places = F.struct("msa_id", "pos")
        if isinstance(key, slice):
            keys = self.df.select(places.alias("p")).orderBy("p").collect()[key]
            asked = self.df.sparkSession.createDataFrame([(*r.p, k) for k, r in enumerate(keys)], "msa_id long, pos long, _to long")
            got = self.df.join(asked, ["msa_id", "pos"]).select(F.lit(0).cast("long").alias("msa_id"), F.col("_to").alias("pos"), "id", "aligned")
            return Alignment(got, self.kind)
        if isinstance(key, bool) or not isinstance(key, int):
            raise TypeError("an index is an int or a slice")
        order = ("msa_id", "pos") if key >= 0 else (F.desc("msa_id"), F.desc("pos"))
        got = self.df.orderBy(*order).offset(key if key >= 0 else -key - 1).limit(1).collect()
        if not got:
            raise IndexError("index out of range")
        return got[0].id, got[0].aligned

    def conservation(self) -> DataFrame:
        """(msa_id, col, conserved): a column whose symbols are equal in either case and no gap; of a single row every column.

        A task folds its rows of an alignment into one row (a mark where symbols differ, their
        number); those are few, and folded again.
        """

        def fold(batches):
            import numpy as np
            import pyarrow as pa

            held: dict[int, list] = {}  # msa_id: rows, columns that agree so far
            for b in batches:
                for m, row, n in zip(b.column("msa_id").to_pylist(), b.column("row"), b.column("n").to_pylist()):
                    own = np.frombuffer(row.as_buffer(), np.uint8)
                    if m not in held:
                        held[m] = [n, own.copy()]
                        continue
                    n_held, first = held[m]
                    if len(first) != len(own):
                        raise SequenceError("rows of an alignment have equal widths")
                    first[first != own] = 0
                    held[m][0] = n_held + n
                while len(held) > FOLDED:
                    m = next(iter(held))
                    n, own = held.pop(m)
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([own.tobytes()]), pa.array([n], pa.int64())], ["msa_id", "row", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([own.tobytes() for _, own in held.values()], pa.binary()), pa.array([n for n, _ in held.values()], pa.int64())], ["msa_id", "row", "n"])

        kind = "msa_id long, row binary, n long"
        rows = self.df.select("msa_id", F.upper("aligned").cast("binary").alias("row"), F.lit(1).cast("long").alias("n"))
        got = rows.mapInArrow(fold, kind).repartition("msa_id").mapInArrow(fold, kind)
        got = got.groupBy("msa_id").agg(F.sum("n").alias("n"), F.collect_list("row").alias("parts"))  # one part, or a few of a busy task
        cells = got.select("msa_id", "n", F.posexplode(_agreed()).alias("col", "c"))
        return cells.select("msa_id", F.col("col").cast("long").alias("col"), ((F.col("n") == 1) | ~F.col("c").isin("-", ".", "\x00")).alias("conserved"))

    def diagram(self) -> str:
        """Rows with right-aligned ids, and a line that marks conserved columns."""
        rows = list(self)
        if not rows:
            return ""
        pad = max(len(i) for i, _ in rows)
        marks = "".join("*" if r.conserved else " " for r in self.conservation().orderBy("col").collect())
        return "\n".join([f"{i:>{pad}}  {s}" for i, s in rows] + [" " * pad + "  " + marks])

    __str__ = diagram

    def __repr__(self) -> str:
        return f"Alignment({self.kind}, rows={len(self)}, width={self.width()})"


def _agreed():
    """The symbols of the parts' columns, NUL where parts differ."""
    split = lambda x: F.when(F.octet_length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x.cast("string"), ""))
    return F.aggregate(F.slice("parts", 2, F.size("parts")), split(F.col("parts")[0]), lambda z, x: F.zip_with(z, split(x), lambda a, b: F.when(a == b, a).otherwise("\x00")))


def find_clustalo() -> str:
    """Path of the external aligner. A path named by the variable is it or an error; RuntimeError if there is none anywhere."""
    named = os.environ.get(BINARY_VARIABLE)
    if named is not None:
        if not os.path.exists(named):
            raise FileNotFoundError(f"{BINARY_VARIABLE} names {named!r}, which does not exist")
        if not os.access(named, os.X_OK):
            raise PermissionError(f"{BINARY_VARIABLE} names {named!r}, which can't be run")
        return named
    found = shutil.which("clustalo")
    if not found:
        raise RuntimeError(f"Clustal Omega was not found: set {BINARY_VARIABLE} or add it to the search path")
    return found


def check_args(extra: Iterable[str] | None) -> list[str]:
    """Extra arguments, unless they touch input, output, format or threads."""
    if extra is not None and (isinstance(extra, (str, bytes)) or not isinstance(extra, (list, tuple))):
        raise TypeError("extra arguments are a list of strings")
    out = list(extra or ())
    for a in out:
        if not isinstance(a, str):
            raise TypeError("extra arguments are strings")
        name = a.split("=")[0]
        if name in FORBIDDEN or name.startswith(("--in", "--out")):
            raise ValueError(f"{name} is set by this function")
    return out


def parse_fasta(text: str) -> list[tuple[str, str]]:
    out: list[list] = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append([line[1:].split()[0] if line[1:].split() else "", []])
        elif line.strip():
            if not out:
                raise FormatError("a FASTA text starts with >")
            out[-1][1].append(line.strip())
    return [(i, "".join(s)) for i, s in out]


def run_clustalo(rows: list[tuple[str, str]], kind: str, threads: int | None = None, extra: Iterable[str] | None = None, binary: str | None = None) -> list[tuple[str, str]]:
    """Aligned rows of one group, in their order."""
    binary, extra = binary or find_clustalo(), check_args(extra)
    with tempfile.TemporaryDirectory() as d:
        source, out = os.path.join(d, "in.fa"), os.path.join(d, "out.fa")
        with open(source, "w") as f:
            f.writelines(f">{k}\n{s}\n" for k, (_, s) in enumerate(rows))
        run = subprocess.run([binary, "-i", source, "-o", out, "--force", "--outfmt=fasta", f"--seqtype={'DNA' if kind == 'dna' else 'Protein'}", *([f"--threads={threads}"] if threads else []), *extra], capture_output=True, text=True)
        if run.returncode:
            raise RuntimeError(f"Clustal Omega failed: {run.stderr.strip()}")
        with open(out) as f:
            got = dict(parse_fasta(f.read()))
    aligned = [(name, got[str(k)]) for k, (name, _) in enumerate(rows)]
    if len({len(s) for _, s in aligned}) > 1:
        raise SequenceError("the aligner gave rows of unequal width")
    return aligned


def _grouped(spark: SparkSession | None, records, kind: str | None) -> tuple[DataFrame, str | None]:
    """A frame of groups and the kind, for what msa() takes."""
    if isinstance(records, RecordFrame):
        return records.df.select(F.lit(0).cast("long").alias("msa_id"), "pos", "id", "seq"), records.kind
    if isinstance(records, (list, tuple)):
        if len(records) < 2:
            raise SequenceError("at least two sequences are aligned")
        if not all(isinstance(r, dict) and {"id", "seq"} <= set(r) for r in records):
            raise TypeError("records have an id and a seq")
        spark = spark or SparkSession.getActiveSession()
        return spark.createDataFrame([(0, k, r["id"], r["seq"]) for k, r in enumerate(records)], "msa_id long, pos long, id string, seq string"), kind
    if not isinstance(records, DataFrame):
        raise TypeError(f"a RecordFrame, records or a DataFrame are aligned, not {type(records).__name__}")
    return records, kind


#: Alignments that a task folds at once, at most.
FOLDED = 256


def msa(records: DataFrame | RecordFrame | list[dict], kind: str | None = None, algorithm: str = "clustalo", group: str = "msa_id", threads: int | None = None, extra_args: Iterable[str] | None = None, binary: str | None = None) -> Alignment:
    """Align each group of records (msa_id, pos, id, seq) of at least two rows with an external tool, groups in parallel.

    A RecordFrame is one group of its own kind; so is a list of records, of the kind given.
    """
    records, kind = _grouped(None, records, kind)
    if algorithm != "clustalo":
        raise ValueError(f"unknown algorithm {algorithm!r}; there is clustalo")
    if kind not in ("dna", "protein"):
        raise TypeError(f"DNA or protein, not {kind}")
    binary, extra = binary or find_clustalo(), check_args(extra_args)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        if len(pdf) < 2:
            raise SequenceError("at least two sequences are aligned")
        rows = run_clustalo(list(zip(pdf["id"], pdf["seq"])), kind, threads, extra, binary)
        return pd.DataFrame({"msa_id": pdf["msa_id"].to_numpy(), "pos": pdf["pos"].to_numpy(), "id": [i for i, _ in rows], "aligned": [s for _, s in rows]})

    grouped = records.select(F.col(group).alias("msa_id"), "pos", "id", "seq")
    return Alignment(grouped.groupBy("msa_id").applyInPandas(one, SCHEMA), kind)
