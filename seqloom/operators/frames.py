"""Ordered sequences and annotated records as DataFrames.

A SeqFrame holds (pos, seq), a RecordFrame (pos, id, description, seq, features,
annotations). pos orders the rows and is unique; it need not be gapless. Operations by
position make it gapless first, from counts of ranges of pos, so that no task sees more
than one range. Frames are immutable: what a list would change in place gives a new frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.errors import SequenceError
from seqloom.functions import nucleotide, protein, strings
from seqloom.functions.alphabets import KINDS, both_cases

SEQ_SCHEMA = "pos long, seq string"
RECORD_SCHEMA = "pos long, id string, description string, seq string, features array<struct<feature_type: string, location: struct<start: long, end: long, strand: tinyint>, qualifiers: map<string, array<string>>>>, annotations map<string, array<string>>"
SKIPPED_SCHEMA = "row long, id string, column string, message string"
#: Ranges of pos that a renumbering counts, at most.
RANGES = 1024


def renumber(df: DataFrame, pos: str = "pos") -> DataFrame:
    """pos as 0, 1, 2, ... in its own order.

    Bounds of near-equal ranges are estimated, rows counted by range (a row for each), and
    rows numbered inside their range. Equal values of pos are not told apart.
    """
    ranges = min(RANGES, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted(set(df.approxQuantile(pos, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    own = F.lit(0)
    if bounds:
        own = F.width_bucket(F.col(pos).cast("double"), F.lit(bounds[0]), F.lit(bounds[-1]), F.lit(len(bounds))).cast("int") if len(bounds) > 2 and len({round(b - a, 6) for a, b in zip(bounds, bounds[1:])}) == 1 else F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(pos).cast("double")))
    ranged = df.withColumn("_range", own)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(pos)) - 1
    return ranged.withColumn("_nth", nth).join(F.broadcast(offsets), "_range").withColumn(pos, F.col("_base") + F.col("_nth")).select(*df.columns)


def _bounds(n: int, start: int | None, stop: int | None, step: int) -> tuple[int, int, int]:
    return slice(start, stop, step).indices(n)


class _Frame:
    schema = ""

    def __init__(self, df: DataFrame, kind: str, gapless: bool = False):
        if kind not in KINDS:
            raise TypeError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")
        self.df, self.kind, self.gapless = df, kind, gapless

    def _new(self, df: DataFrame, gapless: bool = False, kind: str | None = None):
        return type(self)(df, kind or self.kind, gapless)

    def _same(self, other) -> None:
        if type(other) is not type(self) or other.kind != self.kind:
            raise TypeError(f"expected a {type(self).__name__} of {self.kind}")

    def numbered(self):
        """The same rows with pos 0, 1, 2, ..."""
        return self if self.gapless else self._new(renumber(self.df), True)

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def _ordered(self, *columns: str):
        return self.df.orderBy("pos").select(*columns).toLocalIterator()

    def lengths(self) -> DataFrame:
        return self.df.select("pos", strings.length(F.col("seq")).alias("length"))

    def copy(self):
        return self._new(self.df, self.gapless)

    def filter_by_len(self, min: int | None = None, max: int | None = None):
        """Rows whose length is within inclusive bounds; none if min is above max."""
        keep, n = F.lit(True), F.length("seq")
        if min is not None:
            keep = keep & (n >= min)
        if max is not None:
            keep = keep & (n <= max)
        return self._new(self.df.where(keep))

    def filter_empty(self):
        return self._new(self.df.where(F.length("seq") > 0))

    def at(self, i: int):
        """The row at position i, negative from the end; IndexError out of range."""
        own = self.numbered()
        n = own.count()
        if not -n <= i < n:
            raise IndexError("index out of range")
        return own.df.where(F.col("pos") == (i if i >= 0 else i + n)).first()

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1):
        """Rows start, start + step, ... before stop, renumbered; step is at least 1."""
        if step < 1:
            raise ValueError("step is at least 1")
        return self[start:stop:step]

    def __getitem__(self, key):
        if isinstance(key, int):
            return self.at(key)
        if not isinstance(key, slice):
            raise TypeError("an index is an int or a slice")
        own = self.numbered()
        n = own.count() if (key.step or 1) < 0 or any(x is not None and x < 0 for x in (key.start, key.stop)) else 2**62
        lo, hi, step = _bounds(n, key.start, key.stop, 1 if key.step is None else key.step)
        pos = F.col("pos")
        inside = (pos >= lo) & (pos < hi) if step > 0 else (pos <= lo) & (pos > hi)
        kept = own.df.where(inside & ((pos - lo) % abs(step) == 0))
        return self._new(kept.withColumn("pos", F.floor((pos - lo) / step).cast("long")), True)

    def take(self, indexes: Iterable[int]):
        """Rows by position, in the order asked for, repeats kept; IndexError out of range."""
        own = self.numbered()
        indexes = list(indexes)
        n = own.count()
        if any(not -n <= i < n for i in indexes):
            raise IndexError("index out of range")
        asked = self.df.sparkSession.createDataFrame([(k, i if i >= 0 else i + n) for k, i in enumerate(indexes)], "_to long, pos long")
        return self._new(own.df.join(asked, "pos").withColumn("pos", F.col("_to")).select(*self.df.columns), True)

    def extend(self, other):
        """The rows of other after these."""
        self._same(other)
        shift = self.df.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_shift"))
        low = other.df.agg(F.coalesce(F.min("pos"), F.lit(0)).alias("_low"))
        moved = other.df.crossJoin(F.broadcast(shift)).crossJoin(F.broadcast(low)).withColumn("pos", F.col("pos") - F.col("_low") + F.col("_shift")).select(*other.df.columns)
        return self._new(self.df.unionByName(moved), self.gapless and other.gapless)

    __add__ = extend

    def repeat(self, n: int):
        """The rows n times over; none for n <= 0."""
        if n <= 0:
            return self.clear()
        own = self.numbered()
        size = own.df.agg(F.count("*").alias("_size"))
        copies = own.df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).crossJoin(F.broadcast(size))
        return self._new(copies.withColumn("pos", F.col("_copy") * F.col("_size") + F.col("pos")).select(*self.df.columns), True)

    __mul__ = repeat

    def truncate(self, n: int):
        own = self.numbered()
        return self._new(own.df.where(F.col("pos") < n), True)

    def clear(self):
        return self._new(self.df.limit(0), True)

    def reserve(self, n: int):
        """Nothing: frames have no capacity."""
        return self

    def pop(self):
        """(last row, frame without it); IndexError if empty."""
        last = self.df.orderBy(F.desc("pos")).first()
        if last is None:
            raise IndexError("pop from an empty frame")
        return last, self._new(self.df.where(F.col("pos") < last.pos), self.gapless)

    def with_seq(self, seq: Column, kind: str | None = None):
        return self._new(self.df.withColumn("seq", seq), self.gapless, kind)

    def _nucleotide(self) -> None:
        if self.kind not in ("dna", "rna"):
            raise TypeError(f"DNA or RNA, not {self.kind}")


class SeqFrame(_Frame):
    """Ordered sequences of one kind."""

    @classmethod
    def of(cls, spark: SparkSession, seqs: Iterable[str], kind: str) -> SeqFrame:
        """From strings; an error names the first invalid symbol."""
        seqs = list(seqs)
        allowed = set(both_cases(KINDS[kind]))
        for s in seqs:
            if not isinstance(s, str):
                raise TypeError("sequences are strings")
            for k, c in enumerate(s):
                if c not in allowed:
                    raise SequenceError(f"invalid character {c!r} at position {k}")
        return cls(spark.createDataFrame(list(enumerate(seqs)), SEQ_SCHEMA), kind, True)

    def validated(self) -> SeqFrame:
        """The same, failing at the first invalid symbol when it runs."""
        return self.with_seq(strings.validate(F.col("seq"), self.kind))

    def __iter__(self):
        """Sequences in order, a partition at a time on the driver."""
        return (r.seq for r in self._ordered("seq"))

    def to_list(self) -> list[str]:
        return list(self)

    def append(self, seq: str) -> SeqFrame:
        return self.extend(SeqFrame.of(self.df.sparkSession, [seq], self.kind))

    def concat(self) -> str:
        """All sequences joined in order; an error for an empty frame. Ranges of pos are joined on the executors, the driver joins those."""
        ranged = self.df.select("pos", "seq").repartitionByRange("pos")
        parts = ranged.groupBy(F.spark_partition_id().alias("g")).agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "seq"))).alias("parts"))
        out = [r.seq for r in parts.orderBy("first").select(F.array_join(F.transform("parts", lambda x: x["seq"]), "").alias("seq")).toLocalIterator()]
        if not out:
            raise SequenceError("an empty frame can't be joined")
        return "".join(out)

    def concat_by(self, group: Column, name: str = "g") -> DataFrame:
        """(name, seq): the sequences of each group joined in order; a group without rows isn't there."""
        parts = self.df.select(group.alias(name), "pos", "seq").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("pos", "seq"))).alias("parts"))
        return parts.select(name, F.array_join(F.transform("parts", lambda x: x["seq"]), "").alias("seq"))

    def count_of(self, needle) -> DataFrame:
        """(pos, count) of occurrences that don't overlap; DNA and protein only."""
        if self.kind == "rna":
            raise TypeError("DNA or protein, not rna")
        return self.df.select("pos", strings.count(F.col("seq"), needle).alias("count"))

    def contains(self, needle) -> DataFrame:
        if self.kind == "rna":
            raise TypeError("DNA or protein, not rna")
        return self.df.select("pos", strings.contains(F.col("seq"), needle).alias("contains"))

    def complement(self) -> SeqFrame:
        self._nucleotide()
        return self.with_seq(nucleotide.complement(F.col("seq"), self.kind))

    def reverse_complements(self) -> SeqFrame:
        self._nucleotide()
        return self.with_seq(nucleotide.reverse_complement(F.col("seq"), self.kind))

    def transcribe(self) -> SeqFrame:
        if self.kind != "dna":
            raise TypeError(f"DNA, not {self.kind}")
        return self.with_seq(nucleotide.transcribe(F.col("seq")), "rna")

    def back_transcribe(self) -> SeqFrame:
        if self.kind != "rna":
            raise TypeError(f"RNA, not {self.kind}")
        return self.with_seq(nucleotide.back_transcribe(F.col("seq")), "dna")

    def translate(self, frame: int | str | None = None) -> SeqFrame:
        self._nucleotide()
        return self.with_seq(nucleotide.translate(F.col("seq"), frame, self.kind), "protein")

    def reverse(self) -> SeqFrame:
        return self.with_seq(F.reverse("seq"))

    def metric(self, name: str, *args) -> DataFrame:
        """(pos, value) of a protein function: counts, frequencies, aa_counts_20, molecular_weight, ..."""
        if self.kind != "protein":
            raise TypeError(f"protein, not {self.kind}")
        return self.df.select("pos", getattr(protein, name)(F.col("seq"), *args).alias(name))

    def map(self, f: Callable[[str], str], kind: str | None = None) -> SeqFrame:
        """f on every sequence, in Arrow batches; results are checked against the kind."""

        @F.pandas_udf("string")
        def run(seqs):
            return seqs.map(f)

        kind = kind or self.kind
        return self.with_seq(strings.validate(run(F.col("seq")), kind), kind)

    def map_bytes(self, f: Callable[[bytes], bytes], kind: str | None = None) -> SeqFrame:
        return self.map(lambda s: f(s.encode("latin-1")).decode("latin-1"), kind)

    def to_bytes(self) -> DataFrame:
        return self.df.select("pos", strings.to_bytes(F.col("seq")).alias("seq"))


def location(start: int, end: int, strand: int | None = None) -> dict:
    """[start, end), 0-based."""
    if start < 0 or start > end:
        raise SequenceError(f"a location runs from start to end, not {start} to {end}")
    if strand not in (None, -1, 1):
        raise SequenceError("strand is -1, 1 or None")
    return {"start": start, "end": end, "strand": strand}


def feature(kind: str, where: dict, qualifiers: dict[str, list[str]] | None = None) -> dict:
    if not kind:
        raise SequenceError("a feature has a type")
    for k, v in (qualifiers or {}).items():
        if not isinstance(k, str) or not isinstance(v, list) or not all(isinstance(x, str) for x in v):
            raise TypeError("qualifiers map a str to a list of str")
    return {"feature_type": kind, "location": where, "qualifiers": dict(qualifiers or {})}


def record(id: str, seq: str, description: str | None = None, features: list[dict] | None = None, annotations: dict[str, list[str]] | None = None) -> dict:
    return {"id": id, "seq": seq, "description": description, "features": list(features or []), "annotations": dict(annotations or {})}


def reverse_features(features: Column, length: Column) -> Column:
    """Features as they lie on the other strand; an error if one ends beyond the sequence."""
    n = length.cast("long")

    def turn(f: Column) -> Column:
        at = f["location"]
        end = F.when(at["end"] > n, F.raise_error(F.lit("feature ends beyond its sequence")).cast("long")).otherwise(at["end"])
        return f.withField("location", F.struct((n - end).alias("start"), (n - at["start"]).alias("end"), (-at["strand"]).cast("tinyint").alias("strand")))

    return F.transform(features, turn)


class RecordFrame(_Frame):
    """Ordered, annotated records of one kind; `skipped` holds rows that a reader left out."""

    def __init__(self, df: DataFrame, kind: str, gapless: bool = False, skipped: DataFrame | None = None):
        super().__init__(df, kind, gapless)
        self.skipped = df.sparkSession.createDataFrame([], SKIPPED_SCHEMA) if skipped is None else skipped

    @classmethod
    def of(cls, spark: SparkSession, records: Iterable[dict], kind: str) -> RecordFrame:
        rows = [(k, r["id"], r["description"], r["seq"], r["features"], r["annotations"]) for k, r in enumerate(records)]
        allowed = set(both_cases(KINDS[kind]))
        for r in rows:
            for k, c in enumerate(r[3]):
                if c not in allowed:
                    raise SequenceError(f"record {r[1]!r}: invalid character {c!r} at position {k}")
        return cls(spark.createDataFrame(rows, RECORD_SCHEMA), kind, True)

    @classmethod
    def written(cls, records) -> RecordFrame:
        """What a writer takes: a RecordFrame, or an iterable of records (checked for their fields, not for an alphabet)."""
        if isinstance(records, RecordFrame):
            return records
        if isinstance(records, (str, bytes, dict)) or not isinstance(records, Iterable):
            raise TypeError("a RecordFrame or records are written")
        rows = list(records)
        if not all(isinstance(r, dict) and {"id", "seq", "description", "features", "annotations"} <= set(r) for r in rows):
            raise TypeError("a RecordFrame or records are written")
        spark = SparkSession.getActiveSession()
        return cls(spark.createDataFrame([(k, r["id"], r["description"], r["seq"], r["features"], r["annotations"]) for k, r in enumerate(rows)], RECORD_SCHEMA), "protein", True)

    def __iter__(self):
        """Records in order, as record() makes them, a partition at a time on the driver."""
        for r in self._ordered("id", "seq", "description", "features", "annotations"):
            yield r.asDict(recursive=True)

    def ids(self) -> DataFrame:
        return self.df.select("pos", "id")

    def descriptions(self) -> DataFrame:
        return self.df.select("pos", "description")

    def seqs(self) -> SeqFrame:
        return SeqFrame(self.df.select("pos", "seq"), self.kind, self.gapless)

    def translate(self, frame: int | str | None = None) -> RecordFrame:
        """Proteins with ids, descriptions and annotations kept, features cleared."""
        self._nucleotide()
        out = self.df.withColumn("seq", nucleotide.translate(F.col("seq"), frame, self.kind)).withColumn("features", F.filter("features", lambda _: F.lit(False)))
        return RecordFrame(out, "protein", self.gapless)

    def reverse_complements(self) -> RecordFrame:
        """The other strand, features moved along."""
        self._nucleotide()
        out = self.df.withColumn("features", reverse_features(F.col("features"), F.length("seq"))).withColumn("seq", nucleotide.reverse_complement(F.col("seq"), self.kind))
        return RecordFrame(out, self.kind, self.gapless)
