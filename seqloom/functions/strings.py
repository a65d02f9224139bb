"""Functions that DNA, RNA and protein sequences share; every one takes and returns Columns.

Positions count from 0. Window bounds are normalised like slice bounds (negative from the
end) and clamped to the sequence; an empty needle is found at the clamped bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.errors import SequenceError
from seqloom.functions.alphabets import KINDS, PROTEIN_ONLY, both_cases, char_class

WHITE = " \t\n\r\f\x0b"
NO_STRINGS = lambda: F.array().cast("array<string>")


def needle(x) -> Column:
    """A search argument: str, bytes-like, byte number, or a Column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, bool):
        raise TypeError("a needle is a str, bytes, an int from 0 to 255 or a Column")
    if isinstance(x, int):
        if not 0 <= x <= 255:
            raise ValueError("a byte is from 0 to 255")
        x = chr(x)
    elif isinstance(x, (bytes, bytearray, memoryview)):
        x = bytes(x).decode("latin-1")
    if not isinstance(x, str):
        raise TypeError("a needle is a str, bytes, an int from 0 to 255 or a Column")
    return F.lit(x)


# -- validity -----------------------------------------------------------------


def is_valid(seq: Column, kind: str) -> Column:
    """Whether all symbols are in the alphabet of this kind, either case."""
    return F.length(F.translate(seq, both_cases(KINDS[kind]), "")) == 0


def invalid_position(seq: Column, kind: str) -> Column:
    """0-based position of the first symbol outside the alphabet; null if there is none."""
    at = F.length(F.regexp_extract(seq, f"^[{char_class(both_cases(KINDS[kind]))}]*", 0))
    return F.when(at < F.length(seq), at.cast("long"))


def validate(seq: Column, kind: str) -> Column:
    """seq itself; an error naming symbol and position if a symbol is invalid."""
    at = invalid_position(seq, kind)
    said = F.concat(F.lit("invalid character '"), F.substring(seq, (at + 1).cast("int"), F.lit(1)), F.lit("' at position "), at.cast("string"))
    return F.when(at.isNotNull(), F.raise_error(said)).otherwise(seq)


def normalize(seq: Column) -> Column:
    """seq without ASCII white space."""
    return F.translate(seq, WHITE, "")


def detect_kind(sample: Column) -> Column:
    """'protein' if a letter is in no nucleotide's strict set, else 'rna' for U without T, else 'dna'.

    Either case counts, code point by code point: ß is no S, though F.upper() makes it SS; ı and ſ are lower cases of I and S.
    """
    other = sample.rlike(f"[{both_cases(PROTEIN_ONLY)}ıſ]")
    return F.when(other, "protein").when(sample.rlike("[Uu]") & ~sample.rlike("[Tt]"), "rna").otherwise("dna")


# -- windows ------------------------------------------------------------------


def _bound(seq: Column, at: int | Column | None, default: Column) -> Column:
    if at is None:
        return default
    at = at if isinstance(at, Column) else F.lit(at)
    n = F.length(seq)
    return F.greatest(F.least(F.when(at < 0, at + n).otherwise(at), n), F.lit(0)).cast("int")


def _window(seq: Column, start, end) -> tuple[Column, Column, Column]:
    lo, hi = _bound(seq, start, F.lit(0)), _bound(seq, end, F.length(seq))
    if start is None and end is None:
        return seq, lo, hi
    return F.substring(seq, lo + 1, F.greatest(hi - lo, F.lit(0))), lo, hi


# -- search -------------------------------------------------------------------


def contains(seq: Column, sub) -> Column:
    return F.contains(seq, needle(sub))


def count(seq: Column, sub) -> Column:
    """Occurrences that don't overlap, left to right; one more than the length for an empty needle."""
    sub = needle(sub)
    return F.when(F.length(sub) == 0, F.length(seq) + 1).otherwise(F.expr("0") + ((F.length(seq) - F.length(F.replace(seq, sub, F.lit("")))) / F.greatest(F.length(sub), F.lit(1)))).cast("long")


def count_overlap(seq: Column, sub) -> Column:
    """Positions at which the needle starts."""
    sub = needle(sub)
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(sub, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(sub) == 0, F.length(seq) + 1).otherwise(F.regexp_count(seq, quoted)).cast("long")


def find(seq: Column, sub, start=None, end=None) -> Column:
    """First position in the window, or -1."""
    sub = needle(sub)
    w, lo, hi = _window(seq, start, end)
    at = F.instr(w, sub)
    return F.when(lo > hi, -1).when(F.length(sub) == 0, lo).when(at == 0, -1).otherwise(lo + at - 1).cast("long")


def rfind(seq: Column, sub, start=None, end=None) -> Column:
    """Last position in the window, or -1."""
    sub = needle(sub)
    w, lo, hi = _window(seq, start, end)
    at = F.instr(F.reverse(w), F.reverse(sub))
    return F.when(lo > hi, -1).when(F.length(sub) == 0, hi).when(at == 0, -1).otherwise(lo + F.length(w) - at - F.length(sub) + 1).cast("long")


def _found(at: Column) -> Column:
    return F.when(at < 0, F.raise_error(F.lit("subsequence not found")).cast("long")).otherwise(at)


def index(seq: Column, sub, start=None, end=None) -> Column:
    return _found(find(seq, sub, start, end))


def rindex(seq: Column, sub, start=None, end=None) -> Column:
    return _found(rfind(seq, sub, start, end))


def _any_of(test, seq: Column, x, start, end) -> Column:
    w, lo, hi = _window(seq, start, end)
    out = F.lit(False)
    for one in x if isinstance(x, tuple) else (x,):
        out = out | test(w, needle(one))
    return out & (lo <= hi)


def startswith(seq: Column, x, start=None, end=None) -> Column:
    """Whether the window starts with x, or with any of a tuple."""
    return _any_of(F.startswith, seq, x, start, end)


def endswith(seq: Column, x, start=None, end=None) -> Column:
    return _any_of(F.endswith, seq, x, start, end)


# -- parts --------------------------------------------------------------------


def _quoted(sep: str) -> str:
    return "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split(seq: Column, sep: str | None = None, maxsplit: int = -1) -> Column:
    """array<string>: parts between separators, or between runs of white space for None."""
    if sep == "":
        raise ValueError("empty separator")
    if sep is not None:
        return F.split(seq, _quoted(sep), maxsplit + 1 if maxsplit >= 0 else -1)
    s = F.regexp_replace(seq, "^[ \\t\\n\\r\\f\\x0B]+", "")
    s = s if maxsplit >= 0 else F.regexp_replace(s, "[ \\t\\n\\r\\f\\x0B]+\\z", "")
    # the last part keeps what follows it, but for trailing blanks when all splits were not used up
    parts = F.split(s, "[ \\t\\n\\r\\f\\x0B]+", maxsplit + 1 if maxsplit >= 0 else -1)
    return F.when(F.length(s) == 0, NO_STRINGS()).otherwise(F.filter(parts, lambda p: F.length(p) > 0))


def rsplit(seq: Column, sep: str | None = None, maxsplit: int = -1) -> Column:
    """As split(), counting splits from the right."""
    if sep == "":
        raise ValueError("empty separator")
    if sep is not None:
        return F.reverse(F.transform(F.split(F.reverse(seq), _quoted(sep[::-1]), maxsplit + 1 if maxsplit >= 0 else -1), lambda p: F.reverse(p)))
    return F.reverse(F.transform(split(F.reverse(seq), None, maxsplit), lambda p: F.reverse(p)))


def _strip(seq: Column, chars: str | None, left: bool, right: bool) -> Column:
    chars = WHITE if chars is None else chars
    if not chars:
        return seq
    if left and right:
        return F.btrim(seq, F.lit(chars))
    return F.ltrim(seq, F.lit(chars)) if left else F.rtrim(seq, F.lit(chars))


def strip(seq: Column, chars: str | None = None) -> Column:
    """seq without any of a set of symbols at either end; white space for None."""
    return _strip(seq, chars, True, True)


def lstrip(seq: Column, chars: str | None = None) -> Column:
    return _strip(seq, chars, True, False)


def rstrip(seq: Column, chars: str | None = None) -> Column:
    return _strip(seq, chars, False, True)


def upper(seq: Column) -> Column:
    return F.upper(seq)


def lower(seq: Column) -> Column:
    return F.lower(seq)


def get(seq: Column, i: int) -> Column:
    """The symbol at position i, negative from the end; an error out of range."""
    at = F.lit(i) if i >= 0 else F.length(seq) + i
    return F.when((at < 0) | (at >= F.length(seq)), F.raise_error(F.lit("sequence index out of range"))).otherwise(F.substring(seq, at + 1, F.lit(1)))


def slice_(seq: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """seq[start:stop:step] by the rules of Python."""
    if step == 0:
        raise ValueError("slice step cannot be zero")
    n = F.length(seq)
    if step == 1:
        return _window(seq, start, stop)[0]
    if step > 0:
        lo, hi = _bound(seq, start, F.lit(0)), _bound(seq, stop, n)
        empty, last = lo >= hi, hi - 1
    else:
        edge = lambda x: F.greatest(F.least(F.when(F.lit(x) < 0, F.lit(x) + n).otherwise(F.lit(x)), n - 1), F.lit(-1))
        lo = n - 1 if start is None else edge(start)
        last = F.lit(0) if stop is None else edge(stop) + 1
        empty = lo < last
    picked = F.transform(F.sequence(lo, F.when(empty, lo).otherwise(last), F.lit(step)), lambda i: F.substring(seq, i + 1, F.lit(1)))
    return F.when(empty, F.lit("")).otherwise(F.array_join(picked, ""))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def repeat(seq: Column, n: int | Column) -> Column:
    """seq n times; empty for n <= 0."""
    return F.repeat(seq, n if isinstance(n, Column) else F.lit(n))


def length(seq: Column) -> Column:
    return F.length(seq).cast("long")


def to_bytes(seq: Column) -> Column:
    return seq.cast("binary")


def symbols(seq: Column) -> Column:
    """array<string> of the symbols; explode it to iterate."""
    return F.when(F.length(seq) == 0, NO_STRINGS()).otherwise(F.split(seq, ""))


def identity(seq: Column) -> Column:
    """A hash that equal sequences share."""
    return F.xxhash64(seq)


def represent(seq: Column, kind: str) -> Column:
    """The sequence as a constructor call, e.g. DNA("ACGT")."""
    names = {"dna": "DNA", "rna": "RNA", "protein": "Protein", "gapped_dna": "GappedDNA", "gapped_protein": "GappedProtein"}
    return F.concat(F.lit(names[kind] + '("'), seq, F.lit('")'))


def compare(a: Column, op: str, b: Column) -> Column:
    """Bytewise comparison by one of == != < <= > >=."""
    ops = {"==": a.__eq__, "!=": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}
    if op not in ops:
        raise SequenceError(f"unknown comparison {op!r}")
    return ops[op](b)


def ungapped(seq: Column) -> Column:
    """seq without gap symbols."""
    return F.translate(seq, "-.", "")
