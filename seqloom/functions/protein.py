"""Functions on protein columns. Residues are looked up in either case; counts() keeps the case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.alphabets import HYDROPATHY, MASS, METRIC_ORDER, PKA_ACIDIC, PKA_BASIC, PKA_C_TERM, PKA_N_TERM, PROTEIN_STRICT, WATER
from seqloom.functions.strings import symbols

_OTHER = f"(?i)[^{PROTEIN_STRICT}]"


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def tally_function():
    """A function to array<long>: how often each of the 20 occurs in either case, in METRIC_ORDER, and last all other symbols; one pass, in Arrow batches."""
    import numpy as np

    table = np.full(256, len(METRIC_ORDER), np.int64)
    for k, a in enumerate(METRIC_ORDER):
        table[ord(a)] = table[ord(a.lower())] = k

    @F.pandas_udf("array<long>")
    def seq_tally(seqs):
        import pandas as pd

        one = lambda s: np.bincount(table[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)], minlength=len(METRIC_ORDER) + 1)
        return pd.Series([None if s is None else one(s) for s in seqs], dtype=object)

    return seq_tally


def _tally(seq: Column) -> Column:
    return tally_function()(seq)


def counts(seq: Column) -> Column:
    """array<struct<symbol, count>> of the symbols that occur, in byte order, case kept."""

    @F.pandas_udf("array<struct<symbol: string, count: long>>")
    def tally(seqs):
        import numpy as np
        import pandas as pd

        def one(s):
            codes, n = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_counts=True)
            return [{"symbol": chr(c), "count": k} for c, k in zip(codes.tolist(), n.tolist())]

        return pd.Series([None if s is None else one(s) for s in seqs], dtype=object)

    return tally(seq)


def frequencies(seq: Column) -> Column:
    """counts() over the length."""
    return F.transform(counts(seq), lambda x: F.struct(x["symbol"].alias("symbol"), (x["count"] / F.length(seq)).alias("frequency")))


def _twenty(seq: Column, name: str, value) -> Column:
    symbols20 = F.array(*[F.lit(a) for a in METRIC_ORDER])
    return F.zip_with(symbols20, F.slice(_tally(seq), 1, len(METRIC_ORDER)), lambda a, c: F.struct(a.alias("symbol"), value(c).alias(name)))


def aa_counts_20(seq: Column) -> Column:
    """array<struct<symbol, count>> of the 20 amino acids in fixed order, zeros kept, either case."""
    return _twenty(seq, "count", lambda c: c)


def aa_frequencies_20(seq: Column) -> Column:
    """aa_counts_20() over the whole length; zeros for an empty sequence."""
    return _twenty(seq, "frequency", lambda c: c / F.greatest(F.length(seq), F.lit(1)))


def shannon_entropy(seq: Column) -> Column:
    """Bits per symbol, case-sensitive; 0 for an empty sequence."""
    n = F.length(seq)
    return F.aggregate(counts(seq), F.lit(0.0), lambda a, x: a - x["count"] / n * F.log2(x["count"] / n)) + F.lit(0.0)


def _strict(seq: Column, value: Column, kind: str = "double") -> Column:
    at = F.length(F.regexp_extract(seq, f"(?i)^[{PROTEIN_STRICT}]*", 0))
    said = F.concat(F.lit("invalid residue '"), F.substring(seq, at + 1, F.lit(1)), F.lit("' at position "), at.cast("string"))
    return F.when(seq.rlike(_OTHER), F.raise_error(said).cast(kind)).otherwise(value)


def _tallied(seq: Column, value) -> Column:
    """value(the counts of the 20), or an error that names the first symbol that is none of them."""
    t = _tally(seq)
    at = F.length(F.regexp_extract(seq, f"(?i)^[{PROTEIN_STRICT}]*", 0))
    said = F.concat(F.lit("invalid residue '"), F.substring(seq, at + 1, F.lit(1)), F.lit("' at position "), at.cast("string"))
    return F.when(t[len(METRIC_ORDER)] > 0, F.raise_error(said).cast("double")).otherwise(value(t))


def _weighted(t: Column, weight: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for k, a in enumerate(METRIC_ORDER):
        total = total + t[k] * F.lit(float(weight[a]))
    return total


def molecular_weight(seq: Column) -> Column:
    """Average mass with one water; 0 for an empty sequence, an error for other than the 20."""
    return _tallied(seq, lambda t: F.when(F.length(seq) == 0, 0.0).otherwise(_weighted(t, MASS) + WATER))


def hydrophobicity(seq: Column) -> Column:
    """Mean hydropathy; 0 for an empty sequence, an error for other than the 20."""
    return _tallied(seq, lambda t: F.when(F.length(seq) == 0, 0.0).otherwise(_weighted(t, HYDROPATHY) / F.greatest(F.length(seq), F.lit(1))))


def hydrophobicity_profile(seq: Column, window: int) -> Column:
    """array<double>: mean hydropathy of every window; empty for shorter sequences.

    Sums run along the sequence, so the cost does not grow with the window.
    """
    if window < 1:
        raise ValueError("window is at least 1")
    import numpy as np

    table = np.full(256, np.nan)
    for a, v in HYDROPATHY.items():
        table[ord(a)] = table[ord(a.lower())] = v

    @F.pandas_udf("array<double>")
    def run(seqs):
        import pandas as pd

        out = []
        for s in seqs:
            if s is None:
                out.append(None)
                continue
            if len(s) < window:
                out.append([])
                continue
            v = table[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
            if np.isnan(v).any():
                at = int(np.flatnonzero(np.isnan(v))[0])
                raise ValueError(f"invalid residue '{s[at]}' at position {at}")
            sums = np.concatenate(([0.0], np.cumsum(v)))
            out.append((sums[window:] - sums[:-window]) / window)
        return pd.Series(out, dtype=object)

    return run(seq)


def _of(t: Column, symbol: str) -> Column:
    return t[METRIC_ORDER.index(symbol)]


def _charge(t: Column, ph: Column) -> Column:
    basic = lambda pka: F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), ph - F.lit(pka)))
    acidic = lambda pka: F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), F.lit(pka) - ph))
    total = basic(PKA_N_TERM) - acidic(PKA_C_TERM)
    for a, pka in PKA_BASIC.items():
        total = total + _of(t, a) * basic(pka)
    for a, pka in PKA_ACIDIC.items():
        total = total - _of(t, a) * acidic(pka)
    return total


def net_charge(seq: Column, ph: float | Column) -> Column:
    """Henderson-Hasselbalch charge with one terminus of each kind; an error for other than the 20."""
    return _tallied(seq, lambda t: _charge(t, ph if isinstance(ph, Column) else F.lit(float(ph))))


def isoelectric_point(seq: Column, steps: int = 60) -> Column:
    """The pH of no charge, by bisection on 0 to 14; an error for other than the 20.

    The seven counts are taken once; a fold halves the interval.
    """
    t = _tally(seq)
    groups = F.array(*[F.struct(_of(t, a).alias("n"), F.lit(pka).alias("pka"), F.lit(sign).alias("sign")) for sign, own in ((1, PKA_BASIC), (-1, PKA_ACIDIC)) for a, pka in own.items()], F.struct(F.lit(1).cast("long").alias("n"), F.lit(PKA_N_TERM).alias("pka"), F.lit(1).alias("sign")), F.struct(F.lit(1).cast("long").alias("n"), F.lit(PKA_C_TERM).alias("pka"), F.lit(-1).alias("sign")))

    def halve(z: Column, _: Column) -> Column:
        mid = (z["lo"] + z["hi"]) / 2
        charge = F.aggregate(z["groups"], F.lit(0.0), lambda a, g: a + g["sign"] * g["n"] / (F.lit(1.0) + F.pow(F.lit(10.0), g["sign"] * (mid - g["pka"]))))
        up = charge > 0
        return F.struct(F.when(up, mid).otherwise(z["lo"]).alias("lo"), F.when(up, z["hi"]).otherwise(mid).alias("hi"), z["groups"].alias("groups"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi"), groups.alias("groups"))
    return _tallied(seq, lambda _: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda z: (z["lo"] + z["hi"]) / 2))


def has_ambiguous(seq: Column) -> Column:
    """Whether a symbol is none of the 20."""
    return seq.rlike(_OTHER)


def validate_strict_20(seq: Column) -> Column:
    """seq itself; an error if a symbol is none of the 20."""
    return _strict(seq, seq, "string")


def unknown_positions(seq: Column) -> Column:
    """array<int> of 0-based positions of symbols that are none of the 20."""
    return F.filter(F.transform(symbols(seq), lambda c, i: F.when(c.rlike(_OTHER), i)), lambda i: i.isNotNull())
