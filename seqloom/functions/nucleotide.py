"""Functions on DNA and RNA columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.alphabets import COMPLEMENT_FROM, DNA_COMPLEMENT_TO, RNA_COMPLEMENT_FROM, RNA_COMPLEMENT_TO, codons


def _pair(kind: str) -> tuple[str, str]:
    if kind not in ("dna", "rna"):
        raise TypeError(f"DNA or RNA, not {kind}")
    a, b = (COMPLEMENT_FROM, DNA_COMPLEMENT_TO) if kind == "dna" else (RNA_COMPLEMENT_FROM, RNA_COMPLEMENT_TO)
    return a + a.lower(), b + b.lower()


def complement(seq: Column, kind: str = "dna") -> Column:
    """IUPAC complement, case kept."""
    return F.translate(seq, *_pair(kind))


def reverse_complement(seq: Column, kind: str = "dna") -> Column:
    return F.reverse(complement(seq, kind))


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def back_transcribe(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def gc_content(seq: Column) -> Column:
    """Share of G and C, either case, in the whole length; 0 for an empty sequence."""
    n = F.length(seq)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.translate(seq, "GCgc", ""))) / n)


def _codons(seq: Column, kind: str) -> Column:
    """Translation of a sequence whose length is a multiple of three."""
    table = F.create_map(*[F.lit(x) for pair in codons(kind).items() for x in pair])
    triples = F.regexp_extract_all(F.upper(seq), F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(triples, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def translate_frame(seq: Column, frame: int = 1, kind: str = "dna") -> Column:
    """Translation from offset frame - 1; bases left over are dropped."""
    if frame not in (1, 2, 3):
        raise ValueError("frame is 1, 2, 3 or 'auto'")
    return _codons(seq if frame == 1 else F.substring(seq, F.lit(frame), F.length(seq)), kind)


def translate(seq: Column, frame: int | str | None = None, kind: str = "dna") -> Column:
    """Standard code; stops are *, codons with other than A, C, G, T (U) are X.

    frame None: the length must be a multiple of three, else an error. 1, 2, 3: that
    frame. "auto": the frame whose open reading frame (from its first M to the next stop)
    is longest; ties go to the earlier M, then to the lower frame; without any M frame 1.
    """
    _pair(kind)
    if frame is None:
        return F.when(F.length(seq) % 3 != 0, F.raise_error(F.concat(F.lit("length is not a multiple of 3: "), F.length(seq).cast("string")))).otherwise(_codons(seq, kind))
    if frame != "auto":
        return translate_frame(seq, frame, kind)
    rank = []
    for k in (1, 2, 3):
        p = translate_frame(seq, k, kind)
        orf = F.length(F.regexp_extract(p, "M[^*]*", 0))
        rank.append(F.struct(orf.alias("orf"), F.when(orf == 0, 0).otherwise(-F.instr(p, "M")).alias("start"), F.lit(-k).alias("frame"), p.alias("protein")))
    return F.array_max(F.array(*rank))["protein"]


def translate_fast(seq: Column, frame: int = 1, kind: str = "dna") -> Column:
    """translate_frame() by table look-up over Arrow batches, for long sequences."""
    import numpy as np

    code = np.full(256, 64, np.uint8)
    for k, b in enumerate("TCAG" if kind == "dna" else "UCAG"):
        code[ord(b)] = code[ord(b.lower())] = k
    from seqloom.functions.alphabets import CODON_TABLE

    amino = np.frombuffer(CODON_TABLE.encode(), np.uint8)

    @F.pandas_udf("string")
    def run(seqs):
        import pandas as pd

        out = []
        for s in seqs:
            if s is None:
                out.append(None)
                continue
            c = code[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)[frame - 1 :]].astype(np.int64)
            c = c[: len(c) // 3 * 3].reshape(-1, 3)
            known = (c < 4).all(axis=1)
            out.append(np.where(known, amino[np.where(known, c @ np.array([16, 4, 1]), 0)], ord("X")).astype(np.uint8).tobytes().decode())
        return pd.Series(out, dtype=object)

    return run(seq)
