"""Alphabets and constant tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol sets of the alphabets.
DNA_STRICT, DNA_N, DNA_IUPAC = "ACGT", "ACGTN", "ACGTRYSWKMBDHVN"
RNA_STRICT, RNA_N, RNA_IUPAC = "ACGU", "ACGUN", "ACGURYSWKMBDHVN"
PROTEIN_STRICT, PROTEIN_IUPAC = "ACDEFGHIKLMNPQRSTVWY", "ABCDEFGHIKLMNPQRSTVWXYZ*"
GAPS = "-."
PROTEIN_ONLY = "DEFHIKLMPQRSVWY"
METRIC_ORDER = "ARNDCEQGHILKMFPSTWYV"

# IUPAC complements of the upper-case symbols.
COMPLEMENT_FROM, DNA_COMPLEMENT_TO, RNA_COMPLEMENT_FROM, RNA_COMPLEMENT_TO = "ACGTRYKMDHVB", "TGCAYRMKHDBV", "ACGURYKMDHVB", "UGCAYRMKHDBV"

# NCBI translation table 1, codons in the order TCAG.
CODON_BASES = "TCAG"
CODON_TABLE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Average residue masses, water, Kyte-Doolittle hydropathy, pKa.
MASS = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326}
WATER = 18.01528
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "E": -3.5, "Q": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
PKA_N_TERM, PKA_C_TERM = 9.69, 2.34
PKA_BASIC = {"H": 6.00, "K": 10.53, "R": 12.48}
PKA_ACIDIC = {"C": 8.33, "D": 3.86, "E": 4.25, "Y": 10.07}

KINDS = {
    "dna": DNA_IUPAC, "rna": RNA_IUPAC, "protein": PROTEIN_IUPAC,
    "gapped_dna": DNA_IUPAC + GAPS, "gapped_protein": PROTEIN_IUPAC + GAPS,
}


def both_cases(symbols: str) -> str:
    return "".join(sorted(set(symbols.upper() + symbols.lower())))


def char_class(symbols: str) -> str:
    """The inside of a regular-expression class for these symbols."""
    return "".join("\\" + c if c in "\\]^-[&" else c for c in symbols)


def codons(kind: str = "dna") -> dict[str, str]:
    bases = CODON_BASES if kind == "dna" else CODON_BASES.replace("T", "U")
    return {a + b + c: CODON_TABLE[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


class Alphabet:
    """A set of symbols with the usual algebra, and checks of columns against it."""

    def __init__(self, symbols: Iterable[str | int] = ""):
        self.symbols = frozenset(chr(s) if isinstance(s, int) else s for s in symbols)

    def insert(self, symbol: str) -> Alphabet:
        return Alphabet(self.symbols | {symbol})

    def __len__(self) -> int:
        return len(self.symbols)

    def __contains__(self, symbol: str) -> bool:
        return symbol in self.symbols

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Alphabet) and self.symbols == other.symbols

    def __hash__(self) -> int:
        return hash(self.symbols)

    def is_empty(self) -> bool:
        return not self.symbols

    def max_symbol(self) -> str | None:
        return max(self.symbols, default=None)

    def union(self, other: Alphabet) -> Alphabet:
        return Alphabet(self.symbols | other.symbols)

    def intersection(self, other: Alphabet) -> Alphabet:
        return Alphabet(self.symbols & other.symbols)

    def difference(self, other: Alphabet) -> Alphabet:
        return Alphabet(self.symbols - other.symbols)

    def is_word(self, text: Column | str) -> Column | bool:
        """Whether every symbol belongs to the alphabet; true for an empty text."""
        if isinstance(text, str):
            return set(text) <= self.symbols
        return F.length(F.translate(text, "".join(sorted(self.symbols)), "")) == 0 if self.symbols else F.length(text) == 0

    def ranks(self) -> RankTransform:
        return RankTransform(self)


class RankTransform:
    """Symbols by their rank in byte order, and rolling codes of q-grams."""

    def __init__(self, alphabet: Alphabet):
        self.alphabet = alphabet
        self.rank = {s: k for k, s in enumerate(sorted(alphabet.symbols))}

    def get(self, symbol: str) -> int | None:
        return self.rank.get(symbol)

    def width(self) -> int:
        """Bits that hold any rank."""
        return max(0, len(self.rank) - 1).bit_length()

    def _map(self) -> Column:
        return F.create_map(*[F.lit(x) for pair in self.rank.items() for x in pair])

    def transform(self, text: Column) -> Column:
        """array<int> of ranks; a symbol without one is an error."""
        table = self._map()
        chars = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))
        return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("symbol without a rank: "), c)).cast("int")))

    def qgrams(self, q: int, text: Column) -> Column:
        """array<long> with the code of every q-gram, left to right; empty for texts under q symbols."""
        bits = self.width()
        if q < 1 or bits * q > 64:
            raise ValueError(f"q-grams of {q} symbols of {bits} bits don't fit 64 bits")
        steps = F.sequence(F.lit(1), F.length(text) - q + 1)

        def codes(ranks: Column) -> Column:
            # each code from q ranks: at most 64 steps
            code = lambda i: F.aggregate(F.slice(ranks, i, F.lit(q)), F.lit(0).cast("long"), lambda a, r: F.shiftleft(a, bits).bitwiseOR(r.cast("long")))
            return F.transform(steps, code)

        # as a lambda's argument the ranks are computed once, not for every step
        bound = F.transform(F.array(self.transform(text)), codes)[0]
        return F.when(F.length(text) < q, F.array().cast("array<bigint>")).otherwise(bound)

    def rev_qgrams(self, q: int, text: Column) -> Column:
        return F.reverse(self.qgrams(q, text))


DNA, DNA_WITH_N, DNA_FULL = (Alphabet(both_cases(s)) for s in (DNA_STRICT, DNA_N, DNA_IUPAC))
RNA, RNA_WITH_N, RNA_FULL = (Alphabet(both_cases(s)) for s in (RNA_STRICT, RNA_N, RNA_IUPAC))
PROTEIN, PROTEIN_FULL = (Alphabet(both_cases(s)) for s in (PROTEIN_STRICT, PROTEIN_IUPAC))
LETTERS = Alphabet(both_cases("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
