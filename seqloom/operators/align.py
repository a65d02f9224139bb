"""Pairwise alignment with affine gaps, whole Arrow batches at a time.

Pairs of a batch are ordered by size, cut into blocks of bounded cells, and filled along
anti-diagonals: one numpy step handles a diagonal of all pairs of the block. A gap of
length k costs open + extend * (k - 1). Extending wins over opening only if strictly
better; a diagonal step wins ties over a deletion, that over an insertion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code orders of the alphabets and the public EDNAFULL and BLOSUM62 matrices.
DNA_CODES = "ATGCSWRYKMBVHDN"
PROTEIN_CODES = "ARNDCQEGHILKMFPSTWYVBZX*"
EDNAFULL = """
 5 -4 -4 -4 -4  1  1 -4 -4  1 -4 -1 -1 -1 -2
-4  5 -4 -4 -4  1 -4  1  1 -4 -1 -4 -1 -1 -2
-4 -4  5 -4  1 -4  1 -4  1 -4 -1 -1 -4 -1 -2
-4 -4 -4  5  1 -4 -4  1 -4  1 -1 -1 -1 -4 -2
-4 -4  1  1 -1 -4 -2 -2 -2 -2 -1 -1 -3 -3 -1
 1  1 -4 -4 -4 -1 -2 -2 -2 -2 -3 -3 -1 -1 -1
 1 -4  1 -4 -2 -2 -1 -4 -2 -2 -3 -1 -3 -1 -1
-4  1 -4  1 -2 -2 -4 -1 -2 -2 -1 -3 -1 -3 -1
-4  1  1 -4 -2 -2 -2 -2 -1 -4 -1 -3 -3 -1 -1
 1 -4 -4  1 -2 -2 -2 -2 -4 -1 -3 -1 -1 -3 -1
-4 -1 -1 -1 -1 -3 -3 -1 -1 -3 -1 -2 -2 -2 -1
-1 -4 -1 -1 -1 -3 -1 -3 -3 -1 -2 -1 -2 -2 -1
-1 -1 -4 -1 -3 -1 -3 -1 -3 -1 -2 -2 -1 -2 -1
-1 -1 -1 -4 -3 -1 -1 -3 -1 -3 -2 -2 -2 -1 -1
-2 -2 -2 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1
"""
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
MATRICES = {"EDNAFULL": EDNAFULL, "BLOSUM62": BLOSUM62}
RESULT = "struct<score: float, query_start: int, query_end: int, target_start: int, target_end: int, cigar: array<struct<op: string, len: int>>>"
#: Cells filled at once: with traceback a byte each, without it a diagonal of floats for each pair. A larger pair is traced piece by piece.
CELLS = 1 << 24
NONE = np.float32(-np.inf)


def matrix_names() -> list[str]:
    return sorted(MATRICES)


def matrix(name: str) -> np.ndarray:
    """A named matrix; case and blanks around the name don't count."""
    text = MATRICES.get(name.strip().upper())
    if text is None:
        raise ValueError(f"unknown matrix {name!r}; there are {', '.join(matrix_names())}")
    return np.array([row.split() for row in text.strip().splitlines()], np.int16)


@dataclass(frozen=True)
class Scoring:
    """How to score. end_gap True: gaps at the ends of a global alignment cost like any; False: they cost end_gap_open and end_gap_extend, 0 unless given.

    A matrix (name or square list, in code order) wins; without one, match and mismatch
    scores are used if either is given, else EDNAFULL for DNA and BLOSUM62 for protein.
    """

    match_score: int | None = None
    mismatch_score: int | None = None
    gap_open: float = -2.0
    gap_extend: float = -1.0
    matrix: str | tuple | list | None = None
    alphabet_size: int | None = None
    end_gap: bool = True
    end_gap_open: float | None = None
    end_gap_extend: float | None = None
    use_matrix: bool | None = None
    _table: tuple = field(default=(), repr=False)

    def __post_init__(self):
        for v in (self.gap_open, self.gap_extend, self.end_gap_open or 0.0, self.end_gap_extend or 0.0):
            if v > 0 or v != v:
                raise ValueError("gap costs are at most 0")
        for v in (self.match_score, self.mismatch_score):
            if v is not None and not -32768 <= v <= 32767:
                raise ValueError("scores are 16-bit integers")
        if isinstance(self.matrix, (list, tuple)):
            flat = [x for r in self.matrix for x in r] if self.matrix and isinstance(self.matrix[0], (list, tuple)) else list(self.matrix)
            size = self.alphabet_size or round(len(flat) ** 0.5)
            if size * size != len(flat):
                raise ValueError(f"a matrix of {size} symbols has {size * size} scores, not {len(flat)}")
            if any(not -32768 <= x <= 32767 for x in flat):
                raise ValueError("scores are 16-bit integers")
            object.__setattr__(self, "matrix", tuple(flat))

    @classmethod
    def with_matrix(cls, scores: list[int], size: int, **rest) -> Scoring:
        return cls(matrix=scores, alphabet_size=size, **rest)

    def table(self, kind: str) -> np.ndarray:
        """Scores of code pairs for this kind."""
        size = len(DNA_CODES if kind == "dna" else PROTEIN_CODES)
        if isinstance(self.matrix, str):
            got = matrix(self.matrix)
        elif self.matrix is not None:
            got = np.array(self.matrix, np.int16).reshape(round(len(self.matrix) ** 0.5), -1)
        elif self.use_matrix or (self.use_matrix is None and self.match_score is None and self.mismatch_score is None):
            got = matrix("EDNAFULL" if kind == "dna" else "BLOSUM62")
        else:
            same = 2 if self.match_score is None else self.match_score
            other = -1 if self.mismatch_score is None else self.mismatch_score
            got = np.full((size, size), other, np.int16)
            np.fill_diagonal(got, same)
        if len(got) != size:
            raise ValueError(f"{kind} needs a matrix of {size} symbols, not {len(got)}")
        return got.astype(np.float32)

    def ends(self) -> tuple[float, float]:
        """Costs of gaps at the ends of a global alignment."""
        if self.end_gap:
            return self.gap_open, self.gap_extend
        return self.end_gap_open or 0.0, self.end_gap_extend or 0.0


def encode(seq: str, kind: str) -> np.ndarray:
    """Codes of the symbols, either case, U as T; ValueError for another symbol."""
    table = np.full(256, 255, np.uint8)
    for k, c in enumerate(DNA_CODES if kind == "dna" else PROTEIN_CODES):
        table[ord(c)] = table[ord(c.lower())] = k
    if kind == "dna":
        table[ord("U")] = table[ord("u")] = table[ord("T")]
    codes = table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if (codes == 255).any():
        at = int(np.flatnonzero(codes == 255)[0])
        raise ValueError(f"symbol {seq[at]!r} at position {at} can't be aligned as {kind}")
    return codes


def _two_scores(qs: list[np.ndarray], ts: list[np.ndarray], table: np.ndarray) -> tuple[float, float] | None:
    """(score of equal symbols, of unequal ones), if the symbols that occur have no more than these."""
    there = np.zeros(len(table), bool)
    for x in (*qs, *ts):
        there[x] = True
    own = table[np.ix_(there, there)]
    equal, unequal = np.unique(np.diag(own)), np.unique(own[~np.eye(len(own), dtype=bool)])
    return (float(equal[0]), float(unequal[0]) if len(unequal) else float(equal[0])) if len(equal) == 1 and len(unequal) <= 1 else None


def _fill(qs: list[np.ndarray], ts: list[np.ndarray], table: np.ndarray, scoring: Scoring, local: bool, traceback: bool, first: int = 1, last: int | None = None, buffers: tuple | None = None, every: int = 0, saved: dict | None = None):
    """Scores, ends and trace bytes of a block of pairs; neither side is empty.

    Diagonal d holds cells (i, d - i), i from 0 on; buffers of three diagonals are used in turn.
    Filling may go on from the buffers of diagonal first - 1, end with a last one, and save
    its buffers after each `every` diagonals; the trace is that of diagonals first to last.
    """
    size = len(qs)
    ms, ns = np.array([len(q) for q in qs]), np.array([len(t) for t in ts])
    m, n = int(ms.max()), int(ns.max())
    width = len(table)
    two = _two_scores(qs, ts, table)
    kind = np.int32 if two is None else np.uint8
    q, t = np.full((size, m), width, kind), np.full((size, n), width + (two is not None), kind)
    for k in range(size):
        q[k, : ms[k]] = qs[k]
        t[k, : ns[k]] = ts[k]
    if two is None:
        # padding symbols score so low that no best cell lies among them
        wide = np.full((width + 1, width + 1), -1e9, np.float32)
        wide[:width, :width] = table
        flat = wide.ravel()
        t *= width + 1
    else:  # padding is unequal to all
        equal, unequal = (np.float32(x) for x in two)
    q = np.ascontiguousarray(q[:, ::-1])  # a diagonal is then a run of both
    go, ge = np.float32(scoring.gap_open), np.float32(scoring.gap_extend)
    eo, ee = (np.float32(x) for x in scoring.ends())
    special = not local and (eo, ee) != (go, ge)
    masked = go == 0 or ge == 0 or two is not None and two[1] >= 0  # free steps could carry a best score into the padding
    last = n + m if last is None else last
    trace = np.zeros((size, last - first + 1, n + 1), np.uint8) if traceback else None  # by diagonal and row: 1 D, 2 I, 3 stop; 4 D extends, 8 I extends
    if buffers is None:
        hs, es, fs = (np.full((3, size, n + 1), NONE, np.float32) for _ in range(3))
        hs[0, :, 0] = 0  # diagonal 0
    else:
        hs, es, fs = (x.copy() for x in buffers)
    everyone = np.arange(size)
    best, best_i, best_j = np.zeros(size, np.float32), np.zeros(size, np.int64), np.zeros(size, np.int64)
    final = np.zeros(size, np.float32)
    ending: dict[int, list[int]] = {}
    for k, d in enumerate((ns + ms).tolist()):
        ending.setdefault(d, []).append(k)
    for d in range(first, last + 1):
        h, e, f = hs[d % 3], es[d % 3], fs[d % 3]
        h1, e1, f1, h2 = hs[(d - 1) % 3], es[(d - 1) % 3], fs[(d - 1) % 3], hs[(d - 2) % 3]
        lo, hi = max(1, d - m), min(n, d - 1)  # rows with an inner cell
        if lo <= hi:
            at = slice(lo, hi + 1)
            up = slice(lo - 1, hi)
            e_open, e_ext = h1[:, up] + go, e1[:, up] + ge
            f_open, f_ext = h1[:, at] + go, f1[:, at] + ge
            if special:  # one cell of a pair at most is in its last column, one in its last row
                i = d - ms
                own = everyone[(i >= lo) & (i <= hi)]
                e_open[own, i[own] - lo] = h1[own, i[own] - 1] + eo
                e_ext[own, i[own] - lo] = e1[own, i[own] - 1] + ee
                own = everyone[(ns >= lo) & (ns <= hi)]
                f_open[own, ns[own] - lo] = h1[own, ns[own]] + eo
                f_ext[own, ns[own] - lo] = f1[own, ns[own]] + ee
            if two is None:
                top = flat[t[:, up] + q[:, m - d + lo : m - d + hi + 1]]
            else:
                top = (t[:, up] == q[:, m - d + lo : m - d + hi + 1]).astype(np.float32)
                top *= equal - unequal
                top += unequal
            top += h2[:, up]
            if traceback:
                bits = (e_ext > e_open).view(np.uint8) << 2 | (f_ext > f_open).view(np.uint8) << 3
            deletion, insertion = np.maximum(e_open, e_ext, out=e[:, at]), np.maximum(f_open, f_ext, out=f[:, at])
            if traceback:
                move = (deletion > top).view(np.uint8)
                np.maximum(top, deletion, out=top)
                np.maximum(move, (insertion > top).view(np.uint8) << 1, out=move)
                np.maximum(top, insertion, out=top)
                if local:
                    np.maximum(move, (top < 0).view(np.uint8) * np.uint8(3), out=move)
                np.bitwise_or(bits, move, out=trace[:, d - first, at])
            else:
                np.maximum(top, deletion, out=top)
                np.maximum(top, insertion, out=top)
            if local:
                np.maximum(top, 0, out=top)
                inside = top
                if masked:
                    rows = np.arange(lo, hi + 1)
                    inside = np.where((rows[None] <= ns[:, None]) & ((d - rows)[None] <= ms[:, None]), top, NONE)
                value = inside.max(axis=1)
                may = np.flatnonzero((value >= best) & (value > 0))
                if len(may):
                    i = inside[may].argmax(axis=1) + lo
                    better = (value[may] > best[may]) | (i < best_i[may])
                    may, i = may[better], i[better]
                    best[may], best_i[may], best_j[may] = value[may], i, d - i
            h[:, at] = top
        # what lies beside the inner cells is read by the next two diagonals
        edge = np.float32(0) if local else np.float32(eo + ee * np.float32(d - 1))
        h[:, 0] = edge if d <= m else NONE
        e[:, 0] = f[:, 0] = NONE
        if lo > 1:
            h[:, lo - 1] = e[:, lo - 1] = f[:, lo - 1] = NONE
        if d <= n:
            h[:, d] = edge
            e[:, d] = f[:, d] = NONE
        if not local and d in ending:
            done = np.array(ending[d])
            final[done] = h[done, ns[done]]
        if every and d % every == 0:
            saved[d] = (hs.copy(), es.copy(), fs.copy())
    if local:
        return best, best_i, best_j, trace
    return final, ns, ms, trace


def _long_pair(q: np.ndarray, t: np.ndarray, table: np.ndarray, scoring: Scoring, local: bool):
    """Score, end and trace cells of one pair too large for a whole trace.

    A first filling saves the buffers of some diagonals; the walk back fills the trace
    again between two of them at a time. Memory grows with the length to the power 1.5.
    """
    every = max(1, int((36 * (len(q) + len(t))) ** 0.5))  # saved buffers and a piece of trace are as large
    saved: dict[int, tuple] = {}
    score, i, j, _ = _fill([q], [t], table, scoring, local, False, every=every, saved=saved)
    held: list = [None, None]

    def cell(i: int, j: int) -> int:
        piece = (i + j - 1) // every
        if held[0] != piece:
            first = piece * every + 1
            held[:] = piece, _fill([q], [t], table, scoring, local, True, first, min(first + every - 1, len(q) + len(t)), saved.get(first - 1))[3][0]
        return int(held[1][i + j - 1 - piece * every, i])

    return score, i, j, cell


def _walk(cell, i: int, j: int, local: bool) -> tuple[list[tuple[str, int]], int, int]:
    """Operations from the start to (i, j), and where they start; cell(i, j) is a trace byte."""
    ops: list[list] = []

    def push(op: str, k: int) -> None:
        if ops and ops[-1][0] == op:
            ops[-1][1] += k
        else:
            ops.append([op, k])

    state = 0
    while i > 0 or j > 0:
        if i == 0 or j == 0:
            if not local:
                push("I" if i == 0 else "D", i + j)
                i = j = 0
            break
        b = cell(i, j)
        if state == 0:
            kind = b & 3
            if kind == 3:
                break
            if kind == 0:
                push("M", 1)
                i, j = i - 1, j - 1
            state = kind
        elif state == 1:
            push("D", 1)
            state = 1 if b & 4 else 0
            i -= 1
        else:
            push("I", 1)
            state = 2 if b & 8 else 0
            j -= 1
    return [(op, k) for op, k in reversed(ops)], i, j


def _empty(m: int, n: int, scoring: Scoring, local: bool, traceback: bool) -> dict:
    if local:
        return {"score": 0.0, "query_start": 0 if traceback else None, "query_end": 0, "target_start": 0 if traceback else None, "target_end": 0, "cigar": [] if traceback else None}
    eo, ee = scoring.ends()
    k = m + n
    return {"score": float(np.float32(eo + ee * (k - 1))) if k else 0.0, "query_start": 0, "query_end": max(0, m - 1), "target_start": 0, "target_end": max(0, n - 1), "cigar": ([("I" if m else "D", k)] if k else []) if traceback else None}


def align_batch(queries: list[str], targets: list[str], scoring: Scoring, kind: str, local: bool, traceback: bool) -> list[dict | None]:
    """Results of many pairs, as dicts of the fields of RESULT; None where either is None."""
    table = scoring.table(kind)
    out: list[dict | None] = [None] * len(queries)
    todo = []
    for k, (a, b) in enumerate(zip(queries, targets)):
        if a is None or b is None:
            continue
        q, t = encode(a, kind), encode(b, kind)
        if len(q) and len(t):
            todo.append((max(len(q), len(t)), k, q, t))
        else:
            out[k] = _empty(len(q), len(t), scoring, local, traceback)
    todo.sort(key=lambda x: x[:2])
    at = 0
    while at < len(todo):
        end, m, n = at, 0, 0
        while end < len(todo):
            m2, n2 = max(m, len(todo[end][2])), max(n, len(todo[end][3]))
            if end > at and (end - at + 1) * (n2 + 1) * ((m2 + n2 + 1) if traceback else 256) > CELLS:
                break
            m, n, end = m2, n2, end + 1
        part = todo[at:end]
        at = end
        if traceback and (n + 1) * (m + n) > CELLS:  # one pair
            score, i, j, cell = _long_pair(part[0][2], part[0][3], table, scoring, local)
        else:
            score, i, j, trace = _fill([x[2] for x in part], [x[3] for x in part], table, scoring, local, traceback)
        for x, (_, k, q, t) in enumerate(part):
            if traceback and (n + 1) * (m + n) <= CELLS:
                own = trace[x]
                cell = lambda i, j, own=own: int(own[i + j - 1, i])
            if local and score[x] <= 0:
                out[k] = _empty(0, 0, scoring, True, traceback)
                continue
            got = {"score": float(score[x]), "query_start": None if local else 0, "query_end": int(j[x]) - 1, "target_start": None if local else 0, "target_end": int(i[x]) - 1, "cigar": None}
            if traceback:
                got["cigar"], i0, j0 = _walk(cell, int(i[x]), int(j[x]), local)
                if local:
                    got["query_start"], got["target_start"] = j0, i0
            out[k] = got
    return out


def _check_kind(kind: str) -> None:
    if kind not in ("dna", "protein"):
        raise TypeError(f"DNA or protein can be aligned, not {kind}")


def align(query: Column, target: Column, scoring: Scoring = Scoring(), kind: str = "dna", local: bool = True, traceback: bool = False) -> Column:
    """Struct of score, inclusive ends, starts and CIGAR (with traceback; M covers match and mismatch, I query only, D target only)."""
    _check_kind(kind)
    scoring.table(kind)

    @F.pandas_udf(RESULT)
    def run(q, t):
        import pandas as pd

        got = align_batch(list(q), list(t), scoring, kind, local, traceback)
        names = ("score", "query_start", "query_end", "target_start", "target_end")
        frame = pd.DataFrame({c: pd.Series([None if r is None else r[c] for r in got], dtype="float64" if c == "score" else "Int32") for c in names})
        frame["score"] = frame["score"].astype("float32")
        frame["cigar"] = pd.Series([None if r is None or r["cigar"] is None else [{"op": o, "len": k} for o, k in r["cigar"]] for r in got], dtype=object)
        return frame

    return run(query, target)


def align_local(query: Column, target: Column, scoring: Scoring = Scoring(), kind: str = "dna", traceback: bool = False) -> Column:
    """Smith-Waterman; the first best cell in row order (rows: target) ends the alignment."""
    return align(query, target, scoring, kind, True, traceback)


def align_global(query: Column, target: Column, scoring: Scoring = Scoring(), kind: str = "dna", traceback: bool = False) -> Column:
    """Needleman-Wunsch."""
    return align(query, target, scoring, kind, False, traceback)


def cigar_text(cigar: Column) -> Column:
    """e.g. 3M1D2M."""
    return F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")


def _op_strings(seq: Column, start: Column, cigar: Column, moves: str) -> Column:
    """The aligned part of a sequence: symbols where it moves, - elsewhere."""
    z = F.struct(F.lit("").alias("s"), start.cast("int").alias("at"))

    def step(z: Column, c: Column) -> Column:
        mine = (c["op"] == "M") | (c["op"] == moves)
        piece = F.when(mine, F.substring(seq, z["at"] + 1, c["len"])).otherwise(F.repeat(F.lit("-"), c["len"]))
        return F.struct(F.concat(z["s"], piece).alias("s"), (z["at"] + F.when(mine, c["len"]).otherwise(0)).cast("int").alias("at"))

    return F.aggregate(cigar, z, step, lambda z: z["s"])


def aligned_strings(query: Column, target: Column, result: Column) -> Column:
    """Struct of both aligned strings; an error without traceback."""
    lacks = result["score"].isNotNull() & result["cigar"].isNull()
    cigar = F.when(lacks, F.raise_error(F.lit("alignment has no traceback")).cast("array<struct<op: string, len: int>>")).otherwise(result["cigar"])
    return F.struct(_op_strings(query, result["query_start"], cigar, "I").alias("query"), _op_strings(target, result["target_start"], cigar, "D").alias("target"))


def alignment_diagram(query: Column, target: Column, result: Column) -> Column:
    """Three lines: query, | for equal, * for unequal symbols, target."""
    s = aligned_strings(query, target, result)
    chars = lambda x: F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, ""))
    marks = F.zip_with(chars(s["query"]), chars(s["target"]), lambda a, b: F.when((a == "-") | (b == "-"), " ").when(a == b, "|").otherwise("*"))
    return F.concat_ws("\n", s["query"], F.array_join(marks, ""), s["target"])


def rescore(query: str, target: str, result: dict, scoring: Scoring, kind: str, local: bool) -> float:
    """The score that a result's operations add up to."""
    q, t, table = encode(query, kind), encode(target, kind), scoring.table(kind)
    j, i, total = result["query_start"], result["target_start"], 0.0
    for op, k in result["cigar"]:
        if op == "M":
            total += float(sum(table[t[i + x], q[j + x]] for x in range(k)))
            i, j = i + k, j + k
            continue
        at_end = not local and ((op == "D" and j in (0, len(q))) or (op == "I" and i in (0, len(t))))
        o, e = scoring.ends() if at_end else (scoring.gap_open, scoring.gap_extend)
        total += o + e * (k - 1)
        i, j = (i + k, j) if op == "D" else (i, j + k)
    return total


def align_pairs(pairs: DataFrame, query: str = "query", target: str = "target", scoring: Scoring = Scoring(), kind: str = "dna", local: bool = True, traceback: bool = False, name: str = "aln") -> DataFrame:
    """pairs with a struct column of results."""
    return pairs.withColumn(name, align(F.col(query), F.col(target), scoring, kind, local, traceback))
