"""Evolutionary distances between the rows of alignments, and trees from them.

Rows are gathered in blocks of BLOCK; a pair of blocks is one row of a join, and numpy
compares all its pairs of sequences at once. Trees are built for each alignment in parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.errors import SequenceError
from seqloom.operators.msa import Alignment

BLOCK = 64
MODELS = {"dna": ("p-distance", "jc69", "k2p"), "protein": ("p-distance", "poisson")}
NODES = "node_id int, parent int, children array<int>, label string, branch_length double, is_root boolean"


def _dna_codes(rows: list[str]) -> np.ndarray:
    table = np.full(256, 4, np.int8)
    for k, pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
        for c in pair:
            table[ord(c)] = k
    return np.array([table[np.frombuffer(r.encode("latin-1"), np.uint8)] for r in rows]).reshape(len(rows), -1)


def _protein_codes(rows: list[str]) -> np.ndarray:
    table = np.arange(256).astype(np.int16)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = c - 32
    table[ord("-")] = table[ord(".")] = -1
    return np.array([table[np.frombuffer(r.encode("latin-1"), np.uint8)] for r in rows]).reshape(len(rows), -1)


def _counts(a: np.ndarray, b: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid columns, transitions and transversions (protein: all differences) of a row against many."""
    if kind == "protein":
        valid = (a >= 0) & (b >= 0)
        return valid.sum(axis=1), (valid & (a != b)).sum(axis=1), np.zeros(len(b), np.int64)
    valid = (a < 4) & (b < 4)
    differ = valid & (a != b)
    transition = differ & ((a ^ b) == 2)  # A-G and C-T
    return valid.sum(axis=1), transition.sum(axis=1), (differ & ~transition).sum(axis=1)


def distance_of(valid: np.ndarray, first: np.ndarray, second: np.ndarray, model: str) -> np.ndarray:
    """Distances from counts; NaN where the model has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (first + second) / valid
        if model == "p-distance":
            d = p
        elif model == "jc69":
            x = 1 - 4 * p / 3
            d = np.where(x > 0, -0.75 * np.log(np.where(x > 0, x, 1)), np.nan)
        elif model == "k2p":
            x, y = 1 - 2 * first / valid - second / valid, 1 - 2 * second / valid
            ok = (x > 0) & (y > 0)
            d = np.where(ok, -0.5 * np.log(np.where(ok, x, 1)) - 0.25 * np.log(np.where(ok, y, 1)), np.nan)
        else:
            d = np.where(p < 1, -np.log(np.where(p < 1, 1 - p, 1)), np.nan)
    return d + 0.0


def pair_distances(alignment: Alignment, model: str = "p-distance", strict: bool = True) -> DataFrame:
    """(msa_id, i, j, label_i, label_j, d) for i < j, i and j being pos.

    strict: a pair without a valid column or beyond the model's reach is an error; else its
    d is null. DNA: columns where either has a gap or other than A, C, G, T are skipped;
    protein: gaps only.
    """
    kind = alignment.kind
    if model not in MODELS[kind]:
        raise ValueError(f"unknown model {model!r} for {kind}; there are {', '.join(MODELS[kind])}")
    code = _dna_codes if kind == "dna" else _protein_codes
    packed = alignment.df.select("msa_id", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), F.struct("pos", "id", "aligned").alias("row"))
    blocks = packed.groupBy("msa_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    # each block goes to the pairs that it is in: a large alignment's pairs are as many keys
    own = blocks.select("msa_id", "block")
    ends = own.groupBy("msa_id").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    placed = blocks.join(ends, "msa_id")
    left = placed.select("msa_id", F.col("block").alias("a"), F.explode(F.sequence("block", "high")).alias("b"), F.col("rows").alias("left"))
    right = placed.select("msa_id", F.explode(F.sequence("low", "block")).alias("a"), F.col("block").alias("b"), F.col("rows").alias("right"))

    def compare(batches):
        import pyarrow as pa

        for rows in batches:
            for at in range(len(rows)):  # a pair of blocks at a time
                m, a, b, left, right = (rows.column(c)[at].as_py() for c in ("msa_id", "a", "b", "left", "right"))
                out = []
                if len({len(r["aligned"]) for r in (*left, *right)}) > 1:
                    raise SequenceError("rows of an alignment have equal widths")
                x, y = code([r["aligned"] for r in left]), code([r["aligned"] for r in right])
                for k, r in enumerate(left):
                    lo = k + 1 if a == b else 0  # i < j
                    if lo >= len(right):
                        continue
                    valid, first, second = _counts(x[k], y[lo:], kind)
                    d = distance_of(valid, first, second, model)
                    if strict and np.isnan(d).any():
                        bad = int(np.flatnonzero(np.isnan(d))[0])
                        why = "no valid column" if not valid[bad] else f"too far apart for {model}"
                        raise SequenceError(f"rows {r['pos']} and {right[lo + bad]['pos']}: {why}")
                    out.append({"msa_id": m, "i": r["pos"], "j": [s["pos"] for s in right[lo:]], "label_i": r["id"], "label_j": [s["id"] for s in right[lo:]], "d": d})
                if out:
                    wide = [len(x["j"]) for x in out]
                    d = np.concatenate([x["d"] for x in out])
                    columns = [
                        pa.array(np.full(len(d), m, np.int64)),
                        pa.array(np.repeat([x["i"] for x in out], wide)),
                        pa.array([j for x in out for j in x["j"]], pa.int64()),
                        pa.array([x["label_i"] for x in out for _ in x["j"]], pa.string()),
                        pa.array([s for x in out for s in x["label_j"]], pa.string()),
                        pa.array(d, mask=np.isnan(d)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["msa_id", "i", "j", "label_i", "label_j", "d"])

    return left.join(right, ["msa_id", "a", "b"]).mapInArrow(compare, "msa_id long, i long, j long, label_i string, label_j string, d double")


def long_matrix(alignment: Alignment, model: str = "p-distance", strict: bool = True) -> DataFrame:
    """The whole matrix in long form: pair_distances(), its mirror image, and zeros on the diagonal."""
    pairs = pair_distances(alignment, model, strict)
    both = pairs.select("msa_id", F.explode(F.array(F.struct("i", "j", "label_i", "label_j", "d"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("label_j").alias("label_i"), F.col("label_i").alias("label_j"), "d"))).alias("x")).select("msa_id", "x.*")
    own = alignment.df.select("msa_id", F.col("pos").alias("i"), F.col("pos").alias("j"), F.col("id").alias("label_i"), F.col("id").alias("label_j"), F.lit(0.0).alias("d"))
    return both.unionByName(own)


def distance_matrix(alignment: Alignment, model: str = "p-distance") -> DistanceMatrix:
    """The matrix of one alignment of at least two rows."""
    n = alignment.df.count()
    if n < 2:
        raise SequenceError("distances need at least two sequences")
    alignment.widths().collect()
    labels = alignment.ids()
    order = {r.pos: k for k, r in enumerate(alignment.df.orderBy("pos").select("pos").collect())}
    d = np.zeros((n, n))
    for r in pair_distances(alignment, model).collect():
        d[order[r.i], order[r.j]] = d[order[r.j], order[r.i]] = r.d
    return DistanceMatrix(labels, d)


class DistanceMatrix:
    """Labels and a symmetric matrix, on the driver."""

    def __init__(self, labels: list[str], values):
        self.labels, self.values = list(labels), np.array(values, float)
        if self.values.shape != (len(self.labels), len(self.labels)):
            raise SequenceError("a matrix has a row and a column for each label")

    @property
    def n(self) -> int:
        return len(self.labels)

    __len__ = lambda self: self.n

    def get(self, i: int, j: int) -> float:
        if not (0 <= i < self.n and 0 <= j < self.n):
            raise IndexError("index out of range")
        return float(self.values[i, j])

    def set(self, i: int, j: int, d: float) -> None:
        self.values[i, j] = self.values[j, i] = d

    def to_list(self) -> list[float]:
        return self.values.ravel().tolist()

    def to_list_of_lists(self) -> list[list[float]]:
        return self.values.tolist()

    def __str__(self) -> str:
        cells = [["", *self.labels]] + [[label, *(f"{x:.4f}" for x in row)] for label, row in zip(self.labels, self.values)]
        wide = [max(len(r[k]) for r in cells) for k in range(self.n + 1)]
        return "\n".join("  ".join(f"{x:>{w}}" for x, w in zip(r, wide)) for r in cells)

    def __repr__(self) -> str:
        return f"DistanceMatrix(n={self.n})"


@dataclass
class Node:
    label: str | None = None
    branch_length: float | None = None
    parent: int | None = None
    children: tuple[int, ...] = ()


class Tree:
    """Nodes, leaves first in the order of the labels; root is None for an unrooted tree."""

    def __init__(self, nodes: list[Node], root: int | None):
        self.nodes, self.root = nodes, root

    def leaf_labels(self) -> list[str]:
        return [x.label for x in self.nodes if not x.children]

    num_leaves = property(lambda self: sum(not x.children for x in self.nodes))
    num_nodes = property(lambda self: len(self.nodes))
    is_rooted = property(lambda self: self.root is not None)

    def _top(self) -> int:
        return len(self.nodes) - 1 if self.root is None else self.root

    def to_newick(self) -> str:
        if not self.nodes:
            return ";"
        done: dict[int, str] = {}
        todo = [self._top()]
        while todo:  # no recursion: trees may be deep
            k = todo[-1]
            x = self.nodes[k]
            wait = [c for c in x.children if c not in done]
            if wait:
                todo += wait
                continue
            todo.pop()
            text = "(" + ",".join(done.pop(c) for c in x.children) + ")" if x.children else ""
            text += "" if x.label is None or x.children else quote(x.label)
            done[k] = text + ("" if x.branch_length is None else f":{x.branch_length:.6f}")
        return done[self._top()] + ";"

    __str__ = to_newick

    def ascii_diagram(self) -> str:
        if not self.nodes:
            return ""
        lines, todo = [], [(self._top(), "", "", "")]
        while todo:
            k, lead, mark, below = todo.pop()
            x = self.nodes[k]
            name = x.label if x.label is not None else f"node{k}"
            lines.append(lead + mark + name + ("" if x.branch_length is None else f":{x.branch_length:.6f}"))
            last = len(x.children) - 1
            for i in range(last, -1, -1):
                todo.append((x.children[i], below, "`-- " if i == last else "|-- ", below + ("    " if i == last else "|   ")))
        return "\n".join(lines)

    def __repr__(self) -> str:
        return f"Tree(leaves={self.num_leaves}, nodes={self.num_nodes}, rooted={self.is_rooted})"


def quote(label: str) -> str:
    return "'" + label.replace("'", "''") + "'" if any(c.isspace() or c in ":,()[];'" for c in label) else label


def _first_least(part: np.ndarray) -> tuple[int, int]:
    """Places i < j of the first least value, row by row."""
    part = np.where(np.tri(len(part), dtype=bool), np.inf, part)
    return divmod(int(part.argmin()), len(part))


def neighbour_joining(labels: list[str], d: np.ndarray) -> Tree:
    n = len(labels)
    if n < 2:
        raise SequenceError("a tree needs at least two sequences")
    nodes = [Node(x) for x in labels]
    m = np.zeros((2 * n, 2 * n))
    m[:n, :n] = d
    active = list(range(n))

    def join(a: int, b: int, la: float, lb: float) -> int:
        k = len(nodes)
        nodes.append(Node(children=(a, b)))
        for x, length in ((a, la), (b, lb)):
            nodes[x].parent, nodes[x].branch_length = k, float(length) + 0.0
        return k

    while len(active) > 2:
        r = len(active)
        part = m[np.ix_(active, active)]
        sums = np.cumsum(part, axis=1)[:, -1]  # added one by one, in order: ties stay ties
        i, j = _first_least((r - 2) * part - sums[:, None] - sums[None, :])
        a, b = active[i], active[j]
        la = m[a, b] / 2 + (sums[i] - sums[j]) / (2 * (r - 2))
        k = join(a, b, la, m[a, b] - la)
        rest = [x for x in active if x not in (a, b)]
        m[k, rest] = m[rest, k] = (m[a, rest] + m[b, rest] - m[a, b]) / 2
        active = [*rest, k]
    a, b = active
    join(a, b, m[a, b] / 2, m[a, b] / 2)
    return Tree(nodes, None)


def upgma(labels: list[str], d: np.ndarray) -> Tree:
    n = len(labels)
    if n < 2:
        raise SequenceError("a tree needs at least two sequences")
    nodes = [Node(x) for x in labels]
    m = np.zeros((2 * n, 2 * n))
    m[:n, :n] = d
    active, size, height = list(range(n)), [1] * n, [0.0] * n
    while len(active) > 1:
        i, j = _first_least(m[np.ix_(active, active)])
        a, b = active[i], active[j]
        k, h = len(nodes), m[a, b] / 2
        nodes.append(Node(children=(a, b)))
        for x in (a, b):
            nodes[x].parent, nodes[x].branch_length = k, float(h - height[x]) + 0.0
        rest = [x for x in active if x not in (a, b)]
        m[k, rest] = m[rest, k] = (size[a] * m[a, rest] + size[b] * m[b, rest]) / (size[a] + size[b])
        size.append(size[a] + size[b])
        height.append(h)
        active = [*rest, k]
    return Tree(nodes, len(nodes) - 1)


METHODS = {"nj": neighbour_joining, "upgma": upgma}


def build_tree(matrix: DistanceMatrix, method: str = "nj") -> Tree:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    return METHODS[method](matrix.labels, matrix.values)


def build_trees(distances: DataFrame, method: str = "nj") -> DataFrame:
    """One row for each msa_id of pair distances: newick, diagram, leaves, nodes (the table of the tree). A tree is built in one task, trees in parallel."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    make = METHODS[method]

    def one(pdf):
        import pandas as pd

        at = sorted({*zip(pdf["i"], pdf["label_i"]), *zip(pdf["j"], pdf["label_j"])})
        place = {p: k for k, (p, _) in enumerate(at)}
        d = np.zeros((len(at), len(at)))
        i, j = pdf["i"].map(place).to_numpy(), pdf["j"].map(place).to_numpy()
        d[i, j] = d[j, i] = pdf["d"].to_numpy(float)
        if math.isnan(d.sum()):
            raise SequenceError("a tree needs all distances")
        t = make([label for _, label in at], d)
        nodes = [{"node_id": k, "parent": x.parent, "children": list(x.children), "label": x.label, "branch_length": x.branch_length, "is_root": k == t.root} for k, x in enumerate(t.nodes)]
        return pd.DataFrame({"msa_id": [int(pdf["msa_id"].iloc[0])], "newick": [t.to_newick()], "diagram": [t.ascii_diagram()], "leaves": [t.num_leaves], "nodes": [nodes]})

    struct = NODES.replace(" int", ": int").replace(" array", ": array").replace(" string", ": string").replace(" double", ": double").replace(" boolean", ": boolean")
    return distances.groupBy("msa_id").applyInPandas(one, f"msa_id long, newick string, diagram string, leaves long, nodes array<struct<{struct}>>")
