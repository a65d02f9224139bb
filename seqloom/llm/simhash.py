"""Near-duplicates by SimHash, linked through vantage-point trees.

Fingerprints are cut into blocks (halves of a 64-bit word, say). Two fingerprints that
differ in at most `radius` bits differ in at most radius // blocks of some block, so each
block has its own vantage-point tree, over the Hamming distance on that block (a
pseudo-metric: the triangle bound holds). The upper levels are fitted on a bounded sample
and deal fingerprints into shards: each has one home leaf, and visits those leaves before
it whose side of a boundary lies within the block's radius. A leaf that its own block
cannot divide further is dealt on by a tree over the whole distance. Inside a shard the
same splitting goes on in memory, and full distances decide. A shard returns a spanning
star for each group of linked fingerprints, so output stays linear in its rows however
dense a group is.

Rows may have a class such that links join equal or neighbouring classes only (of a set's
size, say): each class has its own trees, and rows may visit those of the class above.

The tree over halves of 64 bits, radius 4, needs about n^1.47 comparisons on unrelated
fingerprints, one tree over all 64 bits about n^1.62 (a band of radius 2 holds half of a
32-bit distance's distribution, one of radius 4 two thirds of a 64-bit one).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import components, ref, stage

RADIUS = 4
HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)
#: Fingerprints that fit the upper levels, about: a bounded number and one in eight at most. All rows are dealt by them.
SAMPLE = 131072
#: Of them in each leaf, at least: the levels stop where boundaries would rest on fewer.
IN_LEAF = 16
#: Fingerprints at home in a shard, about. A leaf of four times as many is dealt on.
SHARD = 8192
BLOCK = 1 << 20


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of lower-cased, space-joined word shingles (repeats count); no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), 65536):  # long texts by pieces
        a, b = starts[k : k + 65536].tolist(), ends[k : k + 65536].tolist()
        h = np.fromiter((digest(joined[x:y], 42) for x, y in zip(a, b)), np.uint64, len(a))
        by_byte = np.bincount((h.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)).ravel(), minlength=2048)
        counts += by_byte.reshape(8, 256) @ ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    bits = (2 * counts > len(starts)).ravel()
    return int(sum(1 << i for i in np.flatnonzero(bits).tolist()))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, int] = {}
            out = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                if text not in seen:
                    seen[text] = fingerprint(text, width)
                out.append(seen[text])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, th: xxhash64 of the text, fp). Null text: as empty, fingerprint 0."""
    slim = docs.select(ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return slim.mapInArrow(_fingerprints(width), "doc_id long, th long, fp long")


def distance(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Differing bits under the mask; the last axis holds a fingerprint's words."""
    out = np.int16(0)
    for w in np.flatnonzero(mask).tolist():
        out = out + np.bitwise_count((a[..., w] ^ b[..., w]) & mask[w]).astype(np.int16)
    return out


def block_masks(words: int, parts: tuple[int, ...] = HALVES) -> list[np.ndarray]:
    out = []
    for w in range(words):
        for part in parts:
            out.append(np.zeros(words, np.uint64))
            out[-1][w] = part
    return out


def grow(sample: np.ndarray, mask: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The vantage point and boundary of each inner node, as a heap: children of i are 2i+1 (within) and 2i+2. And the sample in each leaf."""
    points, bounds = np.zeros((2**depth - 1, sample.shape[1]), np.uint64), np.zeros(2**depth - 1, np.int16)
    parts = {0: sample}
    for i in range(len(points)):
        own = parts.pop(i)
        d = np.zeros(0, np.int16)
        if len(own):
            # of a few vantage points, that whose distances spread most
            tried = own[:: max(1, len(own) // 8)][:8]
            points[i] = max(tried, key=lambda v: (distance(own, v, mask).var(), v.tolist()))
            d = distance(own, points[i], mask)
            bounds[i] = int(np.median(d))
        parts[2 * i + 1], parts[2 * i + 2] = own[d <= bounds[i]], own[d > bounds[i]]
    return points, bounds, [parts[2**depth - 1 + k] for k in range(2**depth)]


def deal(fps: np.ndarray, home: np.ndarray, points: np.ndarray, bounds: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): of rows at home their leaf and the leaves before it that their ball reaches, of visitors all leaves that it reaches."""
    row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for _ in range(len(points).bit_length()):
        d = distance(fps[row], points[node], mask)
        inner = d <= bounds[node]
        stay = np.where(home, inner, d - radius <= bounds[node])
        leave = np.where(home, ~inner, d + radius > bounds[node])
        also = home & ~inner & (d - radius <= bounds[node])  # the ball crosses to a leaf before
        row = np.concatenate((row[stay], row[leave], row[also]))
        node = np.concatenate((2 * node[stay] + 1, 2 * node[leave] + 2, 2 * node[also] + 1))
        home = np.concatenate((home[stay], home[leave], np.zeros(also.sum(), bool)))
    return row, node - len(points), home


class Links:
    """Groups of linked positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            i, j = i[differ], j[differ]
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def link(fps: np.ndarray, block: np.ndarray, home: np.ndarray, block_radius: int, radius: int) -> np.ndarray:
    """Roots of the groups that pairs within both radii (of a word, and of whole fingerprints) form: home against home, and home against visitors."""
    links, whole = Links(len(fps)), np.full(fps.shape[1], 2**64 - 1, np.uint64)

    def join(i: np.ndarray, j: np.ndarray) -> None:
        near = distance(fps[i], fps[j], whole) <= radius
        if near.any():
            links.add(i[near], j[near])

    def brute(a: np.ndarray, b: np.ndarray) -> None:
        v = a[len(a) // 2]  # around one of them first
        for own in (a, b):
            near = own[np.bitwise_count(block[own] ^ block[v]) <= block_radius]
            join(np.full(len(near), v), near)
        step = max(1, BLOCK // max(1, len(b)))
        for k in range(0, len(a), step):
            own = a[k : k + step]
            if fps.shape[1] == 1:
                near = np.bitwise_count(fps[own] ^ fps[b, 0]) <= radius
            else:
                near = np.bitwise_count(block[own][:, None] ^ block[b]) <= block_radius
            if 8 * np.count_nonzero(near) > near.size:  # a dense place: most are linked already
                near &= links.root[own][:, None] != links.root[b]
                if 8 * np.count_nonzero(near) > near.size:
                    near &= distance(fps[own][:, None], fps[b], whole) <= radius
            i, j = np.nonzero(near)
            join(own[i], b[j])

    start = np.flatnonzero(home)
    todo = [(start, start, True), (start, np.flatnonzero(~home), False)]
    while todo:
        a, b, same = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= BLOCK:
            brute(a, b)
            continue
        v = block[a[len(a) // 2]]
        da, db = np.bitwise_count(block[a] ^ v).astype(np.int16), np.bitwise_count(block[b] ^ v).astype(np.int16)
        mu = int(np.median(da if len(a) >= len(b) else db))
        ai, bi = da <= mu, db <= mu
        if min(ai.mean(), bi.mean()) == 1 or max(ai.mean(), bi.mean()) == 0:
            mu -= 1
            ai, bi = da <= mu, db <= mu
        near_in, near_out = lambda d: (d <= mu) & (d > mu - block_radius), lambda d: (d > mu) & (d <= mu + block_radius)
        parts = [(a[ai], b[bi], same), (a[~ai], b[~bi], same), (a[near_in(da)], b[near_out(db)], False)]
        if not same:
            parts.append((a[near_out(da)], b[near_in(db)], False))
        if sum(len(x) * len(y) for x, y, _ in parts) > 0.95 * len(a) * len(b):  # no boundary tells these apart
            brute(a, b)
        else:
            todo += parts
    return links.root


class Forest:
    """The trees of one block and class: an upper one over the block, and one over the whole distance below each heavy leaf."""

    def __init__(self, sample: np.ndarray, mask: np.ndarray, whole: np.ndarray, block_radius: int, radius: int, n: int, shard: int):
        def depth(n: float, own: np.ndarray) -> int:
            return max(0, min(math.ceil(math.log2(max(1, n) / shard)), int(math.log2(max(1, len(own) // IN_LEAF)))))

        self.mask, self.whole, self.block_radius, self.radius = mask, whole, block_radius, radius
        self.points, self.bounds, leaves = grow(sample, mask, depth(n, sample))
        each = n / max(1, len(sample))
        self.below = {k: grow(own, whole, depth(len(own) * each, own))[:2] for k, own in enumerate(leaves) if len(own) * each > 4 * shard}

    def deal(self, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, leaf, home = deal(fps, home, self.points, self.bounds, self.mask, self.block_radius)
        leaf = leaf << 20
        for k, (points, bounds) in self.below.items():
            own = leaf == k << 20
            if own.any():
                r, below, h = deal(fps[row[own]], home[own], points, bounds, self.whole, self.radius)
                row, leaf, home = np.concatenate((row[~own], row[own][r])), np.concatenate((leaf[~own], leaf[own][r] + below)), np.concatenate((home[~own], h))
        return row, leaf, home


def near_links(distinct: DataFrame, words: tuple[str, ...] = ("fp",), ident: str = "fp", radius: int = RADIUS, block_radius: int = RADIUS // 2, parts: tuple[int, ...] = HALVES, checked: int | None = None, kind: str | None = None, up: str | None = None, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(u, v) long edges that join all rows whose fingerprints are within block_radius in some part of some word, and within the radius in the first `checked` words (all); a spanning star for each group of a shard.

    ident: a distinct long. kind: an int column; links join rows of equal kinds, and rows where `up` is true to the kind above.
    """
    checked = checked or len(words)
    rows = distinct.select(F.col(ident).alias("id"), *[F.col(w).alias(f"w{k}") for k, w in enumerate(words)], (F.col(kind) if kind else F.lit(0)).cast("int").alias("kind"), (F.col(up) if up else F.lit(False)).alias("up"))
    names = [f"w{k}" for k in range(len(words))]
    sizes = {(r.kind, r.up): r.n for r in rows.groupBy("kind", "up").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    fitted, kinds, ups = np.zeros((0, len(words)), np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)
    if n > shard:  # one in eight at most, and a bounded number
        part = max(8, n // sample)
        found = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(part)) == 0).limit(2 * sample).toArrow().sort_by("id")
        fitted = np.stack([found[w].to_numpy().view(np.uint64) for w in names], axis=1)
        kinds, ups = found["kind"].to_numpy(), found["up"].to_numpy()
    masks = block_masks(len(words), parts)
    whole = np.array([2**64 - 1] * checked + [0] * (len(words) - checked), np.uint64)
    # a class's shards hold its rows, and visitors from the class below
    forests = {}
    for c in {k for k, _ in sizes}:
        own = fitted[(kinds == c) | (kinds == c - 1) & ups]
        held = sizes.get((c, False), 0) + sizes.get((c, True), 0) + sizes.get((c - 1, True), 0)
        forests[c] = [Forest(own, m, whole, block_radius, radius, held, shard) for m in masks]
    carried = names[:checked]
    columns = ["tree", "kind", "leaf", "id", "block", *carried, "home"]

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 4096):
                part = b.slice(k, 4096)
                ids, of, up = part.column("id").to_numpy(), part.column("kind").to_numpy(), part.column("up").to_numpy(zero_copy_only=False)
                fps = np.stack([part.column(w).to_numpy().view(np.uint64) for w in names], axis=1)
                for c in np.unique(of).tolist():
                    for home, to, own in ((True, c, np.flatnonzero(of == c)), (False, c + 1, np.flatnonzero((of == c) & up))):
                        for t, forest in enumerate(forests.get(to, ()) if len(own) else ()):
                            row, leaf, at_home = forest.deal(fps[own], np.full(len(own), home))
                            at, w = own[row], t // len(parts)
                            block = fps[at, w] & masks[t][w]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(np.full(len(row), to, np.int32)), pa.array(leaf), pa.array(ids[at]), pa.array(block.view(np.int64)), *[pa.array(fps[at, k].view(np.int64)) for k in range(checked)], pa.array(at_home)], columns)

    def in_shard(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        fps, ids = np.stack([table[w].to_numpy().view(np.uint64) for w in carried], axis=1), table["id"].to_numpy()
        root = link(fps, table["block"].to_numpy().view(np.uint64), table["home"].to_numpy(), block_radius, radius)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": ids[own], "v": ids[root[own]]})

    dealt = rows.mapInArrow(to_shards, f"tree int, kind int, leaf long, id long, block long, {', '.join(f'{w} long' for w in carried)}, home boolean")
    return dealt.groupBy("tree", "kind", "leaf").applyInArrow(in_shard, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, th, fp, root (the group's least fingerprint), component_id (smallest id reachable over links of at most radius bits).

    Nulls: a null text is empty; texts without words have fingerprint 0 and are linked
    like any other. A null id never is the smallest while another is there. Repeated
    rows stay repeated. An empty table gives an empty result. Other columns are not read.
    """
    fps = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    groups = components(near_links(distinct, radius=radius, block_radius=radius // 2)).withColumnRenamed("node", "fp")
    rooted = stage(distinct.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    # written first: a join straight on the sums could not split a hot root
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of_fp = rooted.join(least, "root").select("fp", "root", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_duplicates) -> DataFrame:
    """docs with one row of each group that groups() finds (near-duplicates): that of the smallest id; of rows alike in id and text, one."""
    marked = groups(docs, id_col, text_col)
    # where all of a group's ids are null, any one text of it stays: the least hash
    kept = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("th").alias("__th"))
    void = -(2**63)
    keyed = docs.select(F.struct(*[ref(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row"), F.coalesce(ref(id_col).cast("long"), F.lit(void)).alias("__id"), F.xxhash64(F.coalesce(ref(text_col), F.lit(""))).alias("__th"))
    one = keyed.dropDuplicates(["__id", "__th"])
    kept = kept.select(F.coalesce("component_id", F.lit(void)).alias("__id"), "__th").distinct()
    return one.join(kept, ["__id", "__th"], "left_semi").select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
