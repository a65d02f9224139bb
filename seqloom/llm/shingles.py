"""Near-duplicate texts: SimHash over sets of word shingles proposes groups through vantage-point trees, exact Jaccard similarity links inside them.

A set's fingerprint has WORDS words of 64 bits. Bits of two sets as similar as 0.8 differ
with probability acos(1.6 / 1.8) / pi = 0.1515 (fewer for more similar ones): one of the 18
blocks of 20 bits differs in at most one bit with probability 0.967 (0.994 for 0.85, over
0.999 for 0.9), and of the first 192 bits 29 differ (standard deviation 5). Sets as similar
as 0.8 have sizes within that ratio: links join neighbouring classes of sizes only.

Candidates are only ever grouped. In a group each set is compared with one leader, whole
set against whole set, in a pass linear in the rows. Those that aren't alike with the
leader are then compared with every other of the group, blocks of bounded size at a time.
So inside a group no pair is passed over, and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import FILE_TEXTS, by_bytes, components, few, ref, stage, take_lists, text_of
from seqloom.llm.decontaminate import shingle_codes
from seqloom.llm.simhash import Links, near_links

WIDTH = 5
SIMILAR = 0.8
WORDS = 6
BLOCKS = (0xFFFFF, 0xFFFFF << 20, 0xFFFFF << 40)
BLOCK_RADIUS = 1
#: Words whose whole distance is looked at, and a bound three standard deviations above that of sets as similar as 0.8.
CHECKED, RADIUS = 3, 45
#: Sets at home in a shard, about.
SHARD = 16384
#: Sets in a block, about: those not alike with their leader, and those that they are compared with.
REST, OTHERS = 256, 1024
#: Codes compared with a set's at once, about.
RUN = 1 << 18
#: Text that a worker takes at once, longer rows aside.
SLICE_BYTES = 1 << 20
_ODD = np.random.default_rng(42).integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.arange(8, dtype=np.uint64)
_ONES = np.uint64(0x0101010101010101)


def shingle_set(text: bytes, width: int = WIDTH, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Distinct 64-bit codes of lower-cased word shingles, in order; fewer words than the width are one shingle, no words none."""
    words = text.lower().split()
    known = {} if known is None else known
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.unique(shingle_codes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), max(1, min(width, len(words)))))


def sketch(codes: np.ndarray) -> np.ndarray:
    """SimHash of a set of codes: WORDS words; a bit is set if it is in over half of the codes' hashes."""
    counts = np.zeros((8, WORDS, 8), np.int64)  # shift, word, byte
    for k in range(0, len(codes), 255):  # byte-wide counters side by side in a word
        h = codes[k : k + 255, None] * _ODD
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        counts += ((h[:, None, :] >> _SHIFTS[:, None]) & _ONES).sum(axis=0).view(np.uint8).reshape(8, WORDS, 8)
    bits = (2 * counts > len(codes)).transpose(1, 2, 0).reshape(WORDS, 64)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def size_class(n: int, least: float) -> tuple[int, bool]:
    """(class, upper half): sizes within the ratio `least` of one another are in one class, or the smaller is in the upper half of the class below."""
    at = math.log(n) / (1e-9 - 2 * math.log(least)) if n else -2.0
    return math.floor(at), at % 1 >= 0.5 - 1e-9


def linked(flat: np.ndarray, offsets: np.ndarray, asks: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """Roots of the groups that pairs of sets at least so similar form, one of each pair at least being one that asks; sets lie in flat between offsets, each in order."""
    sizes = np.diff(offsets)
    links = Links(len(sizes))
    for i in np.flatnonzero(asks).tolist():
        own = flat[offsets[i] : offsets[i + 1]]
        todo = np.flatnonzero(links.root != links.root[i])
        todo = todo[np.minimum(sizes[todo], sizes[i]) >= least * np.maximum(sizes[todo], sizes[i])]
        piece = np.cumsum(sizes[todo]) // RUN
        for j in np.split(todo, np.flatnonzero(np.diff(piece)) + 1) if len(todo) else ():
            other, ends = take_lists(flat, offsets, j)
            same = np.concatenate(([0], np.cumsum(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other)))
            both = same[ends[1:]] - same[ends[:-1]]
            j = j[both >= least * (sizes[i] + sizes[j] - both)]
            links.add(np.full(len(j), i), j)
    return links.root


def _sketches(width: int, least: float):
    names = ["doc_id", "th", "sh", "kind", "up", *[f"f{k}" for k in range(WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known: dict[bytes, int] = {}
            seen: dict[int, tuple] = {}  # by the text's hash
            for b in by_bytes(whole, "text", SLICE_BYTES):
                out = []
                for text, th in zip(b.column("text").cast(pa.binary()), b.column("th").to_pylist()):
                    if th not in seen:
                        codes = shingle_set(text.as_py(), width, known)
                        seen[th] = (xxhash.xxh3_64_intdigest(codes.tobytes()), size_class(len(codes), least), sketch(codes))
                    out.append(seen[th])
                sets = pa.array(np.array([x for x, _, _ in out], np.uint64).view(np.int64))
                fps = np.array([f for _, _, f in out], np.uint64).reshape(-1, WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), sets, pa.array([c for _, (c, _), _ in out], pa.int32()), pa.array([u for _, (_, u), _ in out], pa.bool_()), *[pa.array(fps[:, k]) for k in range(WORDS)]], names)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known: dict[bytes, int] = {}
            for b in by_bytes(whole, "text", SLICE_BYTES):
                codes = [shingle_set(t.as_py(), width, known).view(np.int64) for t in b.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("sh"), b.column("near"), pa.array(codes, pa.list_(pa.int64()))], ["sh", "near", "codes"])

    return run


def _block(least: float):
    def star(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("sh").combine_chunks()
        sh, codes = table["sh"].to_numpy(), table["codes"].combine_chunks()
        offsets = np.concatenate(([0], np.cumsum(codes.value_lengths().to_numpy(), dtype=np.int64)))
        root = linked(codes.flatten().to_numpy().view(np.uint64), offsets, table["asks"].to_numpy(), least)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": sh[own], "v": sh[root[own]]})

    return star


def exact_links(sets: DataFrame, n: int, least: float = SIMILAR) -> DataFrame:
    """(u, v) edges that join all sets of a group (near: its least sh) with a Jaccard similarity of at least `least`. sets: n rows at most of (sh, near, codes: distinct codes in order)."""
    leaders = sets.where("sh = near").select("near", F.col("codes").alias("lead"))
    both = F.size(F.array_intersect("codes", "lead"))
    judged = sets.where("sh <> near").join(leaders, "near").select("sh", "near", "codes", (both >= least * (F.size("codes") + F.size("lead") - both)).alias("alike"))
    judged = stage(few(judged, n, FILE_TEXTS // 2), "judged")
    # sets that aren't alike with the leader ask all others of the group, in blocks
    sizes = judged.groupBy("near").agg(F.count("*").alias("n"), F.count_if(~F.col("alike")).alias("asking")).where("asking > 0")
    sizes = stage(few(sizes.select("near", F.expr(f"1 + asking div {REST}").cast("int").alias("rest"), F.expr(f"1 + n div {OTHERS}").cast("int").alias("others")), n), "asking")
    group = judged.join(sizes, "near")
    part = lambda n, seed: F.pmod(F.xxhash64("sh", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = group.where("not alike").select("near", part("rest", 1).alias("b"), every("others").alias("o"), "sh", "codes", F.lit(True).alias("asks"))
    others = group.where("alike").select("near", every("rest").alias("b"), part("others", 2).alias("o"), "sh", "codes", F.lit(False).alias("asks"))
    # those that ask are asked too, by other blocks
    mutual = group.where("not alike").select("near", "rest", part("rest", 1).alias("own"), part("others", 2).alias("o"), "sh", "codes").select("near", "own", every("rest").alias("b"), "o", "sh", "codes").where("b <> own").select("near", "b", "o", "sh", "codes", F.lit(False).alias("asks"))
    blocks = asking.unionByName(others).unionByName(mutual)
    found = blocks.groupBy("near", "b", "o").applyInArrow(_block(least), "u long, v long")
    return judged.where("alike").select(F.col("sh").alias("u"), F.col("near").alias("v")).unionByName(found)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, th, root (the group), component_id (smallest id reachable over pairs of texts whose shingle sets have a Jaccard similarity of at least `least`).

    The trees find a pair as similar as 0.8 with a probability of 0.967, more similar ones more
    surely and equal sets always (see the module; less surely sets of under nine shingles); no
    pair below is linked. Nulls: a null text is empty;
    texts without words are alike. A null id never is the smallest while another is there.
    Repeated rows stay repeated; ties go to the smallest id. Very long texts are handled one at
    a time. An empty table gives an empty result. Other columns are not read.
    """
    slim = docs.select(ref(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    fps = [f"f{k}" for k in range(WORDS)]
    keyed = stage(slim.mapInArrow(_sketches(width, least), f"doc_id long, th long, sh long, kind int, up boolean, {', '.join(f'{f} long' for f in fps)}"), "keyed")
    distinct = keyed.groupBy("sh").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), *[F.min(c).alias(c) for c in ("kind", "up", *fps)])
    rows = keyed.count()
    distinct = stage(few(distinct, rows), "sets")
    n = distinct.count()
    near = components(near_links(distinct, tuple(fps), "sh", RADIUS, BLOCK_RADIUS, BLOCKS, CHECKED, "kind", "up", shard=SHARD), nodes=n).select(F.col("node").alias("sh"), F.col("root").alias("near"))
    wanted = stage(distinct.join(near, "sh").select("sh", "near", "th"), "wanted")
    some = wanted.count()
    # by all rows: the join reads every text
    texts = few(slim.join(wanted, "th").dropDuplicates(["th", "sh"]).select("sh", "near", "text"), rows, FILE_TEXTS)
    sets = stage(texts.mapInArrow(_sets(width), "sh long, near long, codes array<long>"), "codes")
    groups = components(exact_links(sets, some, least), nodes=some).withColumnRenamed("node", "sh")
    rooted = stage(distinct.join(groups, "sh", "left").select("sh", "first", F.coalesce("root", "sh").alias("root")), "rooted")
    # written first: a join straight on the sums could not split a hot root
    firsts = stage(few(rooted.groupBy("root").agg(F.min("first").alias("component_id")), n), "least")
    of_set = rooted.join(firsts, "root").select("sh", "root", "component_id")
    return keyed.select("doc_id", "th", "sh").join(of_set, "sh").select("doc_id", "th", "root", "component_id")
