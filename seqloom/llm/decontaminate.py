"""Benchmark leaks: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window of a document has an item's number of words; a document of fewer is one window. It leaks the item if the weighted
(multiset) Jaccard similarity of their five-word shingles is at least 0.8. Windows with too few
shingles of any item for that are passed over, which loses none; what is left may hold shingles of
many items, and which item it is like, if any, the fingerprints tell. They are looked up in eight
blocks of eight bits: one that differs from an item's in at most RADIUS bits differs in at most
RADIUS // 8 of some block, so the buckets within that of each block hold all items within the
radius. Candidates are then compared exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import ref, stage, take_lists, text_of

WIDTH = 5
SIMILAR = 0.8
#: Shingle sets as similar as 0.8 differ in about 10 of 64 bits (standard deviation 3).
RADIUS = 23
#: Characters of items taken at once; more items are taken in several rounds over the documents.
ITEM_CHARS = 8 << 20
#: Words whose windows are fingerprinted at once.
RUN = 4096
#: Members of buckets looked at at once, about.
PAIRS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def _codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.fromiter((known[w] if w in known else xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingle_codes(codes: np.ndarray, width: int) -> np.ndarray:
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, width):
        h = h * BASE + codes[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bits(shingles: np.ndarray) -> np.ndarray:
    """-1 or 1 for each of 64 bits of each shingle."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(shingles: np.ndarray) -> int:
    return int(_pack(_bits(shingles).sum(axis=0, keepdims=True))[0]) if len(shingles) else 0


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if both else 0.0


class Blocks:
    """Fingerprints of items in buckets, each item in those near its value of every eight-bit block: a query's eight buckets hold all within the radius."""

    def __init__(self, fps: list[int], radius: int = RADIUS):
        self.fps, self.radius = np.array(fps, np.uint64), radius
        flips = np.arange(256, dtype=np.uint8)
        near = self.fps.view(np.uint8).reshape(-1, 8, 1) ^ flips[np.bitwise_count(flips) <= radius // 8]
        buckets = (near + 256 * np.arange(8)[:, None]).reshape(len(self.fps), -1)
        order = np.argsort(buckets, axis=None, kind="stable")
        self.members = (order // max(1, buckets.shape[1])).astype(np.int32)
        self.starts = np.searchsorted(buckets.ravel()[order], np.arange(8 * 256 + 1))

    def within(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs at most the radius apart, in order."""
        buckets, n, pairs = fps.view(np.uint8).reshape(-1, 8) + 256 * np.arange(8), len(self.fps), []
        step = max(1, PAIRS // max(1, n))
        for at in range(0, len(fps), step):
            part = buckets[at : at + step].ravel()
            j, ends = take_lists(self.members, self.starts, part)
            i = np.repeat(at + np.arange(len(part)) // 8, np.diff(ends))
            ok = np.bitwise_count(fps[i] ^ self.fps[j]) <= self.radius
            pairs.append(np.unique(i[ok] * n + j[ok]))
        return np.divmod(np.concatenate(pairs), max(1, n)) if pairs else (np.zeros(0, np.int64),) * 2


class Items:
    """Benchmark items, by their number of words."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, least: float = SIMILAR):
        self.least = least
        self.known: dict[str, int] = {}
        sized: dict[int, list] = defaultdict(list)
        self.hashes: dict[int, np.ndarray] = {}
        every: dict[int, list] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            for w in words:
                self.known.setdefault(w, xxhash.xxh3_64_intdigest(w))
            width = min(WIDTH, len(words))
            own = shingle_codes(_codes(words, self.known), width)
            every[width].append(own)
            sized[len(words)].append((item, simhash(own), Counter(own.tolist())))
        self.hashes = {w: np.unique(np.concatenate(x)) for w, x in every.items()}
        self.sized = {m: (min(WIDTH, m), [(i, c) for i, _, c in own], Blocks([f for _, f, _ in own], radius)) for m, own in sorted(sized.items())}

    def leaks(self, text: str) -> list[tuple[int, int, float]]:
        """(item, first word of the best window, similarity): the first of the most similar windows of each item that leaks."""
        words = words_of(text)
        known = self.known
        coded = np.fromiter((known.get(w, 0) for w in words), np.uint64, len(words))
        hits, best = {}, {}
        for width, hashes in self.hashes.items():
            own = shingle_codes(coded, width)
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            found = hashes[at] == own
            if found.any():
                hits[width] = np.concatenate(([0], np.cumsum(found)))
        if not hits:
            return []
        codes, sums = _codes(words, known), {}
        for m, (width, items, blocks) in self.sized.items():
            n = min(m, len(words)) - width + 1  # shingles of a window; a text shorter than the item is one window
            if width not in hits or n < self.least * (m - width + 1) - 1e-9:
                continue
            need = math.ceil(self.least * (n + m - width + 1) / (1 + self.least) - 1e-9)
            starts = np.flatnonzero(hits[width][n:] - hits[width][:-n] >= need)
            if not len(starts):
                continue
            if width not in sums:
                sums[width] = shingle_codes(codes, width)
            own = sums[width]
            k = 0
            while k < len(starts):  # windows that start within RUN words of the first
                lo = int(starts[k])
                end = int(np.searchsorted(starts, lo + RUN))
                part, k = starts[k:end], end
                run = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(own[lo : int(part[-1]) + n]), axis=0, dtype=np.int32)))
                fps = _pack(run[part - lo + n] - run[part - lo])
                for i, j in zip(*(x.tolist() for x in blocks.within(fps))):
                    item, counts = items[j]
                    s = int(part[i])
                    sim = similarity(Counter(own[s : s + n].tolist()), counts)
                    if sim >= self.least and (item not in best or sim > best[item][1]):
                        best[item] = (s, sim)
        return [(item, s, sim) for item, (s, sim) in best.items()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS, name: str = "leaks") -> DataFrame:
    """docs with an array column `name` of (item_id, start, similarity), a struct for each item that the text leaks.

    Items go to the workers in rounds of at most item_chars characters (one longer item
    by itself), which the driver reads one at a time. Where there are several, each round's
    result is written before the next one begins, so one round's items are held at a time,
    however many items there are. Items shorter than five words are one shingle. Null or
    wordless texts leak nothing, null or wordless items are never leaked. An item_id that
    stands in several rows counts for the best of them; of windows alike the first. Repeated
    rows are judged alike; very long texts are taken RUN windows at a time; an empty table of
    either kind gives no leaks. A column called `name` is replaced, all others pass through.
    """
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("similarity", T.DoubleType())]))
    context = docs.sparkSession.sparkContext
    out, held = docs.withColumn(name, F.array().cast(kind)), None
    for own in _rounds(benchmark, item_col, item_text_col, item_chars):
        if held is not None:  # another round: the last one's items can go when its result is written
            out = stage(out, "leaks")
            held.destroy()
        held = context.broadcast(own)
        out = out.withColumn(name, F.concat(ref(name), _leaking(held)(text_of(text_col))))
    return out


def _rounds(benchmark: DataFrame, item_col: str, text_col: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    own, size = [], 0
    rows = benchmark.select(ref(item_col).cast("long").alias("i"), text_of(text_col).alias("t")).where("t <> ''").orderBy("i", "t")
    for r in rows.toLocalIterator():
        if own and size + len(r.t) > chars:
            yield own
            own, size = [], 0
        own.append((r.i, r.t))
        size += len(r.t)
    if own:
        yield own


def _leaking(items):
    held: list[Items] = []

    @F.pandas_udf("array<struct<item_id: long, start: long, similarity: double>>")
    def find(texts):
        import pandas as pd

        if not held:
            held.append(Items(items.value))
        return pd.Series([[{"item_id": i, "start": s, "similarity": x} for i, s, x in held[0].leaks(t)] for t in texts])

    return find
