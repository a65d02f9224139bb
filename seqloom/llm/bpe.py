"""Byte-level BPE over a minimal acyclic transducer of frequent words.

Words are counted over all documents; the most frequent ones are compiled, with their
ids as outputs, into an automaton that shares prefixes and suffixes. Workers map its
image into memory. A word that it lacks is merged exactly, pair by pair in rank order.
Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import json
import mmap
import struct
import tempfile
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import by_bytes, kept_in_worker, ref, stage, take_lists

#: Words in the automaton; a bound on its size, not on what is encoded.
LEXICON = 50_000
#: Text that a worker encodes at once, longer rows aside.
BATCH_BYTES = 8 << 20
#: No rank.
NEVER = 1 << 30
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, ranks of merges and special strings of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        back = {c: b for b, c in byte_chars().items()}
        as_bytes = lambda s: bytes(back[c] for c in s)
        ids = {as_bytes(k): v for k, v in got["model"]["vocab"].items() if all(c in back for c in k)}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in got["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in got["added_tokens"]}
        top = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * top
        for word, i in ids.items():
            self.bytes[i] = word
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.single = [ids[bytes([b])] for b in range(256)]
        self.ranks: dict[int, int] = {}  # of a pair of ids, as one number
        self.merged: list[int] = []  # the id that a rank's pair becomes
        for k, (x, y) in enumerate(pairs):
            x, y = as_bytes(x), as_bytes(y)
            self.ranks[ids[x] << 20 | ids[y]] = k
            self.merged.append(ids[x + y])
        self.single_ids, self.merged_ids = np.array(self.single, np.int32), np.array(self.merged, np.int32)
        keys = np.array(list(self.ranks), np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int32)[order]
        self.byte_ranks = np.array([[self.ranks.get(x << 20 | y, NEVER) for y in self.single] for x in self.single], np.int32)
        sizes = [len(w) for w in self.bytes]
        self.byte_ends = np.concatenate(([0], np.cumsum(sizes)))
        self.byte_data = np.frombuffer(b"".join(self.bytes), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the leftmost pair of least rank is merged until none is left; long words by a heap."""
        if len(word) > 200:
            return self._merge_long(word)
        get, merged, none = self.ranks.get, self.merged, NEVER
        parts = [self.single[b] for b in word]
        near = [get(x << 20 | y, none) for x, y in zip(parts, parts[1:])]
        while near:
            least = min(near)
            if least == none:
                break
            i = near.index(least)
            parts[i] = new = merged[least]
            del parts[i + 1], near[i]
            if i:
                near[i - 1] = get(parts[i - 1] << 20 | new, none)
            if i < len(near):
                near[i] = get(new << 20 | parts[i + 1], none)
        return parts

    def merge_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words at once, the bytes of word i from offsets[i] on: their ids one after another, and offsets of those.

        Words of like length are laid out as rows; a step merges the leftmost pair of
        least rank in every row that has one. Only pairs beside a merge are looked up again.
        """
        sizes = offsets[1:] - offsets[:-1]
        counts, rows, order = np.zeros(len(sizes), np.int64), [], []
        least = 0
        for most in (4, 8, 12, 16, 24, 32, 64):
            for own in np.split(of := np.flatnonzero((sizes > least) & (sizes <= most)), range(65536, len(of), 65536)):
                if len(own):
                    ids, n = self._merge_rows(data, offsets[own], sizes[own], most)
                    counts[own] = n
                    rows.append(ids)
                    order.append(own)
            least = most
        for i in np.flatnonzero(sizes > least).tolist():
            ids = np.array(self.merge(data[offsets[i] : offsets[i + 1]].tobytes()), np.int32)
            counts[i] = len(ids)
            rows.append(ids)
            order.append(np.array([i]))
        if not rows:
            return np.zeros(0, np.int32), np.zeros(len(sizes) + 1, np.int64)
        order = np.concatenate(order)
        at = np.empty(len(sizes), np.int64)  # of each word among the rows
        at[order] = np.arange(len(order))
        empty = sizes == 0
        at[empty] = len(order)
        ends = np.concatenate(([0], np.cumsum(counts[order])))
        return take_lists(np.concatenate(rows), np.append(ends, ends[-1]), at)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts)
        col = np.arange(width)
        inside = col < sizes[:, None]
        raw = data[np.where(inside, starts[:, None] + col, 0)]
        ids = np.where(inside, self.single_ids[raw], -1)
        rank = np.full((n, width), NEVER, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_ranks[raw[:, :-1], raw[:, 1:]], NEVER)
        after, before = np.tile((col + 1).astype(np.int16), (n, 1)), np.tile((col - 1).astype(np.int16), (n, 1))
        live = np.arange(n)
        while len(live):
            own = rank[live]
            j = own.argmin(axis=1)
            r = own[np.arange(len(live)), j]
            more = r < NEVER
            live, j, r = live[more], j[more], r[more]
            k = after[live, j]
            next_, last = after[live, k], before[live, j]
            new = self.merged_ids[r]
            ids[live, j], ids[live, k], rank[live, k], after[live, j] = new, -1, NEVER, next_
            has = next_ < sizes[live]
            right = np.full(len(live), NEVER, np.int32)
            right[has] = self._rank(new[has], ids[live[has], next_[has]])
            rank[live, j] = right
            before[live[has], next_[has]] = j[has]
            has = last >= 0
            rank[live[has], last[has]] = self._rank(ids[live[has], last[has]], new[has])
        left = ids >= 0
        return ids[left].astype(np.int32), left.sum(axis=1)

    def _merge_long(self, word: bytes) -> list[int]:
        from heapq import heapify, heappop, heappush

        n = len(word)
        parts = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(parts[x] << 20 | parts[y])) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


class Transducer:
    """A minimal acyclic automaton over bytes; a word's number is the count of words before it on its path, its output that entry of the id table.

    Image: header, the arcs' keys (state and byte in one 8-byte number, ascending), for each
    state its first arc and whether a word ends there, for each arc its target and the words
    that it passes over, then the outputs. All arrays are read in place.
    """

    HEAD = "<4q"

    @classmethod
    def compile(cls, words: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """The image for distinct words and their ids: Daciuk's incremental construction over sorted words."""
        entries = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # open states: final, arcs (byte, state)
        last = b""
        for word, _ in entries:
            k = 0
            while k < len(word) and k < len(last) and word[k] == last[k]:
                k += 1
            while len(path) > k + 1:
                s = close(path.pop())
                path[-1][1].append((last[len(path) - 1], s))
            for _ in word[k:]:
                path.append([False, []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            s = close(path.pop())
            path[-1][1].append((last[len(path) - 1], s))
        root = close(path[0])
        below = [0] * len(states)  # words from each state on; arcs lead to states made before
        first, key, target, skipped, final = [0], [], [], [], []
        for i, (end, arcs) in enumerate(states):
            n = int(end)
            for byte, to in arcs:
                key.append(i << 8 | byte)
                target.append(to)
                skipped.append(n)
                n += below[to]
            below[i] = n
            first.append(len(key))
            final.append(end)
        starts = np.concatenate(([0], np.cumsum([len(ids) for _, ids in entries]))).astype("<i4") if entries else np.zeros(1, "<i4")
        ids = np.array([i for _, own in entries for i in own], "<i4")
        parts = [np.array(key, "<i8"), np.array(first, "<i4"), np.array(final, "<i4"), np.array(target, "<i4"), np.array(skipped, "<i4"), starts, ids]
        return struct.pack(cls.HEAD, len(states), len(key), len(entries), root) + b"".join(p.tobytes() for p in parts)

    def __init__(self, image):
        view = memoryview(image)
        at = struct.calcsize(self.HEAD)
        n, m, w, self.root = struct.unpack(self.HEAD, view[:at])
        self.key = view[at : at + 8 * m].cast("q")
        at += 8 * m
        sizes, arrays = [n + 1, n, m, m, w + 1], []
        for k in sizes:
            arrays.append(view[at : at + 4 * k].cast("i"))
            at += 4 * k
        self.first, self.final, self.target, self.skipped, self.starts = arrays
        self.ids = view[at:].cast("i")

    @classmethod
    def mapped(cls, image: bytes) -> Transducer:
        """Over a memory map of an unlinked file."""
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            return cls(mmap.mmap(f.fileno(), len(image), access=mmap.ACCESS_READ))

    def find(self, word: bytes) -> list[int] | None:
        s, number = self.root, 0
        for byte in word:
            end = self.first[s + 1]
            arc = bisect_left(self.key, s << 8 | byte, self.first[s], end)
            if arc == end or self.key[arc] != s << 8 | byte:
                return None
            number += self.skipped[arc]
            s = self.target[arc]
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist() if self.final[s] else None

    def find_many(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of many words at once, -1 for those that it lacks: a step follows the next byte of every word still on a path."""
        arcs, final, target, skipped = (np.asarray(x) for x in (self.key, self.final, self.target, self.skipped))
        n = len(offsets) - 1
        out = np.full(n, -1, np.int64)
        live, at, state, number = np.arange(n), offsets[:-1].copy(), np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        while len(live):
            done = at == offsets[live + 1]
            ended = done & (final[state] > 0)
            out[live[ended]] = number[ended]
            live, at, state, number = live[~done], at[~done], state[~done], number[~done]
            if not len(live) or not len(arcs):
                break
            key = state << 8 | data[at]
            arc = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            on = arcs[arc] == key
            live, arc = live[on], arc[on]
            at, state, number = at[on] + 1, target[arc].astype(np.int64), number[on] + skipped[arc]
        return out


def _pieces(special: list[str]):
    """Splits a text into words, special strings apart."""
    import regex

    words = regex.compile(PATTERN).findall
    if not special:
        return lambda text: [(None, words(text))]
    apart = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))

    def pieces(text: str) -> list[tuple[str | None, list[str]]]:
        if not apart.search(text):
            return [(None, words(text))]
        out, at = [], 0
        for m in apart.finditer(text):
            out += [(None, words(text[at : m.start()])), (m[0], [])]
            at = m.end()
        return [*out, (None, words(text[at:]))]

    return pieces


class Codec:
    """encode() and decode() of whole texts."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.v, self.lexicon = vocabulary, lexicon
        self.pieces = _pieces(list(vocabulary.special))

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and their offsets: from the lexicon, or merged."""
        raw = words.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        number = self.lexicon.find_many(data, offsets)
        known, rest = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        own, ends = take_lists(data, offsets, rest)
        merged, merged_ends = self.v.merge_many(own, ends)
        table = np.asarray(self.lexicon.ids)
        flat, ends = np.concatenate((table, merged)), np.concatenate((np.asarray(self.lexicon.starts, np.int64), merged_ends[1:] + len(table)))
        place = np.empty(len(words), np.int64)
        place[known], place[rest] = number[known], len(self.lexicon.starts) - 1 + np.arange(len(rest))
        for special, i in self.v.special.items():  # such a word is nothing but the special string
            at = pc.index(words, special).as_py()
            if at >= 0:
                place[at] = len(ends) - 1
                flat, ends = np.append(flat, np.int32(i)), np.append(ends, len(flat) + 1)
        return take_lists(flat, ends, place)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and their offsets; each distinct word is encoded once."""
        words: list[str] = []
        parts, bounds, before = [], [0], 0
        for text in texts:
            for special, own in self.pieces(text):
                if special is not None:
                    words.append(special)
                words += own
            bounds.append(before + len(words))
            if len(words) > 100_000:  # Arrow holds words in a tenth of the memory
                parts.append(pa.array(words, pa.large_string()))
                before, words = bounds[-1], []
        coded = pa.concat_arrays([*parts, pa.array(words, pa.large_string())]).dictionary_encode()
        del parts, words
        ids, ends = take_lists(*self.encode_words(coded.dictionary), coded.indices.to_numpy().astype(np.int64))
        return ids.astype(np.int32), ends[np.array(bounds)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of lists of ids that lie between bounds."""
        data, ends = take_lists(self.v.byte_data, self.v.byte_ends, ids.astype(np.int64))
        out = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends[bounds].astype(np.int64)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # some id ends within a character
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())
        return out.cast(pa.string())


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", limit: int = LEXICON) -> list[str]:
    """The most frequent words over all documents, limit of them at most: counted by partition, then summed; words of like frequency are taken or left together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = _pieces(list(Vocabulary(path).special)), Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return got

        for b in batches:
            for text in b.column("text").to_pylist():
                for _, words in pieces(text):
                    counts.update(words)
                if len(counts) > 200_000:
                    yield out()
        yield out()

    counted = docs.select(F.coalesce(ref(text_col), F.lit("")).alias("text")).mapInArrow(run, "word string, n long")
    # classes of like frequency, the highest first, as many as fit: the driver gets no more than limit words
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 and octet_length(word) <= 64").withColumn("class", F.floor(F.log2("n") * 8).cast("int"))
    counted = stage(counted, "words")
    left, least = limit, None
    for r in counted.groupBy("class").agg(F.count("*").alias("k")).orderBy(F.desc("class")).collect():
        left -= r.k
        if left < 0:
            break
        least = r["class"]
    return [] if least is None else [r.word for r in counted.where(F.col("class") >= least).select("word").collect()]


def lexicon(words: list[str], path: str) -> bytes:
    v = Vocabulary(path)
    return Transducer.compile((w.encode(), v.merge(w.encode())) for w in dict.fromkeys(words))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LEXICON) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text, as the library encodes and decodes it.

    Special strings in a text become their ids. Null text: as empty, no ids. Repeated
    rows stay. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    image = spark.sparkContext.broadcast(lexicon(frequent_words(docs, path, text_col, limit), path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(kept_in_worker(("bytes", path), lambda: Vocabulary(path)), Transducer.mapped(image.value))
        for b in batches:
            for part in by_bytes(b, "text", BATCH_BYTES):
                ids, bounds = codec.encode_batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), codec.decode_batch(ids, bounds)], ["doc_id", "ids", "decoded"])

    return docs.select(ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
