"""Byte-exact removal of passages that occur more than once, by a sparse suffix array.

Which suffixes: every `length`-byte window chooses the k-gram in it of least hash
(the last of equals) as its anchor, by content alone, so equal windows choose anchors
at equal offsets. A text's windows thus fall into segments, one for each anchor, and
only windows of segments with equal anchor hashes can be equal.

1. Segments are counted by anchor hash, summed before the shuffle. An anchor seen once
   settles its windows.
2. Of anchors seen more often, segments whose whole bytes have equal digests are
   repeats of one another; only one of each is compared on.
3. What is left for an anchor is compared exactly: the suffixes that start at the anchor
   are sorted by deep-shallow sorting (multikey quicksort to a shallow depth, then
   blind tries for groups that still tie), and so are the reversed left contexts. The
   groups of the suffix order, joined small to large, give for every common right
   length the best common left length, hence all windows that occur twice.
4. An anchor with more than GROUP distinct segments isn't gathered: its windows are
   counted by digest, summed before the shuffle, with the same result.

Passages can be measured in words too: a text then stands as the 32-bit codes of its words as well, and
windows of so many codes are found in the same way and the same pass; the last bit of an anchor's hash
tells the kinds apart. Two windows that differ in one word pass as equal with a probability of 2**-32.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import FILE_TEXTS, few, ref, stage

GRAM = 100
#: Of word codes: 15 words.
WORD_GRAM = 60
WORD = 4
SHALLOW = 64
GROUP = 4096
CHUNK = 1 << 18
#: Rows of a batch that a worker handles at once.
SLICE = 256
#: Segments that a worker holds at once, about.
ROWS = 1 << 16
#: Anchors in a written file, about, counted by the segments that have them.
ANCHORS = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Anchors:
    """Cuts texts into segments: (anchor hash, anchor, first window, last window) in text order, one after another."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        n = CHUNK + length
        self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 2**64), n)
        self.code = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def __call__(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        held = None  # the last of a chunk, which may go on in the next
        raw = np.frombuffer(text, np.uint8)
        for at in range(0, len(raw) - self.length + 1, CHUNK):
            part = raw[at : at + CHUNK + self.length - 1]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.code[part] * self.up[: len(part)])))
            m = len(part) - self.gram + 1
            h = _mix((sums[self.gram :] - sums[:-self.gram]) * self.down[:m])
            v = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
            w = self.span
            rows = -(-m // w)
            padded = np.full(rows * w, np.uint64(2**64 - 1))
            padded[:m] = v
            padded = padded.reshape(rows, w)
            ahead = np.minimum.accumulate(padded, axis=1).ravel()
            back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
            n = m - w + 1
            least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
            owner = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [n]))
            first = owner[cuts[:-1]]
            for k in range(0, len(first), ROWS):
                own, lows, highs = first[k : k + ROWS], cuts[k : k + ROWS], cuts[k + 1 : k + ROWS + 1]
                for a, hv, lo, hi in zip((own + at).tolist(), h[own].tolist(), (lows[: len(own)] + at).tolist(), (highs - 1 + at).tolist()):
                    if held and held[1] == a:
                        lo = held[2]
                    elif held:
                        yield held
                    held = (hv, a, lo, hi)
        if held:
            yield held


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def word_codes(text: bytes, known: dict[bytes, bytes]) -> bytes:
    words = text.split()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh32_digest(w)
    return b"".join(map(known.__getitem__, words))


SEGMENTS = "key binary, doc_id long, n int, h long, dig long, at int, lo int, hi int, end int"


#: Length and gram of the windows of each kind: of bytes, of word codes.
Kinds = list[tuple[int, int]]


def _segments(kinds: Kinds):
    """A row for each segment; equal segments of a text that follow one another (it goes on periodically) are one row, n times, of windows lo to end."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int32(), None, None, *[pa.int32()] * 4]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(x) if t is None else pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, digest = [Anchors(*kind) for kind in kinds], xxhash.xxh3_64_intdigest
        for b in batches:
            known: dict[bytes, bytes] = {}
            times = Counter(b.column("key").to_pylist())  # a copy in this batch counts, and isn't cut again
            for k in range(0, len(b), SLICE):
                part = b.slice(k, SLICE)
                rows: list[list] = []
                for i, (key, doc) in enumerate(zip(part.column("key").to_pylist(), part.column("doc_id").to_pylist())):
                    n = times.pop(key, 0)
                    if not n:
                        continue
                    text = part.column("text")[i].as_buffer().to_pybytes()
                    for of_words, cut in enumerate(cuts):
                        raw, before = word_codes(text, known) if of_words else text, None
                        for h, a, s, e in cut(raw):
                            h, d = h & ~1 | of_words, digest(raw[s : e + cut.length])
                            if before == (h, d):
                                rows[-1][2] += n
                                rows[-1][8] = e
                                continue
                            if len(rows) >= ROWS:
                                yield batch(rows)
                                rows = []
                            rows.append([key, doc, n, h, d, a, s, e, e])
                            before = h, d
                yield batch(rows)

    return run


PARTS = "key binary, h long, dig long, n long, lo int, at int, many long, seg binary"


def _bytes_of(kinds: Kinds):
    """The bytes of the wanted segments of each text."""
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known: dict[bytes, bytes] = {}
            for k in range(0, len(whole), SLICE):
                b = whole.slice(k, SLICE)
                rows = []
                for key, text, parts in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()), b.column("parts")):
                    raw, codes = text.as_py(), None
                    for p in parts.as_py():
                        of_words = p["h"] & 1
                        if of_words and codes is None:
                            codes = word_codes(raw, known)
                        rows.append((key, p["h"], p["dig"], p["n"], p["lo"], p["at"], p["many"], (codes if of_words else raw)[p["lo"] : p["hi"] + kinds[of_words][0]]))
                    if len(rows) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names)

    return run


TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    while start < n:
        step = min(64, n - start)
        if a[start : start + step] != b[start : start + step]:
            while a[start] == b[start]:
                start += 1
            return start
        start += step
    return n


class BlindTrie:
    """Strings as leaves; an inner node keeps only the depth at which its strings first differ, and a branch for each next byte."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, first

    def insert(self, x: int) -> None:
        s, node, path = self.strings[x], self.root, []
        while not isinstance(node, int):  # blind: only branching bytes are read
            path.append(node)
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1, next(iter(kids.values())))
        t = self.strings[node]
        depth = common_prefix(s, t)
        mine, its = s[depth] if depth < len(s) else -1, t[depth] if depth < len(t) else -1
        above = None
        for up in path:
            if up[0] >= depth:
                break
            above = up
        below = self.root if above is None else above[1][s[above[0]] if above[0] < len(s) else -1]
        if not isinstance(below, int) and below[0] == depth and mine not in below[1]:
            below[1][mine] = x
            return
        if mine == its:  # equal strings: a chain of equals, kept as branches beyond the end
            mine = -2 - x
        if not isinstance(below, int) and below[0] == depth:
            below[1][mine] = x
            return
        new = (depth, {its: below, mine: x})
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = new

    def order(self) -> tuple[list[int], list[int]]:
        """Leaves in order, and the common prefix of each with the one before (0 for the first)."""
        out, lcp, todo = [], [], [(self.root, 0)]
        while todo:
            node, shared = todo.pop()
            if isinstance(node, int):
                out.append(node)
                lcp.append(shared)
            else:
                depth, kids = node
                for k, (_, kid) in reversed(list(enumerate(sorted(kids.items(), key=lambda p: p[0])))):
                    todo.append((kid, shared if k == 0 else depth))
        return out, lcp


def deep_shallow(strings: list[bytes], start: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, and each one's common prefix with the one before it (0 for the first).

    Multikey quicksort on eight-byte characters from depth start (up to which all are
    equal) to start + shallow; groups that still tie are sorted by a blind trie.
    """
    out: list[int] = []
    lcp: list[int] = []
    todo = [(list(range(len(strings))), start)]
    while todo:
        own, depth = todo.pop()
        if len(own) == 1:
            done, common = own, [0]
        elif depth >= start + shallow:
            trie = BlindTrie(strings, own[0])
            for x in own[1:]:
                trie.insert(x)
            done, common = trie.order()
        else:
            pivot = strings[own[len(own) // 2]][depth : depth + 8]
            less, same, more = [], [], []
            for x in own:
                c = strings[x][depth : depth + 8]
                (less if c < pivot else more if c > pivot else same).append(x)
            if more:
                todo.append((more, depth))
            if len(pivot) < 8 and len(same) > 1:  # they end here: all equal
                done, common = [], []
                if less:
                    todo.append((same, start + shallow))
                    todo.append((less, depth))
                    continue
                todo.append((same, start + shallow))
                continue
            todo.append((same, depth + 8))
            if less:
                todo.append((less, depth))
            continue
        common[0] = common_prefix(strings[out[-1]], strings[done[0]], start) if out else 0
        out += done
        lcp += common
    return out, lcp


def repeated_windows(members: list[tuple[bytes, int]], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """For (bytes, anchor's place in them) of distinct segments of one anchor: runs of window starts, in them, that occur in another too."""
    n = len(members)
    rights, lefts = [b[a:] for b, a in members], [b[:a][::-1] for b, a in members]
    order, lcp = deep_shallow(rights, 0 if len({r[:gram] for r in rights}) > 1 else gram)
    left_order, left_lcp = deep_shallow(lefts)
    rank = [0] * n
    for k, x in enumerate(left_order):
        rank[x] = k
    # least common prefix over a range of the left order, by doubling
    table, k = [np.array(left_lcp, np.int64)], 1
    while 2 * k <= n:
        table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        k *= 2

    def left_common(p: int, q: int) -> int:
        lo, hi = min(p, q) + 1, max(p, q)
        t = (hi - lo + 1).bit_length() - 1
        return int(min(table[t][lo], table[t][hi - (1 << t) + 1]))

    found: list[list[tuple[int, int]]] = [[] for _ in members]

    def meet(p: int, q: int, depth: int) -> None:
        most = left_common(p, q)
        least = max(0, length - depth)
        if most >= least:
            for x in (left_order[p], left_order[q]):
                found[x].append((len(lefts[x]) - most, len(lefts[x]) - least))

    group = list(range(n))  # of each place in the order, by union

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    ranks = [[rank[x]] for x in order]
    for k in sorted((k for k in range(1, n) if lcp[k] >= gram), key=lambda k: -lcp[k]):
        a, b = top(k - 1), top(k)
        if len(ranks[a]) < len(ranks[b]):
            a, b = b, a
        many, few = ranks[a], ranks[b]
        for r in few:
            i = bisect_left(many, r)
            for j in (i - 1, i):
                if 0 <= j < len(many):
                    meet(r, many[j], lcp[k])
        # those of the larger group that get a new neighbour have met it above
        ranks[a] = sorted(many + few)
        ranks[b] = []
        group[b] = a
    return found


def _compare(kinds: Kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def settle():
            rows = []
            if len(held) > 1:
                own = list(held.values())
                for (key, n, lo, _, _), runs in zip(own, repeated_windows([(seg, at) for _, _, _, at, seg in own], *kinds[now & 1])):
                    if n == 1:
                        rows += [(key, lo + a, lo + b, now & 1) for a, b in runs]
            return rows

        for b in batches:
            rows = []
            for h, dig, n, key, lo, at, seg in zip(*(b.column(c).to_pylist() for c in ("h", "dig", "n", "key", "lo", "at", "seg"))):
                if h != now:
                    rows += settle()
                    now, held = h, {}
                held[dig] = (key, n, lo, at - lo, seg)
            yield _spans(rows)
        yield _spans(settle())

    return run


def _spans(rows: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] == 1 for r in rows], pa.bool_())], ["key", "lo", "hi", "of_words"])


def _windows(kinds: Kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for h, n, key, lo, at, seg in zip(*(b.column(c).to_pylist() for c in ("h", "n", "key", "lo", "at", "seg"))):
                length = kinds[h & 1][0]
                m = len(seg) - length + 1
                starts = np.arange(lo, lo + m)
                yield pa.RecordBatch.from_arrays([pa.array([h] * m, pa.int64()), pa.array(at - starts, pa.int32()), _signed([digest(seg[k : k + length]) for k in range(m)]), pa.array([n] * m, pa.int64()), pa.array([key] * m, pa.binary()), pa.array(starts, pa.int32())], ["h", "l", "dig", "n", "key", "s"])

    return run


def repeat_spans(keyed: DataFrame, rows: int, kinds: Kinds) -> DataFrame:
    """(key, lo, hi, of_words): window starts lo..hi of the text of this key that also start elsewhere, in bytes of the text or of its word codes. keyed: so many rows of (doc_id, key, text), key standing for the text."""
    # a code stands for a letter and a space at least
    shortest = min([kinds[0][0], *(n // 2 - 1 for n, _ in kinds[1:])])
    segments = stage(keyed.where(F.octet_length("text") >= shortest).mapInArrow(_segments(kinds), SEGMENTS), "segments")
    anchors = segments.groupBy("h").agg(F.sum("n").alias("total"), (F.min("dig") != F.max("dig")).alias("many"))
    # written first: a join straight on the sums could not split a hot anchor's segments
    anchors = stage(few(anchors.where("total > 1").select("h", "many"), segments.count(), ANCHORS), "anchors")
    seen = stage(segments.join(anchors, "h"), "repeated-anchors")
    n = seen.count()  # none of the tables below has more rows, but for windows
    of_words = (F.col("h").bitwiseAND(F.lit(1)) == 1).alias("of_words")
    alike = seen.where("not many").select("key", "lo", F.col("end").alias("hi"), of_words)

    mixed = seen.where("many")
    distinct = mixed.groupBy("h", "dig").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "key", "lo", "hi", "at")).alias("r")).select("h", "dig", "n", "r.*")
    distinct = stage(few(distinct, n), "distinct-segments")
    # joins with hot keys are written one by one: in a union Spark would not split them
    full = mixed.join(distinct.where("n > 1").select("h", "dig"), ["h", "dig"], "left_semi").select("key", "lo", F.col("end").alias("hi"), of_words)
    full = stage(few(full, n), "equal-segments")

    sizes = distinct.groupBy("h").agg(F.count("*").alias("many"))
    sizes = stage(few(sizes, n), "anchor-sizes")
    wanted = distinct.join(sizes, "h").groupBy("key", "doc_id").agg(F.collect_list(F.struct("h", "dig", "n", "lo", "hi", "at", "many")).alias("parts"))
    wanted = stage(few(wanted.withColumnRenamed("doc_id", "by"), n), "wanted-segments")
    cut = keyed.join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("by"))).select("key", "text", "parts")
    cut = stage(few(cut, max(rows, n), FILE_TEXTS).mapInArrow(_bytes_of(kinds), PARTS), "segment-bytes")
    near = cut.where(F.col("many") <= GROUP).select("h", "dig", "n", "key", "lo", "at", "seg").repartition("h").sortWithinPartitions("h")
    compared = near.mapInArrow(_compare(kinds), "key binary, lo int, hi int, of_words boolean")

    hot = cut.where(F.col("many") > GROUP).mapInArrow(_windows(kinds), "h long, l int, dig long, n long, key binary, s int")
    twice = stage(hot.groupBy("h", "l", "dig").agg(F.sum("n").alias("times")).where("times > 1").select("h", "l", "dig"), "repeated-windows")
    counted = stage(hot.where("n = 1").join(twice, ["h", "l", "dig"], "left_semi").select("key", F.col("s").alias("lo"), F.col("s").alias("hi"), of_words), "counted-windows")
    return alike.unionByName(full).unionByName(compared).unionByName(counted)


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the text without the bytes in spans, and the maximal runs removed."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return b"".join(kept), [(lo, hi) for lo, hi in runs]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(length: int, words: int, cut_passages: bool, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), SLICE):
                b = whole.slice(k, SLICE)
                kept, removed, passages = [], [], []
                for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                    own = [(s["lo"], s["hi"] + length) for s in spans or () if not s["of_words"]]
                    of_words = word_spans(text, [(s["lo"], s["hi"]) for s in spans or () if s["of_words"]], words)
                    left, runs = cut_out(text, own + of_words if cut_passages else own)
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                    for out, found in ((removed, runs), (passages, cut_out(text, of_words)[1])):
                        out.append([{"start": lo, "end": hi} for lo, hi in found])
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_bytes"), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, RUNS), pa.array(passages, RUNS)], ["row", "n_bytes", "kept", "removed", "passages"])

    return run


def word_spans(text: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Byte runs of the text's words that windows of word codes, starting in spans, cover."""
    if not spans:
        return []
    at = [m.span() for m in re.finditer(rb"\S+", text)]
    return [(at[-(-lo // WORD)][0], at[hi // WORD + words - 1][1]) for lo, hi in spans if -(-lo // WORD) <= hi // WORD]


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None, length: int = 400, words: int | None = None, cut_passages: bool = True, as_text: bool = False) -> DataFrame:
    """Every row of docs as (row: struct of the carried columns, n_bytes, kept binary, removed and passages: arrays of byte runs).

    as_text: kept is a string, without characters that a removal cuts through.

    Each byte that a window of `length` bytes covers which also starts elsewhere, in this
    document or another, is removed; windows are judged on the input. With `words`, passages
    are the runs covered by that many words (between ASCII spaces, whatever these are) that
    are there twice; they are removed too, or with cut_passages=False only told (without `words`: none). Null text: empty.
    Copies of a long text lose all of it, whatever their ids. Repeated rows are copies.
    Texts shorter than the window stay whole. An empty table gives an empty result.
    A very long text is cut piece by piece, a periodic one into one row a period's run.
    Carried columns (all but the text by default) may have any names.
    """
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    row = F.struct(*[ref(c).alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("_"))
    keyed = docs.select(row.alias("row"), ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    kinds = [(length, GRAM)] + ([(WORD * words, WORD_GRAM)] if words else [])
    rows = keyed.count()
    spans = repeat_spans(keyed.select("doc_id", "key", "text"), rows, kinds)
    spans = stage(few(spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi", "of_words")).alias("spans")), rows, FILE_TEXTS), "spans")
    joined = few(keyed.join(spans, "key", "left"), rows, FILE_TEXTS).select("row", "text", "spans", F.octet_length("text").cast("long").alias("n_bytes"))
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = T.StructType([keyed.schema["row"], joined.schema["n_bytes"], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("removed", runs), T.StructField("passages", runs)])
    out = joined.mapInArrow(_cut(length, words or 0, cut_passages, as_text), kind)
    return out.select(F.struct(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)] or [F.lit(0).alias("_")]).alias("row"), "n_bytes", "kept", "removed", "passages")
