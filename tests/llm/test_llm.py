"""The corpus operators against brute force, round trips and the edge cases that their docstrings define."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, licenses, quality, repeats, sharding, shingles, simhash, tokens, urls, warc
from seqloom.llm.common import components
from seqloom.llm.vocabularies import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "One"), (None, "one"), (None, None), (5, "a b c d e f g h i j k l"), (6, "x" * 70_000), (7, "naïve 😀 é́ words\x00 and\x0bmore")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# -- components, SimHash ------------------------------------------------------


def plain_components(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in plain_components([p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) == plain_fingerprint(text.encode("utf-8", "ignore").decode())


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("shard", [8192, 40])
def test_near_links_are_complete(spark, shard):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(1500)}
    fps |= {near(rng, f, k) for f in list(fps)[:150] for k in (1, 3, 4, 5)}
    ball = rng.getrandbits(64)
    fps |= {near(rng, ball, rng.randrange(4)) for _ in range(300)}
    fps = np.array(sorted(fps), np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    want = plain_components([(int(fps[a]), int(fps[b])) for a, b in zip(*np.nonzero(np.triu(close, 1)))])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(df, shard=shard).collect()]
    assert plain_components(links) == want


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = words(rng, 300)
    rows = ODD + [(20 + k, base + f" end{k}") for k in range(6)] + [(40, words(rng, 300)), (19, base), (41, base.upper())]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [(i, plain_fingerprint(t or "")) for i, t in rows]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a, len(fps)) if (fps[a][1] ^ fps[b][1]).bit_count() <= 4]
    group = plain_components(pairs)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    want = Counter((i, f, least.get(group[k])) for k, (i, f) in enumerate(fps))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    one = simhash.keep_one(docs_of(spark, rows))
    assert one.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(one.collect()) == len(set(group.values()))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_dedup_stage_is_brute_force_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(12)
    rows = list(ODD)
    for k in range(60):
        base = words(rng, rng.choice([6, 40, 150, 400])).split()
        for c in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(9)}"
            rows.append((100 + 10 * k + c, " ".join(own).title() if c % 2 else "\n".join(own)))
    common = words(rng, 60)
    rows += [(1000 + k, common + " " + words(rng, 40)) for k in range(60)]  # alike, but not as much as 0.8

    def grams(t):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [grams(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a, len(rows)) if sets[a] == sets[b] or len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8]
    group = plain_components(pairs)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    got = shingles.similar_texts(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least.get(group[k])) for k, (i, _) in enumerate(rows))
    kept = corpus_pipeline.near_dedup(spark, docs_of(spark, rows), "")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.get(g) for g in set(group.values()))
    assert 60 < len(least) < len(rows) - 40
    assert shingles.similar_texts(docs_of(spark, [])).count() == 0


def test_stages_write_few_files(spark, tmp_path, monkeypatch):
    """A file costs the executor two child processes: small tables go to few, also where Spark merges no partitions."""
    import corpus_pipeline

    rng = random.Random(11)
    base = [words(rng, 90) for _ in range(200)]
    docs = docs_of(spark, [(i, base[i % 200] + " " + words(rng, 2 + i % 7)) for i in range(600)]).coalesce(1)
    paths = []
    monkeypatch.setattr("seqloom.llm.common.new_path", lambda _, name: paths.append(f"{tmp_path}/{len(paths)}-{name}") or paths[-1])
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for f, n in ((corpus_pipeline.near_dedup, 200), (corpus_pipeline.passage_dedup, 600)):
            f(spark, docs, "").write.parquet(f"{tmp_path}/out-{n}")
            assert spark.read.parquet(f"{tmp_path}/out-{n}").count() == n
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = {d.name: len([*d.glob("part-*")]) for d in tmp_path.iterdir()}
    assert {"sets", "judged", "least", "anchors", "spans", "200", "600"} <= {name.partition("-")[2] for name in files}
    assert max(files.values()) <= 2 * spark.sparkContext.defaultParallelism, files


# -- sharding -----------------------------------------------------------------


def test_sharding(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), words(rng, rng.randrange(80))) for _ in range(700)] + [(9, "hot")] * 300 + ODD
    got = sharding.shard_by_bytes(docs_of(spark, rows).repartition(7)).collect()
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, n, zlib.crc32((t or "").encode())) for (i, t), n in zip(rows, sizes))
    by = {s: sorted((r for r in got if r.shard == s), key=lambda r: r.slot) for s in range(8)}
    assert all([r.slot for r in own] == list(range(len(own))) for own in by.values())
    order = [-1 if r.doc_id is None else r.doc_id for s in range(8) for r in by[s]]
    assert order == sorted(order)
    assert all(abs(sum(r.size for r in own) - sum(sizes) / 8) <= max(sizes) for own in by.values())
    assert sharding.shard_by_bytes(docs_of(spark, [])).count() == 0


# -- repeated passages --------------------------------------------------------


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\x01" * length
        out.append((bytes(c for c, m in zip(t, mask) if not m), sum(mask), sum(m and not p for p, m in zip(b"\0" + bytes(mask), mask))))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=14))
def test_deep_shallow(texts):
    data = [t.encode() for t in texts]
    order, lcp = repeats.deep_shallow(data, 0, 8)
    got = [data[k] for k in order]
    assert got == sorted(data) and sorted(order) == list(range(len(data)))
    for k in range(1, len(got)):
        assert lcp[k] == repeats.common_prefix(got[k - 1], got[k])


def passages(rng, n):
    shared = [bytes(rng.choice(b"abcdefgh ") for _ in range(k)).decode() for k in (400, 401, 650, 399, 1200)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(bytes(rng.choice(b"abcdefgh i") for _ in range(rng.randrange(0, 500))).decode())
            if rng.random() < 0.7:
                p = rng.choice(shared)
                cut = rng.randrange(0, 120) if rng.random() < 0.5 else 0
                parts.append(p[cut:])
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("group", [1024, 3])
def test_repeats(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(11)
    texts = passages(rng, 120) + ["ab" * 700, "é" * 900, "z" * 399, "z" * 400, "y" * 401]
    texts += texts[:6] + [texts[0]] * 20
    edited = texts[3][:300] + "X" + texts[3][300:]
    texts += [edited, edited[:900] + "Y" + edited[900:]]
    rows = list(enumerate(texts)) + ODD
    got = repeats.remove_repeats(docs_of(spark, rows).repartition(5), carry=["doc_id"]).selectExpr("row.doc_id", "n_bytes", "kept", "removed").collect()
    raw = [(t or "").encode() for _, t in rows]
    want = Counter((i, len(t), k, n, s) for (i, _), t, (k, n, s) in zip(rows, raw, plain_repeats(raw, 400)))
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept), r.n_bytes - len(r.kept), len(r.removed)) for r in got) == want
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("group", [1024, 3])
def test_passage_stage_takes_passages_of_over_50_words(spark, group, monkeypatch):
    import re

    import corpus_pipeline

    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(13)
    shared = [words(rng, n, 90) for n in (50, 51, 52, 60, 120)] + ["z" * 450, "a " * 55, " \n".join(words(rng, 70).split())]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(words(rng, rng.randrange(1, 60), 5000))
            if rng.random() < 0.5:
                parts.append("  ".join(rng.choice(shared).split()[rng.randrange(3) :]) if rng.random() < 0.5 else rng.choice(shared))
        texts.append(" ".join(parts))
    texts += texts[:3] + ["é " * 52, "short one"]
    rows = list(enumerate(texts)) + ODD

    raw = [(t or "").encode() for _, t in rows]
    times = Counter(tuple(w[i : i + 51]) for t in raw for w in [t.split()] for i in range(len(w) - 50))
    want = Counter()
    windows = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    for (i, _), t in zip(rows, raw):
        mask = bytearray(len(t))
        for k in range(len(t) - 399):
            if windows[t[k : k + 400]] > 1:
                mask[k : k + 400] = b"\x01" * 400
        at = [m.span() for m in re.finditer(rb"\S+", t)]
        for k in range(len(at) - 50):
            if times[tuple(t[a:b] for a, b in at[k : k + 51])] > 1:
                mask[at[k][0] : at[k + 50][1]] = b"\x01" * (at[k + 50][1] - at[k][0])
        want[i, bytes(c for c, m in zip(t, mask) if not m).decode("utf-8", "ignore")] += 1
    got = corpus_pipeline.passage_dedup(spark, docs_of(spark, rows).repartition(5), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == want


def test_anchors_span_chunks(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = list(repeats.Anchors(400, 100)(text))
    monkeypatch.setattr(repeats, "CHUNK", 700)
    monkeypatch.setattr(repeats, "ROWS", 3)
    assert list(repeats.Anchors(400, 100)(text)) == whole


def test_very_long_periodic_texts_are_few_segments(spark):
    rows = [(1, "x" * 3_000_000), (2, "ab\n" * 400_000), (3, "one two three " * 100_000)]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs_of(spark, rows), carry=["doc_id"], words=51).selectExpr("row.doc_id", "n_bytes", "length(kept) AS left", "size(removed) AS runs", "size(passages) AS passages").collect()}
    assert {i: (r.n_bytes, r.left, r.runs, r.passages) for i, r in got.items()} == {1: (3_000_000, 0, 1, 0), 2: (1_200_000, 0, 1, 1), 3: (1_400_000, 0, 1, 1)}
    slim = pa.RecordBatch.from_pydict({"key": pa.array([b"k"]), "doc_id": pa.array([1]), "text": pa.array(["x" * 3_000_000])})
    assert sum(map(len, repeats._segments([(400, 100)])([slim]))) <= 2


def test_stages_pass_odd_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    names = ["quality", "leaks", "_quality", "key", "fp", "row", "kept", "a.b", "doc id", "spans", "th"]
    kind = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)), 5, *names), (None, None, None, *[None] * len(names))], kind)
    for name, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, docs, f"file://{tmp_path}")
        assert got.dtypes == docs.dtypes, name
        assert [list(r)[3:] for r in got.where("doc_id = 1").collect()] == [names], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}").count() == 2


def test_odd_columns_pass(spark):
    rows = spark.createDataFrame([(1, "t", "k", 5, "x.y")], "doc_id long, text string, key string, lo int, `a.b` string")
    got = repeats.remove_repeats(rows).select("row.*").first()
    assert (got.key, got.lo, got["a.b"]) == ("k", 5, "x.y")
    assert simhash.keep_one(rows).columns == rows.columns


# -- quality ------------------------------------------------------------------


def plain_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    marks = {}
    for n in range(5, 11):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        times = Counter(grams)
        marks[n] = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(n)}
    lines, dup = set(), []
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += [line] if line in lines else []
            lines.add(line)
    chars = sum(map(len, w))
    dup_chars = sum(len(x) for line in dup for x in re.findall(r"[^\x20\x09-\x0D]+", line))
    failed = len(w) < 10 or 100 * len(marks[5]) > 20 * len(w)
    fine = all(sum(len(w[i]) for i in marks[n]) <= most * chars for n, most in quality.NGRAM_SHARE.items()) and dup_chars <= quality.LINE_SHARE * chars
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), len(dup), len(marks[5]), failed, not failed and fine


def test_quality(spark):
    rng = random.Random(9)
    line = words(rng, 12)
    rows = ODD + [(10, words(rng, 200)), (11, "\n".join([line] * 5)), (12, words(rng, 60) + "\n" + line + "\n" + words(rng, 90, 9) + "\n" + line), (13, "# a | b\n" * 30)]
    rows += [(100 + k, words(rng, 60, rng.choice([3, 8, 500]))) for k in range(40)]
    got = quality.quality(docs_of(spark, rows).withColumnRenamed("lang", "kept")).selectExpr("doc_id", "quality.*").collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == Counter((i, *plain_quality(t or "")) for i, t in rows)


# -- licenses -----------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(4)
    apache = dict(licenses.TEMPLATES)["Apache-2.0"]
    full = licenses.TEMPLATES[4][1]
    broken = full.split()
    del broken[20:23]
    broken[40] = "otherword"
    rows = ODD + [(10, words(rng, 30) + " " + apache + " " + words(rng, 30)), (11, words(rng, 500)), (12, "x. " + " ".join(broken).upper() + " y"), (13, "Released under the MIT License.")]
    got = {r.doc_id: r.licenses for r in licenses.licenses(docs_of(spark, rows)).where("size(licenses) > 0").collect()}
    assert {k: [x.license for x in v] for k, v in got.items()} == {10: ["Apache-2.0"], 12: ["Apache-2.0"], 13: ["MIT"]}
    text = dict(rows)[10]
    assert text[got[10][0].start : got[10][0].end] == apache.rstrip(".")
    assert got[10][0].coverage == 1.0 and got[12][0].template == 4 and 0.9 < got[12][0].coverage < 1
    assert licenses.licenses(docs_of(spark, [])).count() == 0


def plain_licenses(text, templates):
    """Of each template the best local alignment with the whole text, every cell of the table, as (template, matched words)."""
    d, out = licenses._WORD.findall(text.lower()), []
    for t, (_, own) in enumerate(templates):
        w = licenses._WORD.findall(own.lower())
        row = [(0.0, 0)] * (len(d) + 1)
        for x in w:
            new = [(row[0][0] - 0.5, row[0][1])]
            for j, y in enumerate(d, 1):
                diag = (row[j - 1][0] + 1, row[j - 1][1] + 1) if x == y else (row[j - 1][0] - 0.5, row[j - 1][1])
                new.append(max(diag, (row[j][0] - 0.5, row[j][1]), (new[j - 1][0] - 0.5, new[j - 1][1])))
            row = new
        n = max(row)[1]
        if n >= licenses.COVERAGE * len(w):
            out.append((t, n))
    return out


def test_licenses_are_those_of_whole_alignments():
    """One edited notice, header or whole text in each document; brute force fills the whole table of every template."""
    rng = random.Random(21)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = 0
    for k in range(60):
        own = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1].split()
        for _ in range(rng.randrange(0, 1 + len(own) // 12)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = ["qqq"][: rng.randrange(2)]
        text = f"{words(rng, 15)} {' '.join(own)} {words(rng, 15)}" if k % 5 else words(rng, 40)
        want = plain_licenses(text, licenses.TEMPLATES)
        got = [(x[1], x[2]) for x in scanner.scan(text)]
        assert bool(got) == bool(want), (text, got, want)
        if want:  # the template with the most matched words, the better covered of equals
            best = max(want, key=lambda x: (x[1], x[1] / len(licenses._WORD.findall(licenses.TEMPLATES[x[0]][1])), -x[0]))
            assert got == [best], (text, got, want)
            found += 1
    assert found > 40


def test_bsd_texts_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"):
        text = [t for n, t in licenses.TEMPLATES if n == name][-1]
        assert [(x[0], x[3]) for x in scanner.scan("Copyright (c) someone. All rights reserved.\n" + text)] == [(name, 1.0)]


def test_neighbouring_licence_lines_are_all_found():
    """Every line of a run of whole and edited notices, against the places where they were put."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = "Released under the MIT License."
    for k in range(1, 12):
        assert [(x[0], x[4]) for x in scanner.scan(" ".join([mit] * k))] == [("MIT", len(mit + " ") * i) for i in range(k)]
    rng = random.Random(15)
    lines = [(n, t) for n, t in licenses.TEMPLATES if 4 < len(t.split()) < 13]
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randrange(1, 7)):
            name, line = rng.choice(lines)
            own = line.rstrip(".").split()
            lo, hi = 0, len(own)
            if rng.random() < 0.6 and len(own) > 7:
                at = rng.randrange(len(own))
                own[at] = "qqq"
                lo, hi = lo + (at == 0), hi - (at == len(own) - 1)
            spare = "" if rng.random() < 0.7 else words(rng, rng.randrange(1, 9)) + " "
            start = len(text) + len(spare) + len("".join(w + " " for w in own[:lo]))
            want.append((name, start, start + len(" ".join(own[lo:hi]))))
            text += spare + " ".join(own) + " "
        assert [(x[0], x[4], x[5]) for x in scanner.scan(text)] == want, text


# -- URLs ---------------------------------------------------------------------

URLS = [None, "", "nothing", "https://A.Example.NET/en/x?y#z", "http://net/a", "http://netx/a", "https://b.example.com/de/1", "https://b.example.com/DE/1", "x://ORG", "ftp://a.org/fr/", "a://b://c/d", "https://h.net", "https://user@h.net:80/p", "https://é.net/ü?q"]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_score(model, host, path):
    """The model's score by plain integers: n-grams of 3 to 5 bytes of host and of path, hashed, counted and scaled to length 1."""
    counts = Counter()
    for mark, part in ((1, host), (2, path)):
        data = bytes([mark]) + part.encode() + b"\x03"
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                h = (14695981039346656037 + 2 * n + mark) % 2**64
                for c in data[i : i + n]:
                    h = (h ^ c) * 1099511628211 % 2**64
                counts[(h ^ h >> 29) % urls.DIMS] += 1
    size = max(1.0, sum(v * v for v in counts.values()) ** 0.5)
    return 1 / (1 + 2.718281828459045 ** -(sum(float(model[0][k]) * v for k, v in counts.items()) / size + model[1]))


def test_url_filter(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(3, URLS[3], "again"), (None, None, None), (90, "https://pokerclub.test/en/1", "a"), (91, "https://sciencemuseum.test/en/1", "a"), (92, "https://casinos.test/" + "a/" * 40_000, "long")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    model = urls.fit(urls.labelled())
    want = []
    for i, u, _ in rows:
        host, path = urls.plain_parts(u)
        rule, verdict = plain_rule(host, path)
        want.append((i, host, path, rule, verdict or ("block" if plain_score(model, host, path) >= 0.5 else "allow")))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(want)
    assert {r.page_id: r.verdict for r in got if r.page_id in (90, 91)} == {90: "block", 91: "allow"}
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def url_accuracy(train, held):
    model = urls.fit(train)
    return sum((urls.score_of(model, h, p) >= 0.5) == bool(y) for h, p, y in held) / len(held)


def test_url_model_on_held_out_shapes_and_themes():
    by_shape = [url_accuracy(urls.labelled(shapes=[x for x in urls.SHAPES if x != own]), urls.labelled(shapes=[own])) for own in urls.SHAPES]
    assert min(by_shape) >= 0.97, by_shape
    by_theme = []
    for k in range(5):
        rest = tuple([x for i, x in enumerate(own) if i % 5 != k] for own in (urls.BLOCKED, urls.ALLOWED))
        held = tuple([x for i, x in enumerate(own) if i % 5 == k] for own in (urls.BLOCKED, urls.ALLOWED))
        by_theme.append(url_accuracy(urls.labelled(rest), urls.labelled(held)))
    print(by_shape, by_theme)
    assert sum(by_theme) / 5 >= 0.75, by_theme


# -- decontamination ----------------------------------------------------------


def plain_leaks(text, items):
    w, out = decontaminate.words_of(text), []
    for item, t in items:
        b = decontaminate.words_of(t)
        m = len(b)
        if not m or len(w) < m:
            continue
        k = min(5, m)
        grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
        sims = [decontaminate.similarity(grams(w[s : s + m]), grams(b)) for s in range(len(w) - m + 1)]
        if max(sims) >= 0.8:
            out.append((item, sims.index(max(sims)), max(sims)))
    return sorted(out)


def test_leaks(spark):
    rng = random.Random(6)
    items = [(k, words(rng, rng.choice([2, 4, 12, 30, 60, 61, 90]), 300)) for k in range(40)] + [(50, None), (51, " ")]
    rows = list(ODD)
    for k in range(150):
        body = words(rng, 80, 300).split()
        own = items[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [f"new{k}"][: rng.randrange(2)]
        at = rng.randrange(80)
        rows.append((100 + k, " ".join(body[:at] + own + body[at:]).title() if k % 2 else " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, tuple(x)) for i, t in rows for x in plain_leaks(t or "", [(a, b or "") for a, b in items]))
    for size in (decontaminate.ITEM_CHARS, 500):  # in one round and in many
        got = decontaminate.leaks(docs_of(spark, rows), bench, item_chars=size).selectExpr("doc_id", "explode(leaks) AS x").selectExpr("doc_id", "x.*").collect()
        assert Counter((r.doc_id, (r.item_id, r.start, r.similarity)) for r in got) == want
    assert len(want) > 35
    assert decontaminate.leaks(docs_of(spark, rows), bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_leaks_in_texts_shorter_than_the_item(spark):
    rng = random.Random(16)
    items = [(k, words(rng, rng.choice([3, 5, 8, 30, 59, 90]), 300)) for k in range(40)]
    rows = []
    for i, text in items:
        own = text.split()
        rows += [(1000 * i + k, " ".join(own[a : len(own) - b])) for k, (a, b) in enumerate([(0, 0), (0, 1), (2, 2), (4, 0), (3, 6), (20, 5)])]
        rows.append((1000 * i + 9, " ".join(own[:-1] + ["new"])))

    def plain(text):
        w, out = text.split(), []
        for item, t in items:
            b = t.split()
            k = min(5, len(b))
            grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
            sims = [decontaminate.similarity(grams(w[s : s + len(b)]), grams(b)) for s in range(max(1, len(w) - len(b) + 1))]
            if max(sims) >= 0.8:
                out.append((item, sims.index(max(sims)), max(sims)))
        return out

    want = Counter((i, x) for i, t in rows for x in plain(t))
    got = decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).selectExpr("doc_id", "explode(leaks) AS x").selectExpr("doc_id", "x.*").collect()
    assert Counter((r.doc_id, (r.item_id, r.start, r.similarity)) for r in got) == want
    assert sum(i % 1000 > 0 for i, _ in want) > 30


# -- tokens and BPE -----------------------------------------------------------

TEXTS = ["", " ", "Hello World's e\u0301é don't 12345\n\n  x", "ΣΑΣ Σ ς İstanbul ﬁ", "a\u00a0b\u2028c \x1c d\x85e", "<|endoftext|>x <|startoftext|> <|endoftext|", "😀 \u0301x 日本語テスト", "tab\tnew\r\nline   spaces   ", "\ufeffbom \u200b zero", "x" * 5000, "ab " * 3000, "\u0130\u0307 K\u212a ǅ", "Don't WE'LL x.'s ''d 'S é's naïve. ÀÉ, ß! ŉ ĲſS a1b22 a-b --'re"]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_chunk_encoder_is_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + TEXTS
    assert CHUNKS(pa.array(texts, pa.string())).to_pylist() == [e.ids for e in WORDS.encode_batch(texts, add_special_tokens=False)]


WORDS = library("word_bpe_49k.json")
CHUNKS = tokens.BatchEncoder(vocabulary("word_bpe_49k.json"))


def test_token_files(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, t) for k, t in enumerate(TEXTS, 30)] + ODD + [(200 + k, words(rng, 50)) for k in range(300)]
    rng.shuffle(rows)
    got = tokens.token_report(docs_of(spark, rows), vocabulary("word_bpe_49k.json")).collect()
    ids = {t: WORDS.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert keys == sorted(keys)
    import pyarrow.parquet as pq

    tokens.write_tokens(docs_of(spark, rows), f"file://{tmp_path}/t", vocabulary("word_bpe_49k.json"))
    part = next((tmp_path / "t").glob("*.parquet"))
    column = next(pq.ParquetFile(part).metadata.row_group(0).column(k) for k in range(2) if "tokens" in pq.ParquetFile(part).metadata.row_group(0).column(k).path_in_schema)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index
    assert tokens.token_report(docs_of(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


BYTES = library("byte_bpe_50k.json")
VOCABULARY = bpe.Vocabulary(vocabulary("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé", min_size=1, max_size=7), max_size=60), st.text("abcé", max_size=7))
def test_transducer(found, other):
    pairs = [(w.encode(), list(w.encode())) for w in found]
    t = bpe.Transducer.mapped(bpe.Transducer.compile(pairs))
    assert all(t.find(w) == ids for w, ids in pairs)
    words = [w for w, _ in pairs] + [other.encode()]
    at = t.find_many(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    assert [None if k < 0 else t.ids[t.starts[k] : t.starts[k + 1]].tolist() for k in at.tolist()] == [t.find(w) for w in words]
    assert t.find(other.encode()) == (list(other.encode()) if other in found else None)


def test_transducer_is_minimal():
    image = bpe.Transducer.compile([(f"{a}{b}ing".encode(), [1]) for a in "abcdef" for b in "xyz"])
    assert len(bpe.Transducer(image).first) - 1 == 6  # root, one state for the first letters, then x-ing shared


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=120))
def test_codec_is_the_library(text):
    codec = bpe.Codec(VOCABULARY, bpe.Transducer.mapped(bpe.lexicon([" the", "Hello"], vocabulary("byte_bpe_50k.json"))))
    texts = [text.encode("utf-8", "ignore").decode(), *TEXTS, "q" * 70 + " " + "the" * 100]
    ids, bounds = codec.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [BYTES.encode(t, add_special_tokens=False).ids for t in texts]
    assert codec.decode_batch(ids, bounds).to_pylist() == texts
    for t in texts:
        ids = BYTES.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == BYTES.decode(ids, skip_special_tokens=False)


def test_encode_decode(spark):
    rows = ODD + list(enumerate(TEXTS, 30))
    got = bpe.encode_decode(docs_of(spark, rows), vocabulary("byte_bpe_50k.json"), limit=20).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(BYTES.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows)
    assert bpe.encode_decode(docs_of(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


# -- WARC ---------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 50), st.integers(1, 90))
def test_records_round_trip(payload, chunk, segment):
    data = b"".join(r + b"\r\n\r\n" for r in warc.make_records(5, 7, "u", payload, 5, 7, chunk, segment))
    parts = list(warc.split_records(data))
    block = b"".join(b for _, b in parts)
    assert warc.payload_of(block) == (payload, len(payload))
    if len(parts) > 1:
        assert [int(h["warc-segment-number"]) for h, _ in parts] == list(range(1, len(parts) + 1))
        assert int(parts[-1][0]["warc-segment-total-length"]) == len(block)


def test_round_trip(spark):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n"
    html = [(9, "u", trap), (3, None, trap), (4, "x\ny", "é" * 30_000), (5, "u", None), (6, "u", ""), (None, "u", "n"), (None, "u", trap), (8, "u", "é" * 30_000), (8, "u", "n"), (8, "u", "n"), (10, "u", "\ud7ff" * 9000)]
    got = warc.round_trip(spark.createDataFrame(html, "page_id long, url string, html string").repartition(3)).collect()
    first = {}
    for i, _, h in html:
        if i is not None and (h or "") not in first or i is not None and i < first[h or ""]:
            first[h or ""] = i
    assert Counter((r.page_id, bytes(r.payload), r.payload_bytes, r.payload_digest) for r in got if r.record_type == "response") == Counter((i, h.encode(), len(h.encode()), warc.base32_sha1(h.encode())) for h, i in first.items())
    assert all(r.problem is None for r in got) and len(got) == len(html)
    back = Counter((r.page_id, r.refers_to, r.payload_digest, r.payload_bytes) for r in got if r.record_type == "revisit")
    rest = Counter((i, first[h or ""], warc.base32_sha1((h or "").encode()), len((h or "").encode())) for i, _, h in html)
    rest -= Counter((i, i, warc.base32_sha1(h.encode()), len(h.encode())) for h, i in first.items())
    assert back == rest
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_archives_are_named(spark, tmp_path):
    whole = [r + b"\r\n\r\n" for r in warc.make_records(1, 1, "u", b"x" * 500, 1, 1, 100, 150)]
    for name, own in (("missing", whole[:2] + whole[3:]), ("total", [*whole[:-1], whole[-1].replace(b"Total-Length: ", b"Total-Length: 9")]), ("chunk", [w.replace(b"64\r\n", b"65\r\n") for w in whole])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(random.Random(1).sample(own, len(own))))
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert len(got) == 1 and got[0].problem and got[0].payload_bytes is None


# -- every operator's edges ---------------------------------------------------

#: Names that the operators use inside.
CLASHING = ["fp", "th", "sh", "key", "h", "row", "size", "bytes", "shard", "slot", "part", "place", "ids", "tokens", "start", "kind", "up", "leaf", "block", "root", "first", "spans", "kept", "near", "codes", "total", "a.b", "Doc ID"]
OPERATORS = {
    "op1": lambda d: simhash.near_duplicates(d),
    "near texts": lambda d: shingles.similar_texts(d),
    "op2": lambda d: sharding.shard_by_bytes(d),
    "op3": lambda d: repeats.remove_repeats(d, words=51),
    "op4": lambda d: quality.quality(d),
    "op5": lambda d: licenses.licenses(d),
    "op7": lambda d: decontaminate.leaks(d, d.where("doc_id = 20").select(d.doc_id.alias("item_id"), "text")),
    "op8": lambda d: tokens.token_report(d, vocabulary("word_bpe_49k.json")),
    "op9": lambda d: bpe.encode_decode(d, vocabulary("byte_bpe_50k.json")),
    "op10": lambda d: warc.round_trip(d, "doc_id", "lang", "text"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_names_nulls_and_very_long_texts(spark, name):
    rng = random.Random(30)
    long = words(rng, 150_000, 30_000)
    rows = [*ODD, (20, words(rng, 60)), (21, long), (21, long), (22, "z" * 1_000_000), (23, " " * 300_000), (24, "é\n" * 200_000), (25, words(rng, 90_000, 2))]
    whole = docs_of(spark, rows)
    odd = whole.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    got, want = OPERATORS[name](odd), OPERATORS[name](whole)
    assert got.count() == len(rows)
    if name in ("op4", "op5", "op7"):  # these pass other columns through
        assert got.columns[: len(odd.columns)] == odd.columns and got.where("`Doc ID` <> 'own Doc ID' OR h <> 'own h'").count() == 0
        got = got.drop(*[f"`{c}`" if "." in c else c for c in CLASHING])
        got = got.select(*want.columns)
    elif name == "op3":
        got, want = (x.select("row.doc_id", "n_bytes", "kept", "removed", "passages") for x in (got, want))
    elif name == "op10":
        got, want = (x.select("page_id", "payload_digest", "record_type") for x in (got, want))
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))
    empty = OPERATORS[name](odd.limit(0))
    assert empty.count() == 0


# -- pipeline -----------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    bench = [(k, words(rng, 40)) for k in range(6)]
    passage = words(rng, 150)
    texts = [words(rng, rng.randrange(40, 300)) for _ in range(50)]
    texts += [texts[0], texts[1] + " tail", "spam " * 40, words(rng, 50) + " " + bench[2][1] + " " + words(rng, 60), "é " + words(rng, 90) + passage, words(rng, 60) + passage + " ü"]
    rows = list(enumerate(texts)) + [(90, None), (91, "")]
    docs_of(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if plain_quality(t or "")[-1]]
    fps = [plain_fingerprint(t) for _, t in left]
    group = plain_components([(a, b) for a in range(len(fps)) for b in range(a, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4])
    left = [left[k] for k in sorted(set(group.values()))]
    kept = plain_repeats([t.encode() for _, t in left], 400)
    left = [(i, k.decode("utf-8", "ignore")) for (i, _), (k, _, _) in zip(left, kept)]
    left = [(i, t) for i, t in left if not plain_leaks(t, bench)]
    want = set()
    for i, t in left:
        ids = BYTES.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) < 54
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs_of(spark, rows), f"file://{tmp_path}").dtypes == docs_of(spark, rows).dtypes, name
        assert f(spark, docs_of(spark, []), f"file://{tmp_path}").count() == 0
