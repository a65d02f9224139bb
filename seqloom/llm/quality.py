"""Repetition rules: how much of a text lies inside duplicated n-grams and lines."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import ref

#: The largest share of word characters inside n-grams that occur twice or more.
NGRAM_SHARE = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: The largest share of word characters inside lines equal to an earlier line.
LINE_SHARE = 0.30
MIN_WORDS = 10
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BASE = 0x9E3779B97F4A7C15


def _codes(n: int) -> np.ndarray:
    """A pseudo-random 64-bit code for each word number."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def covered(codes: np.ndarray, n: int) -> np.ndarray | None:
    """Which words lie in an n-gram found twice or more, by a rolling hash; None if none does."""
    m = len(codes) - n + 1
    if m < 2:
        return None
    h = codes[:m].copy()
    for k in range(1, n):
        h = h * np.uint64(BASE) + codes[k : k + m]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return None
    starts = np.zeros(len(codes) + 1, np.int32)
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(starts, at, 1)
    np.add.at(starts, at + n, -1)
    return np.cumsum(starts[:-1]) > 0


def measure(text: bytes) -> dict:
    """Counts and shares of one text; see quality()."""
    words = text.split()  # ASCII white space, as in the pattern [^\x20\x09-\x0D]+
    n = len(words)
    chars = np.fromiter((len(w) for w in words), np.int64, n)
    if not text.isascii():
        chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, n)
    total = int(chars.sum())
    lines, dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in lines:
            dup_lines += 1
            dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif line.strip():
            lines.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    codes = _codes(len(number))[ids] if n else np.zeros(0, np.uint64)
    shares, repeat_words, some = {}, 0, True
    for k in sorted({WINDOW, *NGRAM_SHARE}):
        mask = covered(codes, k) if some else None
        some = mask is not None  # without a repeated n-gram there is no longer one
        shares[k] = int(chars[mask].sum()) if some else 0
        if k == WINDOW and some:
            repeat_words = int(mask.sum())
    failed = n < MIN_WORDS or 100 * repeat_words > 20 * n
    fine = all(shares[k] <= most * total for k, most in NGRAM_SHARE.items()) and dup_line_chars <= LINE_SHARE * total
    return {"n_words": n, "word_chars": total, "n_symbols": len(text) - len(text.translate(None, SYMBOLS)), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": not failed and fine, "dup_line_chars": dup_line_chars} | {f"dup_chars_{k}": shares[k] for k in NGRAM_SHARE}


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_chars_{k} long" for k in NGRAM_SHARE)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def quality(docs: DataFrame, text_col: str = "text", name: str = "quality") -> DataFrame:
    """docs with a struct column of counts and the verdict `kept`.

    Words are runs of other than ASCII white space. base_failed: fewer than 10 words, or
    more than a fifth of the words in 5-word windows found twice or more. kept: not
    base_failed, and of the word characters (code points) no more than NGRAM_SHARE[n]
    inside n-grams found twice or more, nor more than LINE_SHARE in lines equal to an
    earlier one. n-grams are equal if their 64-bit hashes are (of different ones in one text
    of 20,000 words with a probability of 1e-11). Null or empty text: no words, so it fails.
    Each row is judged alone, a very long one whole; repeated rows and columns of any other
    name pass through, an empty table gives an empty result. A column called `name` is replaced.
    """

    @F.pandas_udf(SCHEMA)
    def judge(texts):
        import pandas as pd

        rows = [measure(t.encode("utf-8", "surrogatepass")) for t in texts]
        return pd.DataFrame({c: [r[c] for r in rows] for c in NAMES}, columns=NAMES)

    return docs.withColumn(name, judge(F.coalesce(ref(text_col), F.lit(""))))
