"""URL filter: rules by host and path first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import ref

#: verdict, host, path: a rule fits its host and all subdomains; the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DIMS = 1 << 14
SIZES = (3, 4, 5)
#: The labelled table: every theme in every shape; shapes say nothing about the label, and each theme has kin among the others.
BLOCKED = ["casino", "casinos", "poker", "pokerroom", "betting", "sportsbets", "jackpot", "jackpots", "slots", "slotmachines", "roulette", "porn", "porntube", "xxx", "xxxvideos", "sexcam", "sexchat", "escort", "escorts", "nudes", "viagra", "cialis", "pills", "dietpills", "steroids", "torrent", "torrents", "warez", "keygen", "cracks", "malware", "spyware", "phishing", "spam", "spammer", "adfarm", "popupads", "payday", "paydayloans", "quickloans"]
ALLOWED = ["news", "newspaper", "dailynews", "science", "sciences", "library", "libraries", "history", "histories", "weather", "weatherreport", "museum", "museums", "school", "schools", "university", "college", "colleges", "recipes", "cooking", "cookbook", "garden", "gardening", "music", "musicschool", "books", "bookstore", "health", "healthcare", "hospital", "travel", "travels", "theater", "research", "researchers", "journal", "journals", "archive", "archives", "community"]
SHAPES = ["https://www.{}.test/", "https://{}.test/index.html", "http://my{}.test/about/", "https://{}24.test/articles/2020/05", "https://{}-online.test/items?id=4", "http://blog.{}.test/page/3", "https://the{}.test/search?q=a#top", "https://{}world.test/p/1/2"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def slots(host: str, path: str, dims: int = DIMS) -> np.ndarray:
    """Hashed n-grams of the host and of the path, each between marks of its own."""
    out = []
    for mark, s in ((1, host), (2, path)):
        b = np.frombuffer(bytes([mark]) + s.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(b) >= n:
                h = np.full(len(b) - n + 1, 14695981039346656037 + 2 * n + mark, np.uint64)
                for k in range(n):
                    h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint64(1099511628211)
                h ^= h >> np.uint64(29)
                out.append(h % np.uint64(dims))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def fit(rows: list[tuple[str, str, int]], dims: int = DIMS, steps: int = 400, rate: float = 2.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent over (host, path, label); the table is small and stays on the driver."""
    own = [slots(host, path, dims) for host, path, _ in rows]
    used = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)  # the others' weights stay 0
    x = np.zeros((len(rows), len(used)))
    for i, s in enumerate(own):
        np.add.at(x[i], np.searchsorted(used, s), 1.0)
        x[i] /= max(1.0, np.linalg.norm(x[i]))
    y = np.array([r[2] for r in rows], float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ e / len(y) + decay * w)
        b -= rate * e.mean()
    whole = np.zeros(dims)
    whole[used] = w
    return whole, float(b)


def plain_parts(url: str | None) -> tuple[str, str]:
    """parts() of one string."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def labelled(themes: tuple[list[str], list[str]] = (BLOCKED, ALLOWED), shapes: list[str] = SHAPES) -> list[tuple[str, str, int]]:
    """The table (host, path, label): 1 is to be blocked."""
    return [(*plain_parts(shape.format(theme)), y) for y, own in zip((1, 0), themes) for theme in own for shape in shapes]


def score_of(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    s = slots(host, path)
    if not len(s):
        return float(1 / (1 + np.exp(-model[1])))
    v, n = np.unique(s, return_counts=True)
    return float(1 / (1 + np.exp(-(model[0][v] @ n / max(1.0, np.linalg.norm(n)) + model[1]))))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, table: list[tuple[str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of each row.

    verdict is the longest fitting rule's, else block where the model's score reaches the
    threshold. Rules that tie in length can't both fit. Null url or one without :// has empty
    host and path, no rule, and the score of no n-grams. Very long urls are read whole. Repeated
    rows stay. An empty table gives an empty result. Other columns are not read. The model is fitted on `table` (host, path, label) on the driver.
    """
    model = fit(labelled() if table is None else table)

    @F.pandas_udf("double")
    def score(hosts, paths):
        import pandas as pd

        return pd.Series([score_of(model, h, p) for h, p in zip(hosts, paths)])

    host, path = parts(ref(url_col))
    out = pages.select(ref(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and win
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    out = out.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("score", score("host", "path"))
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"))
