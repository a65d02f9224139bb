"""The operators as queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import bpe, decontaminate, licenses, quality, repeats, sharding, simhash, tokens, urls, warc
from seqloom.llm.vocabularies import vocabulary

#: A passage has over 50 words.
PASSAGE_WORDS = 51


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the 400-byte contract: bytes and runs of passages of over 50 words that are there twice (they stay in kept)."""
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), carry=["doc_id"], words=PASSAGE_WORDS, cut_passages=False)
    passages = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), passages.alias("passage_bytes"), F.size("passages").cast("long").alias("n_passages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"quality.{c}" for c in quality.NAMES])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("x")).select("doc_id", "x.*")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def queries() -> dict:
    own = [op1_simhash, op2_sharding, op3_suffix_dedup, op4_quality_rules, op5_license_scan, op6_url_filter, op7_decontamination, op8_token_output, op9_bpe, op10_warc]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


SHARDING_SQL = """
WITH RECURSIVE steps AS (SELECT n, n AS c, 0 AS k FROM range(256) x(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, CAST(strlen(t) + 1 AS BIGINT) AS size FROM d),
p AS (SELECT doc_id, h, size, CAST(sum(size) OVER (ORDER BY doc_id) - size AS BIGINT) AS first, CAST(sum(size) OVER () AS BIGINT) AS total FROM s),
g AS (SELECT doc_id, h, size, CAST(first * 8 // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, xor(list_reduce(list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM g, crc
"""

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM n GROUP BY ALL),
e AS (SELECT s.doc_id, lo, hi, lead(lo) OVER (PARTITION BY s.doc_id ORDER BY lo) AS next FROM s),
t AS (SELECT doc_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS x FROM documents)),
b AS (SELECT doc_id, x, i, sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM t),
x AS (SELECT doc_id, x, CAST(b AS BIGINT) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM b WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
y AS (SELECT doc_id, list(x ORDER BY j) AS x, list(b ORDER BY j) AS b FROM x GROUP BY doc_id HAVING count(*) >= 51),
z AS (SELECT doc_id, j, b[j] - strlen(x[j]) AS lo, b[j + 50] AS hi, md5(array_to_string(x[j:j + 50], ' ')) AS k FROM (SELECT doc_id, x, b, unnest(range(1, len(x) - 49)) AS j FROM y)),
p AS (SELECT doc_id, j, lo, hi, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) <= 50 THEN 0 ELSE 1 END AS new FROM z WHERE k IN (SELECT k FROM z GROUP BY k HAVING count(*) > 1)),
o AS (SELECT doc_id, count(*) AS n_passages, sum(hi - lo) AS passage_bytes FROM (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY j) AS run FROM p) GROUP BY doc_id, run) GROUP BY doc_id),
k AS (SELECT e.doc_id, string_agg(substr(h, 2 * hi + 1, 2 * (coalesce(next, length(h) // 2) - hi)), '' ORDER BY lo) AS tail, min(lo) AS lo, count(*) AS n_spans, sum(hi - lo) AS removed FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE substr(h, 1, 2 * lo) || tail END)) AS kept_sha256,
  CAST(coalesce(passage_bytes, 0) AS BIGINT) AS passage_bytes, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id
"""


def quality_sql() -> str:
    """Counts by window functions over words, for the same sizes and shares as the operator."""
    sizes = sorted({quality.WINDOW, *quality.NGRAM_SHARE})
    grams = ", ".join(f"CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN concat_ws(chr(31), w, {', '.join(f'lead(w, {k}) OVER o' for k in range(1, n))}) END AS g{n}" for n in sizes)
    twice = ", ".join(f"CAST(g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS INT) AS t{n}" for n in sizes)
    inside = ", ".join(f"max(t{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    shares = ", ".join(f"sum(c{n} * c) AS dup_chars_{n}" for n in sizes)
    fine = " AND ".join(f"dup_chars_{n} <= {most} * word_chars" for n, most in quality.NGRAM_SHARE.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM l),
a AS (SELECT doc_id, i, CAST(length(w) AS BIGINT) AS c, {grams} FROM (SELECT * FROM u) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i, c, {twice} FROM a),
e AS (SELECT doc_id, i, c, {inside} FROM b),
s AS (SELECT doc_id, count(*) AS n_words, sum(c) AS word_chars, sum(c{quality.WINDOW}) AS n_repeat_words, {shares} FROM e GROUP BY doc_id),
n AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, count(*) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c FROM n WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
q AS (SELECT doc_id, sum(k - 1) AS n_dup_lines, sum((k - 1) * c) AS dup_line_chars FROM m GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in quality.NGRAM_SHARE)}
  FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in quality.NAMES if c not in ("base_failed", "kept"))}, base_failed,
  NOT base_failed AND {fine} AND dup_line_chars <= {quality.LINE_SHARE} * word_chars AS kept FROM v
"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM s
"""


def oracle_sql() -> dict[str, str]:
    found = {"op2_sharding": SHARDING_SQL, "op3_suffix_dedup": REPEATS_SQL, "op4_quality_rules": quality_sql(), "op10_warc": WARC_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
