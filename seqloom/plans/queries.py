"""A query for every operator over the derived sequences, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import alphabets, nucleotide, protein, strings
from seqloom.functions.alphabets import CODON_TABLE, HYDROPATHY, MASS, METRIC_ORDER, PKA_ACIDIC, PKA_BASIC, PKA_C_TERM, PKA_N_TERM, WATER
from seqloom.operators import align, phylo
from seqloom.operators.frames import RecordFrame, SeqFrame
from seqloom.operators.msa import Alignment
from seqloom.plans import base, known
from seqloom.plans.base import DNA_SQL, GROUP, PROTEIN_SQL, RNA_SQL
from seqloom.sources import fasta, fastq, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def over(source: Query, **columns) -> Query:
    """A query of doc_id and functions of the sequence column."""
    return lambda spark, sf: source(spark, sf).select("doc_id", *[f(F.col("seq")).alias(n) for n, f in columns.items()])


def select(with_sql: str, **columns) -> str:
    return f"WITH {with_sql} SELECT doc_id, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM s"


def r6(f):
    return lambda s: F.round(f(s), 6) + F.lit(0.0)


def q6(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 6) + 0.0"


def n(sql: str) -> str:
    return f"CAST({sql} AS BIGINT)"


# -- predicates and filters ---------------------------------------------------


def _texts(spark, sf):
    return base.documents(spark, sf).withColumnRenamed("text", "seq")


TEXTS_SQL = "s AS (SELECT doc_id, coalesce(text, '') AS seq FROM documents)"


def _class(symbols: str) -> str:
    return alphabets.char_class(alphabets.both_cases(symbols)).replace("'", "''")


for _name, _kind in (("f1_validate_dna", "dna"), ("f1_validate_rna", "rna"), ("f1_validate_protein", "protein"), ("f2_validate_gapped_dna", "gapped_dna"), ("f2_validate_gapped_protein", "gapped_protein")):
    _c = _class(alphabets.KINDS[_kind])
    add(
        _name,
        over(_texts, valid=lambda s, k=_kind: strings.is_valid(s, k), position=lambda s, k=_kind: strings.invalid_position(s, k)),
        f"WITH {TEXTS_SQL}, p AS (SELECT doc_id, length(seq) AS n, length(regexp_extract(seq, '^[{_c}]*')) AS k FROM s) SELECT doc_id, k = n AS valid, CASE WHEN k < n THEN {n('k')} END AS position FROM p",
    )
add("f3_is_word", over(_texts, dna_word=lambda s: alphabets.DNA_FULL.is_word(s), letters=lambda s: alphabets.LETTERS.is_word(s)), select(TEXTS_SQL, dna_word=f"NOT regexp_matches(seq, '[^{_class(alphabets.DNA_IUPAC)}]')", letters="NOT regexp_matches(seq, '[^A-Za-z]')"))


def _frame(source: Query, kind: str):
    return lambda spark, sf: SeqFrame(source(spark, sf).withColumnRenamed("doc_id", "pos"), kind)


add("f4_filter_by_len", lambda spark, sf: _frame(base.dna, "dna")(spark, sf).filter_by_len(50, 300).df.select(F.col("pos").alias("doc_id"), "seq"), f"WITH {DNA_SQL} SELECT doc_id, seq FROM s WHERE length(seq) BETWEEN 50 AND 300")
add("f5_filter_empty", lambda spark, sf: _records(spark, sf).filter_empty().df.select("pos", "id", strings.length(F.col("seq")).alias("n")), f"WITH {DNA_SQL} SELECT doc_id AS pos, 'd' || doc_id AS id, {n('length(seq)')} AS n FROM s WHERE length(seq) > 0")
add("f6_contains", over(base.dna, has=lambda s: strings.contains(s, "GATTA"), empty=lambda s: strings.contains(s, "")), select(DNA_SQL, has="contains(seq, 'GATTA')", empty="true"))
add("f7_batch_contains", lambda spark, sf: _frame(base.protein, "protein")(spark, sf).contains("KEN"), f"WITH {PROTEIN_SQL} SELECT doc_id AS pos, contains(seq, 'KEN') AS contains FROM s")
add(
    "f8_starts_ends",
    over(base.dna, starts=lambda s: strings.startswith(s, ("AC", "TT")), inside=lambda s: strings.startswith(s, "A", 2, -1), ends=lambda s: strings.endswith(s, "T"), beyond=lambda s: strings.startswith(s, "", 100)),
    select(DNA_SQL, starts="starts_with(seq, 'AC') OR starts_with(seq, 'TT')", inside="length(seq) > 3 AND substr(seq, 3, 1) = 'A'", ends="suffix(seq, 'T')", beyond="true"),
)
add("f9_has_ambiguous", over(_texts, ambiguous=protein.has_ambiguous), select(TEXTS_SQL, ambiguous=f"regexp_matches(seq, '[^{base.AMINO}{base.AMINO.lower()}]')"))
add("f10_strict_20", over(base.protein, seq=protein.validate_strict_20), select(PROTEIN_SQL, seq="seq"))
add("f11_compare", lambda spark, sf: base.dna(spark, sf).withColumn("other", F.reverse("seq")).select("doc_id", *[strings.compare(F.col("seq"), op, F.col("other")).alias(k) for k, op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))]), f"WITH {DNA_SQL}, r AS (SELECT doc_id, seq, reverse(seq) AS o FROM s) SELECT doc_id, seq = o AS eq, seq <> o AS ne, seq < o AS lt, seq <= o AS le, seq > o AS gt, seq >= o AS ge FROM r")
add("f12_identity", lambda spark, sf: base.dna(spark, sf).withColumn("k", strings.identity(F.col("seq"))).groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("first", "n"), f"WITH {DNA_SQL} SELECT min(doc_id) AS first, count(*) AS n FROM s GROUP BY seq")

# -- strings ------------------------------------------------------------------

add("s1_count", over(base.dna, ac=lambda s: strings.count(s, "AC"), aa=lambda s: strings.count(s, "AA"), empty=lambda s: strings.count(s, "")), select(DNA_SQL, ac=n("(length(seq) - length(replace(seq, 'AC', ''))) // 2"), aa=n("(length(seq) - length(replace(seq, 'AA', ''))) // 2"), empty=n("length(seq) + 1")))
add("s2_count_overlap", over(base.dna, aa=lambda s: strings.count_overlap(s, "AA"), empty=lambda s: strings.count_overlap(s, "")), select(DNA_SQL, aa=n("len(list_filter(range(1, length(seq)), lambda i: substr(seq, i, 2) = 'AA'))"), empty=n("length(seq) + 1")))
add("s3_batch_count", lambda spark, sf: _frame(base.protein, "protein")(spark, sf).count_of("EE"), f"WITH {PROTEIN_SQL} SELECT doc_id AS pos, {n('(length(seq) - length(replace(seq, chr(69) || chr(69), chr(32)))) ')} AS count FROM s")
add("s4_find", over(base.dna, first=lambda s: strings.find(s, "CA"), inside=lambda s: strings.find(s, "CA", 5, -3), empty=lambda s: strings.find(s, "", 3)), select(DNA_SQL, first=n("instr(seq, 'CA') - 1"), inside=n("CASE WHEN length(seq) < 8 OR instr(substr(seq, 6, length(seq) - 8), 'CA') = 0 THEN -1 ELSE 4 + instr(substr(seq, 6, length(seq) - 8), 'CA') END"), empty=n("least(3, length(seq))")))
add("s5_rfind", over(base.dna, last=lambda s: strings.rfind(s, "CA"), empty=lambda s: strings.rfind(s, "", 3)), select(DNA_SQL, last=n("CASE WHEN instr(reverse(seq), 'AC') = 0 THEN -1 ELSE length(seq) - instr(reverse(seq), 'AC') - 1 END"), empty=n("CASE WHEN length(seq) < 3 THEN length(seq) ELSE length(seq) END")))
add("s4_index", lambda spark, sf: base.dna(spark, sf).where(F.contains("seq", F.lit("CA"))).select("doc_id", strings.index(F.col("seq"), "CA").alias("first"), strings.rindex(F.col("seq"), "CA").alias("last")), f"WITH {DNA_SQL} SELECT doc_id, {n('instr(seq, chr(67) || chr(65)) - 1')} AS first, {n('length(seq) - instr(reverse(seq), chr(65) || chr(67)) - 1')} AS last FROM s WHERE contains(seq, 'CA')")
add("s6_split", lambda spark, sf: base.dna(spark, sf).select("doc_id", F.posexplode(strings.split(F.col("seq"), "TT")).alias("i", "part")).select("doc_id", F.col("i").cast("long").alias("i"), "part"), f"WITH {DNA_SQL}, p AS (SELECT doc_id, string_split(seq, 'TT') AS x FROM s) SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS part FROM p")
add("s6_split_white", lambda spark, sf: _texts(spark, sf).select("doc_id", F.size(strings.split(F.col("seq"))).cast("long").alias("parts"), F.size(strings.split(F.col("seq"), None, 2)).cast("long").alias("three")), f"WITH {TEXTS_SQL}, p AS (SELECT doc_id, len(list_filter(regexp_split_to_array(seq, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS k FROM s) SELECT doc_id, {n('k')} AS parts, {n('least(k, 3)')} AS three FROM p")
add("s7_rsplit", lambda spark, sf: base.dna(spark, sf).select("doc_id", F.posexplode(strings.rsplit(F.col("seq"), "AG", 1)).alias("i", "part")).select("doc_id", F.col("i").cast("long").alias("i"), "part"), f"WITH {DNA_SQL}, p AS (SELECT doc_id, seq, instr(reverse(seq), 'GA') AS k FROM s), x AS (SELECT doc_id, CASE WHEN k = 0 THEN [seq] ELSE [substr(seq, 1, length(seq) - k - 1), substr(seq, length(seq) - k + 2)] END AS x FROM p) SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS part FROM x")
add("s8_strip", over(base.dna, both=lambda s: strings.strip(s, "AC"), left=lambda s: strings.lstrip(s, "T"), right=lambda s: strings.rstrip(s, "AT"), none=lambda s: strings.strip(s, "")), select(DNA_SQL, both="trim(seq, 'AC')", left="ltrim(seq, 'T')", right="rtrim(seq, 'AT')", none="seq"))
add("s9_case", over(base.dna, up=strings.upper, low=strings.lower), select(DNA_SQL, up="seq", low="lower(seq)"))
add("s10_slice", over(base.dna, part=lambda s: strings.slice_(s, 3, -2), stepped=lambda s: strings.slice_(s, None, None, 3), backward=lambda s: strings.slice_(s, None, None, -1), tail=lambda s: strings.slice_(s, -5)), select(DNA_SQL, part="CASE WHEN length(seq) > 5 THEN substr(seq, 4, length(seq) - 5) ELSE '' END", stepped="array_to_string(list_transform(range(1, length(seq) + 1, 3), lambda i: substr(seq, i, 1)), '')", backward="reverse(seq)", tail="right(seq, 5)"))
add("s10_get", lambda spark, sf: base.dna(spark, sf).where(F.length("seq") > 1).select("doc_id", strings.get(F.col("seq"), 1).alias("second"), strings.get(F.col("seq"), -1).alias("last")), f"WITH {DNA_SQL} SELECT doc_id, substr(seq, 2, 1) AS second, right(seq, 1) AS last FROM s WHERE length(seq) > 1")
add("s11_concat", over(base.dna, both=lambda s: strings.concat(s, F.reverse(s))), select(DNA_SQL, both="seq || reverse(seq)"))
add("s12_repeat", over(base.dna, twice=lambda s: strings.repeat(s, 2), none=lambda s: strings.repeat(s, 0)), select(DNA_SQL, twice="seq || seq", none="''"))
add("s13_length", over(base.dna, n=strings.length, shown=lambda s: strings.represent(s, "dna"), raw=lambda s: F.hex(strings.to_bytes(s))), select(DNA_SQL, n=n("length(seq)"), shown="'DNA(\"' || seq || '\")'", raw="hex(encode(seq))"))
add("s13_symbols", lambda spark, sf: base.dna(spark, sf).select("doc_id", F.explode(strings.symbols(F.col("seq"))).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n")), f"WITH {DNA_SQL}, p AS (SELECT doc_id, unnest(string_split(seq, '')) AS c FROM s WHERE seq <> '') SELECT doc_id, c, count(*) AS n FROM p GROUP BY ALL")

add("s14_needles", over(base.dna, text=lambda s: strings.count(s, "A"), raw=lambda s: strings.count(s, b"A"), byte=lambda s: strings.count(s, 65), column=lambda s: strings.count(s, F.substring(s, 1, 1))), select(DNA_SQL, text=n("length(seq) - length(replace(seq, 'A', ''))"), raw=n("length(seq) - length(replace(seq, 'A', ''))"), byte=n("length(seq) - length(replace(seq, 'A', ''))"), column=n("CASE WHEN seq = '' THEN 1 ELSE length(seq) - length(replace(seq, left(seq, 1), '')) END")))

# -- nucleotides --------------------------------------------------------------

add("n1_complement", over(base.dna, c=nucleotide.complement), select(DNA_SQL, c="translate(seq, 'ACGT', 'TGCA')"))
add("n1_complement_rna", over(base.rna, c=lambda s: nucleotide.complement(s, "rna")), select(RNA_SQL, c="translate(seq, 'ACGU', 'UGCA')"))
add("n2_reverse_complement", over(base.dna, rc=nucleotide.reverse_complement), select(DNA_SQL, rc="reverse(translate(seq, 'ACGT', 'TGCA'))"))
add("n3_reverse", over(base.dna, r=nucleotide.reverse), select(DNA_SQL, r="reverse(seq)"))
add("n4_transcribe", over(base.dna, r=nucleotide.transcribe), select(DNA_SQL, r="replace(seq, 'T', 'U')"))
add("n5_back_transcribe", over(base.rna, r=nucleotide.back_transcribe), select(RNA_SQL, r="replace(seq, 'U', 'T')"))
add("n6_gc_content", over(base.dna, gc=r6(nucleotide.gc_content)), select(DNA_SQL, gc=q6("CASE WHEN seq = '' THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END")))


def _codons(seq: str, bases: str = "TCAG") -> str:
    at = lambda k: f"(instr('{bases}', substr({seq}, 3 * i + {k}, 1)) - 1)"
    return f"array_to_string(list_transform(range(length({seq}) // 3), lambda i: substr('{CODON_TABLE}', CAST(16 * {at(1)} + 4 * {at(2)} + {at(3)} + 1 AS BIGINT), 1)), '')"


add("n7_translate_strict", lambda spark, sf: base.dna(spark, sf).where("length(seq) % 3 = 0").select("doc_id", nucleotide.translate(F.col("seq")).alias("p")), f"WITH {DNA_SQL} SELECT doc_id, {_codons('seq')} AS p FROM s WHERE length(seq) % 3 = 0")
add("n8_translate_frames", over(base.dna, **{f"p{k}": lambda s, k=k: nucleotide.translate(s, k) for k in (1, 2, 3)}), f"WITH {DNA_SQL}, f AS (SELECT doc_id, seq, substr(seq, 2) AS s2, substr(seq, 3) AS s3 FROM s) SELECT doc_id, {_codons('seq')} AS p1, {_codons('s2')} AS p2, {_codons('s3')} AS p3 FROM f")
add("n8_translate_rna", over(base.rna, p=lambda s: nucleotide.translate(s, 1, "rna")), select(RNA_SQL, p=_codons("seq", "UCAG")))
add("n8_translate_arrow", over(base.dna, p=lambda s: nucleotide.translate_fast(s, 1)), select(DNA_SQL, p=_codons("seq")))
AUTO_SQL = f"WITH {DNA_SQL}, f AS (SELECT doc_id, unnest([1, 2, 3]) AS frame, unnest([seq, substr(seq, 2), substr(seq, 3)]) AS x FROM s), t AS (SELECT doc_id, frame, {_codons('x')} AS p FROM f), o AS (SELECT doc_id, frame, p, length(regexp_extract(p, 'M[^*]*')) AS orf, instr(p, 'M') AS m FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY orf DESC, CASE WHEN orf = 0 THEN 0 ELSE m END, frame) AS k FROM o) SELECT doc_id, p FROM r WHERE k = 1"
add("n9_translate_auto", over(base.dna, p=lambda s: nucleotide.translate(s, "auto")), AUTO_SQL)


def _records(spark: SparkSession, sf: str) -> RecordFrame:
    d = base.dna(spark, sf)
    feature = F.struct(F.lit("gene").alias("feature_type"), F.struct(F.lit(0).cast("long").alias("start"), F.ceil(F.length("seq") / 2).cast("long").alias("end"), F.when(F.col("doc_id") % 3 == 0, None).otherwise(1).cast("tinyint").alias("strand")).alias("location"), F.create_map(F.lit("gene"), F.array(F.col("doc_id").cast("string"))).alias("qualifiers"))
    return RecordFrame(d.select(F.col("doc_id").alias("pos"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("about "), F.col("doc_id").cast("string"))).alias("description"), "seq", F.array(feature).alias("features"), F.create_map(F.lit("source"), F.array(F.lit("docs"))).alias("annotations")), "dna")


add("n10_record_translate", lambda spark, sf: _records(spark, sf).translate(1).df.select("pos", "id", "seq", F.size("features").cast("long").alias("n_features"), F.col("annotations")["source"][0].alias("source")), f"WITH {DNA_SQL} SELECT doc_id AS pos, 'd' || doc_id AS id, {_codons('seq')} AS seq, CAST(0 AS BIGINT) AS n_features, 'docs' AS source FROM s")
add("n11_record_reverse_complements", lambda spark, sf: _records(spark, sf).reverse_complements().df.select("pos", "seq", F.col("features")[0]["location"]["start"].alias("start"), F.col("features")[0]["location"]["end"].alias("end"), F.col("features")[0]["location"]["strand"].cast("long").alias("strand")), f"WITH {DNA_SQL} SELECT doc_id AS pos, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, {n('length(seq) - ceil(length(seq) / 2)')} AS start, {n('length(seq)')} AS end, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(-1 AS BIGINT) END AS strand FROM s")

# -- proteins -----------------------------------------------------------------


def _count(a: str) -> str:
    return f"(length(seq) - length(replace(seq, '{a}', '')))"


def _dot(weight: dict[str, float]) -> str:
    return " + ".join(f"{_count(a)} * CAST({weight[a]!r} AS DOUBLE)" for a in METRIC_ORDER)


def _long(name: str, value: str, f) -> Query:
    return lambda spark, sf: base.protein(spark, sf).select("doc_id", F.explode(f(F.col("seq"))).alias("x")).select("doc_id", "x.symbol", (F.col(f"x.{value}") if value == "count" else F.round(f"x.{value}", 6)).alias(value))


SYMBOLS_SQL = f"WITH {PROTEIN_SQL}, p AS (SELECT doc_id, length(seq) AS n, unnest(string_split(seq, '')) AS symbol FROM s WHERE seq <> ''), g AS (SELECT doc_id, n, symbol, count(*) AS k FROM p GROUP BY ALL)"
TWENTY_SQL = f"WITH {PROTEIN_SQL}, a AS (SELECT unnest(string_split('{METRIC_ORDER}', '')) AS symbol)"
add("p1_reverse", over(base.protein, r=protein.reverse), select(PROTEIN_SQL, r="reverse(seq)"))
add("p2_counts", _long("p2", "count", protein.counts), SYMBOLS_SQL + " SELECT doc_id, symbol, k AS count FROM g")
add("p3_frequencies", _long("p3", "frequency", protein.frequencies), SYMBOLS_SQL + " SELECT doc_id, symbol, round(k / n, 6) AS frequency FROM g")
add("p4_aa_counts_20", _long("p4", "count", protein.aa_counts_20), TWENTY_SQL + f" SELECT doc_id, symbol, {n('length(seq) - length(replace(seq, symbol, chr(0)[1:0]))')} AS count FROM s, a")
add("p5_aa_frequencies_20", _long("p5", "frequency", protein.aa_frequencies_20), TWENTY_SQL + " SELECT doc_id, symbol, CASE WHEN seq = '' THEN CAST(0 AS DOUBLE) ELSE round((length(seq) - length(replace(seq, symbol, ''))) / length(seq), 6) END AS frequency FROM s, a")
add("p6_entropy", over(base.protein, h=r6(protein.shannon_entropy)), SYMBOLS_SQL + ", h AS (SELECT doc_id, -sum(k / n * log2(k / n)) AS h FROM g GROUP BY doc_id) SELECT s.doc_id, round(coalesce(h, 0.0), 6) + 0.0 AS h FROM s LEFT JOIN h ON h.doc_id = s.doc_id")
add("p7_molecular_weight", over(base.protein, w=r6(protein.molecular_weight)), select(PROTEIN_SQL, w=q6(f"CASE WHEN seq = '' THEN 0 ELSE {_dot(MASS)} + CAST({WATER} AS DOUBLE) END")))
add("p8_hydrophobicity", over(base.protein, h=r6(protein.hydrophobicity)), select(PROTEIN_SQL, h=q6(f"CASE WHEN seq = '' THEN 0 ELSE ({_dot(HYDROPATHY)}) / length(seq) END")))
_KD = "CASE c " + " ".join(f"WHEN '{a}' THEN CAST({v} AS DOUBLE)" for a, v in HYDROPATHY.items()) + " END"
add(
    "p9_profile",
    lambda spark, sf: base.protein(spark, sf).select("doc_id", F.posexplode(protein.hydrophobicity_profile(F.col("seq"), 7)).alias("i", "h")).select("doc_id", F.col("i").cast("long").alias("i"), (F.round("h", 6) + F.lit(0.0)).alias("h")),
    f"WITH {PROTEIN_SQL}, p AS (SELECT doc_id, length(seq) AS n, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM s WHERE length(seq) >= 7), v AS (SELECT doc_id, n, i, {_KD} AS v FROM p), w AS (SELECT doc_id, n, i, avg(v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS h FROM v) SELECT doc_id, i, round(h, 6) + 0.0 AS h FROM w WHERE i <= n - 7",
)


def _charge(ph: str, count=_count) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    plus = [f"{d(1)} / (1 + power({d(10)}, {ph} - {d(PKA_N_TERM)}))", *[f"{count(a)} / (1 + power({d(10)}, {ph} - {d(v)}))" for a, v in PKA_BASIC.items()]]
    minus = [f"{d(1)} / (1 + power({d(10)}, {d(PKA_C_TERM)} - {ph}))", *[f"{count(a)} / (1 + power({d(10)}, {d(v)} - {ph}))" for a, v in PKA_ACIDIC.items()]]
    return " + ".join(plus) + " - " + " - ".join(minus)


add("p10_net_charge", over(base.protein, at7=r6(lambda s: protein.net_charge(s, 7.0)), at3=r6(lambda s: protein.net_charge(s, 3.5))), select(PROTEIN_SQL, at7=q6(_charge("CAST(7 AS DOUBLE)")), at3=q6(_charge("CAST(3.5 AS DOUBLE)"))))
_MID = "(z.lo + z.hi) / 2"
_PI = _charge(f"({_MID})", lambda a: f"n_{a}")
_CASE = f"(({_PI}) > 0)"
add(
    "p11_isoelectric_point",
    over(base.protein, pi=r6(protein.isoelectric_point)),
    f"WITH {PROTEIN_SQL}, c AS (SELECT doc_id, {', '.join(f'{_count(a)} AS n_{a}' for a in (*PKA_BASIC, *PKA_ACIDIC))} FROM s), z AS (SELECT doc_id, list_reduce(list_transform(range(60), lambda i: {{'lo': CAST(0 AS DOUBLE), 'hi': CAST(14 AS DOUBLE)}}), lambda z, y: {{'lo': CASE WHEN {_CASE} THEN {_MID} ELSE z.lo END, 'hi': CASE WHEN {_CASE} THEN z.hi ELSE {_MID} END}}, {{'lo': CAST(0 AS DOUBLE), 'hi': CAST(14 AS DOUBLE)}}) AS z FROM c) SELECT doc_id, round({_MID}, 6) + 0.0 AS pi FROM z",
)
_LETTERS = "s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS seq FROM documents)"
add("p12_unknown_positions", lambda spark, sf: base.documents(spark, sf).select("doc_id", F.explode(protein.unknown_positions(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("at")).select("doc_id", F.col("at").cast("long").alias("i")), f"WITH {_LETTERS}, p AS (SELECT doc_id, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM s WHERE seq <> '') SELECT doc_id, i FROM p WHERE NOT regexp_matches(c, '[{base.AMINO}{base.AMINO.lower()}]')")

# -- gaps and alphabets -------------------------------------------------------

add("g1_ungapped", lambda spark, sf: base.dna(spark, sf).select("doc_id", strings.ungapped(F.translate("seq", "AG", "-.")).alias("u")), f"WITH {DNA_SQL} SELECT doc_id, translate(seq, 'AG', '') AS u FROM s")
add("g2_gapped", lambda spark, sf: base.dna(spark, sf).select("doc_id", F.translate("seq", "AG", "-.").alias("g")).select("doc_id", strings.length(F.col("g")).alias("n"), strings.slice_(F.col("g"), 2, 7).alias("part"), strings.is_valid(F.col("g"), "gapped_dna").alias("valid"), strings.represent(F.col("g"), "gapped_dna").alias("shown")), f"WITH {DNA_SQL}, g AS (SELECT doc_id, translate(seq, 'AG', '-.') AS g FROM s) SELECT doc_id, {n('length(g)')} AS n, substr(g, 3, 5) AS part, true AS valid, 'GappedDNA(\"' || g || '\")' AS shown FROM g")
_ALPHABETS = {"union": alphabets.DNA.union(alphabets.RNA), "intersection": alphabets.DNA_FULL.intersection(alphabets.PROTEIN), "difference": alphabets.PROTEIN.difference(alphabets.DNA)}
add("a2_algebra", over(_texts, **{k: lambda s, a=a: a.is_word(s) for k, a in _ALPHABETS.items()}), select(TEXTS_SQL, **{f'"{k}"': f"NOT regexp_matches(seq, '[^{''.join(sorted(a.symbols))}]')" for k, a in _ALPHABETS.items()}))
_RANKS = alphabets.Alphabet("ACGT").ranks()
add("a3_ranks", lambda spark, sf: base.dna(spark, sf).select("doc_id", F.posexplode(_RANKS.transform(F.col("seq"))).alias("i", "r")).groupBy("doc_id", "r").agg(F.sum("i").cast("long").alias("places")).select("doc_id", F.col("r").cast("long").alias("r"), "places"), f"WITH {DNA_SQL}, p AS (SELECT doc_id, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS c FROM s WHERE seq <> '') SELECT doc_id, {n('instr(chr(65) || chr(67) || chr(71) || chr(84), c) - 1')} AS r, {n('sum(i)')} AS places FROM p GROUP BY ALL")
_CODE = " + ".join(f"(instr('ACGT', substr(seq, i + {k}, 1)) - 1) * {4 ** (3 - k)}" for k in range(4))
for _name, _f, _order in (("a4_qgrams", lambda s: _RANKS.qgrams(4, s), "k"), ("a5_rev_qgrams", lambda s: _RANKS.rev_qgrams(4, s), "m - 1 - k")):
    add(_name, lambda spark, sf, f=_f: base.dna(spark, sf).select("doc_id", F.posexplode(f(F.col("seq"))).alias("i", "code")).select("doc_id", F.col("i").cast("long").alias("i"), "code"), f"WITH {DNA_SQL}, q AS (SELECT doc_id, length(seq) - 3 AS m, list_transform(range(1, length(seq) - 2), lambda i: {_CODE}) AS x FROM s WHERE length(seq) >= 4), u AS (SELECT doc_id, m, unnest(range(m)) AS k, unnest(x) AS code FROM q) SELECT doc_id, {n(_order)} AS i, {n('code')} AS code FROM u")

# -- frames -------------------------------------------------------------------

NUMBERED_SQL = f"{DNA_SQL}, b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, seq FROM s)"
_batch = _frame(base.dna, "dna")
add("b2_lengths", lambda spark, sf: _batch(spark, sf).lengths(), f"WITH {DNA_SQL} SELECT doc_id AS pos, {n('length(seq)')} AS length FROM s")
add("b3_getitem", lambda spark, sf: _batch(spark, sf)[::-2].df, f"WITH {NUMBERED_SQL}, m AS (SELECT max(pos) AS m FROM b) SELECT {n('(m - pos) // 2')} AS pos, seq FROM b, m WHERE (m - pos) % 2 = 0")
add("b4_slice", lambda spark, sf: _batch(spark, sf).filter_by_len(1).slice(5, -3, 2).df, f"WITH {DNA_SQL}, b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS k, seq FROM s WHERE seq <> '') SELECT {n('(pos - 5) // 2')} AS pos, seq FROM b WHERE pos >= 5 AND pos < k - 3 AND (pos - 5) % 2 = 0")
add("b5_take", lambda spark, sf: _batch(spark, sf).take([2, 0, 7, -1, 2]).df, f"WITH {NUMBERED_SQL}, m AS (SELECT max(pos) AS m FROM b), t AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([2, 0, 7, -1, 2]) AS i) SELECT {n('k')} AS pos, seq FROM t, m JOIN b ON b.pos = CASE WHEN i < 0 THEN m + 1 + i ELSE i END")


def _concat(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of each alignment group joined in order: concat of many frames at once."""
    return _batch(spark, sf).concat_by(F.floor(F.col("pos") / GROUP).cast("long"))


add("b6_concat", _concat, f"WITH {DNA_SQL} SELECT doc_id // {GROUP} AS g, string_agg(seq, '' ORDER BY doc_id) AS seq FROM s GROUP BY 1")
add("b7_extend", lambda spark, sf: _batch(spark, sf).extend(_batch(spark, sf)).df, f"WITH {DNA_SQL}, m AS (SELECT max(doc_id) + 1 - min(doc_id) AS k FROM s) SELECT doc_id AS pos, seq FROM s UNION ALL SELECT {n('doc_id + k')}, seq FROM s, m")
add("b8_repeat", lambda spark, sf: _batch(spark, sf).repeat(3).df, f"WITH {NUMBERED_SQL}, m AS (SELECT count(*) AS k FROM b), c AS (SELECT unnest([0, 1, 2]) AS c) SELECT {n('pos + c * k')} AS pos, seq FROM b, m, c")
add("b9_truncate", lambda spark, sf: _batch(spark, sf).truncate(100).df, f"WITH {NUMBERED_SQL} SELECT pos, seq FROM b WHERE pos < 100")
add("b9_pop", lambda spark, sf: _batch(spark, sf).pop()[1].df, f"WITH {DNA_SQL} SELECT doc_id AS pos, seq FROM s WHERE doc_id < (SELECT max(doc_id) FROM s)")
add("b11_map", lambda spark, sf: _batch(spark, sf).map(lambda s: s[::-1]).df, f"WITH {DNA_SQL} SELECT doc_id AS pos, reverse(seq) AS seq FROM s")
add("b12_bytes", lambda spark, sf: _batch(spark, sf).to_bytes().select("pos", F.hex("seq").alias("raw")), f"WITH {DNA_SQL} SELECT doc_id AS pos, hex(encode(seq)) AS raw FROM s")
add("r3_features", lambda spark, sf: _records(spark, sf).df.select("pos", F.explode("features").alias("f")).select("pos", "f.feature_type", "f.location.start", "f.location.end", F.col("f.location.strand").cast("long").alias("strand"), F.col("f.qualifiers")["gene"][0].alias("gene")), f"WITH {DNA_SQL} SELECT doc_id AS pos, 'gene' AS feature_type, CAST(0 AS BIGINT) AS start, {n('ceil(length(seq) / 2)')} AS end, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1 AS BIGINT) END AS strand, CAST(doc_id AS VARCHAR) AS gene FROM s")
add("r5_getitem", lambda spark, sf: _records(spark, sf)[1::3].df.select("pos", "id", "seq", F.size("features").cast("long").alias("features")), f"WITH {NUMBERED_SQL.replace('seq FROM s)', 'doc_id, seq FROM s)')} SELECT {n('(pos - 1) // 3')} AS pos, 'd' || doc_id AS id, seq, CAST(1 AS BIGINT) AS features FROM b WHERE pos % 3 = 1")
add("r4_records", lambda spark, sf: _records(spark, sf).df.select("pos", "id", "description", strings.length(F.col("seq")).alias("n"), F.col("features")[0]["qualifiers"]["gene"][0].alias("gene")), f"WITH {DNA_SQL} SELECT doc_id AS pos, 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'about ' || doc_id END AS description, {n('length(seq)')} AS n, CAST(doc_id AS VARCHAR) AS gene FROM s")

# -- sources and sinks --------------------------------------------------------

BACK_SQL = f"WITH {DNA_SQL} SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'about ' || doc_id END AS description, seq FROM s"


def _fasta(spark: SparkSession, sf: str) -> DataFrame:
    path = base.scratch(spark, "fasta")
    fasta.write_fasta(path, _records(spark, sf), 60)
    return fasta.read_fasta(spark, path, "dna").df.select("id", "description", "seq")


def _fastq(spark: SparkSession, sf: str) -> DataFrame:
    path = base.scratch(spark, "fastq")
    fastq.write_fastq(path, _records(spark, sf))
    return fastq.read_fastq(spark, path, "dna").df.select("id", "description", "seq")


def _csv(spark: SparkSession, sf: str, on_error: str = "raise"):
    path = base.scratch(spark, "csv")
    rows = _records(spark, sf).df
    if on_error == "skip":
        rows = rows.withColumn("seq", F.when(F.col("pos") % 5 == 0, F.concat("seq", F.lit("#"))).otherwise(F.col("seq")))
    rows.select("id", "seq", "description").repartitionByRange("id").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "id", "seq", "description", "dna", on_error)


add("io1_fasta_round_trip", _fasta, BACK_SQL)
def _lazy(spark: SparkSession, sf: str) -> DataFrame:
    path = base.scratch(spark, "fasta")
    fasta.write_fasta(path, _records(spark, sf), 60)
    return fasta.scan_files(spark, path).select("id", "description", "seq")


add("io2_fasta_iterator", _lazy, BACK_SQL)
add("io4_fastq_round_trip", _fastq, BACK_SQL)
add("io7_csv_round_trip", lambda spark, sf: _csv(spark, sf).df.select("id", "description", "seq"), BACK_SQL)
add("io10_csv_skipped", lambda spark, sf: _csv(spark, sf, "skip").skipped.select("id", "column", "message"), f"WITH {DNA_SQL} SELECT 'd' || doc_id AS id, 'seq' AS column, 'invalid character ''#'' at position ' || length(seq) AS message FROM s WHERE doc_id % 5 = 0")
def _lines(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Lines of a written file by their first character's role."""
    path = base.scratch(spark, kind)
    if kind == "fasta":
        fasta.write_fasta(path, _records(spark, sf), 50)
    else:
        fastq.write_fastq(path, _records(spark, sf), "J")
    line = F.col("value")
    role = F.when(line.startswith(">") | line.startswith("@"), "header").when(line == "+", "plus").when(line.rlike("^J+$"), "quality").when(line == "", "blank").otherwise("bases")
    return spark.read.text(path).groupBy(role.alias("role")).agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("symbols"))


_HEADER = "length('d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' about ' || doc_id ELSE '' END) + 1"
add("io3_fasta_lines", lambda spark, sf: _lines(spark, sf, "fasta"), f"WITH {DNA_SQL} SELECT 'header' AS role, count(*) AS lines, {n(f'sum({_HEADER})')} AS symbols FROM s UNION ALL SELECT 'bases', {n('sum((length(seq) + 49) // 50)')}, {n('sum(length(seq))')} FROM s UNION ALL SELECT 'blank', count(*), CAST(0 AS BIGINT) FROM s WHERE seq = '' HAVING count(*) > 0")
add("io6_fastq_lines", lambda spark, sf: _lines(spark, sf, "fastq"), f"WITH {DNA_SQL} SELECT 'header' AS role, count(*) AS lines, {n(f'sum({_HEADER})')} AS symbols FROM s UNION ALL SELECT 'plus', count(*), count(*) FROM s UNION ALL SELECT unnest(['bases', 'quality']), count(*), {n('sum(length(seq))')} FROM s WHERE seq <> '' UNION ALL SELECT 'blank', 2 * count(*), CAST(0 AS BIGINT) FROM s WHERE seq = '' HAVING count(*) > 0")


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    path = base.scratch(spark, "csv")
    base.documents(spark, sf).select("doc_id", F.length("text").alias("n"), F.lit("x").alias("last one")).coalesce(1).write.option("header", True).csv(path)
    return spark.createDataFrame(list(enumerate(tables.csv_columns(spark, path))), "place long, name string")


add("io8_csv_columns", _columns, "SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS place, unnest(['doc_id', 'n', 'last one']) AS name")
add("io9_detect", over(_texts, kind=lambda s: strings.detect_kind(s)), select(TEXTS_SQL, kind="CASE WHEN regexp_matches(upper(seq), '[DEFHIKLMPQRSVWY]') THEN 'protein' WHEN contains(upper(seq), 'U') AND NOT contains(upper(seq), 'T') THEN 'rna' ELSE 'dna' END"))
add("io11_normalize", over(_texts, seq=lambda s: strings.normalize(s)), select(TEXTS_SQL, seq="regexp_replace(seq, '[ \\t\\n\\r\\f\\x0B]', '', 'g')"))

# -- alignments, distances, trees ---------------------------------------------


def _pairs(source: Query) -> Query:
    """Each document's whole sequence with the next one's. Neighbours meet by a join on doc_id, not through a global order."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = source(spark, sf)
        after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("target"))
        # few bytes, much work: a fixed number of partitions, which Spark doesn't merge
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return d.withColumnRenamed("seq", "query").join(after, "doc_id").repartition(tasks, "doc_id")

    return run


def _aligned(source: Query, kind: str, local: bool, traceback: bool, scoring: align.Scoring = align.Scoring()) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        got = align.align_pairs(_pairs(source)(spark, sf), "query", "target", scoring, kind, local, traceback)
        out = [F.col("aln.score").cast("double").alias("score"), F.col("aln.query_end").cast("long").alias("query_end"), F.col("aln.target_end").cast("long").alias("target_end")]
        if traceback:
            out += [align.cigar_text(F.col("aln.cigar")).alias("cigar")]
        return got.select("doc_id", *out)

    return run


add("l1_align_local", _aligned(base.dna, "dna", True, False))
add("l1_align_local_cigar", _aligned(base.dna, "dna", True, True, align.Scoring(2, -1, -3.0, -1.0)))
add("l2_align_global", _aligned(base.dna, "dna", False, False))
add("l2_align_global_free_ends", _aligned(base.dna, "dna", False, True, align.Scoring(2, -1, -2.0, -0.5, end_gap=False)))

#: Scores of which the best total is minus the number of edits.
EDITS = align.Scoring(0, -1, -1.0, -1.0)
_PAIRS_SQL = "a AS (SELECT s.doc_id, s.seq AS q, t.seq AS t FROM s JOIN s t ON t.doc_id = s.doc_id + 1)"


def _edited(spark: SparkSession, sf: str) -> DataFrame:
    """What the aligned strings of a global alignment show: their symbols, and columns that differ."""
    got = align.align_pairs(_pairs(base.dna)(spark, sf), traceback=True, local=False, scoring=EDITS)
    got = got.select("doc_id", align.aligned_strings(F.col("query"), F.col("target"), F.col("aln")).alias("s"))
    differ = F.size(F.filter(F.zip_with(F.split("s.query", ""), F.split("s.target", ""), lambda a, b: a != b), lambda x: x))
    ungapped = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    return got.select("doc_id", (F.length("s.query") - F.length("s.target")).cast("long").alias("uneven"), ungapped("s.query").alias("query"), ungapped("s.target").alias("target"), differ.cast("long").alias("edits"))


def _rescored(spark: SparkSession, sf: str) -> DataFrame:
    """What the operations of a global alignment add up to, and their symbols of either side."""

    def again(q, t, aln):
        import pandas as pd

        rows = aln.to_dict("records")
        for r in rows:
            r["cigar"] = [(c["op"], c["len"]) for c in r["cigar"]]
        return pd.Series([align.rescore(a, b, r, EDITS, "dna", False) for a, b, r in zip(q, t, rows)])

    got = align.align_pairs(_pairs(base.dna)(spark, sf), scoring=EDITS, local=False, traceback=True)
    moved = lambda ops: F.aggregate("aln.cigar", F.lit(0).cast("long"), lambda z, c: z + F.when(c["op"].isin(*ops), c["len"]).otherwise(0))
    return got.select("doc_id", F.pandas_udf(again, "double")("query", "target", "aln").alias("total"), moved("MI").alias("query_moves"), moved("MD").alias("target_moves"))


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    """Local alignments of each sequence with one that ends in it: no other place scores more."""
    pairs = _pairs(base.dna)(spark, sf).where("query <> ''").withColumn("target", F.concat("target", "query"))
    got = align.align_pairs(pairs, scoring=align.Scoring(2, -3, -5.0, -2.0), traceback=True)
    return got.select("doc_id", F.col("aln.score").cast("double").alias("score"), align.cigar_text(F.col("aln.cigar")).alias("cigar"), align.aligned_strings(F.col("query"), F.col("target"), F.col("aln"))["target"].alias("found"))


add("l1_align_local_planted", _planted, f"WITH {DNA_SQL}, {_PAIRS_SQL} SELECT doc_id, CAST(2 * length(q) AS DOUBLE) AS score, length(q) || 'M' AS cigar, q AS found FROM a WHERE q <> ''")
add("l2_edit_distance", lambda spark, sf: align.align_pairs(_pairs(base.dna)(spark, sf), scoring=EDITS, local=False).select("doc_id", F.col("aln.score").cast("double").alias("score")), f"WITH {DNA_SQL}, {_PAIRS_SQL} SELECT doc_id, -CAST(levenshtein(q, t) AS DOUBLE) + 0.0 AS score FROM a")
add("l9_aligned_strings", _edited, f"WITH {DNA_SQL}, {_PAIRS_SQL} SELECT doc_id, CAST(0 AS BIGINT) AS uneven, q AS query, t AS target, {n('levenshtein(q, t)')} AS edits FROM a")
add("l10_rescore", _rescored, f"WITH {DNA_SQL}, {_PAIRS_SQL} SELECT doc_id, -CAST(levenshtein(q, t) AS DOUBLE) + 0.0 AS total, {n('length(q)')} AS query_moves, {n('length(t)')} AS target_moves FROM a")
# a sequence scores most with itself: every symbol of BLOSUM62 does
_DIAGONAL = {c: int(align.matrix("BLOSUM62")[k, k]) for k, c in enumerate(align.PROTEIN_CODES) if c in base.AMINO}
add("l4_align_protein_self", lambda spark, sf: align.align_pairs(base.protein(spark, sf).select("doc_id", F.col("seq").alias("query"), F.col("seq").alias("target")).repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"), scoring=align.Scoring(gap_open=-11, gap_extend=-1), kind="protein", local=False).select("doc_id", F.col("aln.score").cast("double").alias("score")), f"WITH {PROTEIN_SQL} SELECT doc_id, CAST({' + '.join(f'{v} * {_count(c)}' for c, v in _DIAGONAL.items())} AS DOUBLE) AS score FROM s")


def _translated(spark: SparkSession, sf: str) -> DataFrame:
    return base.dna(spark, sf).withColumn("seq", nucleotide.translate(F.col("seq"), 1))


add("l4_align_protein", _aligned(_translated, "protein", True, False, align.Scoring(gap_open=-11, gap_extend=-1)))


def _encoded(kind: str, codes: str, source: Query) -> Query:
    def total(seqs):
        return seqs.map(lambda s: int(align.encode(s, kind).sum()))

    return lambda spark, sf: source(spark, sf).select("doc_id", F.pandas_udf(total, "long")("seq").alias("total"))


for _name, _kind, _source, _with, _codes in (("l7_encode_dna", "dna", base.dna, DNA_SQL, align.DNA_CODES), ("l7_encode_protein", "protein", base.protein, PROTEIN_SQL, align.PROTEIN_CODES)):
    _total = " + ".join(f"{k} * (length(seq) - length(replace(seq, '{c}', '')))" for k, c in enumerate(_codes))
    add(_name, _encoded(_kind, _codes, _source), f"WITH {_with} SELECT doc_id, {n(_total)} AS total FROM s")

PADDED_SQL = f"g AS (SELECT doc_id, doc_id // {GROUP} AS msa_id, seq, length(seq) AS n FROM s), p AS (SELECT a.msa_id, a.doc_id AS i, b.doc_id AS j, a.seq AS x, b.seq AS y, least(a.n, b.n) AS valid FROM g a JOIN g b ON a.msa_id = b.msa_id AND a.doc_id < b.doc_id)"
_DIFFERENT = "len(list_filter(range(1, valid + 1), lambda k: substr(x, k, 1) <> substr(y, k, 1)))"
_TS = "len(list_filter(range(1, valid + 1), lambda k: substr(x, k, 1) || substr(y, k, 1) IN ('AG', 'GA', 'CT', 'TC')))"
_MODEL_SQL = {
    "p-distance": "CASE WHEN valid > 0 THEN q END",
    "jc69": "CASE WHEN valid > 0 AND 1 - 4 * q / 3 > 0 THEN -0.75 * ln(1 - 4 * q / 3) END",
    "k2p": "CASE WHEN valid > 0 AND 1 - 2 * ts / valid - (diff - ts) / valid > 0 AND 1 - 2 * (diff - ts) / valid > 0 THEN -0.5 * ln(1 - 2 * ts / valid - (diff - ts) / valid) - 0.25 * ln(1 - 2 * (diff - ts) / valid) END",
    "poisson": "CASE WHEN valid > 0 AND q < 1 THEN -ln(1 - q) END",
}


def _distances(source: Query, kind: str, model: str) -> Query:
    return lambda spark, sf: phylo.pair_distances(Alignment(base.aligned(source(spark, sf)), kind), model, strict=False).select("msa_id", "i", "j", (F.round("d", 6) + F.lit(0.0)).alias("d"))


for _name, _source, _with, _kind, _model in (("t1_p_distance", base.dna, DNA_SQL, "dna", "p-distance"), ("t2_jc69", base.dna, DNA_SQL, "dna", "jc69"), ("t3_k2p", base.dna, DNA_SQL, "dna", "k2p"), ("t4_protein_p_distance", base.protein, PROTEIN_SQL, "protein", "p-distance"), ("t5_poisson", base.protein, PROTEIN_SQL, "protein", "poisson")):
    add(_name, _distances(_source, _kind, _model), f"WITH {_with}, {PADDED_SQL}, c AS (SELECT msa_id, i, j, valid, {_DIFFERENT} AS diff, {_TS if _model == 'k2p' else '0'} AS ts FROM p), e AS (SELECT *, CASE WHEN valid > 0 THEN CAST(diff AS DOUBLE) / valid END AS q FROM c) SELECT msa_id, i, j, round(CAST({_MODEL_SQL[_model]} AS DOUBLE), 6) + 0.0 AS d FROM e")


def _tree_distances(spark: SparkSession, sf: str) -> DataFrame:
    """p-distances of groups of documents, of those with a sequence: all are defined."""
    seqs = base.protein(spark, sf).where("seq <> ''")
    return phylo.pair_distances(Alignment(base.aligned(seqs), "protein"), "p-distance")


def _trees(method: str) -> Query:
    return lambda spark, sf: phylo.build_trees(_tree_distances(spark, sf), method).select("msa_id", "newick", "leaves", F.size("nodes").cast("long").alias("n_nodes"))


def _tree_sql(method: str) -> str:
    """The joins one after another, each a step over all groups: active nodes with their text, and distances both ways."""
    length = lambda x: f"printf('%.6f', CAST({x} AS DOUBLE) + 0.0)"
    steps = [
        f"WITH {PROTEIN_SQL}, g AS (SELECT doc_id, doc_id // {GROUP} AS m, seq, length(seq) AS len FROM s WHERE seq <> '')",
        f"n0 AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY doc_id) - 1 AS k, doc_id, 'd' || doc_id AS text, 1 AS size, CAST(0 AS DOUBLE) AS height, count(*) OVER (PARTITION BY m) AS leaves FROM g)",
        f"p AS (SELECT a.m, a.doc_id AS i, b.doc_id AS j, CAST(len(list_filter(range(1, least(a.len, b.len) + 1), lambda k: substr(a.seq, k, 1) <> substr(b.seq, k, 1))) AS DOUBLE) / least(a.len, b.len) AS d FROM g a JOIN g b ON a.m = b.m AND a.doc_id < b.doc_id)",
        "d0 AS MATERIALIZED (SELECT p.m, a.k AS i, b.k AS j, d FROM p JOIN n0 a ON a.doc_id = p.i JOIN n0 b ON b.doc_id = p.j UNION ALL SELECT p.m, b.k, a.k, d FROM p JOIN n0 a ON a.doc_id = p.i JOIN n0 b ON b.doc_id = p.j)",
    ]
    for k in range(GROUP - 1):
        old, new = f"d{k}", f"d{k + 1}"
        if method == "nj":
            steps.append(f"s{k} AS MATERIALIZED (SELECT m, i, list_reduce(list(d ORDER BY j), lambda x, y: x + y) AS total, count(*) + 1 AS r FROM {old} GROUP BY m, i)")
            steps.append(f"c{k} AS MATERIALIZED (SELECT o.m, min(struct_pack(q := CASE WHEN a.r > 2 THEN (a.r - 2) * d - a.total - b.total ELSE 0 END, i := o.i, j := o.j)) AS c FROM {old} o JOIN s{k} a ON a.m = o.m AND a.i = o.i JOIN s{k} b ON b.m = o.m AND b.i = o.j WHERE o.i < o.j GROUP BY o.m)")
            steps.append(f"e{k} AS MATERIALIZED (SELECT c.m, c.c.i AS i, c.c.j AS j, d, CASE WHEN a.r > 2 THEN d / 2 + (a.total - b.total) / (2 * (a.r - 2)) ELSE d / 2 END AS la FROM c{k} c JOIN {old} o ON o.m = c.m AND o.i = c.c.i AND o.j = c.c.j JOIN s{k} a ON a.m = c.m AND a.i = c.c.i JOIN s{k} b ON b.m = c.m AND b.i = c.c.j)")
            lengths, height, far = ("la", "CASE WHEN la = d / 2 THEN d / 2 ELSE d - la END"), "CAST(0 AS DOUBLE)", "(x.d + y.d - e.d) / 2"
        else:
            steps.append(f"c{k} AS MATERIALIZED (SELECT m, min(struct_pack(q := d, i := i, j := j)) AS c FROM {old} WHERE i < j GROUP BY m)")
            steps.append(f"e{k} AS MATERIALIZED (SELECT m, c.i AS i, c.j AS j, c.q AS d FROM c{k})")
            lengths, height, far = ("d / 2 - a.height", "d / 2 - b.height"), "d / 2", "(a.size * x.d + b.size * y.d) / (a.size + b.size)"
        ends = f"JOIN n{k} a ON a.m = e.m AND a.k = e.i JOIN n{k} b ON b.m = e.m AND b.k = e.j"
        steps.append(f"n{k + 1} AS MATERIALIZED (SELECT n.m, n.k, NULL AS doc_id, n.text, n.size, n.height, n.leaves FROM n{k} n LEFT JOIN e{k} e ON e.m = n.m WHERE e.m IS NULL OR (n.k <> e.i AND n.k <> e.j) UNION ALL SELECT e.m, a.leaves + {k}, NULL, '(' || a.text || ':' || {length(lengths[0])} || ',' || b.text || ':' || {length(lengths[1])} || ')', a.size + b.size, {height}, a.leaves FROM e{k} e {ends})")
        steps.append(f"f{k} AS MATERIALIZED (SELECT e.m, x.j, a.leaves + {k} AS k, {far} AS d FROM e{k} e {ends} JOIN {old} x ON x.m = e.m AND x.i = e.i AND x.j <> e.j JOIN {old} y ON y.m = e.m AND y.i = e.j AND y.j = x.j)")
        steps.append(f"{new} AS MATERIALIZED (SELECT o.* FROM {old} o JOIN e{k} e ON e.m = o.m WHERE o.i NOT IN (e.i, e.j) AND o.j NOT IN (e.i, e.j) UNION ALL SELECT m, j, k, d FROM f{k} UNION ALL SELECT m, k, j, d FROM f{k})")
    return ", ".join(steps) + f" SELECT m AS msa_id, text || ';' AS newick, leaves, 2 * leaves - 1 AS n_nodes FROM n{GROUP - 1} WHERE leaves > 1"


add("t9_neighbour_joining", _trees("nj"), _tree_sql("nj"))
add("t10_upgma", _trees("upgma"), _tree_sql("upgma"))


def _shape(method: str) -> Query:
    """Leaves, nodes and lines of the diagram of each tree."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        got = phylo.build_trees(_tree_distances(spark, sf), method)
        roots = F.size(F.filter("nodes", lambda n: n["is_root"])).cast("long")
        return got.select("msa_id", "leaves", F.size("nodes").cast("long").alias("n_nodes"), F.size(F.split("diagram", "\n")).cast("long").alias("lines"), roots.alias("roots"))

    return run


for _name, _method, _roots in (("t9_nj_shape", "nj", 0), ("t10_upgma_shape", "upgma", 1)):
    add(_name, _shape(_method), f"WITH {PROTEIN_SQL} SELECT doc_id // {GROUP} AS msa_id, count(*) AS leaves, 2 * count(*) - 1 AS n_nodes, 2 * count(*) - 1 AS lines, CAST({_roots} AS BIGINT) AS roots FROM s WHERE seq <> '' GROUP BY 1 HAVING count(*) > 1")
add(
    "t7_distance_matrix",
    lambda spark, sf: phylo.long_matrix(Alignment(base.aligned(base.dna(spark, sf)), "dna"), "p-distance", strict=False).select("msa_id", "i", "j", (F.round("d", 6) + F.lit(0.0)).alias("d")),
    f"WITH {DNA_SQL}, {PADDED_SQL}, c AS (SELECT msa_id, i, j, round(CASE WHEN valid > 0 THEN CAST({_DIFFERENT} AS DOUBLE) / valid END, 6) + 0.0 AS d FROM p) SELECT * FROM c UNION ALL SELECT msa_id, j, i, d FROM c UNION ALL SELECT msa_id, doc_id, doc_id, CAST(0 AS DOUBLE) FROM g",
)


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    got = phylo.build_trees(_tree_distances(spark, sf), "upgma")
    return got.select("msa_id", F.explode("nodes").alias("n")).where(F.size("n.children") == 0).select("msa_id", "n.label")


add("t13_leaf_labels", _leaves, f"WITH {PROTEIN_SQL}, g AS (SELECT doc_id // {GROUP} AS msa_id, doc_id, count(*) OVER (PARTITION BY doc_id // {GROUP}) AS k FROM s WHERE seq <> '') SELECT msa_id, 'd' || doc_id AS label FROM g WHERE k > 1")
add("m5_widths", lambda spark, sf: Alignment(base.aligned(base.protein(spark, sf)), "protein").widths(), f"WITH {PROTEIN_SQL} SELECT doc_id // {GROUP} AS msa_id, count(*) AS rows, {n('max(length(seq))')} AS width FROM s GROUP BY 1")
add("m6_conservation", lambda spark, sf: Alignment(base.aligned(base.dna(spark, sf)), "dna").conservation().groupBy("msa_id").agg(F.count("*").alias("width"), F.sum(F.col("conserved").cast("long")).alias("conserved")), f"WITH {DNA_SQL}, g AS (SELECT doc_id // {GROUP} AS msa_id, seq, max(length(seq)) OVER (PARTITION BY doc_id // {GROUP}) AS w FROM s), r AS (SELECT msa_id, rpad(seq, CAST(w AS INTEGER), '-') AS a FROM g WHERE w > 0), c AS (SELECT msa_id, unnest(range(length(a))) AS col, unnest(string_split(a, '')) AS c FROM r), k AS (SELECT msa_id, col, count(*) AS n, count(DISTINCT c) AS u, min(c) AS low FROM c GROUP BY ALL) SELECT msa_id, count(*) AS width, {n('sum(CAST(n = 1 OR (u = 1 AND low <> chr(45)) AS INT))')} AS conserved FROM k GROUP BY msa_id")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """GC content, reverse complement and translation of every document's sequence, in one narrow stage."""
    s = F.col("seq")
    return base.dna(spark, sf).select("doc_id", nucleotide.gc_content(s).alias("gc"), nucleotide.reverse_complement(s).alias("rc"), nucleotide.translate(s, 1).alias("protein"))


add("flagship", lambda spark, sf: entry(spark, sf).withColumn("gc", F.round("gc", 6)), select(DNA_SQL, gc=q6("CASE WHEN seq = '' THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END"), rc="reverse(translate(seq, 'ACGT', 'TGCA'))", protein=_codons("seq")))

# -- known values -------------------------------------------------------------

for _name in known.CASES:
    add(_name, known.query(_name), known.sql(_name))
