"""Sequence functions in SQL: temporary functions whose bodies are the Column functions' own expressions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.functions import nucleotide, protein, strings

#: Name, result, further parameters, and the function of the sequence and of those.
FUNCTIONS = [
    ("seq_complement", "STRING", "", lambda s: nucleotide.complement(s)),
    ("seq_reverse_complement", "STRING", "", lambda s: nucleotide.reverse_complement(s)),
    ("seq_complement_rna", "STRING", "", lambda s: nucleotide.complement(s, "rna")),
    ("seq_transcribe", "STRING", "", lambda s: nucleotide.transcribe(s)),
    ("seq_back_transcribe", "STRING", "", lambda s: nucleotide.back_transcribe(s)),
    ("seq_gc_content", "DOUBLE", "", lambda s: nucleotide.gc_content(s)),
    ("seq_ungapped", "STRING", "", lambda s: strings.ungapped(s)),
    ("seq_normalize", "STRING", "", lambda s: strings.normalize(s)),
    ("seq_detect_kind", "STRING", "", lambda s: strings.detect_kind(s)),
    ("seq_is_dna", "BOOLEAN", "", lambda s: strings.is_valid(s, "dna")),
    ("seq_is_rna", "BOOLEAN", "", lambda s: strings.is_valid(s, "rna")),
    ("seq_is_protein", "BOOLEAN", "", lambda s: strings.is_valid(s, "protein")),
    ("seq_count", "BIGINT", "sub STRING", lambda s, sub: strings.count(s, sub)),
    ("seq_count_overlap", "BIGINT", "sub STRING", lambda s, sub: strings.count_overlap(s, sub)),
    ("seq_find", "BIGINT", "sub STRING", lambda s, sub: strings.find(s, sub)),
    ("seq_rfind", "BIGINT", "sub STRING", lambda s, sub: strings.rfind(s, sub)),
    ("seq_has_ambiguous", "BOOLEAN", "", lambda s: protein.has_ambiguous(s)),
    ("seq_molecular_weight", "DOUBLE", "", lambda s: protein.molecular_weight(s)),
    ("seq_hydrophobicity", "DOUBLE", "", lambda s: protein.hydrophobicity(s)),
    ("seq_net_charge", "DOUBLE", "ph DOUBLE", lambda s, ph: protein.net_charge(s, ph)),
]


#: How Spark writes raise_error() of a message.
_RAISED = re.compile(r"raise_error\('?USER_RAISED_EXCEPTION'?, map\('?errorMessage'?, ")


def _readable(body: str) -> str:
    """body with raise_error(message) in the form that the parser takes."""
    while m := _RAISED.search(body):
        depth, at = 0, m.end()
        while depth >= 0:  # to the parenthesis that closes the map
            depth += {"(": 1, ")": -1}.get(body[at], 0)
            at += 1
        body = body[: m.start()] + "raise_error(" + body[m.end() : at - 1] + body[at:]
    return body


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql() of this session; their names.

    A body is the analysed expression as SQL, so a call is inlined and optimised like any expression.
    Bodies name the one Arrow function that they need, seq_tally, which is registered first.
    """
    spark.udf.register("seq_tally", protein.tally_function())
    for name, kind, more, f in FUNCTIONS:
        given = [p.split() for p in more.split(", ")] if more else []
        row = spark.range(1).selectExpr("'' AS seq", *[f"CAST(NULL AS {t}) AS {p}" for p, t in given])
        made = row.select(f(F.col("seq"), *[F.col(p) for p, _ in given]).alias("x"))
        body = made._jdf.queryExecution().analyzed().projectList().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(seq STRING{', ' + more if more else ''}) RETURNS {kind} RETURN {_readable(body)}")
    return [name for name, *_ in FUNCTIONS]
