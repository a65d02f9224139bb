"""Queries of the entry point: one for each SQL, and the smallest table runs."""

import os
import subprocess
import sys

import pytest

import __spark_entry__
from seqloom.plans import queries as plans

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.SQL) > 70


def test_imports_without_a_session():
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=os.path.dirname(__spark_entry__.__file__))
    assert run.returncode == 0, run.stderr


def normal(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return bytes(v).hex() if isinstance(v, bytearray) else v


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["flagship", "f8_starts_ends", "n9_translate_auto", "p11_isoelectric_point", "b4_slice", "t3_k2p", "m6_conservation", "io1_fasta_round_trip", "io10_csv_skipped"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = plans.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    run = con.execute(plans.SQL[name])
    order = [d[0] for d in run.description]
    assert sorted(order) == names
    rows = lambda own: sorted((tuple(map(normal, r)) for r in own), key=repr)
    assert rows([r[c] for c in names] for r in got.collect()) == rows([r[order.index(c)] for c in names] for r in run.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_detect_counts_letters_by_code_point(spark, tmp_path):
    """Upper cases of several letters (ß, ﬁ, ẗ) count as none of them, as in the SQL."""
    import duckdb

    cased = [c for c in map(chr, range(0x110000)) if c.upper() != c]
    texts = [None, "", *(c + end for c in cased for end in ("", "T", "u")), "Öß.", "zuß", "ungß", "tzßu"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    got = {r.doc_id: r.kind for r in plans.QUERIES["io9_detect"](spark, str(tmp_path)).collect()}
    want = dict(con.execute(plans.SQL["io9_detect"]).fetchall())
    assert len(got) == len(texts) and [(texts[k], got[k], v) for k, v in want.items() if got[k] != v] == []
