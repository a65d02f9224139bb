"""Column functions against known answers and Python's own string methods."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.functions import alphabets, nucleotide, protein, strings


def value(spark, f, *seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    got = [r[0] for r in df.select(f(F.col("seq")).alias("x")).collect()]
    return got if len(seqs) > 1 else got[0]


def test_counts(spark):
    assert value(spark, lambda s: strings.count(s, "AAA"), "AAAAAAA") == 2
    assert value(spark, lambda s: strings.count_overlap(s, "AAA"), "AAAAAAA") == 5
    assert value(spark, lambda s: strings.count(s, ""), "ACGT") == 5
    assert value(spark, lambda s: strings.count(s, b"AC"), "ACAC") == 2
    assert value(spark, lambda s: strings.count(s, 65), "ACAC") == 2
    with pytest.raises(TypeError):
        strings.needle(1.5)
    with pytest.raises(ValueError):
        strings.needle(300)


CASES = [(a, b) for a in (None, 0, 2, -3, 9, -20) for b in (None, 0, 3, -1, 20)]


@pytest.mark.parametrize("seq", ["", "ACGTACGT", "AAAA"])
def test_find_like_python(spark, seq):
    for sub in ("AC", "A", "TT", "GTACG"):
        for a, b in CASES:
            df = spark.createDataFrame([(seq,)], "seq string")
            s = F.col("seq")
            got = df.select(strings.find(s, sub, a, b), strings.rfind(s, sub, a, b), strings.startswith(s, sub, a, b), strings.endswith(s, sub, a, b)).first()
            assert tuple(got) == (seq.find(sub, a, b), seq.rfind(sub, a, b), seq.startswith(sub, a, b), seq.endswith(sub, a, b)), (sub, a, b)


def test_empty_needles(spark):
    seq = "ACGTACGT"
    assert value(spark, lambda s: strings.find(s, "", 3), seq) == 3
    assert value(spark, lambda s: strings.find(s, "", 100), seq) == 8
    assert value(spark, lambda s: strings.rfind(s, "", 3), seq) == 8
    assert value(spark, lambda s: strings.find(s, "", 5, 2), seq) == -1
    assert value(spark, lambda s: strings.startswith(s, "", 100), seq) is True
    assert value(spark, lambda s: strings.startswith(s, ("GG", "AC")), seq) is True
    with pytest.raises(PySparkException):
        value(spark, lambda s: strings.index(s, "TTT"), seq)


def test_slices_like_python(spark):
    for seq in ("", "A", "ACGTACG"):
        df = spark.createDataFrame([(seq,)], "seq string")
        keys = [(a, b, c) for a in (None, 0, 2, -2, 9) for b in (None, 1, -1, -9) for c in (1, 2, -1, -3)]
        got = df.select(*[strings.slice_(F.col("seq"), *k).alias(f"x{i}") for i, k in enumerate(keys)]).first()
        assert list(got) == [seq[a:b:c] for a, b, c in keys]
    assert value(spark, lambda s: strings.get(s, -1), "ACG") == "G"
    with pytest.raises(PySparkException):
        value(spark, lambda s: strings.get(s, 3), "ACG")


@settings(max_examples=25, deadline=None)
@given(st.text("AC \t\n", max_size=14), st.sampled_from([None, "A", "AC", "AA"]), st.integers(-1, 3))
def test_splits_like_python(spark, seq, sep, most):
    df = spark.createDataFrame([(seq,)], "seq string")
    s = F.col("seq")
    got = df.select(strings.split(s, sep, most), strings.rsplit(s, sep, most), strings.strip(s), strings.lstrip(s, "AC"), strings.rstrip(s, "C")).first()
    want = seq.split(sep, most), seq.rsplit(sep, most), seq.strip(), seq.lstrip("AC"), seq.rstrip("C")
    assert (got[0], got[1], *got[2:]) == want


def test_validity(spark):
    assert value(spark, lambda s: strings.is_valid(s, "dna"), "ACGTN", "AC#", "", "acgn", "ACGU") == [True, False, True, True, False]
    assert value(spark, lambda s: strings.invalid_position(s, "protein"), "ACJ", "AC\n", "AC*") == [2, 2, None]
    with pytest.raises(PySparkException, match="position 2"):
        value(spark, lambda s: strings.validate(s, "dna"), "AC#")
    assert value(spark, strings.detect_kind, "ACGT", "ACGU", "ACGTU", "MKV", "acgr", "") == ["dna", "rna", "dna", "protein", "protein", "dna"]
    assert value(spark, strings.normalize, " A C\tG\n") == "ACG"
    assert value(spark, strings.ungapped, "A-C.G") == "ACG"
    assert value(spark, lambda s: alphabets.DNA.is_word(s), "ACGT", "ACN", "") == [True, False, True]


def test_nucleotides(spark):
    every = alphabets.both_cases(alphabets.DNA_IUPAC)
    twice = value(spark, lambda s: nucleotide.complement(nucleotide.complement(s)), every)
    assert twice == every
    assert value(spark, nucleotide.reverse_complement, "AACRN") == "NYGTT"
    assert value(spark, lambda s: nucleotide.complement(s, "rna"), "ACGU") == "UGCA"
    assert value(spark, nucleotide.transcribe, "ATtg") == "AUug"
    assert value(spark, nucleotide.back_transcribe, "AUug") == "ATtg"
    assert value(spark, nucleotide.gc_content, "GGcA", "", "SSNN") == [0.75, 0.0, 0.0]
    assert value(spark, nucleotide.translate, "ATGGCC", "atgtaa", "ATGNNN", "") == ["MA", "M*", "MX", ""]
    with pytest.raises(PySparkException):
        value(spark, nucleotide.translate, "ATGA")
    assert value(spark, lambda s: nucleotide.translate(s, 1), "ATGGCCA") == "MA"
    assert value(spark, lambda s: nucleotide.translate(s, 2), "AATGGCC", "AT", "A", "") == ["MA", "", "", ""]
    assert value(spark, lambda s: nucleotide.translate(s, 3), "CCATGGCC") == "MA"
    assert value(spark, lambda s: nucleotide.translate(s, "auto"), "CATGAAATTT", "ATGTAAGCC", "CCC", "") == ["MKF", "M*A", "P", ""]
    assert value(spark, lambda s: nucleotide.translate_fast(s, 2), "AATGGCC", "A", "") == ["MA", "", ""]
    assert len(alphabets.codons()) == 64 and alphabets.codons("rna")["AUG"] == "M"
    with pytest.raises(ValueError):
        nucleotide.translate_frame(F.lit("A"), 4)
    with pytest.raises(TypeError):
        nucleotide.complement(F.lit("A"), "protein")


def test_translations_agree(spark):
    import random

    rng = random.Random(1)
    seqs = ["".join(rng.choices("ACGTNacgt", k=rng.randrange(50))) for _ in range(60)]
    for frame in (1, 2, 3):
        assert value(spark, lambda s, k=frame: nucleotide.translate(s, k), *seqs) == value(spark, lambda s, k=frame: nucleotide.translate_fast(s, k), *seqs)


def test_proteins(spark):
    assert value(spark, protein.molecular_weight, "AC") == pytest.approx(192.23288)
    assert value(spark, protein.hydrophobicity, "ACD") == pytest.approx(0.26667, abs=1e-5)
    assert value(spark, lambda s: protein.hydrophobicity_profile(s, 2), "ACD") == pytest.approx([2.15, -0.5])
    assert value(spark, lambda s: protein.hydrophobicity_profile(s, 9), "ACB") == []
    assert value(spark, protein.shannon_entropy, "ACAC", "", "AAaa") == pytest.approx([1.0, 0.0, 1.0])
    assert value(spark, protein.unknown_positions, "ACBX", "") == [[2, 3], []]
    assert [tuple(x) for x in value(spark, protein.counts, "bAAa")] == [("A", 2), ("a", 1), ("b", 1)]
    twenty = value(spark, protein.aa_counts_20, "aAX")
    assert [x.symbol for x in twenty] == list(alphabets.METRIC_ORDER) and twenty[0][1] == 2
    assert sum(x.frequency for x in value(spark, protein.aa_frequencies_20, "aAX")) == pytest.approx(2 / 3)
    assert value(spark, protein.isoelectric_point, "AC") == pytest.approx(5.3257042374)
    pi = value(spark, protein.isoelectric_point, "ACDKRHY")
    assert value(spark, lambda s: protein.net_charge(s, pi), "ACDKRHY") == pytest.approx(0, abs=1e-9)
    assert value(spark, protein.has_ambiguous, "ACD", "AC*", "acx") == [False, True, True]
    assert value(spark, protein.molecular_weight, "", "A") [0] == 0.0
    for f in (protein.molecular_weight, protein.hydrophobicity, lambda s: protein.net_charge(s, 7), protein.isoelectric_point, protein.validate_strict_20):
        with pytest.raises(PySparkException, match="position 1"):
            value(spark, f, "AX")


def test_qgrams(spark):
    ranks = alphabets.Alphabet("ACGT").ranks()
    assert ranks.width() == 2 and ranks.get("N") is None
    assert value(spark, lambda s: ranks.qgrams(4, s), "ACTGA", "ACG") == [[30, 120], []]
    assert value(spark, lambda s: ranks.rev_qgrams(4, s), "ACTGA") == [120, 30]
    assert value(spark, ranks.transform, "TA") == [3, 0]
    assert len(value(spark, lambda s: ranks.qgrams(32, s), "ACGT" * 8)) == 1
    with pytest.raises(ValueError):
        ranks.qgrams(33, F.lit("A"))
    a, b = alphabets.Alphabet("AC"), alphabets.Alphabet("CG")
    assert a.union(b) == alphabets.Alphabet("ACG") and a.intersection(b) == alphabets.Alphabet("C") and a.difference(b) == alphabets.Alphabet("A")
    assert a.insert("T").max_symbol() == "T" and alphabets.Alphabet().is_empty() and len(a) == 2


def test_sql_functions(spark):
    from seqloom.functions import sql

    names = sql.register(spark)
    assert len(names) == len(set(names)) == len(sql.FUNCTIONS)
    spark.createDataFrame([("ACGTACGN", "MKV")], "d string, p string").createOrReplaceTempView("seqs")
    got = spark.sql("select seq_reverse_complement(d), seq_gc_content('GGCA'), seq_count(d, 'AC'), seq_count_overlap('AAA', 'AA'), seq_rfind(d, 'AC'), seq_is_dna(d), seq_detect_kind(p), seq_net_charge(p, 7.0D), seq_molecular_weight('AC') from seqs").first()
    charge = value(spark, lambda s: protein.net_charge(s, 7.0), "MKV")
    assert list(got) == ["NCGTACGT", 0.75, 2, 2, 4, True, "protein", charge, pytest.approx(192.23288)]
