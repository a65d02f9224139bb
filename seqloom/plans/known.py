"""Small cases with known values, for what works on literals or on the driver: each a row (name, value)."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import alphabets
from seqloom.operators import align, msa, phylo
from seqloom.operators.frames import RecordFrame, SeqFrame, feature, location, record
from seqloom.sources import fasta, fastq

Case = tuple[str, Callable[[SparkSession], object], str]


def raised(f: Callable) -> str:
    """The kind of error that f() ends in."""
    try:
        f()
    except Exception as e:  # an executor's error comes as one of Spark's
        return "SequenceError" if "SequenceError" in str(e) or type(e).__name__ == "SequenceError" else type(e).__name__
    return "none"


def aligned(spark: SparkSession, query: str, target: str, scoring: align.Scoring = align.Scoring(), kind: str = "dna", local: bool = True) -> str:
    row = spark.createDataFrame([(query, target)], "query string, target string").select(align.align(F.col("query"), F.col("target"), scoring, kind, local, True).alias("a")).select("a.score", align.cigar_text(F.col("a.cigar")).alias("cigar")).first()
    return f"{row.score:g} {row.cigar}"


def _rows(spark: SparkSession, *seqs: str, kind: str = "dna") -> msa.Alignment:
    return msa.Alignment.of(spark, [(f"s{k}", s) for k, s in enumerate(seqs)], kind)


def _distance(spark: SparkSession, model: str, *seqs: str, kind: str = "dna") -> phylo.DistanceMatrix:
    return phylo.distance_matrix(_rows(spark, *seqs, kind=kind), model)


def _named_tool(path: str | None) -> str:
    before = os.environ.get(msa.BINARY_VARIABLE)
    try:
        if path is not None:
            os.environ[msa.BINARY_VARIABLE] = path
        return raised(msa.find_clustalo)
    finally:
        os.environ.pop(msa.BINARY_VARIABLE, None)
        if before is not None:
            os.environ[msa.BINARY_VARIABLE] = before


def _blocked() -> str:
    with tempfile.NamedTemporaryFile() as f:  # there, but not to be run
        os.chmod(f.name, 0o600)
        return _named_tool(f.name)


_DNA = alphabets.Alphabet("ACGT")
_FOUR = ["A", "CC", "GGG", "TTTT"]
_TREE = phylo.DistanceMatrix(list("ABCD"), [[0, 2, 4, 4], [2, 0, 4, 4], [4, 4, 0, 2], [4, 4, 2, 0]])


def _frame(spark: SparkSession) -> SeqFrame:
    return SeqFrame.of(spark, _FOUR, "dna")


def _records(spark: SparkSession) -> RecordFrame:
    first = record("id1", "ATGC", "about", [feature("gene", location(1, 3, 1), {"gene": ["abc"]})], {"source": ["test"]})
    return RecordFrame.of(spark, [first, record("id2", "GG")], "dna")


CASES: dict[str, list[Case]] = {
    "a1_alphabet": [
        ("length", lambda _: len(_DNA), "4"),
        ("inserted twice", lambda _: len(_DNA.insert("N").insert("N")), "5"),
        ("holds", lambda _: ("A" in _DNA, "N" in _DNA), "(True, False)"),
        ("largest", lambda _: (_DNA.max_symbol(), alphabets.Alphabet().max_symbol()), "('T', None)"),
        ("empty", lambda _: (alphabets.Alphabet().is_empty(), _DNA.is_empty()), "(True, False)"),
        ("of codes", lambda _: alphabets.Alphabet([65, 67, 71, 84]) == _DNA, "True"),
        ("ranks", lambda _: ([_DNA.ranks().get(c) for c in "ACGTN"], _DNA.ranks().width()), "([0, 1, 2, 3, None], 2)"),
    ],
    "b1_construct": [
        ("lengths", lambda s: [r.length for r in _frame(s).lengths().orderBy("pos").collect()], "[1, 2, 3, 4]"),
        ("invalid symbol", lambda s: raised(lambda: SeqFrame.of(s, ["AC", "A#"], "dna")), "SequenceError"),
        ("no text", lambda s: raised(lambda: SeqFrame.of(s, [1], "dna")), "TypeError"),
        ("unknown kind", lambda s: raised(lambda: SeqFrame(s.range(0), "x")), "TypeError"),
        ("empty", lambda s: (len(SeqFrame.of(s, [], "dna")), SeqFrame.of(s, [], "dna").is_empty()), "(0, True)"),
    ],
    "b6_concat_whole": [
        ("joined", lambda s: _frame(s).concat(), "ACCGGGTTTT"),
        ("empty", lambda s: raised(lambda: SeqFrame.of(s, [], "dna").concat()), "SequenceError"),
    ],
    "b10_iterate": [
        ("iterated", lambda s: [x for x in _frame(s)], "['A', 'CC', 'GGG', 'TTTT']"),
        ("listed", lambda s: _frame(s).copy().to_list(), "['A', 'CC', 'GGG', 'TTTT']"),
        ("unpacked", lambda s: (lambda a, *b: (a, len(b)))(*_frame(s)), "('A', 3)"),
        ("map_bytes", lambda s: list(_frame(s).map_bytes(lambda b: b[:1])), "['A', 'C', 'G', 'T']"),
    ],
    "r1_record": [
        ("fields", lambda _: sorted(record("a", "AC")), "['annotations', 'description', 'features', 'id', 'seq']"),
        ("defaults", lambda _: (record("a", "AC")["description"], record("a", "AC")["features"], record("a", "AC")["annotations"]), "(None, [], {})"),
        ("invalid symbol", lambda s: raised(lambda: RecordFrame.of(s, [record("a", "A#")], "dna")), "SequenceError"),
    ],
    "r2_location": [
        ("fields", lambda _: list(location(1, 3, -1).values()), "[1, 3, -1]"),
        ("backwards", lambda _: raised(lambda: location(3, 1)), "SequenceError"),
        ("negative", lambda _: raised(lambda: location(-1, 1)), "SequenceError"),
        ("strand", lambda _: raised(lambda: location(0, 1, 2)), "SequenceError"),
    ],
    "r3_feature": [
        ("fields", lambda _: list(feature("gene", location(0, 2), {"g": ["x"]}).values()), "['gene', {'start': 0, 'end': 2, 'strand': None}, {'g': ['x']}]"),
        ("no type", lambda _: raised(lambda: feature("", location(0, 1))), "SequenceError"),
        ("qualifier", lambda _: raised(lambda: feature("g", location(0, 1), {"g": "x"})), "TypeError"),
        ("other strand", lambda s: [tuple(f["location"].values()) for r in _records(s).reverse_complements() for f in r["features"]], "[(1, 3, -1)]"),
    ],
    "r4_accessors": [
        ("ids", lambda s: [r.id for r in _records(s).ids().orderBy("pos").collect()], "['id1', 'id2']"),
        ("descriptions", lambda s: [r.description for r in _records(s).descriptions().orderBy("pos").collect()], "['about', None]"),
        ("seqs", lambda s: list(_records(s).seqs()), "['ATGC', 'GG']"),
        ("iterated", lambda s: [(r["id"], r["annotations"]) for r in _records(s)], "[('id1', {'source': ['test']}), ('id2', {})]"),
        ("item", lambda s: _records(s)[-1].id, "id2"),
    ],
    "io5_bytes": [
        ("fastq", lambda s: [(r["id"], r["description"], r["seq"]) for r in fastq.read_fastq_bytes(s, b"@seq1 some desc\nAC\n+\n!!\n@seq2\nGT\n+\n##\n")], "[('seq1', 'some desc', 'AC'), ('seq2', None, 'GT')]"),
        ("fastq kind", lambda s: fastq.read_fastq_bytes(s, b"@p1\nMFW\n+\n###\n").kind, "protein"),
        ("fastq quality", lambda s: raised(lambda: fastq.read_fastq_bytes(s, b"@a\nAC\n+\n!\n")), "FormatError"),
        ("fasta", lambda s: [(r["id"], r["description"], r["seq"]) for r in fasta.read_fasta_bytes(s, b">seq1 some desc\nAC\nGT\n>seq2\nA\n")], "[('seq1', 'some desc', 'ACGT'), ('seq2', None, 'A')]"),
    ],
    "l5_matrices": [
        ("names", lambda _: align.matrix_names(), "['BLOSUM62', 'EDNAFULL']"),
        ("own matrix", lambda s: aligned(s, "ACGT", "ACGT", align.Scoring.with_matrix([3 if i == j else -1 for i in range(len(align.DNA_CODES)) for j in range(len(align.DNA_CODES))], len(align.DNA_CODES))), "12 4M"),
        ("uneven", lambda _: raised(lambda: align.Scoring.with_matrix([1, 2, 3], 2)), "ValueError"),
        ("gap above 0", lambda _: raised(lambda: align.Scoring(gap_open=1.0)), "ValueError"),
        ("unknown", lambda _: raised(lambda: align.matrix("nope")), "ValueError"),
        ("symmetric", lambda _: [bool((align.matrix(x) == align.matrix(x).T).all()) for x in align.matrix_names()], "[True, True]"),
    ],
    "l8_known_alignments": [
        ("equal", lambda s: aligned(s, "ACGT", "ACGT"), "20 4M"),
        ("end gap", lambda s: aligned(s, "ACGT", "ACG", local=False), "13 3M1I"),
        ("empty query", lambda s: aligned(s, "", "ACGT", local=False), "-5 4D"),
        ("nothing alike", lambda s: aligned(s, "AAAA", "TTTT"), "0 "),
        ("either case", lambda s: aligned(s, "acgu", "ACGT"), "20 4M"),
        ("protein", lambda s: aligned(s, "ACDE", "ACDE", kind="protein", local=False), "24 4M"),
        ("rna", lambda s: raised(lambda: aligned(s, "A", "A", kind="rna")), "TypeError"),
    ],
    "m3_find_tool": [
        ("no such path", lambda _: _named_tool("/nonexistent/clustalo"), "FileNotFoundError"),
        ("not to be run", lambda _: _blocked(), "PermissionError"),
    ],
    "m4_arguments": [
        ("one string", lambda _: raised(lambda: msa.check_args("--full")), "TypeError"),
        ("numbers", lambda _: raised(lambda: msa.check_args([1])), "TypeError"),
        ("output", lambda _: [raised(lambda a=a: msa.check_args([a])) for a in ("-i", "-o", "--force", "--outfmt=fa", "--threads=2", "--infile=x", "--seqtype=DNA")], str(["ValueError"] * 7)),
        ("others", lambda _: msa.check_args(["--full", "--iter=2"]), "['--full', '--iter=2']"),
        ("parsed", lambda _: msa.parse_fasta(">a x\nAC\nGT\n\n>b\nA-\n"), "[('a', 'ACGT'), ('b', 'A-')]"),
        ("one record", lambda _: raised(lambda: msa.msa([record("a", "AC")], "dna", binary="x")), "SequenceError"),
        ("a text", lambda _: raised(lambda: msa.msa("ACGT", "dna", binary="x")), "TypeError"),
    ],
    "m5_alignment": [
        ("strings", lambda s: _rows(s, "AC-GT", "ACAGT").seqs(), "['AC-GT', 'ACAGT']"),
        ("items", lambda s: (_rows(s, "AC-GT", "ACAGT")[1], _rows(s, "AC-GT", "ACAGT")[-2]), "(('s1', 'ACAGT'), ('s0', 'AC-GT'))"),
        ("slice", lambda s: list(_rows(s, "A", "C", "G", "T")[::-2]), "[('s3', 'T'), ('s1', 'C')]"),
        ("empty slice", lambda s: (len(_rows(s, "A")[:0]), _rows(s, "A")[:0].width(), _rows(s, "A")[:0].aligned_strings(), str(_rows(s, "A")[:0])), "(0, 0, [], '')"),
        ("beyond", lambda s: raised(lambda: _rows(s, "A")[1]), "IndexError"),
        ("unequal", lambda s: raised(lambda: _rows(s, "ACGT", "AC")), "SequenceError"),
        ("no rows", lambda s: raised(lambda: _rows(s)), "SequenceError"),
        ("diagram", lambda s: _rows(s, "AC-GT", "ACAGT", "AC-GA").diagram().replace("\n", "/"), "s0  AC-GT/s1  ACAGT/s2  AC-GA/    ** * "),
        ("dots", lambda s: _rows(s, "A.C", "A-C").diagram().split("\n")[-1], "    * *"),
    ],
    "t6_checks": [
        ("far apart, jc69", lambda s: raised(lambda: _distance(s, "jc69", "AAAAA", "TTTTT")), "SequenceError"),
        ("far apart, poisson", lambda s: raised(lambda: _distance(s, "poisson", "ACDE", "FGHI", kind="protein")), "SequenceError"),
        ("no valid column", lambda s: raised(lambda: _distance(s, "p-distance", "----", "ACGT")), "SequenceError"),
        ("one row", lambda s: raised(lambda: _distance(s, "p-distance", "ACGT")), "SequenceError"),
        ("unknown model", lambda s: raised(lambda: _distance(s, "other", "AC", "AC")), "ValueError"),
        ("not for protein", lambda s: raised(lambda: _distance(s, "k2p", "AC", "AC", kind="protein")), "ValueError"),
        ("dots are gaps", lambda s: _distance(s, "p-distance", "ACGT", "A-GT", "acg.").to_list(), str([0.0] * 9)),
    ],
    "t8_matrix": [
        ("listed", lambda s: _distance(s, "p-distance", "AAAA", "AAAT", "AATT").to_list(), "[0.0, 0.25, 0.5, 0.25, 0.0, 0.25, 0.5, 0.25, 0.0]"),
        ("rows", lambda _: _TREE.to_list_of_lists()[1], "[2.0, 0.0, 4.0, 4.0]"),
        ("size", lambda _: (len(_TREE), _TREE.n, _TREE.get(0, 2)), "(4, 4, 4.0)"),
        ("beyond", lambda _: raised(lambda: _TREE.get(0, 4)), "IndexError"),
        ("shape", lambda _: raised(lambda: phylo.DistanceMatrix(["a"], [[0, 1]])), "SequenceError"),
    ],
    "t11_newick": [
        ("nj", lambda _: phylo.build_tree(_TREE).to_newick(), "((A:1.000000,B:1.000000):1.000000,(C:1.000000,D:1.000000):1.000000);"),
        ("upgma", lambda _: phylo.build_tree(_TREE, "upgma").to_newick(), "((A:1.000000,B:1.000000):1.000000,(C:1.000000,D:1.000000):1.000000);"),
        ("quoted", lambda _: phylo.build_tree(phylo.DistanceMatrix(["A B", "E'F"], [[0, 3], [3, 0]])).to_newick(), "('A B':1.500000,'E''F':1.500000);"),
        ("rooted", lambda _: [phylo.build_tree(_TREE, m).is_rooted for m in ("nj", "upgma")], "[False, True]"),
        ("leaves", lambda _: (phylo.build_tree(_TREE).num_leaves, phylo.build_tree(_TREE).num_nodes, phylo.build_tree(_TREE).leaf_labels()), "(4, 7, ['A', 'B', 'C', 'D'])"),
        ("one label", lambda _: raised(lambda: phylo.build_tree(phylo.DistanceMatrix(["a"], [[0]]))), "SequenceError"),
    ],
    "t12_diagram": [
        ("lines", lambda _: phylo.build_tree(_TREE, "upgma").ascii_diagram().replace("\n", "/"), "node6/|-- node4:1.000000/|   |-- A:1.000000/|   `-- B:1.000000/`-- node5:1.000000/    |-- C:1.000000/    `-- D:1.000000"),
    ],
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, _: spark.createDataFrame([(case, str(f(spark))) for case, f, _ in CASES[name]], "name string, value string")


def sql(name: str) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({text(case)}, {text(want)})" for case, _, want in CASES[name]) + ") x(name, value)"
