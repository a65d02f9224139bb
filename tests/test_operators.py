"""Frames, records, alignments, trees and files against known answers and plain versions."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.errors import FormatError, SequenceError
from seqloom.functions import nucleotide
from seqloom.operators import align, frames, msa, phylo
from seqloom.operators.align import Scoring, align_batch
from seqloom.operators.frames import RecordFrame, SeqFrame
from seqloom.sources import fasta, fastq, tables

BATCH = ["A", "CC", "GGG", "TTTT"]


def test_frames_like_lists(spark):
    f = SeqFrame.of(spark, BATCH, "dna")
    assert f.to_list() == BATCH and len(f) == 4 and f.concat() == "ACCGGGTTTT"
    for key in (slice(1, 3), slice(None, None, 2), slice(None, None, -1), slice(-3, None), slice(9, 2), slice(3, 0, -2), slice(-1, -4, -1)):
        assert f[key].to_list() == BATCH[key], key
        assert [r.pos for r in f[key].df.orderBy("pos").collect()] == list(range(len(BATCH[key])))
    assert f.at(-1).seq == "TTTT" and f[1].seq == "CC"
    assert f.take([2, 0, -1, 2]).to_list() == ["GGG", "A", "TTTT", "GGG"]
    assert f.filter_by_len(2, 3).to_list() == ["CC", "GGG"] and f.filter_by_len(3, 2).to_list() == []
    assert f.filter_by_len(2)[0].seq == "CC" and f.filter_by_len(2).slice(1).to_list() == ["GGG", "TTTT"]
    assert f.append("AC").extend(f).to_list() == [*BATCH, "AC", *BATCH]
    assert (f * 2).to_list() == BATCH * 2 and (f * 0).to_list() == [] and f.truncate(1).to_list() == ["A"]
    last, rest = f.pop()
    assert last.seq == "TTTT" and rest.to_list() == BATCH[:3] and f.clear().is_empty()
    assert f.map(str.lower).to_list() == [s.lower() for s in BATCH] and f.map_bytes(lambda b: b[:1]).to_list() == list("ACGT")
    assert [r.length for r in f.lengths().orderBy("pos").collect()] == [1, 2, 3, 4]
    assert SeqFrame.of(spark, ["AAC", "TT"], "dna").count_of("A").orderBy("pos").collect()[0][1] == 2
    assert f.reverse_complements().to_list() == ["T", "GG", "CCC", "AAAA"] and f.transcribe().kind == "rna"
    assert SeqFrame.of(spark, ["ATGGCCA", "AATGGCC"], "dna").translate(1).kind == "protein"
    for bad in (lambda: f.take([4]), lambda: f.at(4), lambda: f.clear().pop()):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: f.extend(SeqFrame.of(spark, ["A"], "rna")), lambda: SeqFrame.of(spark, ["A"], "rna").contains("A"), lambda: f.metric("counts"), lambda: SeqFrame.of(spark, ["A"], "protein").complement(), lambda: f["x"]):
        with pytest.raises(TypeError):
            bad()
    for bad in (lambda: f.slice(step=0), lambda: SeqFrame.of(spark, ["A#"], "dna"), lambda: f.clear().concat()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PySparkException):
        f.map(lambda s: "#").to_list()


def test_renumbering_sparse_positions(spark):
    rng = random.Random(3)
    pos = rng.sample(range(10**12), 500)
    df = spark.createDataFrame([(p, str(p)) for p in pos], "pos long, seq string").repartition(7)
    assert [(r.pos, r.seq) for r in frames.renumber(df).orderBy("pos").collect()] == [(k, str(p)) for k, p in enumerate(sorted(pos))]


def test_records(spark):
    where = frames.location(0, 2, 1)
    rows = [frames.record("a", "ATGC", "x", [frames.feature("gene", where, {"gene": ["abc"]})], {"source": ["t"]}), frames.record("b", ""), frames.record("c", "GCTA")]
    f = RecordFrame.of(spark, rows, "dna")
    assert [r.id for r in f.filter_empty().ids().orderBy("pos").collect()] == ["a", "c"]
    turned = f.reverse_complements().df.orderBy("pos").first()
    assert turned.seq == "GCAT" and tuple(turned.features[0].location) == (2, 4, -1) and turned.features[0].qualifiers == {"gene": ["abc"]}
    p = f.translate(1).df.orderBy("pos").first()
    assert p.seq == "M" and p.features == [] and p.annotations == {"source": ["t"]} and p.description == "x"
    assert f.seqs().to_list() == ["ATGC", "", "GCTA"] and f.skipped.count() == 0 and len(f[1:]) == 2
    for bad in (lambda: frames.location(3, 2), lambda: frames.location(0, 1, 2), lambda: frames.feature("", where)):
        with pytest.raises(SequenceError):
            bad()
    with pytest.raises(TypeError):
        frames.feature("gene", where, {"a": "b"})
    long = RecordFrame.of(spark, [frames.record("a", "AC", None, [frames.feature("g", frames.location(0, 5))])], "dna")
    with pytest.raises(PySparkException, match="beyond"):
        long.reverse_complements().df.collect()


# -- pairwise alignment -------------------------------------------------------


def one(q, t, scoring=Scoring(), kind="dna", local=True, traceback=True):
    return align_batch([q], [t], scoring, kind, local, traceback)[0]


def test_known_alignments(spark):
    assert one("ACGT", "ACGT")["score"] == 20 and one("ACGT", "ACGT")["cigar"] == [("M", 4)]
    assert one("ACGT", "ACG", local=False)["score"] == 13
    assert one("", "ACGT", local=False) == {"score": -5.0, "query_start": 0, "query_end": 0, "target_start": 0, "target_end": 3, "cigar": [("D", 4)]}
    assert one("AAAA", "TTTT")["score"] == 0 and one("AAAA", "TTTT")["cigar"] == []
    assert one("acgu", "ACGT")["score"] == 20
    assert one("ACGT", "ACGT", traceback=False)["cigar"] is None
    with pytest.raises(ValueError):
        one("AC!", "AC")
    for bad in (lambda: Scoring(gap_open=1), lambda: Scoring.with_matrix([1, 2, 3], 2), lambda: align.matrix("nope"), lambda: Scoring(matrix="BLOSUM62").table("dna")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        align.align(F.lit("A"), F.lit("A"), kind="rna")
    for name in align.matrix_names():
        assert (align.matrix(f" {name.lower()} ") == align.matrix(name).T).all()


def plain_score(q, t, s, kind, local):
    tab, a, b = s.table(kind), align.encode(q, kind), align.encode(t, kind)
    m, n, low = len(a), len(b), -1e9
    (eo, ee), go, ge = s.ends(), s.gap_open, s.gap_extend
    H, E, G = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    H[0][0], best = 0.0, (0.0, 0, 0)
    for j in range(1, m + 1):
        H[0][j] = 0.0 if local else eo + ee * (j - 1)
    for i in range(1, n + 1):
        H[i][0] = 0.0 if local else eo + ee * (i - 1)
        for j in range(1, m + 1):
            do, de = (eo, ee) if not local and j == m else (go, ge)
            io, ie = (eo, ee) if not local and i == n else (go, ge)
            E[i][j] = max(H[i - 1][j] + do, E[i - 1][j] + de)
            G[i][j] = max(H[i][j - 1] + io, G[i][j - 1] + ie)
            H[i][j] = max(H[i - 1][j - 1] + tab[b[i - 1], a[j - 1]], E[i][j], G[i][j], 0.0 if local else low)
            if local and H[i][j] > best[0]:
                best = (H[i][j], i, j)
    return best if local else (H[n][m], n, m)


SCORINGS = [Scoring(), Scoring(2, -1, -2.0, -0.5, end_gap=False), Scoring(gap_open=-10, gap_extend=-0.5, end_gap=False), Scoring(3, -2, -4, -1), Scoring(1, -4, -6, -3)]


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("kind", ["dna", "protein"])
def test_alignments_against_plain_tables(local, kind, monkeypatch):
    rng = random.Random(5)
    letters = "ACGT" if kind == "dna" else "ARNDCQEGHILKMFPSTWYV"
    monkeypatch.setattr(align, "CELLS", 20_000)
    for s in SCORINGS:
        qs, ts = (["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(60)] for _ in range(2))
        for q, t, r, r0 in zip(qs, ts, align_batch(qs, ts, s, kind, local, True), align_batch(qs, ts, s, kind, local, False)):
            score, i, j = plain_score(q, t, s, kind, local)
            assert r["score"] == pytest.approx(score, abs=1e-4) and (r0["score"], r0["query_end"], r0["target_end"]) == (r["score"], r["query_end"], r["target_end"])
            if score > 0 or not local:
                assert (r["target_end"], r["query_end"]) == (i - 1, j - 1)
                assert align.rescore(q, t, r, s, kind, local) == pytest.approx(score, abs=1e-4)
                assert sum(k for o, k in r["cigar"] if o in "MI") == r["query_end"] - r["query_start"] + 1
                assert sum(k for o, k in r["cigar"] if o in "MD") == r["target_end"] - r["target_start"] + 1


@pytest.mark.parametrize("local", [True, False])
def test_pairs_too_large_for_a_whole_trace(local, monkeypatch):
    rng = random.Random(40)
    pairs = []
    for _ in range(25):
        a = "".join(rng.choices("ACGT", k=rng.randrange(1, 160)))
        b = "".join(x for x in a if rng.random() > 0.1) + "".join(rng.choices("ACGT", k=rng.randrange(30)))
        pairs.append((a, b or "A"))
    for scoring in SCORINGS:
        want = [align_batch([a], [b], scoring, "dna", local, True)[0] for a, b in pairs]
        monkeypatch.setattr(align, "CELLS", 50)
        assert [align_batch([a], [b], scoring, "dna", local, True)[0] for a, b in pairs] == want
        assert align_batch(*zip(*pairs), scoring, "dna", local, True) == want
        monkeypatch.undo()


def test_alignment_columns(spark):
    df = spark.createDataFrame([("ACGT", "ACT"), ("ACGT", None)], "query string, target string")
    got = align.align_pairs(df, local=False, traceback=True, scoring=Scoring(2, -1, -1, -1))
    r = got.select(align.cigar_text(F.col("aln.cigar")).alias("c"), align.alignment_diagram(F.col("query"), F.col("target"), F.col("aln")).alias("d"), "aln").collect()
    assert r[0].c == "2M1I1M" and r[0].d == "ACGT\n|| |\nAC-T" and r[1].aln is None or r[1].aln.score is None
    with pytest.raises(PySparkException, match="traceback"):
        align.align_pairs(df).select(align.aligned_strings(F.col("query"), F.col("target"), F.col("aln")).alias("s")).select("s.query", "s.target").collect()


# -- multiple alignments, distances, trees ------------------------------------


def rows_of(*seqs):
    return [(f"s{k}", s) for k, s in enumerate(seqs)]


def test_alignment_frames(spark):
    a = msa.Alignment.of(spark, rows_of("AC-GT", "ACAGT", "AC-GA"), "dna")
    assert a.width() == 5 and len(a) == 3 and a.ids() == ["s0", "s1", "s2"] and a[1] == ("s1", "ACAGT") and a[0:0].width() == 0
    assert a.diagram() == "s0  AC-GT\ns1  ACAGT\ns2  AC-GA\n    ** * "
    assert str(msa.Alignment.of(spark, rows_of("A.C", "A-C"), "dna")).endswith("* *")
    assert str(msa.Alignment.of(spark, rows_of("A-C"), "dna")).endswith("***")
    for bad in (lambda: msa.Alignment.of(spark, rows_of("AC", "A"), "dna"), lambda: msa.Alignment.of(spark, [], "dna"), lambda: msa.Alignment.of(spark, rows_of("A!"), "dna"), lambda: msa.msa(a.df, "dna", "other"), lambda: msa.check_args(["--outfmt=x"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        msa.find_clustalo()
    many = a.df.unionByName(a.df.withColumn("msa_id", F.lit(7).cast("long"))).repartition(3)
    assert {tuple(r) for r in msa.Alignment(many, "dna").conservation().groupBy("msa_id").agg(F.sum(F.col("conserved").cast("int"))).collect()} == {(0, 3), (7, 3)}
    assert list(msa.Alignment(many, "dna"))[4] == msa.Alignment(many, "dna")[4] == ("s1", "ACAGT")


def test_aligner_takes_record_frames_and_lists(spark, tmp_path):
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nwhile [ $# -gt 0 ]; do case $1 in -i) i=$2; shift;; -o) o=$2; shift;; esac; shift; done\nawk \'/^>/ {print; next} {s=$0; while (length(s) < 6) s = s "-"; print s}\' "$i" > "$o"\n')
    tool.chmod(0o755)
    own = [frames.record("a", "ACGT"), frames.record("b", "AC")]
    for given, kind in ((frames.RecordFrame.of(spark, own, "dna"), None), (own, "dna")):
        got = msa.msa(given, kind, binary=str(tool))
        assert list(got) == [("a", "ACGT--"), ("b", "AC----")] and got.kind == "dna"


def test_writers_take_records(spark, tmp_path):
    own = [frames.record("a", "ACGT", "x"), frames.record("b", "")]
    fasta.write_fasta(f"file://{tmp_path}/fa", iter(own), single=True)
    fastq.write_fastq(f"file://{tmp_path}/fq", own, "J", single=True)
    text = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part*")))
    assert text("fa") == ">a x\nACGT\n>b\n\n" and text("fq") == "@a x\nACGT\n+\nJJJJ\n@b\n\n+\n\n"
    for bad in ("ACGT", [{"id": "a"}], 5, ["a"]):
        with pytest.raises(TypeError):
            fasta.write_fasta(f"file://{tmp_path}/no", bad)


def test_distances_of_one_large_alignment_are_many_keys(spark, monkeypatch):
    monkeypatch.setattr(phylo, "BLOCK", 4)
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=12)) for _ in range(41)]
    got = phylo.pair_distances(msa.Alignment.of(spark, rows_of(*seqs), "dna"))
    assert got.count() == 41 * 40 // 2
    assert "msa_id#" in got._jdf.queryExecution().executedPlan().toString() and "hashpartitioning(msa_id" in got._jdf.queryExecution().executedPlan().toString()
    d = {(r.i, r.j): r.d for r in got.collect()}
    assert all(d[i, j] == pytest.approx(sum(a != b for a, b in zip(seqs[i], seqs[j])) / 12) for i, j in d)


def test_tied_joins_come_in_order():
    d = np.full((6, 6), 0.1 + 0.2) - np.diag([0.1 + 0.2] * 6)
    assert phylo.neighbour_joining(list("ABCDEF"), d).nodes[6].children == (0, 1)
    assert phylo.upgma(list("ABCDEF"), d).nodes[6].children == (0, 1)


def test_external_aligner(spark, tmp_path):
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nwhile [ $# -gt 0 ]; do case $1 in -i) i=$2; shift;; -o) o=$2; shift;; esac; shift; done\nawk \'/^>/ {print; next} {s=$0; while (length(s) < 6) s = s "-"; print s}\' "$i" > "$o"\n')
    tool.chmod(0o755)
    df = spark.createDataFrame([(m, k, f"r{k}", s) for m in (0, 1) for k, s in enumerate(["ACGT", "AC", "ACGTAA"])], "msa_id long, pos long, id string, seq string")
    got = msa.msa(df, "dna", binary=str(tool), extra_args=["--auto"])
    assert [tuple(r) for r in got.df.where("msa_id = 1").orderBy("pos").collect()] == [(1, 0, "r0", "ACGT--"), (1, 1, "r1", "AC----"), (1, 2, "r2", "ACGTAA")]


def distance(spark, model, *seqs, kind="dna"):
    return phylo.distance_matrix(msa.Alignment.of(spark, rows_of(*seqs), kind), model)


def test_distances(spark, monkeypatch):
    assert distance(spark, "p-distance", "ACGT", "ATAT").get(0, 1) == 0.5
    assert distance(spark, "p-distance", "AAAA", "AAAT", "AATT").to_list() == [0, 0.25, 0.5, 0.25, 0, 0.25, 0.5, 0.25, 0]
    assert distance(spark, "p-distance", "ACGT", "A-GT", "acg.").values.sum() == 0
    assert distance(spark, "jc69", "A" * 10, "A" * 9 + "T").get(0, 1) == pytest.approx(-0.75 * np.log(1 - 0.4 / 3))
    assert distance(spark, "k2p", "AAAA", "AAAG").get(0, 1) == pytest.approx(-0.5 * np.log(0.5))
    assert distance(spark, "k2p", "CCCC", "CCCT").get(0, 1) == distance(spark, "k2p", "AAAA", "AAAG").get(0, 1)
    assert distance(spark, "poisson", "ACDE", "ACDF", kind="protein").get(0, 1) == pytest.approx(-np.log(0.75))
    assert str(distance(spark, "jc69", "AC", "AC")).count("-") == 0
    for model, seqs, kind in (("jc69", ("AAAAA", "TTTTT"), "dna"), ("poisson", ("ACDE", "FGHI"), "protein"), ("p-distance", ("----", "ACGT"), "dna")):
        with pytest.raises(PySparkException):
            distance(spark, model, *seqs, kind=kind)
    for bad in (lambda: distance(spark, "p-distance", "AC"), lambda: distance(spark, "other", "AC", "AC"), lambda: distance(spark, "k2p", "AC", "AC", kind="protein")):
        with pytest.raises(ValueError):
            bad()
    rng = random.Random(1)
    seqs = ["".join(rng.choices("ACGTN-", k=30)) for _ in range(11)]
    want = distance(spark, "p-distance", *seqs).values
    monkeypatch.setattr(phylo, "BLOCK", 3)
    assert (distance(spark, "p-distance", *seqs).values == want).all()


def path_length(tree, a, b):
    def up(x):
        out, d = {}, 0.0
        while x is not None:
            out[x] = d
            d += tree.nodes[x].branch_length or 0.0
            x = tree.nodes[x].parent
        return out

    p, q = up(a), up(b)
    return min(p[x] + q[x] for x in p if x in q)


def test_trees(spark):
    labels = list("ABCD")
    d = np.array([[0, 2, 4, 4], [2, 0, 4, 4], [4, 4, 0, 2], [4, 4, 2, 0]], float)
    nj = phylo.build_tree(phylo.DistanceMatrix(labels, d))
    assert nj.num_nodes == 7 and nj.num_leaves == 4 and not nj.is_rooted and nj.leaf_labels() == labels
    assert all(path_length(nj, i, j) == pytest.approx(d[i, j]) for i in range(4) for j in range(4))
    up = phylo.build_tree(phylo.DistanceMatrix(labels, d), "upgma")
    assert up.to_newick() == "((A:1.000000,B:1.000000):1.000000,(C:1.000000,D:1.000000):1.000000);" and up.is_rooted
    assert up.ascii_diagram().splitlines()[0] == "node6" and "|   `-- B:1.000000" in up.ascii_diagram()
    two = phylo.build_tree(phylo.DistanceMatrix(["A B", "E'F"], [[0, 3], [3, 0]]))
    assert two.to_newick() == "('A B':1.500000,'E''F':1.500000);"
    assert phylo.quote("C:D") == "'C:D'" and phylo.quote("x") == "x"
    rng = np.random.default_rng(2)
    x = rng.random((9, 3))
    d = np.abs(x[:, None] - x[None]).sum(-1)
    deep = phylo.neighbour_joining([str(k) for k in range(9)], d)
    assert deep.num_nodes == 17 and all(n.branch_length is not None for n in deep.nodes[:-1])
    with pytest.raises(ValueError):
        phylo.build_tree(phylo.DistanceMatrix(["a"], [[0]]))
    with pytest.raises(ValueError):
        phylo.build_tree(phylo.DistanceMatrix(labels, np.zeros((4, 4))), "other")
    a = msa.Alignment.of(spark, rows_of("AAAA", "AAAT", "AATT", "ATTT"), "dna")
    both = a.df.unionByName(a.df.withColumn("msa_id", F.lit(5).cast("long")))
    got = phylo.build_trees(phylo.pair_distances(msa.Alignment(both, "dna")), "nj").orderBy("msa_id").collect()
    assert [r.msa_id for r in got] == [0, 5] and got[0].newick == got[1].newick == phylo.build_tree(phylo.distance_matrix(a)).to_newick()


# -- files --------------------------------------------------------------------


def put(tmp_path, text, name="f"):
    (tmp_path / name).write_bytes(text.encode())
    return f"file://{tmp_path}/{name}"


def listed(frame):
    return [(r.id, r.description, r.seq) for r in frame.df.orderBy("pos").collect()]


def test_fasta(spark, tmp_path):
    text = "\n \n>seq1 some desc\nAC\nG T\r\n\n>seq2\n>seq3\t x \nA\n"
    got = fasta.read_fasta(spark, put(tmp_path, text))
    assert got.kind == "dna" and listed(got) == [("seq1", "some desc", "ACGT"), ("seq2", None, ""), ("seq3", "x", "A")]
    assert listed(fasta.read_fasta_bytes(spark, text.encode())) == listed(got) and len(list(fasta.parse_bytes(text.encode()))) == 3
    assert fasta.read_fasta(spark, put(tmp_path, ">p\nMKV\n")).kind == "protein" and fasta.read_fasta(spark, put(tmp_path, ">p\nACGU\n")).kind == "rna"
    late = ">s\n" + ("ACGT" * 15 + "\n") * 17 + "RRR\n>p\nMKV\n"
    assert fasta.read_fasta(spark, put(tmp_path, late)).kind == "dna" and fasta.read_fasta(spark, put(tmp_path, late[:200] + "R" + late[200:])).kind == "protein"
    with pytest.raises(PySparkException, match="invalid"):
        listed(fasta.read_fasta(spark, put(tmp_path, ">s\nAC#\n"), "dna"))
    for bad in ("ACGT\n>s\nA\n", ">\nAC\n", ">s\nA\n> \nC\n"):
        with pytest.raises(FormatError):
            fasta.read_fasta(spark, put(tmp_path, bad))
        with pytest.raises(FormatError):
            list(fasta.parse_bytes(bad.encode()))
    fasta.write_fasta(f"file://{tmp_path}/out", RecordFrame.of(spark, [frames.record("seq1", "ACGT", "some\ndesc"), frames.record("e", ""), frames.record("b", "ACGTA")], "dna"), 2, single=True)
    assert next((tmp_path / "out").glob("part*")).read_text() == ">seq1 some desc\nAC\nGT\n>e\n\n>b\nAC\nGT\nA\n"
    with pytest.raises(TypeError):
        fasta.write_fasta("x", [1])


def test_fasta_splits(spark, tmp_path):
    rng = random.Random(4)
    want = [(f"s{k}", None, "".join(rng.choices("ACGT", k=rng.randrange(400)))) for k in range(3000)]
    path = put(tmp_path, "".join(f">{i}\n{s[:70]}\n{s[70:]}\n" for i, _, s in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = fasta.read_fasta(spark, path, "dna")
        assert got.df.rdd.getNumPartitions() > 4 and listed(got) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq(spark, tmp_path):
    text = "\n@seq1 some desc\nACGT\n+\n!!@!\n\n@seq2\nA\n+x\n#\n"
    got = fastq.read_fastq(spark, put(tmp_path, text))
    assert listed(got) == [("seq1", "some desc", "ACGT"), ("seq2", None, "A")] == listed(fastq.read_fastq_bytes(spark, text.encode()))
    for bad in ("@s\nAC\n+\n!\n", "@s\nAC\n-\n!!\n", ">s\nAC\n+\n!!\n", "@s\nAC\n", "@ \nA\n+\n!\n"):
        with pytest.raises(FormatError):
            list(fastq.parse_bytes(bad.encode()))
        with pytest.raises(PySparkException):
            listed(fastq.read_fastq(spark, put(tmp_path, bad, "bad"), "dna"))
    fastq.write_fastq(f"file://{tmp_path}/out", got, "J", single=True)
    assert next((tmp_path / "out").glob("part*")).read_text() == "@seq1 some desc\nACGT\n+\nJJJJ\n@seq2\nA\n+\nJ\n"
    for bad in ("", "ab", "\n", "é"):
        with pytest.raises(ValueError):
            fastq.write_fastq("x", got, bad)
    spark.dataSource.register(fastq.FastqSource)
    put(tmp_path, text, "f2")
    rows = spark.read.format("seqloom-fastq").option("paths", f"{tmp_path}/f2").load().orderBy("pos").collect()
    assert [(r.id, r.quality) for r in rows] == [("seq1", "!!@!"), ("seq2", "#")]


def test_fastq_splits(spark, tmp_path):
    rng = random.Random(8)
    own = []
    for k in range(900):
        seq = "".join(rng.choices("ACGT", k=rng.choice([0, 1, 7, 60, 150])))
        own.append((f"r{k}", None if k % 3 else f"about {k}", seq))
    blank = lambda k: "\n" * (k % 7 == 0)
    text = lambda rows, eol="\n": "".join(blank(k) + f"@{i}{' ' + d if d else ''}{eol}{s}{eol}+{eol}{'@' * len(s)}{eol}" for k, (i, d, s) in enumerate(rows))
    put(tmp_path, text(own[:600]), "a")
    put(tmp_path, text(own[600:], "\r\n").rstrip("\r\n") + ("\r\n" if not own[-1][2] else ""), "b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", "1733b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = fastq.read_fastq(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"], "dna")
            assert listed(got) == own, size
            with pytest.raises(Exception, match="cut short"):
                listed(fastq.read_fastq(spark, put(tmp_path, text(own)[:-2].rpartition("+")[0], "cut"), "dna"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv(spark, tmp_path):
    path = put(tmp_path, "id,seq,desc\ns1, AC GT ,first\ns2,TT,\n")
    assert tables.csv_columns(spark, path) == ["id", "seq", "desc"]
    assert listed(tables.read_csv(spark, path, "id", "seq", "desc")) == [("s1", "first", "ACGT"), ("s2", None, "TT")]
    assert listed(tables.read_csv(spark, path, 0, 1)) == [("s1", None, "ACGT"), ("s2", None, "TT")]
    bad = put(tmp_path, "id,seq\ns1,ACGT\ns2,AC#\ns3,TT\n")
    got = tables.read_csv(spark, bad, "id", "seq", alphabet="dna", on_error="skip")
    assert listed(got) == [("s1", None, "ACGT"), ("s3", None, "TT")]
    assert [tuple(r) for r in tables.skipped_rows(got).collect()] == [(2, "s2", "seq", "invalid character '#' at position 2")]
    with pytest.raises(PySparkException):
        listed(tables.read_csv(spark, bad, "id", "seq", alphabet="dna"))
    ragged = put(tmp_path, "id,seq,desc\ns1,ACGT\ns2,AC,x,more\n")
    assert listed(tables.read_csv(spark, ragged, "id", "seq")) == [("s1", None, "ACGT"), ("s2", None, "AC")]
    with pytest.raises(PySparkException, match="missing field"):
        listed(tables.read_csv(spark, ragged, "id", "seq", "desc"))
    for wrong in ("x", 9):
        with pytest.raises(ValueError):
            tables.read_csv(spark, path, wrong, "seq")
    with pytest.raises(ValueError):
        tables.read_csv(spark, path, "id", "seq", on_error="other")


def test_stream(spark, tmp_path):
    from seqloom.streaming import streams

    (tmp_path / "in").mkdir()
    put(tmp_path, ">a x\nAC\nGT\n>b\nA#\n", "in/one")
    put(tmp_path, ">c\nGG\n", "in/two")
    s = streams.with_function(streams.read_fasta_stream(spark, f"file://{tmp_path}/in", "dna", 1), "gc", nucleotide.gc_content)
    q = s.writeStream.format("memory").queryName("stream_test").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.id, r.description, r.seq, r.valid, r.gc) for r in spark.table("stream_test").collect()}
    assert got == {("a", "x", "ACGT", True, 0.5), ("b", None, "A#", False, 0.0), ("c", None, "GG", True, 1.0)}


def test_concat_by_group_is_concat_of_each(spark):
    f = SeqFrame.of(spark, BATCH, "dna")
    got = {r.g: r.seq for r in f.concat_by(F.col("pos") % 2).collect()}
    assert got == {k: f[k::2].concat() for k in (0, 1)}
