import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import genotypes as fg
from locusflow.functions import trees
from locusflow.operators import denovo, dstat, graph, intervals, numeric, paralogs, popgen, reads, samstats, sequences, snps
from locusflow.operators.components import connected_components
from locusflow.plans import analyses, external
from locusflow.sources import results, sinks, text
from locusflow.sources.text import FormatError


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_genotype_fields(spark):
    r = one(spark, a=fg.gt_alleles(F.lit("0|12")), b=fg.gt_alleles(F.lit("./1")), c=fg.gt_alleles(F.lit("./1"), keep_half=True), d=fg.depth(F.lit("-3")), e=fg.site_quality(F.lit(".")), f=fg.allele_depths(F.lit("3,.")), g=fg.allele_depths(F.lit("3,4")), h=fg.genotype_base(F.lit("T"), F.lit("C")), i=fg.revcomp(F.lit("AACGRN")), j=fg.softclip(F.lit("5S30M20S")), k=fg.edit_distance_tag(F.lit("AS:i:1\tNM:i:7")), m=fg.hamming(F.lit("ACGT"), F.lit("AGGA")), n=fg.i7_index(F.lit("@x 1:N:0:ACGT+TTT")), o=fg.dosage_base(F.lit(1), F.lit("A"), F.lit("G")), p=fg.masked_gt(F.lit("0|1")))
    assert tuple(r.a) == (0, 12) and tuple(r.b) == (None, None) and tuple(r.c) == (None, 1)
    assert (r.d, r.f, r.g, r.h, r.i, r.j, r.k, r.m, r.n, r.o, r.p) == (0, None, [3, 4], "Y", "NYCGTT", 25, 7, 2, "ACGT", "R", ".|.") and math.isnan(r.e)


def brute_cover(rows_):
    c = {}
    for ch, s, e in rows_:
        for x in range(s, e):
            c[ch, x] = c.get((ch, x), 0) + 1
    return c


@pytest.mark.parametrize("tile", [7, 1 << 20])
def test_intervals_against_per_base_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(intervals, "TILE", tile)
    monkeypatch.setattr(intervals._running, "__defaults__", (tile,))
    rng = random.Random(1)
    a = [(rng.randrange(2), s := rng.randrange(60), s + rng.randrange(8)) for _ in range(40)]
    b = [(rng.randrange(2), s := rng.randrange(60), s + 1 + rng.randrange(8)) for _ in range(15)]
    A, B = (spark.createDataFrame(x, "chrom int, start int, end int") for x in (a, b))
    cov = brute_cover(a)
    got = {(r.chrom, x): r.depth for r in intervals.coverage(A).collect() for x in range(r.start, r.end)}
    assert got == cov
    cb = brute_cover(b)
    left = {(r.chrom, x) for r in intervals.subtract(A, B).collect() for x in range(r.start, r.end)}
    assert left == set(cov) - set(cb)
    want = sorted((*x, *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2])
    j = intervals.range_join(A.where("start < end"), B.withColumnsRenamed({"start": "rstart", "end": "rend"}), 4)
    assert sorted(tuple(r) for r in j.select("chrom", "start", "end", "rstart", "rend").collect()) == want
    merged = intervals.merge(A, 2, tile=tile).collect()
    assert sum(r.n for r in merged) == len(a)
    for x in merged:
        assert all(y is x or y.chrom != x.chrom or y.start > x.end + 2 or x.start > y.end + 2 for y in merged)


def test_interval_edges(spark):
    none = spark.createDataFrame([], "chrom int, start int, end int")
    assert intervals.merge(none).count() == intervals.coverage(none).count() == 0
    assert rows(intervals.callable_runs(spark.createDataFrame([("c", 10, "ACNNGTacn")], "chrom string, start0 int, seq string")), "start") == [("c", 10, 12), ("c", 14, 18)]
    w = intervals.windows(spark.createDataFrame([("c", 25)], "chrom string, length int"), 10, 10)
    assert rows(w, "window") == [("c", 0, 0, 10), ("c", 1, 10, 20), ("c", 2, 20, 25)]
    lo = spark.createDataFrame([("c", 0, 10), ("c", 20, 30)], "chrom string, istart int, iend int")
    pts = spark.createDataFrame([("c", 5), ("c", 15)], "chrom string, pos int")
    assert [tuple(r) for r in intervals.point_in_interval(pts, lo).select("pos", "istart").collect()] == [(5, 0)]
    with pytest.raises(Exception, match="outside"):
        intervals.point_in_interval(pts, lo, strict=True).collect()
    ok = intervals.point_in_interval(pts.where("pos = 5"), lo, strict=True)
    assert ok.count() == 1


def test_site_masks_null_rules(spark):
    # hom-alt with missing is kept, hom-ref with missing and all-missing are invariant, all-het is invariant
    d = {1: (2, None, 2), 2: (0, None, 0), 3: (None, None, None), 4: (1, 1, 1), 5: (0, 1, 2)}
    g = spark.createDataFrame([(s, i, x) for s, xs in d.items() for i, x in enumerate(xs)], "site int, sample int, dosage int")
    m = {r.site: r for r in snps.site_masks(g, 3, 1, 0.1).collect()}
    assert {s: m[s].invariant for s in m} == {1: False, 2: True, 3: True, 4: True, 5: False}
    assert not m[3].maf and m[3].coverage and m[5].keep
    frac = {r.site: r.coverage for r in snps.site_masks(g, 3, 0.9, 0).collect()}
    assert frac == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_four_by_four_alignment(spark):
    a = [(0, "s1", "AAAA"), (0, "s2", "ARAA"), (0, "s3", "GGAA"), (0, "s4", "GGAA")]
    seqs = spark.createDataFrame(a, "locus int, sample string, seq string")
    cells = sequences.sites(seqs)
    ho = {r.sample: r.ho for r in popgen.sample_stats(cells).collect()}
    assert ho == {"s1": 0, "s2": 0.25, "s3": 0, "s4": 0}
    pops = spark.createDataFrame([("s1", "p1"), ("s2", "p1"), ("s3", "p2"), ("s4", "p2")], "sample string, pop string")
    c = popgen.counts_from_bases(cells.withColumnRenamed("pos", "site"), pops)
    t = popgen.global_fit(c).first()
    assert t.sites == 4 and t.ho == 0.0625
    per = {r["pop"]: r for r in popgen.per_population(c).collect()}
    assert per["p2"].pi == 0 and per["p2"].fis is None
    pair = popgen.pairwise(c).first()
    assert pair.fst > 0.5
    assert {r["pop"] for r in popgen.folded_sfs(c).collect()} == {"p1"}


def test_tajima_constants():
    k = popgen.tajima_constants(10)
    assert abs(k["a1"] - 2.828968) < 1e-6 and abs(k["e1"] - 0.019061) < 1e-5 and abs(k["e2"] - 0.004949) < 1e-5


def test_sequence_filters(spark):
    s = spark.createDataFrame([(1, "a", "NNACGT"), (1, "b", "-CACGN"), (1, "c", "NNNNNN"), (2, "a", "NN"), (2, "b", "NN")], "locus int, sample string, seq string")
    assert rows(sequences.locus_trim(sequences.sites(s), 2), "locus") == [(1, 2, 4), (2, 0, 1)]
    kept, verdict = analyses.seqex(s, min_samples=2, trim=2)
    assert rows(verdict.select("locus", "reason"), "locus") == [(1, None), (2, "samples")]
    assert rows(kept.select("sample", "seq"), "sample") == [("a", "ACG"), ("b", "ACG"), ("c", "NNN")]
    assert rows(sequences.consensus(sequences.sites(s)), "locus") == [(1, "CACGT")]
    cat = sequences.concatenation(spark.createDataFrame([(1, 6), (2, 2), (5, 3)], "locus int, length int"), parts=2)
    assert rows(cat, "locus") == [(1, 1, 6), (2, 7, 8), (5, 9, 11)]


def test_paralog_reduce(spark):
    calls = spark.createDataFrame([("s1", "0-10", True, True), ("s1", "20-30", True, False), ("s2", "0-10", True, False), ("s2", "40-50", True, True), ("s2", "20-30", False, True)], "sample string, rid string, has_data boolean, good boolean")
    got = {r.rid: (r.n_data, r.n_fail, r.keep) for r in paralogs.across_samples(calls, 0.5).collect()}
    assert got == {"0-10": (2, 1, True), "20-30": (1, 1, False), "40-50": (1, 0, True)}


def test_alignment_stats(spark):
    a = spark.createDataFrame([("r1", 0, 30, "50M", "NM:i:1", 0), ("r2", 0, 10, "30M20S", "NM:i:55", 0)], "qname string, flag int, mapq int, cigar string, tags string, tlen int")
    r = samstats.single_end(a).first()
    assert (r.low_mapq, r.clip_fail, r.nm_fail, r.passing, r.mapq_mean, r.mapq_median) == (1, 0, 1, 1, 20, 20)


def test_demultiplexing(spark):
    bc = spark.createDataFrame([("s1", "ACGT"), ("s2", "TTGA")], "sample string, barcode string")
    cand = reads.expand_barcodes(bc, 1)
    r = spark.createDataFrame([(1, "ACGTTGCAGG"), (2, "GTTGATGCA"), (3, "ACGATGCAG"), (4, "GGGGGGGG"), (5, "ACGTGGGG")], "read int, seq string")
    got = {x.read: (x.sample, x.status) for x in reads.demultiplex(r, cand, ["TGCA"]).collect()}
    assert got == {1: ("s1", "match"), 2: ("s2", "match"), 3: ("s1", "match"), 4: (None, "miss"), 5: (None, "miss")}
    assert reads.candidate_collisions(reads.expand_barcodes(spark.createDataFrame([("a", "AC"), ("b", "AG")], "sample string, barcode string"))).count() > 0
    km = reads.prefix_kmers(spark.createDataFrame([(i, "TGCAG" + random.Random(i).choice("ACGT") * 1 + "".join(random.Random(i + 99).choices("ACGT", k=20))) for i in range(400)], "read int, seq string"))
    assert reads.infer_motifs(km) == ["TGCAG"]


def test_components_and_split(spark):
    rng = random.Random(2)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in e if a != b for x in (a, b)}
    members = spark.createDataFrame([(1, n, s) for n, s in ((1, "a"), (2, "b"), (3, "a"), (4, "b"))] + [(9, 9, "a"), (9, 10, "b")], "component long, node long, sample string")
    edges = spark.createDataFrame([(1, 2, 0.99, 1.0), (2, 3, 0.9, 1.0), (3, 4, 0.98, 1.0), (9, 10, 0.9, 1.0)], "src long, dst long, pid double, qcov double")
    parts = {r.node: r.part for r in graph.split_components(members, edges, 4).collect()}
    assert parts[1] == parts[2] and parts[3] == parts[4] and parts[1] != parts[3] and parts[9] == parts[10]
    tight = {r.node: r.component for r in graph.presplit(members.unionByName(spark.createDataFrame([(1, n, "c") for n in range(50, 90)], members.schema)), edges, 1).collect()}
    assert tight[1] == tight[2] and tight[3] == tight[4] and tight[1] != tight[3] and tight[60] == 60


def test_jackknife(spark):
    b = [(i, 10, float(5 + i % 3), float(3 + i % 2), 1.0) for i in range(12)]
    df = spark.createDataFrame(b, "block int, sites int, abba double, baba double, bbaa double")
    r = dstat.jackknife(df).first()
    n, d = np.array([x[2] - x[3] for x in b]), np.array([x[2] + x[3] for x in b])
    t = (n.sum() - n) / (d.sum() - d)
    se = math.sqrt((len(b) - 1) / len(b) * ((t - t.mean()) ** 2).sum())
    assert abs(r.d - n.sum() / d.sum()) < 1e-12 and abs(r.se - se) < 1e-12 and abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-12
    boot = dstat.bootstrap(df.withColumnRenamed("block", "loc"), 300).first()
    assert boot.lo < r.d < boot.hi


def test_trees():
    t = trees.parse_newick("(((a:1,b)x,c)[note],(o,'p q'));")
    assert t.tips == ["a", "b", "c", "o", "p q"]
    assert ("a", "b", "c", "o") in trees.rooted_quartets(t)
    assert all(q[3] in ("o", "p q") for q in trees.rooted_quartets(t))
    assert trees.polytomy(["a", "p q"]) == "(a,'p q');"
    with pytest.raises(ValueError):
        trees.parse_newick("((a,b)")


def test_numerical_methods(spark):
    rng = np.random.default_rng(3)
    m = np.vstack([rng.binomial(2, 0.2, (6, 200)), rng.binomial(2, 0.8, (6, 200))])
    g = spark.createDataFrame([(j, i, int(m[i, j])) for i in range(12) for j in range(200)], "site int, sample int, dosage int")
    coords, share = numeric.pca(g, 12)
    pc = [r.pc0 for r in coords.orderBy("sample").collect()]
    assert share[0] > 0.3 and (max(pc[:6]) < 0 < min(pc[6:]) or max(pc[6:]) < 0 < min(pc[:6]))
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(np.abs(pc), np.abs(u[:, 0] * s[0]), atol=1e-6)
    bic = dict(numeric.kmeans_bic(np.array(pc)[:, None], range(1, 4)))
    assert bic[2] < bic[1]
    cv = dict(numeric.admixture_cv(m, range(1, 3)))
    assert cv[2] < cv[1]
    full = snps.impute_sample(g.withColumn("dosage", F.when(F.col("site") % 5 != 0, F.col("dosage"))), g.select("site").distinct(), spark.range(12).select(F.col("id").cast("int").alias("sample")), spark.range(12).select(F.col("id").cast("int").alias("sample"), F.lit("p").alias("pop")))
    assert full.count() == 2400 and full.where("dosage is null or dosage < 0 or dosage > 2").count() == 0


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty
1\t10\t.\tA\tG\t60\tPASS\t.\tGT:DP\t0/1:5\t1|1:7
1\t25010\t.\tC\tT\t.\tPASS\t.\tDP:GT\t3:./1\t4:0/0
"""


def test_readers(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    v = text.vcf_calls(text.vcf(spark, put("a.vcf", VCF)))
    assert rows(v.select("pos", "sample", "a0", "a1", "dp", "base"), "pos", "sample") == [(9, "x", 0, 1, 5, "R"), (9, "y", 1, 1, 7, "G"), (25009, "x", None, None, 3, "N"), (25009, "y", 0, 0, 4, "C")]
    fq = text.fastq(spark, put("r_R1.fastq", "".join(f"@h{i}\nACGT{'A' * i}\n+\n@III{'I' * i}\n" for i in range(7)) + "@cut\nAC\n"))
    assert fq.count() == 7 and rows(fq.select("read", "seq", "qual"), "read")[2] == (2, "ACGTAA", "@IIIII")
    assert rows(text.fasta(spark, put("a.fa", ">c1 x\nacg\nT\n>c2\nNN>\n")), "name") == [("c1", "c1 x", "ACGT"), ("c2", "c2", "NN>")]
    assert rows(text.bed(spark, put("a.bed", "#x\nc\t1\t5\nc\t7\t9\n")).select("start", "rid"), "start") == [(1, "c:1-5"), (7, "c:7-9")]
    with pytest.raises(Exception, match="malformed"):
        text.bed(spark, put("b.bed", "c\tx\t5\n")).collect()
    pops, minima = text.imap(spark, put("imap", "# p:1 q:2\na p\nb q\n"))
    assert minima == {"p": 1, "q": 2} and pops.count() == 2
    with pytest.raises(text.FormatError):
        text.imap(spark, put("imap2", "a p\na q\n"))
    assert rows(text.barcodes(spark, put("bc", "a acgt\nb ttt gg\na ccc\n")), "sample") == [("a-technical-replicate-0", "ACGT", None), ("a-technical-replicate-1", "CCC", None), ("b", "TTT", "GG")]
    s = text.sam(spark, put("a.sam", "@SQ\tSN:c\tLN:9\nq\t0\tc\t5\t30\t4M\t=\t1\t0\tACGT\tIIII\tNM:i:2\tX:Z:y\nq\t256\tc\t5\t30\t4M\t=\t1\t0\tA\tI\n"), 0x100)
    assert [(r.pos, r.tags) for r in s.collect()] == [(5, "NM:i:2\tX:Z:y")]
    assert text.mate_of("/x/s1_R2.fastq.gz") == ("s1", 2) and text.mate_of("s1_R1_001.fq") == ("s1", 1) and text.mate_of("plain.fq") == ("plain", 0)
    assert text.match_populations({"p": ["a*"]}, ["a1", "b"]) == {"p": ["a1"]}
    assert text.region("c:1:5-9") == ("c:1", 5, 9)
    analyses.vcf_to_store(spark, str(tmp_path / "a.vcf"), str(tmp_path / "store"))
    assert rows(spark.read.parquet(str(tmp_path / "store/sites")).select("pos", "loc"), "pos") == [(9, 0), (25009, 1)]


def test_sinks(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, None), (0, 4, 2), (1, 1, 0)], "site int, sample int, dosage int")
    got = {r.site: bytes(r.bytes) for r in sinks.plink_rows(g, 5).collect()}
    assert got[0] == bytes([0b01111000, 0b00000011]) and got[1] == bytes([0b01010001, 0b00000001])
    seqs = spark.createDataFrame([("a", "ACGT"), ("bb", "AC-N")], "sample string, seq string")
    assert [r.value for r in sinks.phylip_lines(seqs).orderBy("line").collect()] == ["2 4", "a       ACGT", "bb      AC-N"]
    assert sinks.nexus_lines(seqs, 2).count() == 6
    t = spark.createDataFrame([(1, "p", 2, 0), (1, "q", 1, 1), (2, "q", 0, 2)], "site int, pop string, ref int, alt int")
    assert [r.value for r in sinks.treemix_lines(t, ["p", "q"]).orderBy("line").collect()] == ["p q", "2,0 1,1", "0,0 0,2"]
    sites = spark.createDataFrame([(0, 0, 9, 3, 4, "A", "G"), (1, 0, 12, 3, 7, "C", "T")], "site int, scaff int, pos int, loc int, loc_pos int, ref string, alt string")
    sinks.write_plink(g, sites, spark.createDataFrame([(i, f"s{i}") for i in range(5)], "sample int, name string"), str(tmp_path / "x"))
    assert (tmp_path / "x.bed").read_bytes() == b"\x6c\x1b\x01" + got[0] + got[1]
    assert (tmp_path / "x.bim").read_text().splitlines()[0] == "1\tloc3_pos5\t0\t10\tG\tA"
    m = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.5), (1, 1, 0.0)], "i int, j int, d double")
    assert [r.value for r in sinks.matrix_lines(m, [0, 1]).orderBy("line").collect()] == ["0.00000000 1.50000000", "1.50000000 0.00000000"]


def test_entry_points(spark):
    g = spark.createDataFrame([(s, i, (s + i) % 3, s // 4) for s in range(40) for i in range(8)], "site int, sample int, dosage int, loc int")
    view = analyses.snpex(g, spark.range(8).select(F.col("id").cast("int").alias("sample")), min_cov=4, unlinked=True)
    assert view.genotypes.select("site").distinct().count() == 10
    labels = spark.createDataFrame([(i, "abco"[i % 4]) for i in range(8)], "sample int, label string")
    t = analyses.baba(g, labels, dstat.locus_blocks(g.select("site", "loc").distinct(), 2), newick="(((a,b),c),o);")
    assert t.count() == 1 and t.first().p3 == "c"
    with pytest.raises(external.ExternalToolNeeded):
        external.run("trim")
    with pytest.raises(text.FormatError):
        analyses.snpex(g, spark.range(8).withColumnRenamed("id", "sample"), min_depth=3)


def test_results_of_other_programs(spark, tmp_path):
    good = '{"summary": {"before_filtering": {"total_reads": 10, "total_bases": 900},\n "after_filtering": {"total_reads": 8, "total_bases": 700}}, "filtering_result": {"low_quality_reads": 2}}'
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "bad.json").write_text('{"summary": 3')
    r = results.trim_reports(spark, str(tmp_path / "a.json")).first()
    assert (r.reads_before, r.reads_after, r.bases_after, r.low_quality_reads, r.too_short_reads) == (10, 8, 700, 2, None)
    with pytest.raises(FormatError):
        results.trim_reports(spark, str(tmp_path / "bad.json"))
    (tmp_path / "m.bim").write_text("1\trs1\t0\t5\tA\tG\n2\trs2\t0\t9\tC\tT\n")
    assert [(m.marker, m.pos) for m in results.markers(spark, str(tmp_path / "m.bim")).collect()] == [("rs1", 5), ("rs2", 9)]
    (tmp_path / "x.Q").write_text("0.25 0.75\n1 0\n")
    assert sorted(tuple(m) for m in results.membership(spark, str(tmp_path / "x.Q")).collect()) == [(0, 0, 0.25), (0, 1, 0.75), (1, 0, 1.0), (1, 1, 0.0)]
    (tmp_path / "y.Q").write_text("0.25 0.75\n1\n")
    with pytest.raises(FormatError):
        results.membership(spark, str(tmp_path / "y.Q"))


def test_species_tree_inputs(spark):
    seqs = spark.createDataFrame([(1, "b", "AC"), (1, "a", "AN"), (2, "a", "GGT"), (2, "z", "GGT")], "locus long, sample string, seq string")
    imap = spark.createDataFrame([("a", "p"), ("b", "q")], "sample string, pop string")
    blocks, names = results.species_tree_lines(seqs, imap)
    assert [b.value for b in blocks.orderBy("line").collect()] == ["2 2\np^a  AN\nq^b  AC\n", "1 3\np^a  GGT\n"]
    assert [n.value for n in names.orderBy("line").collect()] == ["a p", "b q"]
    assert "species&tree = 2 p q" in results.species_tree_control({"p": 1, "q": 1}, "(p,q);", 2, denovo.gamma_prior(0.001, 0.003), (2, 100))
    assert denovo.gamma_prior(0, 4) == (4.0, 2.0)
    draws = spark.createDataFrame([(0.02, 0.008, 2e-3, 2.0)], "tau_1 double, theta_1 double, mu double, gen double")
    r = denovo.scaled_posterior(draws, ["tau_1", "theta_1"]).first()
    assert (round(r.tau_1, 9), round(r.theta_1, 9)) == (20.0, 1.0)
