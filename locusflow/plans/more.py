"""Further registered queries: field decoding, exports and the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusflow.functions import genotypes as fg
from locusflow.operators import graph, intervals, numeric, paralogs, popgen, reads, samstats, sequences, snps
from locusflow.plans import proxies as p
from locusflow.plans.registry import EXPAND, GT, N, PARALOG_METRICS, SITES, barcodes, calls_gt, members, query, rounded
from locusflow.session import table
from locusflow.sources import sinks


@query(f"WITH {GT} SELECT site, sample, CAST(COALESCE(try_cast(substr(gt, 1, 1) AS INTEGER), -1) AS BIGINT) AS a0, CAST(COALESCE(try_cast(substr(gt, 3, 1) AS INTEGER), -1) AS BIGINT) AS a1, CASE WHEN dosage IS NULL THEN 'N' WHEN dosage = 0 THEN 'A' WHEN dosage = 2 THEN 'G' ELSE 'R' END AS base FROM v")
def genotype_decode(spark, sf):
    g = calls_gt(spark, sf).withColumn("_g", fg.gt_alleles("gt"))
    letter = lambda a: F.get(F.array(F.lit("A"), F.lit("G")), F.col(f"_g.{a}"))
    return rounded(g.select("site", "sample", F.coalesce("_g.a0", F.lit(-1)).alias("a0"), F.coalesce("_g.a1", F.lit(-1)).alias("a1"), fg.genotype_base(letter("a0"), letter("a1")).alias("base")))


@query(f"WITH {p.GENO} SELECT site, sample, CASE WHEN dosage IS NULL THEN 'N' WHEN dosage = 0 THEN 'C' WHEN dosage = 2 THEN 'T' ELSE 'Y' END AS base FROM g")
def dosage_bases(spark, sf):
    return p.geno(spark, sf).select("site", "sample", fg.dosage_base("dosage", F.lit("C"), F.lit("T")).alias("base"))


@query(f"WITH {p.SAM} SELECT qname, COUNT(*) AS records, CAST(SUM(clip) AS BIGINT) AS clip, CAST(SUM(nm) AS BIGINT) AS nm FROM sam GROUP BY 1")
def sam_fields(spark, sf):
    return p.sam(spark, sf).groupBy("qname").agg(F.count("*").alias("records"), F.sum(fg.softclip("cigar")).alias("clip"), F.sum(fg.edit_distance_tag("tags")).alias("nm"))


@query(f"WITH {p.SAM} SELECT qname, COUNT(*) AS reads, MIN(mapq) AS mapq, MAX(clip) AS clip, MAX(nm) AS nm, MAX(abs(tlen)) AS tlen FROM sam GROUP BY 1")
def sam_templates(spark, sf):
    return samstats.templates(p.sam(spark, sf))


@query(f"WITH {p.SAM} SELECT rname, COUNT(*) AS records FROM sam WHERE (flag & 2820) = 0 GROUP BY 1")
def structural_filter(spark, sf):
    return samstats.structural(p.sam(spark, sf)).groupBy("rname").agg(F.count("*").alias("records"))


@query(f'WITH {p.IVL} SELECT sample, chrom, GREATEST("start" - 10, 0) AS "start", "end" + 10 AS "end" FROM ivl')
def interval_pad(spark, sf):
    return intervals.pad(p.ivl(spark, sf))


@query("""WITH s AS (SELECT n_nationkey AS chrom, n_nationkey * 130 + 75 AS length FROM nation), w AS (SELECT chrom, length, unnest(generate_series(0, CAST(ceil(length / 50.0) AS BIGINT) - 1)) AS "window" FROM s)
    SELECT CAST(chrom AS BIGINT) AS chrom, "window", "window" * 50 AS wstart, LEAST("window" * 50 + 100, length) AS wend FROM w""")
def window_plan(spark, sf):
    k = F.col("n_nationkey").cast("long")
    return rounded(intervals.windows(table(spark, sf, "nation").select(k.alias("chrom"), (k * 130 + 75).alias("length")), 100, 50))


@query(f"""WITH {p.IVL}, w AS (SELECT i AS "window", i * 200 AS ws, i * 200 + 400 AS we FROM range(26) t(i)) SELECT "window", COUNT(*) AS loci, CAST(SUM(LEAST("end", we) - GREATEST("start", ws)) AS BIGINT) AS bases FROM ivl JOIN w ON "start" < we AND ws < "end" GROUP BY 1""")
def window_locus_overlap(spark, sf):
    w = spark.range(26).select(F.lit(0).cast("long").alias("chrom"), F.col("id").alias("window"), (F.col("id") * 200).alias("rstart"), (F.col("id") * 200 + 400).alias("rend"))
    j = intervals.range_join(p.ivl(spark, sf).withColumn("chrom", F.lit(0).cast("long")), w)
    return j.groupBy("window").agg(F.count("*").alias("loci"), F.sum(intervals.overlap_length(F.col("start"), F.col("end"), F.col("rstart"), F.col("rend"))).alias("bases"))


@query(f"WITH {PARALOG_METRICS} SELECT sample, rid, COUNT(*) AS sites, ROUND(SUM(dp_z), 6) AS z, ROUND(SUM(second), 6) AS second, ROUND(SUM(third), 6) AS third, CAST(SUM(n_alleles) AS BIGINT) AS alleles FROM q GROUP BY 1, 2")
def paralog_site_metrics(spark, sf):
    s = paralogs.allele_metrics(paralogs.depth_z(p.paralog_sites(spark, sf)), 3)
    return rounded(s.groupBy("sample", "rid").agg(F.count("*").alias("sites"), F.sum("dp_z").alias("z"), F.sum("second").alias("second"), F.sum("third").alias("third"), F.sum("n_alleles").alias("alleles")))


ALN = f"""WITH {p.ALIGNMENT},
    c AS (SELECT locus, pos, CASE WHEN sample % 2 = 0 THEN 'x' ELSE 'y' END AS pop, SUM(CASE base WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS a, SUM(CASE base WHEN 'C' THEN 2 WHEN 'Y' THEN 1 ELSE 0 END) AS c, SUM(CASE base WHEN 'G' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS g, SUM(CASE base WHEN 'T' THEN 2 WHEN 'Y' THEN 1 ELSE 0 END) AS t FROM sites WHERE base <> 'N' GROUP BY 1, 2, 3),
    d AS (SELECT *, a + c + g + t AS n, CASE WHEN a + c + g + t > 1 THEN (a + c + g + t) / (a + c + g + t - 1.0) * (1 - (a * a + c * c + g * g + t * t) / ((a + c + g + t) * (a + c + g + t) * 1.0)) END AS pi FROM c)"""


@query(ALN + ", j AS (SELECT 1 - (u.a * v.a + u.c * v.c + u.g * v.g + u.t * v.t) / (u.n * v.n * 1.0) AS dxy, COALESCE(u.pi, 0) AS p1, COALESCE(v.pi, 0) AS p2 FROM d u JOIN d v ON u.locus = v.locus AND u.pos = v.pos AND u.pop = 'x' AND v.pop = 'y') SELECT 'x' AS pop1, 'y' AS pop2, COUNT(*) AS sites, ROUND(AVG(dxy), 6) AS dxy, ROUND(SUM(dxy - (p1 + p2) / 2) / SUM(dxy), 6) AS fst FROM j")
def sequence_dxy_fst(spark, sf):
    s = sequences.sites(p.alignment(spark, sf)).select((F.col("locus") * 1000 + F.col("pos")).alias("site"), "sample", "base")
    pops = spark.range(6).select(F.col("id").alias("sample"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("pop"))
    return rounded(popgen.pairwise(popgen.counts_from_bases(s, pops)))


@query(f"WITH {p.ALIGNMENT}, full_ AS (SELECT l.locus, CAST(i AS BIGINT) AS sample FROM (SELECT DISTINCT locus FROM aln) l, range(7) t(i)) SELECT f.sample, f.locus, COALESCE(seq, repeat('N', 40)) AS seq FROM full_ f LEFT JOIN aln USING (locus, sample)")
def concat_padded(spark, sf):
    a = p.alignment(spark, sf)
    loci = a.groupBy("locus").agg(F.max(F.length("seq")).alias("length"))
    return sequences.concatenate(a, spark.range(7).select(F.col("id").alias("sample")), loci)


@query(f"WITH {p.ALIGNMENT}, r AS (SELECT *, COALESCE(MIN(pos) FILTER (WHERE n >= 3) OVER (PARTITION BY locus), 0) AS lo, COALESCE(MAX(pos) FILTER (WHERE n >= 3) OVER (PARTITION BY locus), 39) AS hi FROM (SELECT *, COUNT(*) FILTER (WHERE raw NOT IN ('N', '-')) OVER (PARTITION BY locus, pos) AS n FROM cells)) SELECT locus, sample, string_agg(raw, '' ORDER BY pos) AS seq FROM r WHERE pos BETWEEN lo AND hi GROUP BY 1, 2")
def locus_trimmed(spark, sf):
    a = p.alignment(spark, sf)
    return sequences.apply_trim(a, sequences.locus_trim(sequences.sites(a), 3)).select("locus", "sample", "seq")


@query(f"WITH {p.GENO}, {p.IMAP}, pc AS (SELECT site, pop, CAST(SUM(2 - dosage) AS BIGINT) AS r, CAST(SUM(dosage) AS BIGINT) AS a FROM g JOIN imap USING (sample) WHERE dosage IS NOT NULL GROUP BY 1, 2), s AS (SELECT DISTINCT site FROM pc), q AS (SELECT DISTINCT pop FROM imap) SELECT site, string_agg(COALESCE(r, 0) || ',' || COALESCE(a, 0), ' ' ORDER BY pop) AS value FROM s CROSS JOIN q LEFT JOIN pc USING (site, pop) GROUP BY site")
def treemix_export(spark, sf):
    lines = sinks.treemix_lines(snps.population_counts(p.geno(spark, sf), p.imap(spark)), ["p0", "p1", "p2"])
    return lines.where("line.o = 1").select("line.site", "value")


@query(f"""WITH {p.GENO}, b AS (SELECT s.site, i // 4 AS b, CAST(SUM((CASE WHEN dosage = 0 THEN 0 WHEN dosage = 1 THEN 2 WHEN dosage = 2 THEN 3 ELSE 1 END) * CAST(pow(4, i % 4) AS BIGINT)) AS BIGINT) AS v FROM (SELECT DISTINCT site FROM g) s CROSS JOIN range({N}) t(i) LEFT JOIN g ON g.site = s.site AND g.sample = i GROUP BY 1, 2)
    SELECT site, string_agg(printf('%02X', v), '' ORDER BY b) AS bytes FROM b GROUP BY site""")
def plink_export(spark, sf):
    return sinks.plink_rows(p.geno(spark, sf), N).select("site", F.hex("bytes").alias("bytes"))


@query(f"WITH {p.ALIGNMENT} SELECT locus, sample, '>' || sample || chr(10) || seq AS value FROM aln")
def fasta_export(spark, sf):
    a = p.alignment(spark, sf)
    return a.select("locus", "sample", F.concat(F.lit(">"), F.col("sample").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


@query(SITES + " SELECT site, dense_rank() OVER (ORDER BY scaff, pos // 500) - 1 AS block FROM st")
def physical_blocks(spark, sf):
    return snps.ld_blocks(p.sites(spark, sf), 500)


@query(f"WITH {p.READS}, c AS (SELECT substr(seq, 1, 6) AS barcode, COUNT(*) AS reads FROM reads GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM reads) SELECT barcode, reads FROM c, n WHERE reads >= GREATEST(2, 0.001 * n) ORDER BY reads DESC, barcode LIMIT 25")
def suspected_barcodes(spark, sf):
    r = p.reads(spark, sf).withColumn("status", F.lit("miss"))
    return reads.suspected_barcodes(r, 6, 0.001, 2)


@query(f"""WITH {p.READS}, b AS (SELECT read, substr(seq, 1, 1) AS barcode1, substr(seq, 2, 1) AS barcode2 FROM reads), c AS (SELECT * FROM (VALUES ('A', 'C', 's1'), ('T', 'C', 's2'), ('T', 'T', 's3'), ('T', 'T', 's4')) t(barcode1, barcode2, sample)),
    w AS (SELECT read, MIN(sample) AS sample, COUNT(DISTINCT sample) AS n FROM b JOIN c USING (barcode1, barcode2) GROUP BY 1) SELECT read, CASE WHEN n = 1 THEN sample END AS sample, CASE WHEN n = 1 THEN 'match' WHEN n > 1 THEN 'ambiguous' ELSE 'miss' END AS status FROM b LEFT JOIN w USING (read)""")
def barcode_combinatorial(spark, sf):
    r = p.reads(spark, sf)
    combos = spark.createDataFrame([("A", "C", "s1"), ("T", "C", "s2"), ("T", "T", "s3"), ("T", "T", "s4")], "barcode1 string, barcode2 string, sample string")
    part = lambda i: r.select("read", F.substring("seq", i, 1).alias("barcode"))
    return reads.demultiplex_pairs(part(1), part(2), combos)


@query(f"WITH {EXPAND}, l AS (SELECT candidate, MIN(distance) AS distance FROM cand GROUP BY 1), j AS (SELECT candidate, COUNT(DISTINCT sample) AS samples FROM cand JOIN l USING (candidate, distance) GROUP BY 1) SELECT * FROM j WHERE samples > 1")
def barcode_collisions(spark, sf):
    return reads.candidate_collisions(reads.expand_barcodes(barcodes(spark)))


@query(f"WITH {p.READS} SELECT read, len(list_filter(range(1, 9), lambda i: substr(a, i, 1) <> substr(b, i, 1))) AS distance FROM (SELECT read, substr(seq, 1, 8) AS a, substr(seq, 9, 8) AS b FROM reads WHERE length(seq) >= 16)")
def hamming_distance(spark, sf):
    r = p.reads(spark, sf).where(F.length("seq") >= 16)
    return r.select("read", fg.hamming(F.substring("seq", 1, 8), F.substring("seq", 9, 8)).cast("long").alias("distance"))


@query(f"WITH {p.READS} SELECT kmer, n FROM (SELECT substr(seq, 1, 6) AS kmer, COUNT(*) AS n FROM reads WHERE length(seq) >= 6 GROUP BY 1) ORDER BY n DESC, kmer LIMIT 10")
def top_kmers(spark, sf):
    k = reads.prefix_kmers(p.reads(spark, sf), (6,), (0,))
    return k.orderBy(F.desc("n"), "kmer").limit(10).select("kmer", "n")


@query(f"""WITH RECURSIVE {p.EDGES}, nb AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT a AS node, a AS hop FROM nb UNION SELECT walk.node, nb.b FROM walk JOIN nb ON walk.hop = nb.a), c AS (SELECT node, MIN(hop) AS component FROM walk GROUP BY node)
    SELECT component, node % {N} AS sample, node FROM c QUALIFY row_number() OVER (PARTITION BY component, node % {N} ORDER BY node % 5 DESC, node % 7 DESC, node) = 1""")
def sample_representatives(spark, sf):
    m = members(spark, sf).withColumns({"n_reads": F.col("node") % 5, "length": F.col("node") % 7})
    return graph.representatives(m)


@query()
def admixture_cv(spark, sf):
    """k and the cross-entropy of held-out genotypes under one membership matrix over all sites."""
    from locusflow.session import cut

    got = numeric.snmf(cut(numeric.matrix_blocks(p.geno(spark, sf), 512)), list(range(N)), [1, 2, 3], rounds=12)
    return spark.createDataFrame([(k, float(h)) for k, _, h in got], "k int, cross_entropy double")


@query()
def dapc_axes(spark, sf):
    rows = numeric.pca(p.geno(spark, sf), N, 5)[0].orderBy("sample").toPandas()
    x = rows.drop(columns="sample").to_numpy()
    labels, _ = numeric.kmeans(x, 3)
    axes = numeric.lda(x, labels, 2)
    return spark.createDataFrame([(int(s), int(k), float(a), float(b)) for s, k, (a, b) in zip(rows["sample"], labels, axes, strict=True)], "sample long, cluster int, ld1 double, ld2 double")
