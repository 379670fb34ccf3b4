"""Registered queries of the reference operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions import genotypes as fg
from locusflow.operators import dstat, graph, intervals, paralogs, popgen, reads, samstats, sequences, snps, variants
from locusflow.plans import proxies as p

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
N = p.SAMPLES


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "decimal(20,0)") else F.col(c) for c, t in df.dtypes])


# ---- SNP filters

MASKS = f"""
    WITH {p.GENO}, {p.IMAP},
    s AS (
        SELECT site, COUNT(dosage) AS called, CAST(COALESCE(SUM(dosage), 0) AS BIGINT) AS alt, COALESCE(round_even(AVG(dosage), 0), 0) AS common,
               CASE WHEN COUNT(*) < {N} THEN LEAST(0, MIN(COALESCE(dosage, 0))) ELSE MIN(COALESCE(dosage, 0)) END AS lo,
               CASE WHEN COUNT(*) < {N} THEN GREATEST(0, MAX(COALESCE(dosage, 0))) ELSE MAX(COALESCE(dosage, 0)) END AS hi,
               COUNT(dosage) FILTER (WHERE pop = 'p0') AS c0, COUNT(dosage) FILTER (WHERE pop = 'p1') AS c1
        FROM g JOIN imap USING (sample) GROUP BY site
    ),
    m AS (
        SELECT site, called, alt, false AS gap, false AS multiallelic, called < 6 AS coverage, c0 < 2 OR c1 < 2 AS population, false AS quality,
               lo = common AND hi = common AS invariant,
               COALESCE(LEAST(alt / (2.0 * NULLIF(called, 0)), 1 - alt / (2.0 * NULLIF(called, 0))) < 0.2, false) AS maf
        FROM s
    ),
    k AS (SELECT *, NOT (coverage OR population OR invariant OR maf) AS keep FROM m)"""


def masks(spark, sf, g=None):
    return snps.site_masks(p.geno(spark, sf) if g is None else g, N, 6, 0.2, p.imap(spark), {"p0": 2, "p1": 2})


@query(MASKS + " SELECT * FROM k")
def snp_site_masks(spark, sf):
    return masks(spark, sf)


@query(MASKS + """
    SELECT unnest(['total', 'gap', 'multiallelic', 'coverage', 'population', 'quality', 'invariant', 'maf', 'keep']) AS mask,
           unnest([COUNT(*), COUNT(*) FILTER (WHERE gap), COUNT(*) FILTER (WHERE multiallelic), COUNT(*) FILTER (WHERE coverage), COUNT(*) FILTER (WHERE population), COUNT(*) FILTER (WHERE quality), COUNT(*) FILTER (WHERE invariant), COUNT(*) FILTER (WHERE maf), COUNT(*) FILTER (WHERE keep)]) AS sites
    FROM k""")
def snp_filter_statistics(spark, sf):
    return snps.mask_counts(masks(spark, sf))


@query(f"WITH {p.GENO} SELECT site, COUNT(*) FILTER (WHERE dp >= 3 AND dosage IS NOT NULL) AS called, COUNT(*) FILTER (WHERE dp < 3 AND dosage IS NOT NULL) AS masked FROM g GROUP BY site")
def snp_depth_mask(spark, sf):
    g = p.geno(spark, sf).withColumn("was", F.col("dosage"))
    return snps.depth_mask(g, 3).groupBy("site").agg(F.count("dosage").alias("called"), (F.count("was") - F.count("dosage")).alias("masked"))


@query(MASKS + f"""
    , n AS (SELECT COUNT(*) AS n FROM k WHERE keep), c AS (SELECT sample, COUNT(*) AS c FROM g JOIN k USING (site) WHERE keep AND dosage IS NOT NULL GROUP BY 1)
    SELECT i AS sample, ROUND(CASE WHEN n > 0 THEN 1 - COALESCE(c, 0) / n ELSE 0.0 END, 6) AS missing FROM range({N}) t(i) CROSS JOIN n LEFT JOIN c ON c.sample = i""")
def sample_missing(spark, sf):
    g = p.geno(spark, sf)
    return rounded(snps.missing_by_sample(g, masks(spark, sf, g).where("keep"), p.samples(spark)))


@query(f"""
    WITH {p.GENO},
    s1 AS (SELECT site FROM g GROUP BY site HAVING COUNT(dosage) >= 6 AND COALESCE(round_even(AVG(dosage), 0), 0) IS NOT NULL AND NOT (CASE WHEN COUNT(*) < {N} THEN LEAST(0, MIN(COALESCE(dosage, 0))) ELSE MIN(COALESCE(dosage, 0)) END = COALESCE(round_even(AVG(dosage), 0), 0) AND CASE WHEN COUNT(*) < {N} THEN GREATEST(0, MAX(COALESCE(dosage, 0))) ELSE MAX(COALESCE(dosage, 0)) END = COALESCE(round_even(AVG(dosage), 0), 0))),
    n AS (SELECT COUNT(*) AS n FROM s1), c AS (SELECT sample, COUNT(*) AS c FROM g JOIN s1 USING (site) WHERE dosage IS NOT NULL GROUP BY 1),
    stay AS (SELECT i AS sample FROM range({N}) t(i) CROSS JOIN n LEFT JOIN c ON c.sample = i WHERE 1 - COALESCE(c, 0) / n <= 0.3),
    h AS (SELECT g.* FROM g JOIN stay USING (sample)), m AS (SELECT COUNT(*) AS m FROM stay)
    SELECT site, called, alt, NOT (called < 6 OR (lo = common AND hi = common)) AS keep FROM (
        SELECT site, COUNT(dosage) AS called, CAST(COALESCE(SUM(dosage), 0) AS BIGINT) AS alt, COALESCE(round_even(AVG(dosage), 0), 0) AS common,
               CASE WHEN COUNT(*) < MAX(m) THEN LEAST(0, MIN(COALESCE(dosage, 0))) ELSE MIN(COALESCE(dosage, 0)) END AS lo, CASE WHEN COUNT(*) < MAX(m) THEN GREATEST(0, MAX(COALESCE(dosage, 0))) ELSE MAX(COALESCE(dosage, 0)) END AS hi
        FROM h CROSS JOIN m GROUP BY site)""")
def sample_missing_prune(spark, sf):
    _, again = snps.prune_samples(p.geno(spark, sf), p.samples(spark), 0.3, min_cov=6)
    return again.select("site", "called", "alt", "keep")


BROWSER = f"""
    WITH {p.GENO},
    s AS (SELECT site, MIN(loc) AS loc, MIN(scaff) AS scaff, COUNT(dosage) AS called, COALESCE(SUM(dosage), 0) AS alt, MIN(dosage) AS lo, MAX(dosage) AS hi FROM g GROUP BY site),
    b AS (SELECT site, loc, scaff, called, 1 - called / {N} AS missing, LEAST(COALESCE(alt / (2.0 * NULLIF(called, 0)), 0), 1 - COALESCE(alt / (2.0 * NULLIF(called, 0)), 0)) AS maf, false AS bad_allele, COALESCE(lo = hi, true) AS invariant FROM s),
    k AS (SELECT *, NOT invariant AND called >= 6 AND missing <= 0.6 AND maf >= 0.2 AS pass FROM b)"""


def browser(spark, sf):
    return snps.browser_sites(p.geno(spark, sf), N, 0.5, 0.6, 0.2)


@query(BROWSER + " SELECT site, loc, scaff, called, ROUND(missing, 6) AS missing, ROUND(maf, 6) AS maf, bad_allele, invariant, pass FROM k")
def browser_site_filter(spark, sf):
    return rounded(browser(spark, sf))


@query(BROWSER + """
    SELECT unnest(['total', 'bad_allele', 'invariant', 'coverage', 'missing', 'maf', 'pass']) AS filter,
           unnest([COUNT(*), COUNT(*) FILTER (WHERE bad_allele), COUNT(*) FILTER (WHERE invariant), COUNT(*) FILTER (WHERE called < 6), COUNT(*) FILTER (WHERE missing > 0.6), COUNT(*) FILTER (WHERE maf < 0.2), COUNT(*) FILTER (WHERE pass)]) AS sites
    FROM k""")
def browser_filter_counts(spark, sf):
    return snps.browser_filter_counts(browser(spark, sf), 6, 0.6, 0.2)


@query(BROWSER + " SELECT loc, MIN(scaff) AS scaff, COUNT(*) AS sites, COUNT(*) FILTER (WHERE pass) AS passing, ROUND(AVG(called), 6) AS mean_called, ROUND(AVG(missing), 6) AS mean_missing FROM k GROUP BY loc")
def browser_locus_summary(spark, sf):
    return rounded(snps.browser_loci(browser(spark, sf)))


# ---- SNP exports and linkage blocks

POP = f"WITH {p.GENO}, {p.IMAP}, pc AS (SELECT site, pop, CAST(SUM(2 - dosage) AS BIGINT) AS ref, CAST(SUM(dosage) AS BIGINT) AS alt FROM g JOIN imap USING (sample) WHERE dosage IS NOT NULL GROUP BY 1, 2)"


@query(POP + " SELECT * FROM pc")
def pop_allele_counts(spark, sf):
    return snps.population_counts(p.geno(spark, sf), p.imap(spark))


@query(POP + " SELECT site, pop, ROUND(alt / (alt + ref), 6) AS freq FROM pc")
def pop_allele_freq(spark, sf):
    return rounded(snps.population_frequencies(p.geno(spark, sf), p.imap(spark)))


GRAM = f"""
    WITH {p.GENO}, mu AS (SELECT site, AVG(dosage) AS m FROM g WHERE dosage IS NOT NULL GROUP BY 1),
    x AS (SELECT site, sample, dosage - m AS x FROM g JOIN mu USING (site) WHERE dosage IS NOT NULL),
    gram AS (SELECT a.sample AS i, b.sample AS j, SUM(a.x * b.x) AS dot FROM x a JOIN x b ON a.site = b.site AND a.sample <= b.sample GROUP BY 1, 2)"""


@query(GRAM + " SELECT i, j, ROUND(dot, 6) AS dot FROM gram")
def gram_matrix(spark, sf):
    return rounded(snps.gram_matrix(p.geno(spark, sf), N))


@query(GRAM + ", n AS (SELECT COUNT(*) AS n FROM mu) SELECT g.i, g.j, ROUND(CASE WHEN g.i = g.j THEN 0.0 ELSE (a.dot + b.dot - 2 * g.dot) / n END, 6) AS d FROM gram g JOIN gram a ON a.i = g.i AND a.j = g.i JOIN gram b ON b.i = g.j AND b.j = g.j CROSS JOIN n")
def eems_dissimilarity(spark, sf):
    return rounded(snps.dissimilarity(p.geno(spark, sf), N))


SITES = f"WITH {p.GENO}, st AS (SELECT DISTINCT site, scaff, pos, loc FROM g)"


@query(SITES + " SELECT site, dense_rank() OVER (ORDER BY scaff, pos // 37) - 1 AS block FROM st")
def ld_block_ids(spark, sf):
    return snps.ld_blocks(p.sites(spark, sf), 37)


@query(SITES + " SELECT loc, arg_min(site, (site * 7919 + 13) % 1009 * 1000000 + site) AS site FROM st GROUP BY loc")
def one_snp_per_block(spark, sf):
    return snps.one_per_block(p.sites(spark, sf), "loc", (F.col("site") * 7919 + 13) % 1009)


@query(f"WITH {p.GENO} SELECT site, i AS sample, COALESCE(dosage, 0) AS dosage FROM (SELECT DISTINCT site FROM g) CROSS JOIN range({N}) t(i) LEFT JOIN g h USING (site) WHERE false UNION ALL SELECT s.site, i, COALESCE(h.dosage, 0) FROM (SELECT DISTINCT site FROM g) s CROSS JOIN range({N}) t(i) LEFT JOIN g h ON h.site = s.site AND h.sample = i")
def impute_zero(spark, sf):
    return snps.impute_zero(p.geno(spark, sf), p.sites(spark, sf), p.samples(spark)).select("site", "sample", "dosage")


@query()
def impute_sample(spark, sf):
    return snps.impute_sample(p.geno(spark, sf), p.sites(spark, sf), p.samples(spark), p.imap(spark))


@query()
def locus_bootstrap(spark, sf):
    return snps.bootstrap_loci(p.sites(spark, sf).select("loc"), 7)


# ---- population genetics

PI = "CASE WHEN n > 1 THEN n / (n - 1.0) * (1 - (a * a + b * b) / (n * n)) END"
COUNTS = f"""
    WITH {p.GENO}, {p.IMAP},
    c AS (SELECT *, a + b AS n FROM (SELECT site, pop, CAST(SUM(2 - dosage) AS DOUBLE) AS a, CAST(SUM(dosage) AS DOUBLE) AS b, COUNT(*) AS called, COUNT(*) FILTER (WHERE dosage = 1) AS het FROM g JOIN imap USING (sample) WHERE dosage IS NOT NULL GROUP BY 1, 2)),
    d AS (SELECT *, {PI} AS pi FROM c)"""


def counts(spark, sf):
    return popgen.counts_from_genotypes(p.geno(spark, sf), p.imap(spark))


@query(COUNTS + " SELECT site, pop, ROUND(pi, 6) AS pi FROM d")
def gene_diversity(spark, sf):
    return rounded(counts(spark, sf).select("site", "pop", popgen.diversity().alias("pi")))


@query(COUNTS + " SELECT pop, COUNT(*) AS sites, COUNT(pi) AS sites_pi, ROUND(AVG(pi), 6) AS pi, ROUND(AVG(het / called), 6) AS ho, COUNT(*) FILTER (WHERE a > 0 AND b > 0) AS segregating, ROUND(AVG(pi), 6) AS he, ROUND(1 - AVG(het / called) / AVG(pi), 6) AS fis FROM d GROUP BY pop")
def het_fis(spark, sf):
    return rounded(popgen.per_population(counts(spark, sf)))


@query(COUNTS + f", t AS (SELECT *, {PI} AS he FROM (SELECT site, SUM(a) AS a, SUM(b) AS b, SUM(n) AS n, SUM(called) AS called, SUM(het) AS het FROM c GROUP BY site)) SELECT COUNT(*) AS sites, ROUND(AVG(het / called), 6) AS ho, ROUND(AVG(he), 6) AS he, ROUND(1 - AVG(het / called) / AVG(he), 6) AS fit FROM t")
def global_fit(spark, sf):
    return rounded(popgen.global_fit(counts(spark, sf)))


@query(COUNTS + " SELECT pop, CAST(LEAST(a, b) AS BIGINT) AS mac, COUNT(*) AS sites FROM c WHERE a > 0 AND b > 0 GROUP BY 1, 2")
def folded_sfs(spark, sf):
    return rounded(popgen.folded_sfs(counts(spark, sf)))


@query(COUNTS + """
    , j AS (SELECT x.pop AS pop1, y.pop AS pop2, 1 - (x.a * y.a + x.b * y.b) / (x.n * y.n) AS dxy, COALESCE(x.pi, 0) AS p1, COALESCE(y.pi, 0) AS p2 FROM d x JOIN d y ON x.site = y.site AND x.pop < y.pop)
    SELECT pop1, pop2, COUNT(*) AS sites, ROUND(AVG(dxy), 6) AS dxy, ROUND(SUM(dxy - (p1 + p2) / 2) / SUM(dxy), 6) AS fst FROM j GROUP BY 1, 2""")
def dxy_fst(spark, sf):
    return rounded(popgen.pairwise(counts(spark, sf)))


K = popgen.tajima_constants(8)


@query(COUNTS + f"""
    , t AS (SELECT pop, COUNT(*) FILTER (WHERE called = 4) AS sites, COUNT(*) FILTER (WHERE called = 4 AND a > 0 AND b > 0) AS s, SUM(pi) FILTER (WHERE called = 4) AS pi FROM d GROUP BY pop)
    SELECT pop, sites, s AS segregating, ROUND(s / {K["a1"]!r} / NULLIF(sites, 0), 6) AS theta_w, ROUND(CASE WHEN {K["e1"]!r} * s + {K["e2"]!r} * s * (s - 1) > 0 THEN (pi - s / {K["a1"]!r}) / sqrt({K["e1"]!r} * s + {K["e2"]!r} * s * (s - 1)) END, 6) AS tajima_d FROM t""")
def theta_tajima(spark, sf):
    return rounded(popgen.theta_tajima(counts(spark, sf), {"p0": 4, "p1": 4, "p2": 4}))


@query(COUNTS + """
    , st AS (SELECT DISTINCT site, scaff, pos FROM g),
    w AS (SELECT site, scaff, unnest(generate_series(GREATEST(CAST(ceil((pos - 100 + 1) / 50.0) AS BIGINT), 0), pos // 50)) AS "window" FROM st)
    SELECT scaff, "window", pop, COUNT(*) AS sites, ROUND(AVG(pi), 6) AS pi FROM d JOIN w USING (site) GROUP BY 1, 2, 3""")
def sliding_window_pi(spark, sf):
    return rounded(popgen.window_pi(counts(spark, sf), p.sites(spark, sf), 100, 50))


@query(COUNTS + ', st AS (SELECT DISTINCT site, loc FROM g) SELECT loc // 5 AS "window", pop, COUNT(*) AS sites, ROUND(AVG(pi), 6) AS pi FROM d JOIN st USING (site) GROUP BY 1, 2')
def locus_window_pi(spark, sf):
    return rounded(popgen.locus_pi(counts(spark, sf), p.sites(spark, sf), 5))


# ---- introgression

ABBA = f"""
    WITH {p.GENO}, f AS (SELECT site, substr('abco', CAST(sample % 4 AS BIGINT) + 1, 1) AS label, SUM(dosage) / (2.0 * COUNT(*)) AS f, COUNT(*) AS called FROM g WHERE dosage IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT site, MAX(f) FILTER (WHERE label = 'a') AS a, MAX(f) FILTER (WHERE label = 'b') AS b, MAX(f) FILTER (WHERE label = 'c') AS c, MAX(f) FILTER (WHERE label = 'o') AS o FROM f GROUP BY site HAVING COUNT(*) = 4),
    s AS (SELECT site, (1 - a) * b * c * (1 - o) + a * (1 - b) * (1 - c) * o AS abba, (1 - b) * a * c * (1 - o) + b * (1 - a) * (1 - c) * o AS baba, (1 - c) * b * a * (1 - o) + c * (1 - b) * (1 - a) * o AS bbaa FROM w),
    k AS (SELECT site // 10 // 5 AS block, COUNT(*) AS sites, SUM(abba) AS abba, SUM(baba) AS baba, SUM(bbaa) AS bbaa, (SUM(abba) - SUM(baba)) / NULLIF(SUM(abba) + SUM(baba), 0) AS d FROM s GROUP BY 1)"""


def patterns(spark, sf):
    return dstat.site_patterns(dstat.label_frequencies(p.geno(spark, sf), p.labels(spark)), ("a", "b", "c", "o"))


def blocks(spark, sf):
    return dstat.block_sums(patterns(spark, sf), dstat.locus_blocks(p.sites(spark, sf), 5))


@query(ABBA + " SELECT site, label, ROUND(f, 6) AS freq, called FROM f")
def label_frequencies(spark, sf):
    return rounded(dstat.label_frequencies(p.geno(spark, sf), p.labels(spark)))


@query(ABBA + " SELECT COUNT(*) AS sites, ROUND(SUM(abba), 10) AS abba, ROUND(SUM(baba), 10) AS baba, ROUND(SUM(bbaa), 10) AS bbaa, ROUND((SUM(abba) - SUM(baba)) / (SUM(abba) + SUM(baba)), 10) AS d FROM s")
def abba_baba(spark, sf):
    return rounded(dstat.d_statistic(patterns(spark, sf)), 10)  # sums of dyadic fractions: at 6 digits they can end in a tie


@query(ABBA + " SELECT block, sites, ROUND(abba, 10) AS abba, ROUND(baba, 10) AS baba, ROUND(bbaa, 10) AS bbaa, ROUND(d, 10) AS d FROM k")
def abba_baba_blocks(spark, sf):
    return rounded(blocks(spark, sf), 10)  # sums of dyadic fractions: at 6 digits they can end in a tie


@query(ABBA + """
    , t AS (SELECT SUM(abba - baba) AS nn, SUM(abba + baba) AS dd FROM k), e AS (SELECT (nn - (abba - baba)) / NULLIF(dd - (abba + baba), 0) AS t, nn, dd FROM k, t),
    r AS (SELECT COUNT(t) AS n, MAX(nn) / MAX(dd) AS d, sqrt((COUNT(t) - 1) * var_pop(t)) AS se FROM e)
    SELECT n, ROUND(d, 6) AS d, ROUND(se, 6) AS se, ROUND(d / se, 6) AS z, ROUND(d - 1.96 * se, 6) AS lo, ROUND(d + 1.96 * se, 6) AS hi FROM r""")
def dstat_jackknife(spark, sf):
    return rounded(dstat.jackknife(blocks(spark, sf), p_value=False))


@query()
def dstat_jackknife_p(spark, sf):
    return dstat.jackknife(blocks(spark, sf))


@query()
def dstat_bootstrap(spark, sf):
    loci = dstat.block_sums(patterns(spark, sf), p.sites(spark, sf).select("site", F.col("loc").alias("block"))).withColumnRenamed("block", "loc")
    return dstat.bootstrap(loci, 200)


@query(ABBA + """
    , v AS (SELECT block, sign(ROUND(COALESCE(d, 0), 12)) AS s FROM k), u AS (SELECT *, CASE WHEN s = lag(s) OVER (ORDER BY block) THEN 0 ELSE 1 END AS new FROM v),
    x AS (SELECT *, SUM(new) OVER (ORDER BY block) AS run FROM u), y AS (SELECT *, lag(s) OVER (ORDER BY block) AS b FROM v WHERE s <> 0)
    SELECT COALESCE((SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM x WHERE s <> 0 GROUP BY run)), 0) AS longest, (SELECT COUNT(*) FROM y WHERE s <> b) AS switches""")
def block_sign_runs(spark, sf):
    return rounded(dstat.sign_runs(blocks(spark, sf)))


FB = "(SELECT n_nationkey % 2 AS branch, n_nationkey % 3 AS recipient, n_regionkey AS sister, n_nationkey AS descendant, CAST(n_nationkey * 37 % 50 AS DOUBLE) / 100 AS f FROM nation)"


@query(f"SELECT branch, recipient, ROUND(quantile_cont(f, 0.5), 6) AS value FROM (SELECT branch, recipient, sister, MIN(f) AS f FROM {FB} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def f_branch(spark, sf):
    from locusflow.session import table

    k = F.col("n_nationkey")
    fgs = table(spark, sf, "nation").select((k % 2).alias("branch"), (k % 3).alias("recipient"), F.col("n_regionkey").alias("sister"), k.alias("descendant"), ((k * 37 % 50).cast("double") / 100).alias("f"))
    return dstat.f_branch(fgs).select("branch", "recipient", F.round("value", 6).alias("value"))


# ---- intervals


def _merged(distance: int, strict: bool) -> str:
    cmp = ">=" if strict else ">"
    return f"""
    SELECT chrom, MIN("start") AS "start", MAX("end") AS "end", COUNT(*) AS n FROM (
        SELECT *, SUM(new) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isle FROM (
            SELECT *, CASE WHEN "start" {cmp} MAX("end") OVER w + {distance} OR MAX("end") OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ivl WINDOW w AS (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        )
    ) GROUP BY chrom, isle"""


@query(f"WITH {p.IVL} {_merged(3, False)}")
def interval_merge(spark, sf):
    return intervals.merge(p.ivl(spark, sf), 3)


@query(f"WITH {p.IVL} {_merged(0, True)} HAVING COUNT(*) >= 2")
def interval_merge_strict(spark, sf):
    return intervals.indel_clusters(p.ivl(spark, sf))


COVER = """ev AS (SELECT {by}, pos, SUM(delta) AS delta FROM (SELECT {by}, "start" AS pos, 1 AS delta FROM {t} UNION ALL SELECT {by}, "end", -1 FROM {t}) GROUP BY ALL HAVING SUM(delta) <> 0),
    sg AS (SELECT {by}, pos AS "start", lead(pos) OVER w AS "end", CAST(SUM(delta) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY {by} ORDER BY pos)),
    cov AS (SELECT * FROM sg WHERE "end" IS NOT NULL AND depth >= 1)"""


@query(f'WITH {p.IVL}, {COVER.format(by="chrom", t="ivl")} SELECT chrom, "start", "end", depth FROM cov WHERE depth >= 2')
def interval_coverage(spark, sf):
    return intervals.coverage(p.ivl(spark, sf), 2)


MULTI = f"""WITH {p.IVL},
    one AS (SELECT sample, chrom, MIN("start") AS "start", MAX("end") AS "end" FROM (
        SELECT *, SUM(new) OVER (PARTITION BY sample, chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isle FROM (
            SELECT *, CASE WHEN "start" > MAX("end") OVER w OR MAX("end") OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ivl WINDOW w AS (PARTITION BY sample, chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
        GROUP BY sample, chrom, isle),
    {COVER.format(by="chrom", t="one")},
    sh AS (SELECT * FROM cov WHERE depth >= 2)
    SELECT chrom, MIN("start") AS "start", MAX("end") AS "end", MIN(depth) AS n_samples FROM (
        SELECT *, SUM(new) OVER (PARTITION BY chrom ORDER BY "start") AS isle FROM (SELECT *, CASE WHEN "start" > lag("end") OVER (PARTITION BY chrom ORDER BY "start") + 2 THEN 1 ELSE 0 END AS new FROM sh)
    ) GROUP BY chrom, isle HAVING MAX("end") - MIN("start") >= 5"""


@query(MULTI)
def interval_multiinter(spark, sf):
    return rounded(intervals.multi_intersect(p.ivl(spark, sf), 2, 2, 5))


SUB = f"""WITH {p.IVL}, base AS (SELECT DISTINCT chrom, unnest(generate_series("start", "end" - 1)) AS x FROM ivl WHERE sample = 0),
    gone AS (SELECT DISTINCT chrom, unnest(generate_series("start", "end" - 1)) AS x FROM ivl WHERE sample = 1),
    r AS (SELECT chrom, x, x - row_number() OVER (PARTITION BY chrom ORDER BY x) AS k FROM (SELECT * FROM base EXCEPT SELECT * FROM gone))
    SELECT chrom, MIN(x) AS "start", MAX(x) + 1 AS "end" FROM r GROUP BY chrom, k"""


@query(SUB)
def interval_subtract(spark, sf):
    i = p.ivl(spark, sf)
    return intervals.subtract(i.where("sample = 0"), i.where("sample = 1"))


@query(f"""WITH {p.IVL}, r AS (SELECT chrom, x, x - row_number() OVER (PARTITION BY chrom ORDER BY x) AS k FROM (SELECT DISTINCT chrom, unnest(generate_series("start", "end" - 1)) AS x FROM ivl WHERE sample < 2))
    SELECT chrom, MIN(x) AS "start", MAX(x) + 1 AS "end" FROM r GROUP BY chrom, k""")
def interval_union(spark, sf):
    i = p.ivl(spark, sf)
    return intervals.union(i.where("sample = 0"), i.where("sample = 1"))


def pair_ivl(spark, sf):
    i = p.ivl(spark, sf)
    return i.where("sample = 0").drop("sample"), i.where("sample = 1").select("chrom", F.col("start").alias("rstart"), F.col("end").alias("rend"))


OVER = f'WITH {p.IVL}, a AS (SELECT * FROM ivl WHERE sample = 0), b AS (SELECT * FROM ivl WHERE sample = 1)'


@query(OVER + ' SELECT a.chrom, a."start", a."end", b."start" AS rstart, b."end" AS rend FROM a JOIN b ON a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end"')
def interval_range_join(spark, sf):
    return intervals.range_join(*pair_ivl(spark, sf)).select("chrom", "start", "end", "rstart", "rend")


@query(OVER + ' SELECT a.chrom, GREATEST(a."start", b."start") AS "start", LEAST(a."end", b."end") AS "end" FROM a JOIN b ON a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end"')
def interval_clip(spark, sf):
    return intervals.clip(*pair_ivl(spark, sf)).select("chrom", "start", "end")


@query(OVER + ' SELECT chrom, "start", "end" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end")')
def interval_anti_join(spark, sf):
    i = p.ivl(spark, sf)
    return intervals.anti_join(i.where("sample = 0").drop("sample"), i.where("sample = 1"))


@query(f'WITH {p.IVL}, {p.LOCI}, h AS (SELECT DISTINCT l.chrom, l."start", sample FROM loci l JOIN ivl v ON l.chrom = v.chrom AND l."start" < v."end" AND v."start" < l."end"), c AS (SELECT chrom, "start", COUNT(*) AS n FROM h GROUP BY 1, 2) SELECT n AS samples, COUNT(*) AS loci FROM c GROUP BY 1')
def interval_semi_occupancy(spark, sf):
    i = p.ivl(spark, sf).select("sample", "chrom", F.col("start").alias("rstart"), F.col("end").alias("rend"))
    j = intervals.range_join(p.loci(spark, sf), i)
    return j.groupBy("chrom", "start").agg(F.count_distinct("sample").alias("samples")).groupBy("samples").agg(F.count("*").alias("loci"))


@query(f"""WITH {p.IVL}, {p.LOCI}, {COVER.format(by="chrom", t="ivl")}
    SELECT l.chrom, l."start", l."end", ROUND(COALESCE(SUM((LEAST(l."end", c."end") - GREATEST(l."start", c."start")) * depth), 0) / (l."end" - l."start"), 6) AS mean_depth
    FROM loci l LEFT JOIN cov c ON l.chrom = c.chrom AND l."start" < c."end" AND c."start" < l."end" GROUP BY 1, 2, 3""")
def interval_depth_summary(spark, sf):
    return rounded(intervals.depth_in_loci(p.loci(spark, sf), intervals.coverage(p.ivl(spark, sf))))


@query(f"""WITH {p.IVL}, {p.LOCI}, {COVER.format(by="chrom", t="ivl")}, x AS (SELECT chrom, unnest(generate_series("start", "end" - 1)) AS x FROM loci EXCEPT SELECT chrom, unnest(generate_series("start", "end" - 1)) FROM cov WHERE depth >= 2),
    r AS (SELECT chrom, x, x - row_number() OVER (PARTITION BY chrom ORDER BY x) AS k FROM x) SELECT chrom, MIN(x) AS "start", MAX(x) + 1 AS "end" FROM r GROUP BY chrom, k""")
def low_depth_mask(spark, sf):
    return intervals.low_depth_mask(p.loci(spark, sf), intervals.coverage(p.ivl(spark, sf)), 2)


@query(f'WITH {p.LOCI}, pt AS (SELECT l_partkey % 5 AS chrom, l_orderkey * 10 AS pos FROM lineitem) SELECT pt.chrom, l."start" AS istart, COUNT(*) AS points, CAST(SUM(pos - l."start") AS BIGINT) AS places FROM pt JOIN loci l ON pt.chrom = l.chrom AND pos >= l."start" AND pos < l."end" GROUP BY 1, 2')
def point_in_interval(spark, sf):
    from locusflow.session import table

    pts = table(spark, sf, "lineitem").select((F.col("l_partkey") % 5).alias("chrom"), (F.col("l_orderkey") * 10).alias("pos"))
    lo = p.loci(spark, sf).select("chrom", F.col("start").alias("istart"), F.col("end").alias("iend"))
    return intervals.point_in_interval(pts, lo).groupBy("chrom", "istart").agg(F.count("*").alias("points"), F.sum(F.col("pos") - F.col("istart")).alias("places"))


# ---- paralogs

PARALOG_METRICS = p.PARALOG + """,
    z AS (SELECT sample, AVG(ln(1 + dp)) AS m, COALESCE(stddev_samp(ln(1 + dp)), 1) AS s FROM ps GROUP BY 1),
    q AS (SELECT ps.*, (ln(1 + dp) - m) / GREATEST(s, 1e-12) AS dp_z, CASE WHEN dp > 0 THEN len(list_filter(ad, lambda x: x >= 3)) ELSE 0 END AS n_alleles, CASE WHEN dp > 0 THEN ad[2] / dp ELSE 0.0 END AS second, CASE WHEN dp > 0 THEN ad[3] / dp ELSE 0.0 END AS third FROM ps JOIN z USING (sample)),
    lm AS (SELECT sample, rid, COUNT(*) AS n_sites, MAX(dp) AS max_dp, MAX(abs(dp_z)) AS max_z, AVG(CASE WHEN het THEN 1 ELSE 0 END) AS het, COUNT(*) FILTER (WHERE third > 0.15) AS n_third, MAX(n_alleles) AS n_alleles FROM q GROUP BY 1, 2),
    lp AS (SELECT *, max_z > 4 AS fail_depth, n_third > 3 - 3 AS fail_third, het > 0.5 AS fail_het, n_alleles > 2 AS fail_alleles FROM lm),
    calls AS (SELECT sample, rid, true AS has_data, NOT (fail_depth OR fail_third OR fail_het OR fail_alleles) AS good FROM lp)"""


def metrics(spark, sf):
    s = paralogs.allele_metrics(paralogs.depth_z(p.paralog_sites(spark, sf)), 3)
    return paralogs.locus_metrics(s, 4.0, 0.15, 0.5)


def calls(spark, sf):
    return metrics(spark, sf).select("sample", "rid", F.lit(True).alias("has_data"), F.col("pass").alias("good"))


@query(f"WITH {PARALOG_METRICS} SELECT sample, rid, n_sites, max_dp, ROUND(max_z, 6) AS max_z, ROUND(het, 6) AS het, n_third, CAST(n_alleles AS BIGINT) AS n_alleles, fail_depth, fail_third, fail_het, fail_alleles, NOT (fail_depth OR fail_third OR fail_het OR fail_alleles) AS pass FROM lp")
def paralog_locus_metrics(spark, sf):
    return rounded(metrics(spark, sf))


REDUCE = "SELECT rid, COUNT(*) FILTER (WHERE has_data) AS n_data, COUNT(*) FILTER (WHERE has_data AND good) AS n_good, COUNT(*) FILTER (WHERE has_data AND NOT good) AS n_fail, COALESCE(COUNT(*) FILTER (WHERE has_data AND NOT good) / NULLIF(COUNT(*) FILTER (WHERE has_data), 0), 0) AS fail_fraction FROM calls"


@query(f"WITH {PARALOG_METRICS}, r AS ({REDUCE} GROUP BY rid) SELECT rid, n_data, n_good, n_fail, ROUND(fail_fraction, 6) AS fail_fraction, n_data >= 3 AND fail_fraction <= 0.9 AS keep FROM r")
def paralog_cross_sample(spark, sf):
    return rounded(paralogs.across_samples(calls(spark, sf), 0.9, 3))


@query(f"""WITH {PARALOG_METRICS}, a AS ({REDUCE} WHERE sample % 2 = 0 GROUP BY rid), b AS ({REDUCE.replace('SELECT rid,', 'SELECT rid + 5 AS rid,')} WHERE sample % 2 = 1 GROUP BY calls.rid)
    SELECT COALESCE(a.rid, b.rid) AS rid, COALESCE(a.n_data, 0) AS rad_data, COALESCE(a.n_fail, 0) AS rad_fail, COALESCE(b.n_data, 0) AS wgs_data, COALESCE(b.n_fail, 0) AS wgs_fail,
           COALESCE(a.n_data >= 1 AND a.fail_fraction <= 0.9, true) AND COALESCE(b.n_data >= 1 AND b.fail_fraction <= 0.9, true) AS keep FROM a FULL JOIN b ON a.rid = b.rid""")
def paralog_rad_wgs(spark, sf):
    c = calls(spark, sf)
    return rounded(paralogs.rad_wgs(paralogs.across_samples(c.where("sample % 2 = 0"), 0.9), paralogs.across_samples(c.where("sample % 2 = 1").withColumn("rid", F.col("rid") + 5), 0.9)))


@query("WITH r AS (SELECT l_partkey % 97 AS rid, COUNT(*) AS reads, COUNT(*) FILTER (WHERE l_linenumber * 6 >= 20) AS clipped FROM lineitem GROUP BY 1) SELECT i AS rid, COALESCE(reads, 0) AS reads, COALESCE(clipped, 0) AS clipped, ROUND(COALESCE(clipped / reads, 0), 6) AS fraction FROM range(120) t(i) LEFT JOIN r ON r.rid = i")
def softclip_fraction(spark, sf):
    from locusflow.session import table

    r = table(spark, sf, "lineitem").select((F.col("l_partkey") % 97).alias("rid"), (F.col("l_linenumber") * 6).alias("clip"))
    return rounded(paralogs.softclip_fraction(spark.range(120).select(F.col("id").alias("rid")), r, 20))


# ---- variant calls

GT = f"""{p.GENO}, v AS (
        SELECT site, sample, dosage, dp, site * 7 % 50 AS gq, CAST(site % 90 AS DOUBLE) AS qual, site * 3 % 11 AS ad0, sample * 5 % 9 AS ad1,
               CASE WHEN dosage IS NULL THEN './.' ELSE CASE WHEN dosage = 2 THEN '1' ELSE '0' END || '/' || CASE WHEN dosage >= 1 THEN '1' ELSE '0' END END AS gt FROM g)"""


def calls_gt(spark, sf):
    d = F.col("dosage")
    gt = F.when(d.isNull(), "./.").otherwise(F.concat(F.when(d == 2, "1").otherwise("0"), F.lit("/"), F.when(d >= 1, "1").otherwise("0")))
    s = F.col("site")
    return p.geno(spark, sf).select("site", "sample", "dosage", "dp", (s * 7 % 50).alias("gq"), (s % 90).cast("double").alias("qual"), (s * 3 % 11).alias("ad0"), (F.col("sample") * 5 % 9).alias("ad1"), gt.alias("gt"))


@query(f"WITH {GT} SELECT site, sample, CASE WHEN dp < 2 OR gq < 10 OR qual < 20 THEN './.' ELSE gt END AS gt, CASE WHEN qual < 20 THEN 'lowQual' ELSE 'PASS' END AS filter FROM v")
def vcf_genotype_filter(spark, sf):
    return variants.filter_genotypes(calls_gt(spark, sf), 2, 10, 20.0).select("site", "sample", "gt", "filter")


@query(f"WITH {GT}, t AS (SELECT site, CAST(COALESCE(SUM(dosage), 0) AS BIGINT) AS ac, 2 * COUNT(dosage) AS an, 1 - COUNT(dosage) / COUNT(*) AS f_missing FROM v GROUP BY site) SELECT site, ac, an, ROUND(ac / NULLIF(an, 0), 6) AS af, ROUND(LEAST(ac / NULLIF(an, 0), 1 - ac / NULLIF(an, 0)), 6) AS maf, ROUND(f_missing, 6) AS f_missing FROM t")
def vcf_site_tags(spark, sf):
    return rounded(variants.site_tags(calls_gt(spark, sf)))


@query(f"WITH {GT} SELECT site, sample, CASE WHEN dosage = 1 AND (ad0 / NULLIF(ad0 + ad1, 0) < 0.2 OR ad0 / NULLIF(ad0 + ad1, 0) > 0.8) THEN './.' ELSE gt END AS gt FROM v")
def allele_balance_mask(spark, sf):
    return variants.allele_balance(calls_gt(spark, sf)).select("site", "sample", "gt")


@query(f"WITH {GT}, s AS (SELECT site, bool_or(dosage > 0 AND sample % 2 = 0) AS r, bool_or(dosage > 0 AND sample % 2 = 1) AS w FROM v GROUP BY site) SELECT CASE WHEN r AND w THEN 'both' WHEN r THEN 'rad' WHEN w THEN 'wgs' ELSE 'none' END AS kind, COUNT(*) AS sites FROM s GROUP BY 1")
def variant_support(spark, sf):
    groups = p.samples(spark).withColumn("kind", F.when(F.col("sample") % 2 == 0, "rad").otherwise("wgs"))
    return variants.support(calls_gt(spark, sf), groups)


# ---- alignments

CLASSES = f"""WITH {p.ALIGNMENT},
    cp AS (SELECT locus, pos, unnest(CASE base WHEN 'R' THEN ['A', 'G'] WHEN 'Y' THEN ['C', 'T'] WHEN 'N' THEN CAST([] AS VARCHAR[]) ELSE [base] END) AS b FROM sites),
    n AS (SELECT locus, pos, b, COUNT(*) AS n FROM cp GROUP BY ALL), s AS (SELECT locus, pos, list_reverse_sort(list(n)) AS c FROM n GROUP BY 1, 2),
    h AS (SELECT locus, pos, COUNT(*) FILTER (WHERE base IN ('R', 'Y')) AS hets FROM sites GROUP BY 1, 2),
    k AS (SELECT locus, pos, COALESCE(c[2], 0) AS second, hets FROM h LEFT JOIN s USING (locus, pos))"""


@query(CLASSES + " SELECT locus, CAST(pos AS BIGINT) AS pos, second, hets, CASE WHEN second = 0 THEN 'invariant' WHEN second = 1 THEN 'autapomorphy' ELSE 'pis' END AS kind FROM k")
def iupac_site_classes(spark, sf):
    return rounded(sequences.site_classes(sequences.sites(p.alignment(spark, sf))))


@query(f"WITH {p.ALIGNMENT} SELECT sample, COUNT(*) FILTER (WHERE base <> 'N') AS called, COUNT(*) FILTER (WHERE base = 'N') AS missing, COUNT(*) FILTER (WHERE base IN ('A', 'C', 'G', 'T')) AS hom, COUNT(*) FILTER (WHERE base IN ('R', 'Y')) AS het, ROUND(COUNT(*) FILTER (WHERE base IN ('R', 'Y')) / COUNT(*) FILTER (WHERE base <> 'N'), 6) AS ho FROM sites GROUP BY sample")
def sequence_sample_stats(spark, sf):
    return rounded(popgen.sample_stats(sequences.sites(p.alignment(spark, sf))))


@query(f"""WITH {p.ALIGNMENT},
    c AS (SELECT locus, pos, SUM(CASE base WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS a, SUM(CASE base WHEN 'C' THEN 2 WHEN 'Y' THEN 1 ELSE 0 END) AS c, SUM(CASE base WHEN 'G' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS g, SUM(CASE base WHEN 'T' THEN 2 WHEN 'Y' THEN 1 ELSE 0 END) AS t, COUNT(*) AS called, COUNT(*) FILTER (WHERE base IN ('R', 'Y')) AS het FROM sites WHERE base <> 'N' GROUP BY 1, 2),
    d AS (SELECT *, CASE WHEN a + c + g + t > 1 THEN (a + c + g + t) / (a + c + g + t - 1.0) * (1 - (a * a + c * c + g * g + t * t) / ((a + c + g + t) * (a + c + g + t) * 1.0)) END AS pi FROM c)
    SELECT 'all' AS pop, COUNT(*) AS sites, COUNT(pi) AS sites_pi, ROUND(AVG(pi), 6) AS pi, ROUND(AVG(het / called), 6) AS ho, COUNT(*) FILTER (WHERE CAST(a > 0 AS INT) + CAST(c > 0 AS INT) + CAST(g > 0 AS INT) + CAST(t > 0 AS INT) > 1) AS segregating, ROUND(AVG(pi), 6) AS he, ROUND(1 - AVG(het / called) / AVG(pi), 6) AS fis FROM d""")
def sequence_diversity(spark, sf):
    s = sequences.sites(p.alignment(spark, sf)).select((F.col("locus") * 1000 + F.col("pos")).alias("site"), "sample", "base")
    return rounded(popgen.per_population(popgen.counts_from_bases(s, spark.range(6).select(F.col("id").alias("sample"), F.lit("all").alias("pop")))))


@query(f"WITH {p.ALIGNMENT}, c AS (SELECT locus, pos, COUNT(*) FILTER (WHERE base <> 'N') AS n FROM sites GROUP BY 1, 2) SELECT locus, CAST(COALESCE(MIN(pos) FILTER (WHERE n >= 3), MIN(pos)) AS BIGINT) AS first, CAST(COALESCE(MAX(pos) FILTER (WHERE n >= 3), MAX(pos)) AS BIGINT) AS last FROM c GROUP BY locus")
def locus_trim(spark, sf):
    return rounded(sequences.locus_trim(sequences.sites(p.alignment(spark, sf)), 3))


ROWS = f"""WITH {p.ALIGNMENT}, r AS (SELECT locus, sample, seq, length(regexp_replace(seq, '[N-]', '', 'g')) AS observed, length(regexp_replace(seq, '[^RYSWKM]', '', 'g')) AS het FROM aln)"""


@query(ROWS + ", m AS (SELECT *, observed < 0.85 * 40 OR COALESCE(het / NULLIF(observed, 0), 0) > 0.12 AS masked FROM r) SELECT locus, sample, observed, het, masked, CASE WHEN masked THEN repeat('N', 40) ELSE seq END AS seq FROM m")
def locus_row_masks(spark, sf):
    return rounded(sequences.row_masks(p.alignment(spark, sf), 0.85, 0.12).select("locus", "sample", "observed", "het", "masked", "seq"))


@query(ROWS + ", s AS (SELECT locus, COUNT(*) FILTER (WHERE observed > 0) AS samples, MAX(length(seq)) AS length, COUNT(*) FILTER (WHERE observed > 0 AND 1 - observed / 40 <= 0.15) AS whole FROM r GROUP BY locus) SELECT locus, samples, length, CASE WHEN samples < 2 THEN 'samples' WHEN whole < 2 THEN 'missing' WHEN length < 30 THEN 'length' END AS reason FROM s")
def seqex_filter(spark, sf):
    return rounded(sequences.filter_loci(p.alignment(spark, sf), 2, 0.15, 30))


@query("WITH l AS (SELECT o_orderkey AS locus, o_custkey % 400 AS length FROM (SELECT o_orderkey, MIN(o_custkey) AS o_custkey FROM orders GROUP BY 1)) SELECT locus, CAST(SUM(length) OVER (ORDER BY locus) - length + 1 AS BIGINT) AS \"start\", CAST(SUM(length) OVER (ORDER BY locus) AS BIGINT) AS \"end\" FROM l")
def concat_partitions(spark, sf):
    from locusflow.session import table

    o = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("locus")).agg((F.min("o_custkey") % 400).alias("length"))
    return sequences.concatenation(o)


@query(ROWS + " SELECT sample, COUNT(*) FILTER (WHERE observed > 0) AS loci, CAST(SUM(observed) AS BIGINT) AS bases FROM r GROUP BY sample")
def seqex_occupancy(spark, sf):
    return rounded(sequences.occupancy(p.alignment(spark, sf)))


@query(f"WITH {p.ALIGNMENT}, n AS (SELECT locus, pos, base, COUNT(*) AS n FROM sites WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL), t AS (SELECT locus, pos, base FROM n QUALIFY row_number() OVER (PARTITION BY locus, pos ORDER BY n DESC, base) = 1) SELECT locus, string_agg(base, '' ORDER BY pos) AS seq FROM t GROUP BY locus")
def majority_consensus(spark, sf):
    return sequences.consensus(sequences.sites(p.alignment(spark, sf)))


# ---- reads


@query(f"WITH {p.READS}, o AS (SELECT CAST(o AS INTEGER) AS \"offset\", CAST(k AS INTEGER) AS k FROM range(2) a(o), range(3, 11) b(k)) SELECT \"offset\", k, substr(seq, \"offset\" + 1, k) AS kmer, COUNT(*) AS n FROM reads, o WHERE length(seq) >= \"offset\" + k GROUP BY ALL")
def kmer_prefix_counts(spark, sf):
    return reads.prefix_kmers(p.reads(spark, sf))


BARCODES = [("s1", "ACGT"), ("s2", "TTGA"), ("s3", "CATC"), ("s4", "ATTA")]


def barcodes(spark):
    return spark.createDataFrame(BARCODES, "sample string, barcode string")


VALUES = ", ".join(f"('{a}', '{b}')" for a, b in BARCODES)
EXPAND = f"""bc AS (SELECT * FROM (VALUES {VALUES}) t(sample, barcode)),
    ex AS (SELECT sample, barcode, barcode AS candidate, 0 AS distance FROM bc UNION ALL SELECT sample, barcode, substr(barcode, 1, i - 1) || b || substr(barcode, i + 1), 1 FROM bc, range(1, 5) r(i), (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) v(b)),
    cand AS (SELECT sample, barcode, candidate, MIN(distance) AS distance FROM ex GROUP BY 1, 2, 3)"""


@query(f"WITH {EXPAND.replace('range(1, 5) r(i)', '(SELECT CAST(x AS BIGINT) AS i FROM range(1, 5) r(x))')} SELECT sample, barcode, candidate, CAST(distance AS BIGINT) AS distance FROM cand")
def barcode_expand(spark, sf):
    return rounded(reads.expand_barcodes(barcodes(spark)))


@query(f"""WITH {p.READS}, {EXPAND},
    pr AS (SELECT read, seq, CAST(s AS BIGINT) AS s FROM reads, range(2) t(s)),
    hit AS (SELECT read, sample, distance * 100 + s * 10 AS r FROM pr JOIN cand ON substr(seq, s + 1, 4) = candidate WHERE substr(seq, s + 5, 64) LIKE 'T%' OR substr(seq, s + 5, 64) LIKE 'CA%'),
    b AS (SELECT read, MIN(r) AS r FROM hit GROUP BY 1), w AS (SELECT read, MIN(sample) AS sample, COUNT(DISTINCT sample) AS n FROM hit JOIN b USING (read, r) GROUP BY 1)
    SELECT read, CASE WHEN n = 1 THEN sample END AS sample, CASE WHEN n = 1 THEN 'match' WHEN n > 1 THEN 'ambiguous' ELSE 'miss' END AS status FROM reads LEFT JOIN w USING (read)""")
def barcode_join(spark, sf):
    return reads.demultiplex(p.reads(spark, sf), reads.expand_barcodes(barcodes(spark)), ["T", "CA"]).select("read", "sample", "status")


@query(f"WITH {p.READS} SELECT read, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def revcomp(spark, sf):
    return p.reads(spark, sf).select("read", fg.revcomp("seq").alias("rc"))


@query(f"WITH {p.READS} SELECT seq, COUNT(*) AS size, MIN(read) AS read FROM reads GROUP BY 1 HAVING COUNT(*) >= 2")
def derep_min_size(spark, sf):
    return reads.dereplicate(p.reads(spark, sf), 2)


@query()
def motif_inference(spark, sf):
    found = reads.infer_motifs(reads.prefix_kmers(p.reads(spark, sf)))
    return spark.createDataFrame([(m,) for m in found], "motif string")


# ---- alignment records

FAILS = "COUNT(*) FILTER (WHERE mapq < 20) AS low_mapq, COUNT(*) FILTER (WHERE clip > 25) AS clip_fail, COUNT(*) FILTER (WHERE nm >= 50) AS nm_fail"


@query(f"WITH {p.SAM} SELECT COUNT(*) AS reads, {FAILS}, COUNT(*) FILTER (WHERE mapq >= 20 AND clip <= 25 AND nm < 50) AS passing, ROUND(AVG(mapq), 6) AS mapq_mean, ROUND(quantile_cont(mapq, 0.5), 6) AS mapq_median, ROUND(stddev_pop(mapq), 6) AS mapq_sd FROM sam")
def align_stats_single(spark, sf):
    return rounded(samstats.single_end(p.sam(spark, sf)))


@query(f"WITH {p.SAM}, t AS (SELECT qname, MIN(mapq) AS mapq, MAX(clip) AS clip, MAX(nm) AS nm, MAX(abs(tlen)) AS tlen FROM sam GROUP BY 1) SELECT COUNT(*) AS templates, {FAILS}, COUNT(*) FILTER (WHERE tlen > 1000) AS tlen_fail, COUNT(*) FILTER (WHERE mapq >= 20 AND clip <= 25 AND nm < 50 AND tlen <= 1000) AS passing, ROUND(AVG(mapq), 6) AS mapq_mean FROM t")
def align_stats_paired(spark, sf):
    return rounded(samstats.paired(p.sam(spark, sf), tlen=1000))


@query(f"WITH {p.SAM} SELECT rname, pos, CAST(flag AS BIGINT) AS flag, MAX(mapq) AS mapq FROM sam GROUP BY 1, 2, 3")
def markdup(spark, sf):
    return rounded(samstats.remove_duplicates(p.sam(spark, sf)).select("rname", "pos", "flag", "mapq"))


@query(f"WITH {p.SAM} SELECT mapq AS value, COUNT(*) AS n FROM sam GROUP BY 1")
def mapq_histogram(spark, sf):
    return samstats.histogram(p.sam(spark, sf), "mapq")


# ---- graph

CC = f"""WITH RECURSIVE {p.EDGES}, nb AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    walk AS (SELECT a AS node, a AS hop FROM nb UNION SELECT walk.node, nb.b FROM walk JOIN nb ON walk.hop = nb.a)"""


@query(CC + " SELECT node, MIN(hop) AS component FROM walk GROUP BY node")
def connected_components(spark, sf):
    return graph.connected_components(p.edges(spark, sf))


@query(f"WITH {p.EDGES}, h AS (SELECT src AS q, dst AS t, pid, 0.9 AS c FROM edges UNION ALL SELECT dst, src, (src * 3 % 101) / 100.0, 0.8 FROM edges) SELECT LEAST(q, t) AS src, GREATEST(q, t) AS dst, ROUND(MAX(pid), 6) AS pid, arg_max(c, pid * 100 + c) AS qcov FROM h GROUP BY 1, 2")
def edge_best(spark, sf):
    e = p.edges(spark, sf)
    h = e.select(F.col("src").alias("query"), F.col("dst").alias("target"), "pid", F.lit(0.9).alias("qcov")).unionByName(e.select(F.col("dst").alias("query"), F.col("src").alias("target"), ((F.col("src") * 3 % 101) / 100).alias("pid"), F.lit(0.8).alias("qcov")))
    return rounded(graph.best_edges(h))


def members(spark, sf):
    return graph.connected_components(p.edges(spark, sf)).withColumn("sample", F.col("node") % N)


@query(CC + f", c AS (SELECT node, MIN(hop) AS component FROM walk GROUP BY node), d AS (SELECT component, node % {N} AS sample, COUNT(*) AS n FROM c GROUP BY 1, 2) SELECT component, CAST(SUM(n) AS BIGINT) AS nodes, COUNT(*) AS samples, CAST(SUM(n - 1) AS BIGINT) AS burden, MAX(n) > 1 AS duplicated FROM d GROUP BY 1")
def component_dup_samples(spark, sf):
    return rounded(graph.duplicate_samples(members(spark, sf)))


@query()
def constrained_split(spark, sf):
    return graph.split_components(members(spark, sf), p.edges(spark, sf).withColumn("qcov", F.lit(1.0)), N)


@query(CC.replace("edges UNION SELECT dst, src FROM edges)", f"ed UNION SELECT dst, src FROM ed)").replace("nb AS", f"ed AS (SELECT * FROM edges WHERE pid >= 0.5 AND src % {N} = dst % {N}), nb AS", 1) + ", a AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT a.node, COALESCE(MIN(hop), a.node) AS rep FROM a LEFT JOIN walk ON walk.node = a.node GROUP BY a.node")
def same_sample_contraction(spark, sf):
    return graph.contract(members(spark, sf), p.edges(spark, sf), 0.5)


# ---- numerical methods


@query()
def pca_coords(spark, sf):
    from locusflow.operators import numeric

    return numeric.pca(p.geno(spark, sf), N)[0]


@query()
def kmeans_bic(spark, sf):
    from locusflow.operators import numeric

    rows = numeric.pca(p.geno(spark, sf), N, 4)[0].orderBy("sample").toPandas()
    return spark.createDataFrame(numeric.kmeans_bic(rows.drop(columns="sample").to_numpy(), range(1, 5)), "k int, bic double")


@query()
def stream_demux(spark, sf):
    from locusflow.streaming.demux import demux_once

    return demux_once(p.reads(spark, sf), reads.expand_barcodes(barcodes(spark)), ["T", "CA"])


from locusflow.plans import more, summaries  # noqa: E402,F401  register further queries
