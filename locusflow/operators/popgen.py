"""Population-genetic statistics as aggregates over per-site, per-population allele counts.

``c``: site, pop, nA, nC, nG, nT (allele copies), called (samples), het (heterozygous samples). Genotype matrices and
alignments both come to this form once; every statistic is then a mergeable sum over sites.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.genotypes import base_copies, is_iupac_het

BASES = ("nA", "nC", "nG", "nT")


def counts_from_genotypes(g: DataFrame, imap: DataFrame) -> DataFrame:
    """Reference copies as nA, alternative as nC."""
    j = g.where("dosage is not null").join(F.broadcast(imap), "sample")
    return j.groupBy("site", "pop").agg(F.sum(2 - F.col("dosage")).alias("nA"), F.sum("dosage").alias("nC"), F.lit(0).cast("long").alias("nG"), F.lit(0).cast("long").alias("nT"), F.count("*").alias("called"), F.count_if(F.col("dosage") == 1).alias("het"))


def counts_from_bases(sites: DataFrame, imap: DataFrame) -> DataFrame:
    """From site, sample, base: a plain base is two copies, an IUPAC heterozygote one of each; anything else is missing."""
    j = sites.withColumn("_a", base_copies("base")).where(F.size("_a") == 2).join(F.broadcast(imap), "sample")
    n = lambda b: F.sum(F.when(F.col("_a")[0] == b, 1).otherwise(0) + F.when(F.col("_a")[1] == b, 1).otherwise(0))
    return j.groupBy("site", "pop").agg(*[n(b).alias(f"n{b}") for b in "ACGT"], F.count("*").alias("called"), F.count_if(is_iupac_het("base")).alias("het"))


def _total(prefix: str = "") -> Column:
    return sum((F.col(prefix + b) for b in BASES[1:]), F.col(prefix + BASES[0]))


def diversity(prefix: str = "") -> Column:
    """n/(n-1) (1 - sum p^2); null for one copy or none."""
    n = _total(prefix).cast("double")
    homo = sum((F.col(prefix + b) * F.col(prefix + b) for b in BASES[1:]), F.col(prefix + BASES[0]) * F.col(prefix + BASES[0]))
    return F.when(n > 1, n / F.nullif(n - 1, F.lit(0.0)) * (1 - homo / F.nullif(n * n, F.lit(0.0))))


def alleles() -> Column:
    """Number of different bases."""
    return sum(((F.col(b) > 0).cast("int") for b in BASES[1:]), (F.col(BASES[0]) > 0).cast("int"))


def minor() -> Column:
    """Copies of the rarer base of a biallelic site."""
    return F.when(alleles() == 2, F.array_min(F.filter(F.array(*BASES), lambda x: x > 0)))


def per_population(c: DataFrame) -> DataFrame:
    """pop, sites, sites_pi, pi, ho, he, fis, segregating. Means over sites where the statistic is defined; Fis is null unless He > 0."""
    s = c.where("called > 0").withColumn("pi", diversity()).withColumn("seg", (alleles() > 1).cast("int"))
    a = s.groupBy("pop").agg(F.count("*").alias("sites"), F.count("pi").alias("sites_pi"), F.avg("pi").alias("pi"), F.avg(F.col("het") / F.col("called")).alias("ho"), F.sum("seg").alias("segregating"))
    return a.withColumn("he", F.col("pi")).withColumn("fis", F.when(F.col("he") > 0, 1 - F.col("ho") / F.col("he")))


def global_fit(c: DataFrame) -> DataFrame:
    """One row: sites, ho, he, fit over all populations together."""
    t = c.groupBy("site").agg(*[F.sum(b).alias(b) for b in BASES], F.sum("called").alias("called"), F.sum("het").alias("het")).where("called > 0")
    a = t.agg(F.count("*").alias("sites"), F.avg(F.col("het") / F.col("called")).alias("ho"), F.avg(diversity()).alias("he"))
    return a.withColumn("fit", F.when(F.col("he") > 0, 1 - F.col("ho") / F.col("he")))


def folded_sfs(c: DataFrame) -> DataFrame:
    """pop, mac, sites: histogram of minor-allele counts of biallelic sites."""
    return c.withColumn("mac", minor()).where("mac is not null").groupBy("pop", "mac").agg(F.count("*").alias("sites"))


def pairwise(c: DataFrame) -> DataFrame:
    """pop1 < pop2, sites, dxy (mean), fst (Hudson, ratio of sums; undefined pi counts as 0)."""
    d = c.where("called > 0").withColumn("pi", diversity()).select("site", "pop", "pi", *BASES, _total().alias("n"))
    right = d.select("site", *[F.col(x).alias("r_" + x) for x in ("pop", "pi", *BASES, "n")])
    j = d.join(right, "site").where("pop < r_pop")
    dxy = 1 - sum((F.col(b) * F.col("r_" + b) for b in BASES[1:]), F.col("nA") * F.col("r_nA")) / (F.col("n") * F.col("r_n"))
    j = j.withColumn("dxy", dxy).withColumn("num", F.col("dxy") - (F.coalesce("pi", F.lit(0.0)) + F.coalesce("r_pi", F.lit(0.0))) / 2)
    return j.groupBy(F.col("pop").alias("pop1"), F.col("r_pop").alias("pop2")).agg(F.count("*").alias("sites"), F.avg("dxy").alias("dxy"), (F.sum("num") / F.nullif(F.sum("dxy"), F.lit(0.0))).alias("fst"))


def _harmonic(n: int) -> tuple[float, float]:
    return sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))


def tajima_constants(n: int) -> dict[str, float]:
    """Constants of Tajima (1989) for ``n`` chromosomes."""
    a1, a2 = _harmonic(n)
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1 = b1 - 1 / a1
    c2 = b2 - (n + 2) / (a1 * n) + a2 / a1**2
    return {"a1": a1, "e1": c1 / a1, "e2": c2 / (a1**2 + a2)}


def theta_tajima(c: DataFrame, sizes: dict) -> DataFrame:
    """pop, sites, segregating, theta_w (per site), tajima_d, over sites where all ``sizes[pop]`` samples are called."""
    out = None
    for pop, size in sorted(sizes.items()):
        s = c.where((F.col("pop") == pop) & (F.col("called") == size)).agg(F.count("*").alias("sites"), F.coalesce(F.sum((alleles() > 1).cast("int")), F.lit(0)).alias("segregating"), F.sum(diversity()).alias("pi"))
        if size < 1 or 2 * size < 2:
            continue
        k = tajima_constants(2 * size)
        S = F.col("segregating")
        var = k["e1"] * S + k["e2"] * S * (S - 1)
        s = s.select(F.lit(pop).alias("pop"), "sites", "segregating", (S / k["a1"] / F.nullif(F.col("sites"), F.lit(0))).alias("theta_w"), F.when(var > 0, (F.col("pi") - S / k["a1"]) / F.sqrt(var)).alias("tajima_d"))
        out = s if out is None else out.unionByName(s)
    return out


def sample_stats(sites: DataFrame) -> DataFrame:
    """sample, called, missing, hom, het, ho from site, sample, base."""
    het, hom = is_iupac_het("base"), F.upper("base").isin(*"ACGT")
    s = sites.groupBy("sample").agg(F.count("*").alias("total"), F.count_if(het | hom).alias("called"), F.count_if(hom).alias("hom"), F.count_if(het).alias("het"))
    return s.select("sample", "called", (F.col("total") - F.col("called")).alias("missing"), "hom", "het", F.coalesce(F.col("het") / F.nullif(F.col("called"), F.lit(0)), F.lit(0.0)).alias("ho"))


def window_pi(c: DataFrame, sites: DataFrame, size: int, step: int) -> DataFrame:
    """scaff, window, pop, sites, pi: sliding windows [k step, k step + size); a site falls into at most size/step of them. Empty windows are skipped."""
    first = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0))
    w = sites.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col("pos") / step).cast("long"))))
    return c.withColumn("pi", diversity()).join(w.select("site", "scaff", "window"), "site").groupBy("scaff", "window", "pop").agg(F.count("*").alias("sites"), F.avg("pi").alias("pi"))


def locus_pi(c: DataFrame, sites: DataFrame, loci_per_window: int) -> DataFrame:
    """window (dense locus number div the given count; loc must be dense), pop, sites, pi."""
    return c.withColumn("pi", diversity()).join(sites.select("site", "loc"), "site").groupBy(F.floor(F.col("loc") / loci_per_window).alias("window"), "pop").agg(F.count("*").alias("sites"), F.avg("pi").alias("pi"))


def normal_p(z: float) -> float:
    """Two-sided p of a z score."""
    return math.erfc(abs(z) / math.sqrt(2))
