"""Genotype and site filters on long variant calls: site, sample, gt (0/1 tokens), dp, gq, ad0, ad1, qual, alt0.. as needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.genotypes import gt_alleles


def filter_genotypes(v: DataFrame, min_dp: int, min_gq: int, min_qual: float | None = None) -> DataFrame:
    """Calls under a minimum become ./. ; sites under ``min_qual`` get filter lowQual and no calls."""
    low = (F.col("dp") < min_dp) | (F.col("gq") < min_gq)
    site = (F.col("qual") < min_qual) if min_qual is not None else F.lit(False)
    return v.withColumns({"gt": F.when(low | site, "./.").otherwise(F.col("gt")), "filter": F.when(site, "lowQual").otherwise("PASS")})


def site_tags(v: DataFrame) -> DataFrame:
    """site, ac, an, af, maf, f_missing recomputed from biallelic calls."""
    x = v.withColumn("_g", gt_alleles("gt"))
    one = lambda c: F.coalesce(F.col(f"_g.{c}"), F.lit(0))
    s = x.groupBy("site").agg(F.sum(one("a0") + one("a1")).cast("long").alias("ac"), (2 * F.count("_g.a0")).alias("an"), (1 - F.count("_g.a0") / F.count("*")).alias("f_missing"))
    s = s.withColumn("af", F.col("ac") / F.nullif(F.col("an"), F.lit(0)))
    return s.withColumn("maf", F.least("af", 1 - F.col("af"))).select("site", "ac", "an", "af", "maf", "f_missing")


def allele_balance(v: DataFrame, low: float = 0.2) -> DataFrame:
    """Heterozygous calls with a called allele's share of the depth under ``low`` or over 1 - ``low`` become ./. (ad0, ad1: depths of the called alleles)."""
    g = gt_alleles("gt")
    n = F.col("ad0") + F.col("ad1")
    f = F.col("ad0") / F.nullif(n, F.lit(0))
    bad = (g["a0"] != g["a1"]) & ((f < low) | (f > 1 - low))
    return v.withColumn("gt", F.when(F.coalesce(bad, F.lit(False)), "./.").otherwise(F.col("gt")))


def support(v: DataFrame, groups: DataFrame) -> DataFrame:
    """kind (both, rad, wgs, none), sites: whether any sample of a group has an alternative allele. ``groups``: sample, kind."""
    g = gt_alleles("gt")
    alt = F.coalesce((g["a0"] > 0) | (g["a1"] > 0), F.lit(False))
    s = v.join(F.broadcast(groups), "sample").groupBy("site").agg(F.max(alt & (F.col("kind") == "rad")).alias("rad"), F.max(alt & (F.col("kind") == "wgs")).alias("wgs"))
    return s.groupBy(F.when(F.col("rad") & F.col("wgs"), "both").when(F.col("rad"), "rad").when(F.col("wgs"), "wgs").otherwise("none").alias("kind")).agg(F.count("*").alias("sites"))
